"""Replicas of memory blocks on devices and how accesses move them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.operators.deps import epochs, writes


def validity(log: DataFrame) -> DataFrame:
    """(block, seq, device, mode, epoch, valid): the devices with a valid replica after each access, as a sorted list.

    A read makes its device valid; a write leaves its device only. Within an epoch (a write and the reads after it)
    the list grows to the number of devices at most.
    """
    e = epochs(log, ["block"]).withColumn("epoch", F.col("ep") + writes().cast("long"))
    order = Window.partitionBy("block", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("block", "seq", "device", "mode", "epoch", F.sort_array(F.collect_set("device").over(order)).alias("valid"))


def fetch_plan(log: DataFrame) -> DataFrame:
    """(block, seq, device, plan) of the accesses that read: HIT, D2D (from another device) or H2D (from the host).

    The epoch of a read is that of the writes before it; a read and write reads first.
    """
    e = epochs(log, ["block"])
    # who holds the block in an epoch: the write that began it, then the reads
    holds = e.select("block", "seq", "device", (F.col("ep") + writes().cast("long")).alias("epoch"))
    reads = e.where(F.col("mode").bitwiseAND(1) != 0).select("block", "seq", "device", F.col("ep").alias("epoch"))
    first = holds.groupBy("block", "epoch", "device").agg(F.min("seq").alias("own"))
    any_ = holds.groupBy("block", "epoch").agg(F.min("seq").alias("any"))
    both = reads.join(first, ["block", "epoch", "device"], "left").join(any_, ["block", "epoch"], "left")
    plan = F.when(F.col("own") < F.col("seq"), "HIT").when(F.col("any") < F.col("seq"), "D2D").otherwise("H2D")
    return both.select("block", "seq", "device", plan.alias("plan"))


def copy_dims(m: Column, n: Column, ld: Column) -> Column:
    """1 if a tile is contiguous and copied in one piece, else 2."""
    return F.when((n == 1) | (m == ld), F.lit(1)).otherwise(F.lit(2))


def transfer(src: Column, dst: Column) -> tuple[Column, Column]:
    """Command and queue type of a copy; the host is device 0."""
    s, d = src == 0, dst == 0
    command = F.when(s & d, "H2H").when(s, "H2D").when(d, "D2H").otherwise("D2D")
    queue = F.when(s, "H2D").when(d, "D2H").when(src == dst, "D2D").otherwise("P2P")
    return command, queue


def copy_bytes(dims: Column, size: Column, m: Column, n: Column, sizeof: Column) -> Column:
    return F.when(dims == 1, size).otherwise(m * n * sizeof)
