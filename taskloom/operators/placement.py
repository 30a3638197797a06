"""Chunks, ranges, tiles and their places on devices 1 to n; device 0 is the host."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chunk_of(index: Column, size: int, n: int) -> Column:
    """The chunk of an index if ``size`` indices are cut in n chunks, the last with the remainder."""
    n = max(1, min(n, size))
    return F.least(F.floor(index / (size // n)), F.lit(n - 1))


def chunks(spark: SparkSession, p: int, size: int, n: int) -> DataFrame:
    """(i, a, b) of the chunks of [p, p + size). None for size 0."""
    n = min(n, size)
    if n <= 0:
        return spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("a"), F.col("id").alias("b"))
    step = size // n
    i = F.col("id")
    return spark.range(n).select(i.alias("i"), (F.lit(p) + i * step).alias("a"), F.when(i == n - 1, F.lit(p + size)).otherwise(F.lit(p) + (i + 1) * step).cast("long").alias("b"))


def parallel_for(spark: SparkSession, low: int, up: int, incr: int, threads: int) -> DataFrame:
    """(tid, a, b): iterations [a, b) of low, low + incr, ... up (included) for each thread; the first get one more."""
    if incr <= 0:
        raise ValueError("the increment must be positive")
    trip = max(0, (up - low) // incr + 1)
    each, extra = divmod(trip, threads)
    t = F.col("id")
    a = t * each + F.least(t, F.lit(extra))
    return spark.range(threads).select(t.alias("tid"), a.alias("a"), (a + each + (t < extra).cast("long")).alias("b"))


def pages(spark: SparkSession, p: int, size: int, n: int, page: int = 4096) -> DataFrame:
    """(i, a, b, covered): page ranges of n tasks at most. Pages that don't divide evenly are left at the end.

    ``covered`` tells whether the tasks together reach the end of the memory.
    """
    npages = max(1, size // page)
    tasks = min(npages, n)
    per = npages // tasks
    start = p - p % page
    i = F.col("id")
    end = F.least(F.lit(start) + (i + 1) * per * page, F.lit(p + size))
    return spark.range(tasks).select(i.alias("i"), (F.lit(start) + i * per * page).alias("a"), end.alias("b"), F.lit(min(start + tasks * per * page, p + size) >= p + size).alias("covered"))


def halves(df: DataFrame, stop: int) -> DataFrame:
    """Leaves of the recursive halving of each [a, b): pieces longer than ``stop`` are cut at a + (b - a) div 2.

    The rows of a generation come from the one before; there are log2 of the greatest length of them, whatever the
    number of rows.
    """
    longest = df.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 0
    rounds = max(0, math.ceil(math.log2(longest / stop))) + 1 if longest > stop else 0
    for _ in range(rounds):
        mid = F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)
        both = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))
        one = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")))
        rest = [c for c in df.columns if c not in ("a", "b")]
        df = df.select(*rest, F.explode(F.when(F.col("b") - F.col("a") > stop, both).otherwise(one)).alias("_h")).select(*rest, "_h.a", "_h.b")
    return df


def cyclic_1d(t: Column, count: int) -> Column:
    return 1 + F.pmod(t, F.lit(count))


def cyclic_2d(tm: Column, tn: Column, nt: int, count: int) -> Column:
    return 1 + F.pmod(tm * nt + tn, F.lit(count))


def grid(count: int) -> tuple[int, int]:
    """Rows and columns of the device grid: the first divisor at or below floor(sqrt(count)) + 1."""
    g = math.isqrt(count) + 1
    while count % g:
        g -= 1
    return g, count // g


def block_cyclic(tm: Column, tn: Column, count: int, blkm: int = 1, blkn: int = 1) -> Column:
    gm, gn = grid(count)
    return 1 + F.pmod(F.pmod(F.floor(tm / blkm), F.lit(gm)) * gn + F.pmod(F.floor(tn / blkn), F.lit(gn)), F.lit(count))


def halo_1d(spark: SparkSession, size: int, chunk: int, h: int, count: int) -> DataFrame:
    """(t, a, b, device) of chunks with h more at both sides, within [0, size)."""
    if not 0 <= h < chunk:
        raise ValueError("the halo must be below the chunk")
    t = F.col("id")
    return spark.range(-(-size // chunk)).select(t.alias("t"), F.greatest(t * chunk - h, F.lit(0)).alias("a"), F.least((t + 1) * chunk + h, F.lit(size)).alias("b"), cyclic_1d(t, count).alias("device"))


def halo_2d(spark: SparkSession, m: int, n: int, mb: int, nb: int, hx: int, hy: int, count: int) -> DataFrame:
    """(tm, tn, x0, x1, y0, y1, device) of the tiles of an m x n matrix with halos, cyclic over the devices."""
    mt, nt = -(-m // mb), -(-n // nb)
    tiles = spark.range(mt * nt).select(F.floor(F.col("id") / nt).alias("tm"), F.pmod("id", F.lit(nt)).alias("tn"))
    x, y = F.col("tm") * mb, F.col("tn") * nb
    return tiles.select("tm", "tn", F.greatest(x - hx, F.lit(0)).alias("x0"), F.least(x + mb + hx, F.lit(m)).alias("x1"), F.greatest(y - hy, F.lit(0)).alias("y0"), F.least(y + nb + hy, F.lit(n)).alias("y1"), cyclic_2d(F.col("tm"), F.col("tn"), nt, count).alias("device"))


def owners(parts: DataFrame, access: list[str]) -> DataFrame:
    """(access, device, bytes): the devices with the most coherent bytes of an access, all of them if tied."""
    sums = parts.groupBy(*access, "device").agg(F.sum("bytes").alias("bytes"))
    best = sums.groupBy(*access).agg(F.max("bytes").alias("_m")).where("_m > 0")
    return sums.join(best, access).where("bytes = _m").drop("_m")


def owner_mask(found: DataFrame, access: list[str]) -> DataFrame:
    return found.groupBy(*access).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("device").cast("int"))).alias("owners"))


def route(valid: DataFrame, ranks: DataFrame) -> DataFrame:
    """(block, dst, src): where a block comes from: dst itself if valid there, else the valid device of the best
    rank 0 to 2 of (dst, src, rank), else any; ties go to the lowest device.

    ``valid``: (block, dst, device) rows of the devices with a valid replica.
    """
    known = valid.join(ranks.select("dst", F.col("src").alias("device"), "rank"), ["dst", "device"], "left")  # the optimizer broadcasts ranks if they are few
    score = F.when(F.col("device") == F.col("dst"), -1).when(F.col("rank").between(0, 2), F.col("rank")).otherwise(3)
    return known.groupBy("block", "dst").agg(F.min(F.struct(score.alias("s"), F.col("device").alias("d"))).alias("m")).select("block", "dst", F.col("m.d").alias("src"))


def elect(devices: int, suggested: Column, owned: Column, target: Column) -> Column:
    """The device of a task: all devices, cut to the suggested if any is left, to the owners but the host if any is
    left, and to the target if it is left; the host only if it alone is left, else the lowest device.
    """
    every = F.lit((1 << devices) - 1)
    host = F.lit(1)
    no = F.lit(0)
    s = F.when(every.bitwiseAND(F.coalesce(suggested, no)) != 0, every.bitwiseAND(suggested)).otherwise(every)
    own = F.coalesce(owned, no).bitwiseAND(F.lit(~1))
    o = F.when(s.bitwiseAND(own) != 0, s.bitwiseAND(own)).otherwise(s)
    bit = F.when(target.isNull(), no).otherwise(F.call_function("shiftleft", F.lit(1), target.cast("int")))
    t = F.when(o.bitwiseAND(bit) != 0, bit).otherwise(o)
    rest = t.bitwiseAND(F.lit(~1))
    lowest = rest.bitwiseAND(-rest)
    return F.when(t == host, F.lit(0)).otherwise(F.bit_count(lowest - 1).cast("int"))
