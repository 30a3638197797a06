"""Element-wise and stencil kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def axpy_bytes(x: Column, y: Column) -> Column:
    """x + y of unsigned bytes."""
    return F.pmod(x + y, F.lit(256))


def axpy_arrays(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def stencil(grid: DataFrame, key: list[str], alpha: float, dt: float, dx: float, dy: float) -> DataFrame:
    """(key, i, j, v) after one step of 5-point heat diffusion; cells without four neighbours stay.

    Each cell sends its value to itself and its four neighbours, and a sum by cell collects them: one shuffle with
    partial sums, however the grid is partitioned.
    """
    send = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)))))
    sent = grid.select(*key, "i", "j", "v", send.alias("d")).select(*key, (F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j"), "v", (F.col("d.di") != 0).alias("h"), ((F.col("d.di") == 0) & (F.col("d.dj") == 0)).alias("own"))
    got = sent.groupBy(*key, "i", "j").agg(F.max(F.when(F.col("own"), F.col("v"))).alias("v"), F.count(F.when(~F.col("own"), 1)).alias("n"), F.sum(F.when(~F.col("own") & F.col("h"), F.col("v"))).alias("sx"), F.sum(F.when(~F.col("own") & ~F.col("h"), F.col("v"))).alias("sy"))
    c = alpha * dt / (dx * dy)
    new = F.col("v") + F.lit(c) * ((F.col("sx") - 2 * F.col("v")) / (dx * dx) + (F.col("sy") - 2 * F.col("v")) / (dy * dy))
    return got.where("v is not null").select(*key, "i", "j", F.when(F.col("n") == 4, new).otherwise(F.col("v")).alias("v"))


def fib(spark: SparkSession, n: int) -> DataFrame:
    """(n, fib): 1, 2, 3, 5, ... for n from 1, by a recursive query."""
    return spark.sql(f"WITH RECURSIVE f(n, a, b) AS (SELECT 1L, 1L, 2L UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < {int(n)}) SELECT n, a AS fib FROM f")


def running_sum(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """What a reader sees after concurrent writers have added their values."""
    return df.groupBy(*key).agg(F.count("*").alias("writers"), F.sum(value).alias("total"))
