"""Half-open intervals [a, b) and sets of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Axis units of a block of begins that is sorted by one task.
BLOCK = 1 << 20


def length(a: Column, b: Column) -> Column:
    return b - a


def is_empty(a: Column, b: Column) -> Column:
    return a >= b


def includes(a: Column, b: Column, c: Column, d: Column) -> Column:
    """[a, b) has all of [c, d)."""
    return (a <= c) & (d <= b)


def intersects(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Touching intervals don't intersect."""
    return (a < d) & (c < b)


def before(a: Column, b: Column, c: Column, d: Column) -> Column:
    return b <= c


def _reach(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """Non-empty intervals with ``_r``, the furthest end of those of the key that come before in order of (a, b).

    Counted in two levels, within blocks of ``width`` of begins and over the blocks' ends, so that the intervals of
    one key are sorted by many tasks.
    """
    rows = rows.select(*key, "a", "b").where("a < b").withColumn("_k", F.floor(F.col("a") / width).cast("long"))
    ends = rows.groupBy(*key, "_k").agg(F.max("b").alias("_e"))
    earlier = Window.partitionBy(*key).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, "_k", F.max("_e").over(earlier).alias("_e"))
    inside = Window.partitionBy(*key, "_k").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(ends, [*key, "_k"]).withColumn("_r", F.greatest(F.max("b").over(inside), F.col("_e"))).drop("_k", "_e")


def fill(rows: DataFrame, key: list[str], width: int = BLOCK) -> DataFrame:
    """Union of each key's intervals. Overlapping ones become one; touching ones stay apart."""
    marked = _reach(rows, key, width)
    # an island begins where nothing before reaches; it ends with the furthest end before the next begin
    heads = marked.where((F.col("a") >= F.col("_r")) | F.col("_r").isNull()).select(*key, "a", "_r")
    last = rows.where("a < b").groupBy(*key).agg(F.max("b").alias("_z"))
    order = Window.partitionBy(*key).orderBy("a")
    return heads.join(last, key).select(*key, "a", F.coalesce(F.lead("_r").over(order), F.col("_z")).alias("b"))


def unfill(rows: DataFrame, holes: DataFrame, key: list[str]) -> DataFrame:
    """What the intervals of ``holes`` leave of the intervals of ``rows``, in maximal pieces."""

    def steps(df: DataFrame, name: str, other: str) -> DataFrame:
        e = F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("d")), F.struct(F.col("b").alias("x"), F.lit(-1).alias("d"))))
        return df.where("a < b").select(*key, e.alias("e")).select(*key, "e.x", F.col("e.d").alias(name), F.lit(0).alias(other))

    delta = steps(rows, "s", "h").unionByName(steps(holes, "h", "s")).groupBy(*key, "x").agg(F.sum("s").alias("s"), F.sum("h").alias("h"))
    order = Window.partitionBy(*key).orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    part = delta.select(*key, F.col("x").alias("a"), F.lead("x").over(order).alias("b"), F.sum("s").over(upto).alias("s"), F.sum("h").over(upto).alias("h")).where("s > 0 and h = 0 and b is not null")
    order = Window.partitionBy(*key).orderBy("a")
    new = F.coalesce((F.lag("b").over(order) != F.col("a")).cast("long"), F.lit(1))
    part = part.withColumn("_new", new).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*key, "_i").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_i")


def gaps(rows: DataFrame, key: list[str], lo: int, hi: int) -> DataFrame:
    """The holes between each key's intervals within [lo, hi)."""
    merged = fill(rows, key).where((F.col("b") > lo) & (F.col("a") < hi)).select(*key, "a", "b")
    ends = rows.select(*key).distinct().select(*key, F.explode(F.array(F.struct(F.lit(lo).cast("long").alias("a"), F.lit(lo).cast("long").alias("b")), F.struct(F.lit(hi).cast("long").alias("a"), F.lit(hi).cast("long").alias("b")))).alias("e")).select(*key, "e.a", "e.b")
    order = Window.partitionBy(*key).orderBy("a", "b")
    every = merged.unionByName(ends).select(*key, F.greatest(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(lo)).alias("x"), F.least(F.lead("a").over(order), F.lit(hi)).alias("y"))
    return every.where("x < y").select(*key, F.col("x").alias("a"), F.col("y").alias("b"))


def find(stored: DataFrame, queries: DataFrame, key: list[str], width: int = 64) -> DataFrame:
    """Stored intervals that intersect a query [qa, qb) of their key, whole; by buckets of ``width`` as in :func:`overlap`."""

    def spread(df: DataFrame, a: str, b: str) -> DataFrame:
        first, last = F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)
        return df.where(F.col(a) < F.col(b)).withColumn("_w", F.explode(F.sequence(first, last)))

    both = spread(queries, "qa", "qb").join(spread(stored, "a", "b"), [*key, "_w"])
    own = F.floor(F.greatest("a", "qa") / width) == F.col("_w")
    return both.where(intersects(F.col("a"), F.col("b"), F.col("qa"), F.col("qb")) & own).drop("_w")


def overlap(left: DataFrame, right: DataFrame, key: list[str], width: int, on_left: str = "id", on_right: str = "id") -> DataFrame:
    """(key, left_id, right_id) of intersecting intervals, by buckets of ``width`` and the key.

    Each interval is in every bucket that it meets; a pair is reported in the bucket of its later begin only.
    """

    def spread(df: DataFrame, i: str, p: str) -> DataFrame:
        first, last = F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width)
        return df.where("a < b").select(*key, F.col(i).alias(f"{p}_id"), F.col("a").alias(f"{p}_a"), F.col("b").alias(f"{p}_b"), F.explode(F.sequence(first, last)).alias("_w"))

    both = spread(left, on_left, "left").join(spread(right, on_right, "right"), [*key, "_w"])
    meet = intersects(F.col("left_a"), F.col("left_b"), F.col("right_a"), F.col("right_b"))
    return both.where(meet & (F.floor(F.greatest("left_a", "right_a") / width) == F.col("_w"))).select(*key, "left_id", "right_id")
