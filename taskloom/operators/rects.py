"""Rectangles [x0, x1) x [y0, y1), x in bytes along a column, y in columns; and tiles of column-major matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.operators.deps import cells_1d

def area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def is_empty(p: str = "") -> Column:
    return (F.col(f"{p}x0") >= F.col(f"{p}x1")) | (F.col(f"{p}y0") >= F.col(f"{p}y1"))


def intersects(p: str, q: str) -> Column:
    return (F.col(f"{p}x0") < F.col(f"{q}x1")) & (F.col(f"{q}x0") < F.col(f"{p}x1")) & (F.col(f"{p}y0") < F.col(f"{q}y1")) & (F.col(f"{q}y0") < F.col(f"{p}y1"))


def equals(p: str, q: str) -> Column:
    out = F.lit(True)
    for c in ("x0", "x1", "y0", "y1"):
        out = out & (F.col(p + c) == F.col(q + c))
    return out


def includes(p: str, q: str) -> Column:
    return (F.col(f"{p}x0") <= F.col(f"{q}x0")) & (F.col(f"{q}x1") <= F.col(f"{p}x1")) & (F.col(f"{p}y0") <= F.col(f"{q}y0")) & (F.col(f"{q}y1") <= F.col(f"{p}y1"))


def intersection(p: str, q: str) -> list[Column]:
    """x0, x1, y0, y1 of the common part, which may be empty."""
    return [F.greatest(p + c, q + c).alias(c) if c[1] == "0" else F.least(p + c, q + c).alias(c) for c in ("x0", "x1", "y0", "y1")]


def distance(p: str, q: str) -> list[Column]:
    """Signed way from the corner of p to that of q."""
    return [(F.col(f"{q}x0") - F.col(f"{p}x0")).alias("dx"), (F.col(f"{q}y0") - F.col(f"{p}y0")).alias("dy")]


def overlap(left: DataFrame, right: DataFrame, key: list[str], wx: int, wy: int, most: int = 1000) -> DataFrame:
    """(key, l_id, r_id and both rectangles) of intersecting rectangles, by grid cells of wx x wy and the key.

    A pair is reported in the cell of the lower corner of its common part only. Equal rectangles are compared once, in
    lists of up to ``most`` ids; the pairs of ids are made after the comparison, by whom it met.
    """

    def spread(df: DataFrame, p: str) -> DataFrame:
        named = df.where(~is_empty()).select(*key, *(F.col(c).alias(p + c) for c in ("id", "x0", "x1", "y0", "y1")))
        shape = [*key, *(p + c for c in ("x0", "x1", "y0", "y1"))]
        named = named.groupBy(*shape).agg(F.collect_list(p + "id").alias("_ids"))
        lists = F.transform(F.sequence(F.lit(0), F.floor((F.size("_ids") - 1) / most).cast("int")), lambda i: F.slice("_ids", i * most + 1, most))
        named = named.select(*shape, F.explode(lists).alias(p + "ids"))
        cells = named.withColumn("_cx", F.explode(F.sequence(F.floor(F.col(f"{p}x0") / wx), F.floor((F.col(f"{p}x1") - 1) / wx))))
        cells = cells.withColumn("_cy", F.explode(F.sequence(F.floor(F.col(f"{p}y0") / wy), F.floor((F.col(f"{p}y1") - 1) / wy))))
        # a number of partitions of its own: few bytes become many pairs, so they must not be merged by size
        return cells.repartition(parts, *key, "_cx", "_cy")

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = spread(left, "l_").join(spread(right, "r_"), [*key, "_cx", "_cy"])
    own = (F.floor(F.greatest("l_x0", "r_x0") / wx) == F.col("_cx")) & (F.floor(F.greatest("l_y0", "r_y0") / wy) == F.col("_cy"))
    sides = [f"{p}{c}" for p in ("l_", "r_") for c in ("x0", "x1", "y0", "y1")]
    met = both.where(intersects("l_", "r_") & own).select(*key, "l_ids", "r_ids", *sides)
    return met.withColumn("l_id", F.explode("l_ids")).drop("l_ids").withColumn("r_id", F.explode("r_ids")).drop("r_ids")


def partite(rows: DataFrame, key: list[str]) -> DataFrame:
    """Cells of the grid of all cuts of a key that some rectangle covers: disjoint, and together their union."""
    cuts = []
    for lo, hi, cell in (("x0", "x1", "cx"), ("y0", "y1", "cy")):
        points = rows.select(*key, F.col(lo).alias("p")).union(rows.select(*key, F.col(hi).alias("p"))).distinct()
        cuts.append((points, cell))
    grid = cells_1d(cells_1d(rows.where(~is_empty()), key, "x0", "x1", "cx"), key, "y0", "y1", "cy").select(*key, "cx", "cy").distinct()

    for points, cell in cuts:
        order = Window.partitionBy(*key).orderBy("p")
        low = points.select(*key, F.row_number().over(order).alias(cell), F.col("p").alias(cell[1] + "0"), F.lead("p").over(order).alias(cell[1] + "1"))
        grid = grid.join(low, [*key, cell])
    return grid.select(*key, "x0", "x1", "y0", "y1")


def segment_rects(rows: DataFrame, ld: int, sizeof: int) -> DataFrame:
    """Up to three rectangles of an interval [a, b): head column, whole columns, tail column; ``part`` 0, 1, 2."""
    col = ld * sizeof
    a, size = F.col("a"), F.col("b") - F.col("a")
    x0 = F.pmod(a, F.lit(col))
    head = F.least(x0 + size, F.lit(col)) - x0
    tail = F.pmod(size - head, F.lit(col))
    y0 = F.floor(a / col)
    last = y0 + 1 + F.floor((size - head - tail) / col)

    def rect(k: int, *c: Column) -> Column:
        return F.struct(F.lit(k).alias("part"), *(v.cast("long").alias(n) for v, n in zip(c, ("x0", "x1", "y0", "y1"), strict=True)))

    three = F.array(rect(0, x0, x0 + head, y0, y0 + 1), rect(1, F.lit(0), F.lit(col), y0 + 1, last), rect(2, F.lit(0), tail, last, last + 1))
    rest = [c for c in rows.columns if c not in ("a", "b")]
    return rows.where("a < b").select(*rest, F.explode(three).alias("_r")).select(*rest, "_r.*").where(~is_empty())


def tile_rects(rows: DataFrame) -> DataFrame:
    """One rectangle of a tile (addr, ld, m, n, sizeof), or two where its rows wrap to the next column."""
    col, high = F.col("ld") * F.col("sizeof"), F.col("m") * F.col("sizeof")
    x0 = F.pmod(F.col("addr"), col)
    y0 = F.floor(F.col("addr") / col)
    fits = x0 + high <= col

    def rect(k: int, *c: Column) -> Column:
        return F.struct(F.lit(k).alias("part"), *(v.cast("long").alias(n) for v, n in zip(c, ("x0", "x1", "y0", "y1"), strict=True)))

    one = F.array(rect(0, x0, x0 + high, y0, y0 + F.col("n")))
    two = F.array(rect(0, x0, col, y0, y0 + F.col("n")), rect(1, F.lit(0), high - (col - x0), y0 + 1, y0 + F.col("n") + 1))
    rest = [c for c in rows.columns if c not in ("addr", "ld", "m", "n", "sizeof")]
    return rows.select(*rest, F.explode(F.when(fits, one).otherwise(two)).alias("_r")).select(*rest, "_r.*").where(~is_empty())


def rects_tile(rows: DataFrame, key: list[str], ld: int, sizeof: int) -> DataFrame:
    """The tile of one rectangle or of the two of a wrapped tile (``part`` 0 and 1)."""
    col = ld * sizeof
    both = rows.groupBy(*key).agg(F.min_by("x0", "part").alias("x"), F.max_by("x1", "part").alias("xf"), F.min_by("y0", "part").alias("y"), F.max_by("y1", "part").alias("yf"))
    wraps = F.col("xf") < F.col("x")
    return both.select(*key, (F.col("x") + F.col("y") * col).alias("addr"), F.lit(ld).cast("long").alias("ld"), F.floor((F.col("xf") - F.col("x") + F.when(wraps, F.lit(col)).otherwise(0)) / sizeof).alias("m"), (F.col("yf") - F.col("y") - F.when(wraps, F.lit(1)).otherwise(0)).alias("n"))


def address(row_major: bool, offset_m: Column, offset_n: Column) -> Column:
    """Address of the element (offset_m, offset_n) of a tile (addr, ld, sizeof)."""
    down, across = (F.col("ld"), F.lit(1)) if row_major else (F.lit(1), F.col("ld"))
    return F.col("addr") + offset_m * F.col("sizeof") * down + offset_n * F.col("sizeof") * across
