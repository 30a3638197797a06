"""Sharding by extendible hashing, in DataFrame functions only.

Each row has a hash of 60 bits. The directory starts as one bucket; a bucket over the byte limit is split on
the next bit of the hash, others stay. A shard is a bucket that fits, named by its bits. Sizes by hash prefix
come from one histogram with partial aggregation; only oversized buckets are looked at more deeply, STEP bits
at a time.

The hash is of the id, the text and, of rows that are equal in both, the number of the copy. So a hot id or a
hot text is split as other rows are. A bucket of one row isn't split: a row over the limit has a shard of its
own, and is the only kind of shard that is over it.

Null texts have no bytes, null ids are ids like any other, and rows that are equal in id and text are told apart by
the number of the copy. A very long text is one row of the histogram like any other. Rows of one hash, of which there
are none for copies, would stay together. Extra columns are ignored by :func:`assign` and kept by :func:`write`. An
empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.llm.common import cut, prepare

BITS = 60
STEP = 10
#: Cells of the directory that are broadcast at most (24 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 500_000
#: Blocks in which equal rows are numbered.
COPY_BLOCKS = 1024


def _prefix(bits: int):
    return F.shiftrightunsigned(F.col("h"), BITS - bits)


def _hash() -> Column:
    """The hash of a row (id, m, copy)."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "m", F.col("copy").cast("string")))
    return F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long")


def _directory(rows: DataFrame, limit_bytes: int) -> tuple[dict[int, DataFrame], Column]:
    """By number of bits, the cells whose buckets fit and their depths, of rows (h, b); and the bits of h as a string."""
    todo, depth, leaves = rows, 0, None
    while depth < BITS:
        deeper = min(BITS, depth + STEP)
        cells = cut(todo.groupBy(_prefix(deeper).alias("cell")).agg(F.sum("b").alias("b"), F.count("*").alias("n")))
        levels = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("d")).withColumn("p", F.expr(f"shiftrightunsigned(cell, {deeper} - d)"))
        sums = levels.groupBy("d", "p").agg(F.sum("b").alias("sb"), F.sum("n").alias("sn"))
        fits = levels.select("cell", "d", "p").join(sums, ["d", "p"]).where((F.col("sb") <= limit_bytes) | (F.col("sn") == 1))
        done = cells.select("cell").join(fits.groupBy("cell").agg(F.min("d").alias("depth")), "cell", "left")
        done = cut(done.select(F.lit(deeper).alias("bits"), "cell", F.col("depth")))
        leaves = done.where("depth is not null") if leaves is None else leaves.unionByName(done.where("depth is not null"))
        over = done.where("depth is null").select("cell")
        if over.isEmpty():
            break
        todo = todo.withColumn("cell", _prefix(deeper)).join(over, "cell", "left_semi").select("h", "b")
        depth = deeper
    leaves = cut(leaves)
    steps = [r.bits for r in leaves.select("bits").distinct().collect()]  # at most BITS / STEP
    small = leaves.count() <= BROADCAST_CELLS
    own = lambda bits: leaves.where(F.col("bits") == bits).select(F.col("cell").alias(f"cell{bits}"), F.col("depth").alias(f"depth{bits}"))
    return {bits: F.broadcast(own(bits)) if small else own(bits) for bits in sorted(steps)}, F.lpad(F.bin(F.col("h")), BITS, "0")


def _placed(rows: DataFrame, found: dict[int, DataFrame]) -> DataFrame:
    """Rows with an h, and the depth of their shards. Bits run out only for more rows of one hash than fit."""
    for bits, cells in found.items():
        rows = rows.join(cells, _prefix(bits) == F.col(f"cell{bits}"), "left")
    depth = F.coalesce(*[F.col(f"depth{bits}") for bits in found], F.lit(BITS)) if found else F.lit(0)
    return rows.withColumn("depth", depth).drop(*(f"{n}{bits}" for bits in found for n in ("cell", "depth")))


def assign(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: the id, copy (0 for the first of equal rows), n_bytes, depth and shard (its bits)."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("m"), F.octet_length(text).cast("long").alias("b"))
    rows = rows.groupBy("id", "m", "b").agg(F.count("*").alias("c")).select("id", "m", "b", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("copy"))
    rows = cut(rows.select("id", "copy", "b", _hash().alias("h")))
    found, bits = _directory(rows.select("h", "b"), limit_bytes)
    return _placed(rows, found).select(F.col("id").alias(id_col), F.col("copy").cast("long").alias("copy"), F.col("b").alias("n_bytes"), "depth", F.substring(bits, F.lit(1), F.col("depth")).alias("shard"))


def write(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all rows with all columns as Parquet, a folder ``shard=b010`` for the shard of the bits 010.

    A row finds its shard by its hash, which is made of its id, its text and its number among equal rows, so rows
    without an id and repeated ones are written once each. Copies are numbered within blocks of a random split of the
    equal rows, so that one row's thousands of copies aren't numbered in one task.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("m"), F.octet_length(text).cast("long").alias("b"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    # (block, place in it) numbers a copy: blocks have the sizes that the hash of all columns gives them
    rows = cut(rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(COPY_BLOCKS))))
    sizes = rows.groupBy("id", "m", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("id", "m").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("id", "m", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("id", "m", "block").orderBy("b")
    numbered = rows.withColumn("k", F.row_number().over(inside) - 1).alias("r")
    on = F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.m") == F.col("s.m")) & (F.col("r.block") == F.col("s.block"))
    numbered = numbered.join(sizes.alias("s"), on).select("r.*", (F.col("k") + F.col("base")).alias("copy"))
    hashed = numbered.withColumn("h", _hash())
    found, bits = _directory(hashed.select("h", "b"), limit_bytes)
    out = _placed(hashed, found)
    shard = F.concat(F.lit("b"), F.substring(bits, F.lit(1), F.col("depth")))  # bits alone would be read back as a number
    out.withColumn("shard", shard).select(*(F.col(n).alias(c) for c, n in names.items()), "shard").repartition("shard").write.partitionBy("shard").parquet(path)
