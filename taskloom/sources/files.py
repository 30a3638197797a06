"""Parallel reads and writes of a file's bytes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators.placement import chunks


def _ranges() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function of (path, i, a, b) to the same and the bytes [a, b) of the file, a chunk a batch.

    It goes to the workers by value, so they need no package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(re.sub("^file:(//)?(?=/)", "", r["path"]), "rb") as f:
                    f.seek(r["a"])
                    data = f.read(r["b"] - r["a"])
                if len(data) != r["b"] - r["a"]:
                    raise OSError(f"{r['path']}: {len(data)} bytes at {r['a']}, not {r['b'] - r['a']}")
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]], pa.string()), *(pa.array([r[c]], pa.int64()) for c in "iab"), pa.array([data], pa.binary())], ["path", "i", "a", "b", "bytes"])

    return run


def read_chunks(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(path, i, a, b, bytes): each file's bytes in n chunks at most, the last with the remainder.

    Each chunk of a file: path is read by itself at its offset, by tasks that share the chunks; a chunk must fit a
    row (2 GB), a file may be of any size. Python can't open other stores: there a file is read as a row, and must
    fit it.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    count = F.least(F.lit(n).cast("long"), F.col("size"))
    step = F.floor(F.col("size") / count)
    rows = files.where("size > 0").select("path", "size", step.alias("step"), count.alias("count"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i"))
    a = F.col("i") * F.col("step")
    b = F.when(F.col("i") == F.col("count") - 1, F.col("size")).otherwise(a + F.col("step"))
    rows = rows.select("path", "i", a.alias("a"), b.alias("b"))
    if files.where("path not like 'file:/%'").isEmpty():
        tasks = max(n, spark.sparkContext.defaultParallelism)
        return rows.repartition(tasks, "path", "i").mapInArrow(_ranges(), "path string, i long, a long, b long, bytes binary")
    whole = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.join(whole, "path").select("path", "i", "a", "b", F.substring("content", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("bytes"))


def plan(spark: SparkSession, size: int, n: int) -> DataFrame:
    return chunks(spark, 0, size, n)


def write(df: DataFrame, path: str, n: int) -> None:
    """Write rows as n Parquet files by n tasks."""
    df.repartition(n).write.parquet(path)


def write_grid(grid: DataFrame, path: str) -> None:
    """Rows (i, j, v) of a grid as text, a line for each row i."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"].cast("string")), " ")
    grid.groupBy("i").agg(line.alias("line")).repartitionByRange("i").sortWithinPartitions("i").select("line").write.text(path)
