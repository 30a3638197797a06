"""Task logs as text, and DOT text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The form of a line that logs a task's state, with time, thread, label, address and state.
LINE = r"(?i)\[(\d+\.\d+)\]\s+\[TID=(\d+)\].*?task\s+`([^`]+)`\s+of addr\s+`(0x[0-9a-f]+)`\s+is now in state\s+`(\w+)`"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(tid, label, addr, time, state in lower case) of the lines that are of this form.

    Others are dropped, and so are those whose thread number is no int.
    """
    part = lambda k: F.regexp_extract(column, LINE, k)
    hit = lines.where(F.regexp_like(F.col(column), F.lit(LINE)))
    rows = hit.select(part(2).try_cast("int").alias("tid"), part(3).alias("label"), part(4).alias("addr"), part(1).try_cast("double").alias("time"), F.lower(part(5)).alias("state"))
    return rows.where("tid is not null and time is not null")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def write_csv(trace: DataFrame, path: str) -> None:
    """Rows separated by colons, with a header."""
    trace.select("tid", "label", "addr", "time", "state").write.option("sep", ":").option("header", True).csv(path)


def write_dot(lines: DataFrame, path: str, name: str = "G") -> None:
    """The lines of a graph (ord, line) between its braces, in one file in order: for graphs that a person looks at."""
    spark = lines.sparkSession
    frame = spark.createDataFrame([(-1, f"digraph {name} {{"), (2, "}")], "ord int, line string")
    lines.unionByName(frame).orderBy("ord", "line").coalesce(1).select("line").write.text(path)
