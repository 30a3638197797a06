"""Statistics of runs and of task logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_format(tasks: DataFrame) -> DataFrame:
    """(fmt, committed, completed) of task formats with any task."""
    return tasks.groupBy("fmt").agg(F.count("*").alias("committed"), F.count_if(F.col("state") == "completed").alias("completed"))


def by_state(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("tasks"))


def by_device(events: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Sums for each device and, with device null, for all: name -> column."""
    return events.rollup("device").agg(*(F.sum(c).alias(n) for n, c in sums.items()))


def run_stats(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(n, mean, stdev of the population, exact median)."""
    return df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), F.median(value).alias("median"))


def gantt(log: DataFrame) -> DataFrame:
    """(tid, label, addr, start, end) from log rows (tid, label, addr, time, state), ``seq`` breaking ties of time.

    For each address a completed row takes the earliest executing row that waits; a completed row with none waiting
    and executing rows left over are dropped, and so are negative spans. With S the running number of executing less
    completed rows, a completed row has none waiting when S is a new low below 0.
    """
    rows = log.where(F.col("state").isin("executing", "completed"))
    order = Window.partitionBy("addr").orderBy("time", "seq")
    step = F.when(F.col("state") == "executing", 1).otherwise(-1)
    rows = rows.withColumn("_s", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.coalesce(F.min("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    rows = rows.withColumn("_low", low).where((F.col("state") == "executing") | (F.col("_s") >= F.col("_low")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("addr", "state").orderBy("time", "seq")))
    begin = rows.where("state = 'executing'").select("tid", "label", "addr", F.col("time").alias("start"), "_n")
    end = rows.where("state = 'completed'").select("addr", F.col("time").alias("end"), "_n")
    return begin.join(end, ["addr", "_n"]).where("end >= start").select("tid", "label", "addr", "start", "end")
