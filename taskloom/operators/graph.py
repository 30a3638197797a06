"""Task graphs (tables of tasks and of edges pred -> succ) and command graphs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's checkpoint folder. Only in local mode one is made where there is none."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or f"/tmp/taskloom-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def roots(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks without predecessors."""
    return tasks.select("task").join(edges.select(F.col("succ").alias("task")), "task", "left_anti")


def leaves(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks without successors."""
    return tasks.select("task").join(edges.select(F.col("pred").alias("task")), "task", "left_anti")


def wait_counts(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, wc, ready): how many predecessors a task waits for, and whether it is ready."""
    n = edges.select("pred", "succ").distinct().groupBy(F.col("succ").alias("task")).agg(F.count("*").alias("wc"))
    return tasks.select("task").join(n, "task", "left").select("task", F.coalesce("wc", F.lit(0)).cast("long").alias("wc"), F.col("wc").isNull().alias("ready"))


def levels(tasks: DataFrame, edges: DataFrame, every: int = 8) -> DataFrame:
    """(task, level): the longest way from a root, by frontiers.

    A frontier holds the tasks that a level reaches; the last level at which a task is reached is its own. As many
    rounds as the graph is deep; results are cut from their lineage every ``every`` rounds. The graph has no cycle.
    """
    edges = _checkpoint(edges.select("pred", "succ").distinct())
    frontier = roots(tasks, edges).select("task", F.lit(0).cast("long").alias("level"))
    done = frontier
    level = 0
    while True:
        level += 1
        frontier = edges.join(frontier.select(F.col("task").alias("pred")), "pred").select(F.col("succ").alias("task")).distinct().withColumn("level", F.lit(level).cast("long"))
        frontier = _checkpoint(frontier)
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier)
        if level % every == 0:
            done = _checkpoint(done.groupBy("task").agg(F.max("level").alias("level")))
    return done.groupBy("task").agg(F.max("level").alias("level"))


def levels_within(tasks: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, task, level) as of :func:`levels`, of a graph whose edges stay within groups of tasks.

    Both tables have the group's columns ``key``. Rows are shuffled by group once and each group is walked where it
    is, so there are no rounds over the whole graph; a group has to fit into a task's memory. Tasks that only edges
    name have a level too. The graph has no cycle.
    """
    name = tasks.schema["task"].dataType
    rows = tasks.select(*key, "task", F.lit(None).cast(name).alias("pred")).unionByName(edges.select(*key, F.col("succ").alias("task"), "pred"))
    spark = tasks.sparkSession
    # a number of its own, so that small rows are not merged into few tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = StructType([tasks.schema[k] for k in key] + [StructField("task", name), StructField("level", LongType())])
    return rows.repartition(parts, *key).mapInArrow(_walk, columns)


def _walk(batches):
    """Levels of all groups of a partition at once: round by round, those whose predecessors are all done."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    del batches
    keys = rows.column_names[:-2]
    n_rows = rows.num_rows
    wide = [pa.large_string() if pa.types.is_string(c.type) else c.type for c in (rows["task"], rows["pred"])]
    both = pa.chunked_array(rows["task"].cast(wide[0]).chunks + rows["pred"].cast(wide[1]).chunks).combine_chunks().dictionary_encode()
    code = pc.fill_null(both.indices, -1).to_numpy()
    succ, pred = code[:n_rows], code[n_rows:]
    n = len(both.dictionary)
    first = np.full(n, -1, np.int64)
    # the row that lends a task its group: any of its own, or of an edge out of it
    out_of = np.flatnonzero(pred >= 0)
    first[pred[out_of]] = out_of
    first[succ] = np.arange(n_rows)
    order = out_of[np.argsort(pred[out_of], kind="stable")]
    target = succ[order]
    start = np.searchsorted(pred[order], np.arange(n + 1))
    waits = np.bincount(target, minlength=n)
    level = np.full(n, -1, np.int64)
    front, depth = np.flatnonzero(waits == 0), 0
    while len(front):
        level[front] = depth
        size = start[front + 1] - start[front]
        at = np.repeat(start[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
        reached, times = np.unique(target[at], return_counts=True)
        waits[reached] -= times
        front, depth = reached[waits[reached] == 0], depth + 1
    if (level < 0).any():
        raise ValueError("the graph has a cycle")
    step = 1 << 16
    for i in range(0, n, step):
        own = pa.array(first[i : i + step])
        columns = [rows[k].take(own).combine_chunks() for k in keys] + [both.dictionary[i : i + step].cast(rows["task"].type), pa.array(level[i : i + step])]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[*keys, "task", "level"])


def descendants(tasks: DataFrame, parent: str = "parent") -> DataFrame:
    """(task, children, descendants) of a forest of (task, parent): whom a wait and a task group wait for.

    Down the forest one round for each level puts the tasks in levels, each task once; up again each level adds what
    its children have counted. No pair of a task and a task far below is made.
    """
    up = _checkpoint(tasks.select("task", F.col(parent).alias("p")))
    level = _checkpoint(up.where("p is null").select("task", "p").unionByName(up.where("p is not null").join(up.select(F.col("task").alias("p")), "p", "left_anti").select("task", "p")))
    below = up.where("p is not null")
    found = []
    while not level.isEmpty():
        found.append(level)
        level = _checkpoint(below.join(level.select(F.col("task").alias("p")), "p").select("task", "p"))
    counted, done = None, None
    for level in reversed(found):
        own = level.select("task", "p", F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("descendants"))
        if counted is not None:
            sums = counted.groupBy(F.col("p").alias("task")).agg(F.count("*").alias("children"), F.sum(F.col("descendants") + 1).alias("descendants"))
            own = level.join(sums, "task", "left").select("task", "p", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("descendants", F.lit(0)).alias("descendants"))
        counted = _checkpoint(own)
        done = counted if done is None else done.unionByName(counted)
    if done is None:
        return tasks.select("task", F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("descendants"))
    return done.select("task", "children", "descendants")


def reachable(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, idx): every task that a root reaches, once, numbered from 0 in order of the task.

    In a graph without cycles these are all tasks that have an edge or are roots, so nothing is walked. Numbers
    come from per-partition counts of a range-partitioned table, not from one sorted task.
    """
    every = tasks.select("task").distinct()
    part = every.repartitionByRange("task").sortWithinPartitions("task").select("task", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i"))
    part = _checkpoint(part)

    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return part.join(F.broadcast(base), "_p").select("task", (F.col("_o") + F.col("_i")).alias("idx"))


def dot(tasks: DataFrame, edges: DataFrame, label: Column) -> DataFrame:
    """Lines of a DOT text: a row for each task and for each edge, with ``ord`` 0 and 1."""
    nodes = tasks.select(F.lit(0).alias("ord"), F.format_string('  "%d" [label="%s"] ;', F.col("task"), label).alias("line"))
    return nodes.unionByName(edges.select("pred", "succ").distinct().select(F.lit(1).alias("ord"), F.format_string('  "%d" -> "%d" ;', "pred", "succ").alias("line")))


STAGES = ("fetching", "executing", "completed")


def lower(commands: DataFrame, tasks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A command graph: nodes (node, kind, task, device) and edges (src, dst), named by strings.

    ``commands``: (task, stage 0 to 2, command, device). A stage of one command is this node; one of more stands
    between a begin and an end node, on the device of the task's first command. Tasks without commands have no
    node; their predecessors are bridged to their successors. ``entry`` and ``exit`` close the graph.
    """
    nodes, links, opening, closing = lower_parts(commands, edges)
    gates = commands.sparkSession.range(1).select(F.explode(F.array(F.lit("entry"), F.lit("exit"))).alias("node"), F.lit("EMPTY").alias("kind"), F.lit(None).cast("long").alias("task"), F.lit(None).cast("int").alias("device"))
    return nodes.unionByName(gates), links.select("src", "dst").unionByName(opening).unionByName(closing)


def lower_parts(commands: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The nodes and edges of :func:`lower` without the gates, the edges with the ``task`` they lead into or are in;
    and the edges from ``entry`` and to ``exit``. These are of tasks that no edge between tasks enters or leaves.
    """
    name = F.concat(F.lit("c"), F.col("command").cast("string"))
    first = commands.groupBy("task").agg(F.min_by("device", F.struct("stage", "command")).alias("bar"))
    blocks = commands.groupBy("task", "stage").agg(F.count("*").alias("n"), F.min(name).alias("only")).join(first, "task")
    mark = lambda end: F.concat(F.lit(end), F.col("task").cast("string"), F.lit("."), F.col("stage").cast("string"))
    blocks = blocks.select("task", "stage", "n", "bar", F.when(F.col("n") == 1, F.col("only")).otherwise(mark("b")).alias("i"), F.when(F.col("n") == 1, F.col("only")).otherwise(mark("e")).alias("o"))
    blocks = _checkpoint(blocks)
    many = blocks.where("n > 1")
    nodes = commands.select(name.alias("node"), F.lit("COMMAND").alias("kind"), "task", "device")
    nodes = nodes.unionByName(many.select(F.explode(F.array("i", "o")).alias("node"), F.lit("EMPTY").alias("kind"), "task", F.col("bar").alias("device")))
    inner = commands.select("task", "stage", name.alias("c")).join(many, ["task", "stage"]).select("task", "stage", "c", "i", "o").distinct()
    pair = F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("c").alias("dst")), F.struct(F.col("c").alias("src"), F.col("o").alias("dst"))))
    links = inner.select("task", pair.alias("_p")).select("task", "_p.*")

    order = Window.partitionBy("task").orderBy("stage")  # three rows at most
    links = links.unionByName(blocks.select("task", F.lag("o").over(order).alias("src"), F.col("i").alias("dst")).where("src is not null"))
    ends = _checkpoint(blocks.groupBy("task").agg(F.min_by("i", "stage").alias("i"), F.max_by("o", "stage").alias("o")))
    bridged = _bridge(edges, ends)
    between = bridged.join(ends.select(F.col("task").alias("pred"), F.col("o").alias("src")), "pred").join(ends.select(F.col("task").alias("succ"), F.col("i").alias("dst")), "succ").where("src <> dst")
    between = _checkpoint(between.select("pred", "succ", "src", "dst"))
    links = links.unionByName(between.select(F.col("succ").alias("task"), "src", "dst"))
    opening = ends.join(between.select(F.col("succ").alias("task")), "task", "left_anti").select(F.lit("entry").alias("src"), F.col("i").alias("dst"))
    closing = ends.join(between.select(F.col("pred").alias("task")), "task", "left_anti").select(F.col("o").alias("src"), F.lit("exit").alias("dst"))
    return nodes, links, opening, closing


def _bridge(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges between tasks with commands, past those without: one round for each further task on the way."""
    have = ends.select("task")
    edges = _checkpoint(edges.select("pred", "succ").distinct())
    out = edges.join(have.withColumnRenamed("task", "pred"), "pred", "left_semi")
    late = _checkpoint(edges.join(have.withColumnRenamed("task", "pred"), "pred", "left_anti"))  # from a task without commands
    ready = out.join(have.withColumnRenamed("task", "succ"), "succ", "left_semi").select("pred", "succ")
    open_ = _checkpoint(out.join(have.withColumnRenamed("task", "succ"), "succ", "left_anti").select("pred", "succ"))
    while not open_.isEmpty():
        step = _checkpoint(open_.select("pred", F.col("succ").alias("mid")).join(late.select(F.col("pred").alias("mid"), "succ"), "mid").select("pred", "succ").distinct())
        ready = ready.unionByName(step.join(have.withColumnRenamed("task", "succ"), "succ", "left_semi").select("pred", "succ"))
        open_ = step.join(have.withColumnRenamed("task", "succ"), "succ", "left_anti").select("pred", "succ")
    return ready.distinct()


def chains(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, chain): tasks of a maximal chain on one device carry its first task.

    An edge is inside a chain if it is the only one out of its begin and the only one into its end, and both are on
    one device. Chains are found by pointer doubling, so a chain of n tasks takes log2(n) rounds.
    """
    edges = edges.select("pred", "succ").distinct()
    one_out = edges.groupBy("pred").agg(F.count("*").alias("n")).where("n = 1").select("pred")
    one_in = edges.groupBy("succ").agg(F.count("*").alias("n")).where("n = 1").select("succ")
    device = tasks.select("task", "device")
    inner = edges.join(one_out, "pred", "left_semi").join(one_in, "succ", "left_semi")
    inner = inner.join(device.select(F.col("task").alias("pred"), F.col("device").alias("d0")), "pred").join(device.select(F.col("task").alias("succ"), F.col("device").alias("d1")), "succ").where("d0 = d1")
    link = _checkpoint(tasks.select("task").join(inner.select(F.col("succ").alias("task"), F.col("pred").alias("up")), "task", "left").select("task", F.coalesce("up", "task").alias("up")))
    while True:
        # the task that a row points to points further, until it is a first task
        further = link.select(F.col("task").alias("up"), F.col("up").alias("top"))
        new = _checkpoint(link.join(further, "up").select("task", F.col("up").alias("was"), F.col("top").alias("up")))
        if new.where("was <> up").isEmpty():
            return new.select("task", F.col("up").alias("chain"))
        link = new.select("task", "up")
