"""Dependencies between tasks from an ordered log of their accesses.

An access log has a location (columns ``key``), a program order ``seq`` that is unique within a location, the
task, and a mode in bits (1 reads, 2 writes). A write starts an epoch; reads see the last write before them, a
write waits for the reads of its epoch, or for the last write where the epoch has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in program order that are one window at most, so that a location with very many accesses is spread.
BLOCK = 1 << 16
#: Accesses from which on a domain is cut in parts for several tasks, and accesses of a task on average.
HOT, SHARE = 1 << 15, 100_000


def writes(mode: str = "mode") -> Column:
    return F.col(mode).bitwiseAND(2) != 0


def epochs(log: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """The log with ``ep``, the number of earlier writes of the location, and ``lw``, the place of the last one.

    Counted in two levels: within blocks of program order, and over the blocks' totals.
    """
    w = writes().cast("long")
    log = log.withColumn("_b", F.floor(F.col("seq") / block).cast("long"))
    totals = log.groupBy(*key, "_b").agg(F.sum(w).alias("_n"), F.max(F.when(writes(), F.col("seq"))).alias("_l"))
    earlier = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.max("_l").over(earlier).alias("_l"))
    inside = Window.partitionBy(*key, "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = log.join(totals, [*key, "_b"])
    ep = F.col("_n") + F.coalesce(F.sum(w).over(inside), F.lit(0))
    lw = F.coalesce(F.max(F.when(writes(), F.col("seq"))).over(inside), F.col("_l"))
    return out.withColumn("ep", ep).withColumn("lw", lw).drop("_b", "_n", "_l")


def handle_edges(log: DataFrame, key: list[str]) -> DataFrame:
    """(key, pred, succ, kind) of sequential accesses. Tasks are named by their places in program order.

    A write after reads has edges from the reads (WAR) and none from the last write, which these imply.
    """
    e = epochs(log.select(*key, "seq", "mode"), key)
    raw = e.where(~writes() & F.col("lw").isNotNull()).select(*key, F.col("lw").alias("pred"), F.col("seq").alias("succ"), F.lit("RAW").alias("kind"))
    reads = e.where(~writes()).select(*key, "ep", F.col("seq").alias("r"))
    w = e.where(writes()).select(*key, "ep", "lw", F.col("seq").alias("succ")).join(reads, [*key, "ep"], "left")
    w = w.select(*key, F.coalesce("r", "lw").alias("pred"), "succ", F.when(F.col("r").isNotNull(), "WAR").otherwise("WAW").alias("kind")).where("pred is not null")
    return raw.unionByName(w)


def cells_1d(log: DataFrame, domain: list[str], a: str = "a", b: str = "b", cell: str = "cell") -> DataFrame:
    """A row for each access and elementary interval: the cuts of a domain are all begins and ends in it."""
    cuts = log.select(*domain, F.col(a).alias("_x")).union(log.select(*domain, F.col(b).alias("_x"))).distinct()
    order = Window.partitionBy(*domain).orderBy("_x")
    rank = cuts.withColumn("_k", F.row_number().over(order))
    lo, hi = rank.select(*domain, F.col("_x").alias(a), F.col("_k").alias("_lo")), rank.select(*domain, F.col("_x").alias(b), F.col("_k").alias("_hi"))
    return log.where(F.col(a) < F.col(b)).join(lo, [*domain, a]).join(hi, [*domain, b]).withColumn(cell, F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1))).drop("_lo", "_hi")


def _dealt(log: DataFrame, domain: list[str], axes: list[tuple[str, str]], hot: int = HOT) -> DataFrame:
    """Accesses by domain, one shuffle of the log alone; ``_b`` is the part of a domain, one task works on a part.

    A domain with more than ``hot`` accesses is cut in 16 parts along one axis or 8 x 8 along two, at begins that it
    has, so no cut is new. An access is in each part that it meets, clipped to it. A part of 100,000 accesses is the
    mean size of a task's share; the log is counted for that.
    """
    spark = log.sparkSession
    log = log.where(" and ".join(f"{c} is not null" for c in domain)).where(" and ".join(f"{a} < {b}" for a, b in axes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + log.count() // SHARE)
    many = log.groupBy(*domain).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*domain)
    k = 16 if len(axes) == 1 else 8
    at = F.array(*(F.lit(i / k) for i in range(1, k)))
    bounds = log.join(F.broadcast(many), domain, "left_semi").groupBy(*domain).agg(*(F.array_distinct(F.percentile_approx(a, at)).alias(f"_{a}") for a, _ in axes))
    out = log.join(F.broadcast(bounds), domain, "left").withColumn("_b", F.lit(0).cast("long"))
    for a, b in axes:
        cut = F.col(f"_{a}")
        first = F.size(F.filter(cut, lambda x: x <= F.col(a)))  # noqa: B023
        last = F.size(F.filter(cut, lambda x: x < F.col(b)))  # noqa: B023
        out = out.withColumn("_i", F.explode(F.when(cut.isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, last))))
        low, high = F.get(cut, F.col("_i") - 1), F.get(cut, F.col("_i"))
        out = out.withColumns({a: F.greatest(a, low), b: F.least(b, high), "_b": F.col("_b") * k + F.col("_i")}).drop("_i", f"_{a}")
    return out.repartition(parts, *domain, "_b")


def cells(log: DataFrame, domain: list[str], axes: list[tuple[str, str]], hot: int = HOT) -> DataFrame:
    """(domain, _b, c0 [, c1], seq, mode): a row for each access and cell of the grid of its part's cuts.

    Only the log is shuffled (:func:`_dealt`); cuts are ranked and rows made where they are. Equal accesses are one.
    """
    group = [*domain, "_b"]
    out = _dealt(log.select(*domain, "seq", "mode", *(c for axis in axes for c in axis)), domain, axes, hot)
    for i, (a, b) in enumerate(axes):
        columns = [c for c in out.columns if c not in (a, b)]
        rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("_x"))
        ends = out.withColumn("_x", F.explode(F.array(a, b))).withColumn("_k", rank)
        out = ends.groupBy(*columns, a, b).agg(F.min("_k").alias(f"_lo{i}"), F.max("_k").alias(f"_hi{i}")).drop(a, b)
    for i in range(len(axes)):
        out = out.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"_lo{i}"), F.col(f"_hi{i}") - 1))).drop(f"_lo{i}", f"_hi{i}")
    return out


def _seen(cells: DataFrame, domain: list[str], silent: bool = False) -> DataFrame:
    """Cells with ``lw``, ``lr`` and ``nw``: the last write and read before an access and the next write after it.

    With ``silent``, only accesses of exactly mode R count as reads later on.
    """
    spots = [c for c in cells.columns if c not in ("seq", "mode")]
    # a hash in front decides nearly all comparisons of the sort
    over = f"(PARTITION BY _h, {', '.join(spots)} ORDER BY seq)"
    read = "mode = 1" if silent else "mode & 2 = 0"
    near = {"lw": "lag(if(mode & 2 <> 0, seq, null))", "lr": f"lag(if({read}, seq, null))", "nw": "lead(if(mode & 2 <> 0, seq, null))"}
    return cells.withColumn("_h", F.xxhash64(*spots)).select("*", *(F.expr(f"{f} IGNORE NULLS OVER {over}").alias(c) for c, f in near.items()))


def cell_edges(cells: DataFrame, domain: list[str], silent: bool = False) -> DataFrame:
    """(domain, pred, succ, kind) of each cell as of :func:`handle_edges`, from one sorted pass and without a join.

    A read names the writes next to it on both sides; a write names the last one if no read is between.
    """
    read = "mode = 1" if silent else "mode & 2 = 0"
    raw = "if(mode & 2 = 0, lw, null)"
    war = f"if({read}, nw, null)"
    waw = "if(mode & 2 <> 0 and (lr is null or lr < lw), lw, null)"
    each = F.expr(f"explode(array(struct(coalesce({raw}, {waw}) as pred, seq as succ, if(mode & 2 = 0, 0, 2) as k), struct(if({war} is null, null, seq) as pred, {war} as succ, 1 as k)))")
    return _seen(cells, domain, silent).select(*domain, each.alias("_e")).select(*domain, "_e.*").where("pred is not null and pred <> succ")


def _once(edges: DataFrame, domain: list[str]) -> DataFrame:
    kind = F.element_at(F.array(F.lit("RAW"), F.lit("WAR"), F.lit("WAW")), F.col("k") + 1)
    return edges.distinct().select(*domain, "pred", "succ", kind.alias("kind"))


def segment_edges(log: DataFrame, domain: list[str], hot: int = HOT) -> DataFrame:
    """Edges of accesses to intervals [a, b): those of each elementary interval, once."""
    return _once(cell_edges(cells(log, domain, [("a", "b")], hot), domain), domain)


def rect_edges(log: DataFrame, domain: list[str], hot: int = HOT) -> DataFrame:
    """Edges of accesses to rectangles [x0, x1) x [y0, y1): those of each cell of the grid of all cuts, once.

    Only accesses of exactly mode R count as reads later on; other modes without W leave no trace.
    """
    return _once(cell_edges(cells(log, domain, [("x0", "x1"), ("y0", "y1")], hot), domain, silent=True), domain)


def phases(log: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """The log with ``class`` (R, W or C: reads, sequential and concurrent writes) and ``phase``.

    A phase is a run of equal class; each sequential or commutative write is one by itself. Counted in two levels as in
    :func:`epochs`: within blocks of program order, then over the blocks.
    """
    kind = F.when(~writes(), "R").when(F.col("concurrency") == "CONCURRENT", "C").otherwise("W")
    log = log.withColumn("class", kind).withColumn("_b", F.floor(F.col("seq") / block).cast("long"))
    inside = Window.partitionBy(*key, "_b").orderBy("seq")
    new = (F.col("class") == "W") | F.coalesce(F.lag("class").over(inside) != F.col("class"), F.lit(False))
    log = log.withColumn("_n", F.sum(new.cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # of a block: how many phases begin in it but for its first row, which may continue the block before
    totals = log.groupBy(*key, "_b").agg(F.max("_n").alias("_t"), F.min_by("class", "seq").alias("_f"), F.max_by("class", "seq").alias("_l"))
    order = Window.partitionBy(*key).orderBy("_b")
    starts = (F.col("_f") != "W") & F.coalesce(F.lag("_l").over(order) != F.col("_f"), F.lit(True))
    totals = totals.withColumn("_s", starts.cast("long"))
    before = F.coalesce(F.sum(F.col("_t") + F.col("_s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*key, "_b", (before + F.col("_s")).alias("_o"))
    return log.join(totals, [*key, "_b"]).withColumn("phase", F.col("_n") + F.col("_o")).drop("_b", "_n", "_o")


def _consecutive(p: DataFrame, key: list[str]) -> DataFrame:
    left = p.select(*key, F.col("seq").alias("pred"), F.col("class").alias("c0"), (F.col("phase") + 1).alias("phase"))
    return left.join(p.select(*key, F.col("seq").alias("succ"), F.col("class").alias("c1"), "phase"), [*key, "phase"])


def concurrent_edges(log: DataFrame, key: list[str]) -> DataFrame:
    """Edges with concurrent writers: all of a phase to all of the next."""
    kind = F.when(F.col("c1") == "R", "RAW").when(F.col("c0") == "R", "WAR").otherwise("WAW")
    return _consecutive(phases(log, key), key).select(*key, "pred", "succ", kind.alias("kind"))


def empty_node_edges(log: DataFrame, key: list[str]) -> DataFrame:
    """As :func:`concurrent_edges`, but between reads and concurrent writes an empty task stands, in either order.

    n * m edges become n + m. The empty task is -(first task of the later phase) - 1.
    """
    p = phases(log, key)
    heads = p.groupBy(*key, "phase", "class").agg(F.min("seq").alias("head"))
    prev = heads.select(*key, (F.col("phase") + 1).alias("phase"), F.col("class").alias("c0"))
    joint = heads.join(prev, [*key, "phase"]).where("(class = 'C' and c0 = 'R') or (class = 'R' and c0 = 'C')").select(*key, "phase", (-F.col("head") - 1).alias("node"))
    into = p.select(*key, F.col("seq").alias("pred"), (F.col("phase") + 1).alias("phase")).join(joint, [*key, "phase"]).select(*key, "pred", F.col("node").alias("succ"))
    out_of = p.select(*key, F.col("seq").alias("succ"), "phase").join(joint, [*key, "phase"]).select(*key, F.col("node").alias("pred"), "succ")
    direct = _consecutive(p, key).where("c0 = 'W' or c1 = 'W'").select(*key, "pred", "succ")
    return into.unionByName(out_of).unionByName(direct)


def dedupe(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, set_edges, skipped): edges that stay when an edge is set once, and those that are left out."""
    return edges.groupBy(*key, "pred", "succ").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("*").alias("set_edges"), F.sum(F.col("n") - 1).alias("skipped"))


def conflicting_writers(log: DataFrame, domain: list[str], hot: int = HOT) -> DataFrame:
    """(domain, reader, writer) of the last writes that a read's elementary intervals have."""
    e = _seen(cells(log, domain, [("a", "b")], hot), domain)
    return e.where(~writes() & F.col("lw").isNotNull()).select(*domain, F.col("seq").alias("reader"), F.col("lw").alias("writer")).distinct()
