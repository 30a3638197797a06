"""Queries of dependency derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators import deps, intervals, rects
from taskloom.plans import logs
from taskloom.plans.registry import query

_EP = """ep AS (SELECT {k}, seq, mode, CAST(coalesce(sum(CASE WHEN mode & 2 <> 0 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS ep, max(CASE WHEN mode & 2 <> 0 THEN seq END) OVER w AS lw
FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_EDGES = """edges AS (SELECT {k}, lw AS pred, seq AS succ, 'RAW' AS kind FROM ep WHERE mode & 2 = 0 AND lw IS NOT NULL
UNION ALL SELECT {wk}, r.seq, w.seq, 'WAR' FROM ep w JOIN ep r USING ({k}, ep) WHERE w.mode & 2 <> 0 AND r.mode & 2 = 0
UNION ALL SELECT {wk}, w.lw, w.seq, 'WAW' FROM ep w WHERE w.mode & 2 <> 0 AND w.lw IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ep r WHERE {on} AND r.ep = w.ep AND r.mode & 2 = 0))"""


def edges_sql(source: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return _EP.format(k=k, t=source) + ",\n" + _EDGES.format(k=k, wk=", ".join(f"w.{c}" for c in keys), on=" AND ".join(f"r.{c} = w.{c}" for c in keys))


@query(f"WITH {logs.HANDLES}, {edges_sql('acc', ['handle'])} SELECT * FROM edges")
def dep_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.handle_edges(logs.handles(spark, sf_dir), ["handle"])


@query(f"WITH {logs.HANDLES}, {_EP.format(k='handle', t='acc')} SELECT handle, seq, ep FROM ep")
def epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.epochs(logs.handles(spark, sf_dir), ["handle"]).select("handle", "seq", "ep")


@query(f"WITH {logs.HANDLES} SELECT x.handle, x.seq, (SELECT max(y.seq) FROM acc y WHERE y.handle = x.handle AND y.seq < x.seq AND y.mode = 2) AS lw FROM acc x")
def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.epochs(logs.handles(spark, sf_dir), ["handle"]).select("handle", "seq", "lw")


_CELLS = f"""{logs.SEGMENTS}, pts AS (SELECT DISTINCT domain_id, x FROM (SELECT domain_id, a AS x FROM seg UNION ALL SELECT domain_id, b FROM seg)),
el AS (SELECT domain_id, x AS cell, lead(x) OVER (PARTITION BY domain_id ORDER BY x) AS nx FROM pts),
cells AS (SELECT s.domain_id, e.cell, s.seq, s.mode FROM seg s JOIN el e ON e.domain_id = s.domain_id AND e.cell >= s.a AND e.nx <= s.b)"""


@query(f"WITH {_CELLS}, {edges_sql('cells', ['domain_id', 'cell'])} SELECT DISTINCT domain_id, pred, succ, kind FROM edges")
def dep_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.segment_edges(logs.segments(spark, sf_dir), ["domain_id"])


@query(f"WITH {_CELLS}, {_EP.format(k='domain_id, cell', t='cells')} SELECT DISTINCT domain_id, seq AS reader, lw AS writer FROM ep WHERE mode & 2 = 0 AND lw IS NOT NULL")
def conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.conflicting_writers(logs.segments(spark, sf_dir), ["domain_id"])


@query(f"WITH {logs.PHASES} SELECT a.handle, a.seq AS pred, b.seq AS succ, CASE WHEN b.c = 'R' THEN 'RAW' WHEN a.c = 'R' THEN 'WAR' ELSE 'WAW' END AS kind FROM ph a JOIN ph b ON a.handle = b.handle AND b.p = a.p + 1")
def dep_conc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.concurrent_edges(logs.concurrent(spark, sf_dir), ["handle"])


@query(f"""WITH {logs.PHASES}, hd AS (SELECT handle, p, min(c) AS c, min(seq) AS head FROM ph GROUP BY handle, p),
nd AS (SELECT b.handle, b.p, -b.head - 1 AS node FROM hd a JOIN hd b ON a.handle = b.handle AND b.p = a.p + 1 WHERE (a.c = 'R' AND b.c = 'C') OR (a.c = 'C' AND b.c = 'R'))
SELECT handle, ph.seq AS pred, node AS succ FROM ph JOIN nd USING (handle) WHERE nd.p = ph.p + 1
UNION ALL SELECT handle, node, ph.seq FROM ph JOIN nd USING (handle) WHERE nd.p = ph.p
UNION ALL SELECT a.handle, a.seq, b.seq FROM ph a JOIN ph b ON a.handle = b.handle AND b.p = a.p + 1 WHERE a.c = 'W' OR b.c = 'W'""")
def dep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.empty_node_edges(logs.concurrent(spark, sf_dir), ["handle"])


@query(f"""WITH {_CELLS}, {edges_sql('cells', ['domain_id', 'cell'])}
SELECT domain_id, count(*) AS set_edges, CAST(sum(n - 1) AS BIGINT) AS skipped FROM (SELECT domain_id, pred, succ, count(*) AS n FROM edges GROUP BY ALL) GROUP BY domain_id""")
def dep_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = deps.cell_edges(deps.cells(logs.segments(spark, sf_dir), ["domain_id"], [("a", "b")]), ["domain_id"])
    return deps.dedupe(edges, ["domain_id"])


_GRID = f"{logs.TILES}, grid AS (SELECT domain_id, seq, mode, x0 + u.i AS cx, y0 + v.j AS cy FROM tile, (SELECT unnest(range(9)) AS i) u, (SELECT unnest(range(7)) AS j) v)"


@query(f"WITH {_GRID}, {edges_sql('grid', ['domain_id', 'cx', 'cy'])} SELECT DISTINCT domain_id, pred, succ, kind FROM edges")
def dep_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.rect_edges(logs.tiles(spark, sf_dir), ["domain_id"])


#: Column height of the matrix that segments and tiles share in dep_cross.
_LD = 16


@query(f"""WITH base AS (SELECT user_id AS domain_id, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 1 END AS mode, CAST(floor(value) AS BIGINT) AS v, event_id % 2 AS odd FROM events),
cell AS (SELECT domain_id, seq, mode, v + u.i AS spot FROM base, (SELECT unnest(range(20)) AS i) u WHERE odd = 0
UNION ALL SELECT domain_id, seq, mode, v + u.i + {_LD} * w.j FROM base, (SELECT unnest(range(6)) AS i) u, (SELECT unnest(range(3)) AS j) w WHERE odd = 1),
{edges_sql('cell', ['domain_id', 'spot'])} SELECT DISTINCT domain_id, pred, succ, kind FROM edges""")
def dep_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events access 20 bytes in a row, odd ones a tile of 6 x 3 that may wrap, in one matrix of a user."""
    base = logs.segments(spark, sf_dir)
    even = rects.segment_rects(base.where("seq % 2 = 0"), _LD, 1)
    odd = base.where("seq % 2 = 1").select("domain_id", "seq", "mode", F.col("a").alias("addr"), F.lit(_LD).alias("ld"), F.lit(6).alias("m"), F.lit(3).alias("n"), F.lit(1).alias("sizeof"))
    both = even.drop("part").unionByName(rects.tile_rects(odd).drop("part"))
    return deps.rect_edges(both, ["domain_id"])


@query(f"WITH {logs.SEGMENTS} SELECT x.domain_id, x.seq AS left_id, y.seq AS right_id FROM seg x JOIN seg y ON x.domain_id = y.domain_id AND x.seq < y.seq AND x.a < y.b AND y.a < x.b")
def acc_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs.segments(spark, sf_dir)
    return intervals.overlap(s, s, ["domain_id"], 32, "seq", "seq").where("left_id < right_id")


@query(f"WITH {logs.SEGMENTS} SELECT x.domain_id, x.seq AS left_id, y.seq AS right_id FROM seg x JOIN seg y ON x.domain_id = y.domain_id AND x.seq < y.seq AND x.a < y.b AND y.a < x.b WHERE (x.mode | y.mode) & 2 <> 0")
def acc_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs.segments(spark, sf_dir)
    w = s.where(deps.writes())
    r = s.where(~deps.writes())
    ww = intervals.overlap(w, w, ["domain_id"], 32, "seq", "seq").where("left_id < right_id")
    wr = intervals.overlap(w, r, ["domain_id"], 32, "seq", "seq").select("domain_id", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    return ww.unionByName(wr)
