"""Queries of rectangles and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators import rects
from taskloom.plans import logs
from taskloom.plans.registry import query
from taskloom.session import table

_PAIRS = "FROM prt l JOIN prt r ON l.plane = r.plane AND l.id < r.id AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = logs.parts(spark, sf_dir)
    return rects.overlap(p, p, ["plane"], 8, 16).where("l_id < r_id")


@query(f"WITH {logs.PARTS} SELECT id, (x1 - x0) * (y1 - y0) AS area, x0 >= x1 OR y0 >= y1 AS empty, x0 < 20 AND 10 < x1 AND y0 < 60 AND 30 < y1 AS meets, x0 = 10 AND x1 = 20 AND y0 = 30 AND y1 = 60 AS same, x0 <= 12 AND 14 <= x1 AND y0 <= 40 AND 42 <= y1 AS includes FROM prt")
def rect_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = {"q_x0": 10, "q_x1": 20, "q_y0": 30, "q_y1": 60, "s_x0": 12, "s_x1": 14, "s_y0": 40, "s_y1": 42}
    p = logs.parts(spark, sf_dir).withColumns({k: F.lit(v) for k, v in lit.items()})
    return p.select("id", rects.area().alias("area"), rects.is_empty().alias("empty"), rects.intersects("", "q_").alias("meets"), rects.equals("", "q_").alias("same"), rects.includes("", "s_").alias("includes"))


@query(f"WITH {logs.PARTS} SELECT l.plane, l.id AS l_id, r.id AS r_id {_PAIRS}")
def rect_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("plane", "l_id", "r_id")


@query(f"WITH {logs.PARTS} SELECT l.id AS l_id, r.id AS r_id, greatest(l.x0, r.x0) AS x0, least(l.x1, r.x1) AS x1, greatest(l.y0, r.y0) AS y0, least(l.y1, r.y1) AS y1 {_PAIRS}")
def rect_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("l_id", "r_id", *rects.intersection("l_", "r_"))


@query(f"WITH {logs.PARTS} SELECT l.id AS l_id, r.id AS r_id, r.x0 - l.x0 AS dx, r.y0 - l.y0 AS dy {_PAIRS}")
def rect_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("l_id", "r_id", *rects.distance("l_", "r_"))


@query(f"""WITH {logs.PARTS}, px AS (SELECT DISTINCT plane, unnest([x0, x1]) AS p FROM prt), py AS (SELECT DISTINCT plane, unnest([y0, y1]) AS p FROM prt),
ex AS (SELECT plane, p AS x0, lead(p) OVER (PARTITION BY plane ORDER BY p) AS x1 FROM px), ey AS (SELECT plane, p AS y0, lead(p) OVER (PARTITION BY plane ORDER BY p) AS y1 FROM py)
SELECT DISTINCT ex.plane, ex.x0, ex.x1, ey.y0, ey.y1 FROM prt JOIN ex ON ex.plane = prt.plane AND ex.x0 >= prt.x0 AND ex.x1 <= prt.x1 JOIN ey ON ey.plane = prt.plane AND ey.y0 >= prt.y0 AND ey.y1 <= prt.y1""")
def rect_partite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects.partite(logs.parts(spark, sf_dir), ["plane"])


_SEG2RECT = """s2r AS (SELECT id, 0 AS part, a % 12 AS x0, least(a % 12 + b - a, 12) AS x1, a // 12 AS y0, a // 12 + 1 AS y1 FROM ord
UNION ALL SELECT id, 1, 0, 12, a // 12 + 1, b // 12 FROM ord WHERE a // 12 + 1 < b // 12
UNION ALL SELECT id, 2, 0, b % 12, b // 12, b // 12 + 1 FROM ord WHERE b % 12 > 0 AND b // 12 > a // 12)"""


@query(f"WITH {logs.ORDERS}, {_SEG2RECT} SELECT id, part, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1, y0, y1 FROM s2r")
def seg2rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects.segment_rects(logs.order_days(spark, sf_dir), 6, 2).select("id", "part", "x0", "x1", "y0", "y1")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tiles of up to 8 x 4 elements of 4 bytes in matrices of 10 rows."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 4).alias("addr"), F.lit(10).cast("long").alias("ld"), (1 + F.col("p_size") % 8).cast("long").alias("m"), (1 + F.col("p_size") % 4).cast("long").alias("n"), F.lit(4).cast("long").alias("sizeof"))


_TILES = "til AS (SELECT p_partkey AS id, p_partkey * 4 AS addr, CAST(1 + p_size % 8 AS BIGINT) AS m, CAST(1 + p_size % 4 AS BIGINT) AS n FROM part)"
_M2R = f"""{_TILES}, m2r AS (SELECT id, 0 AS part, addr % 40 AS x0, least(addr % 40 + m * 4, 40) AS x1, addr // 40 AS y0, addr // 40 + n AS y1 FROM til
UNION ALL SELECT id, 1, 0, addr % 40 + m * 4 - 40, addr // 40 + 1, addr // 40 + 1 + n FROM til WHERE addr % 40 + m * 4 > 40)"""


@query(f"WITH {_M2R} SELECT * FROM m2r")
def mat2rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects.tile_rects(_tiles(spark, sf_dir))


@query(f"WITH {_TILES} SELECT id, addr, CAST(10 AS BIGINT) AS ld, m, n FROM til")
def rect2mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects.rects_tile(rects.tile_rects(_tiles(spark, sf_dir)), ["id"], 10, 4)


@query(f"""WITH {_M2R}, p AS (SELECT a.id AS l_id, b.id AS r_id, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1, greatest(a.y0, b.y0) AS y0, least(a.y1, b.y1) AS y1 FROM m2r a JOIN m2r b ON b.id = a.id + 1)
SELECT * FROM p WHERE x0 < x1 AND y0 < y1""")
def rect_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common parts of the rectangles of neighbouring tiles."""
    r = rects.tile_rects(_tiles(spark, sf_dir)).drop("part")
    left = r.select(*(F.col(c).alias(f"l_{c}") for c in r.columns))
    right = r.select(*(F.col(c).alias(f"r_{c}") for c in r.columns))
    both = left.join(right, F.col("r_id") == F.col("l_id") + 1)
    return both.select("l_id", "r_id", *rects.intersection("l_", "r_")).where(~rects.is_empty())


@query(f"""WITH {_TILES} SELECT id, addr + 2 * 4 + 3 * 40 AS col_offset, addr + 2 * 40 + 3 * 4 AS row_offset, addr + m * 4 + n * 40 AS col_end, addr + m * 40 + n * 4 AS row_end, m * n * 4 AS size FROM til""")
def mat_addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tiles(spark, sf_dir)
    m, n = F.col("m"), F.col("n")
    return t.select("id", rects.address(False, F.lit(2), F.lit(3)).alias("col_offset"), rects.address(True, F.lit(2), F.lit(3)).alias("row_offset"), rects.address(False, m, n).alias("col_end"), rects.address(True, m, n).alias("row_end"), (m * n * F.col("sizeof")).alias("size"))
