"""Queries of intervals and interval sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators import intervals
from taskloom.plans import logs
from taskloom.plans.registry import query
from taskloom.session import table

_FILL = """isl AS (SELECT key, a, b, sum(new) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM
(SELECT key, a, b, CASE WHEN a >= coalesce(max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) THEN 1 ELSE 0 END AS new FROM ord)),
fil AS (SELECT key, min(a) AS a, max(b) AS b FROM isl GROUP BY key, i)"""


@query(f"WITH {logs.ORDERS} SELECT id, b - a AS length, a >= b AS empty, a <= 9500 AND 9530 <= b AS includes, a < 9530 AND 9500 < b AS meets, a = 9500 AND b = 9530 AS same, b <= 9500 AS is_before FROM ord")
def iv_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = logs.order_days(spark, sf_dir)
    a, b, c, d = F.col("a"), F.col("b"), F.lit(9500), F.lit(9530)
    return o.select("id", intervals.length(a, b).alias("length"), intervals.is_empty(a, b).alias("empty"), intervals.includes(a, b, c, d).alias("includes"), intervals.intersects(a, b, c, d).alias("meets"), ((a == c) & (b == d)).alias("same"), intervals.before(a, b, c, d).alias("is_before"))


@query(f"WITH {logs.ORDERS}, {_FILL} SELECT * FROM fil")
def iv_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.fill(logs.order_days(spark, sf_dir), ["key"])


@query(f"""WITH {logs.ORDERS}, day AS (SELECT DISTINCT key, unnest(range(a, b)) AS d FROM ord WHERE id % 3 <> 0),
hole AS (SELECT DISTINCT key, unnest(range(a + 10, b - 10)) AS d FROM ord WHERE id % 3 = 0),
stay AS (SELECT * FROM day EXCEPT SELECT * FROM hole), run AS (SELECT key, d, d - row_number() OVER (PARTITION BY key ORDER BY d) AS g FROM stay)
SELECT key, min(d) AS a, max(d) + 1 AS b FROM run GROUP BY key, g""")
def iv_unfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two thirds of the keys, without the middle of the others."""
    o = logs.order_days(spark, sf_dir)
    holes = o.where("id % 3 = 0").select("key", (F.col("a") + 10).alias("a"), (F.col("b") - 10).alias("b"))
    return intervals.unfill(o.where("id % 3 <> 0"), holes, ["key"])


@query(f"""WITH {logs.ORDERS}, day AS (SELECT key, d FROM (SELECT DISTINCT key FROM ord), (SELECT unnest(range(9500, 9900)) AS d) EXCEPT SELECT key, unnest(range(a, b)) FROM ord),
run AS (SELECT key, d, d - row_number() OVER (PARTITION BY key ORDER BY d) AS g FROM day) SELECT key, min(d) AS a, max(d) + 1 AS b FROM run GROUP BY key, g""")
def iv_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(logs.order_days(spark, sf_dir), ["key"], 9500, 9900)


@query(f"WITH {logs.ORDERS}, {_FILL} SELECT c_custkey AS key, 9500 + c_custkey % 500 AS qa, 9600 + c_custkey % 500 AS qb, a, b FROM customer JOIN fil ON key = c_custkey WHERE a < 9600 + c_custkey % 500 AND 9500 + c_custkey % 500 < b")
def iv_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = 9500 + F.col("c_custkey") % 500
    ask = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), start.alias("qa"), (start + 100).alias("qb"))
    return intervals.find(intervals.fill(logs.order_days(spark, sf_dir), ["key"]), ask, ["key"]).select("key", "qa", "qb", "a", "b")


@query(f"WITH {logs.ORDERS} SELECT x.key, x.id AS left_id, y.id AS right_id FROM ord x JOIN ord y ON x.key = y.key AND x.id < y.id AND x.a < y.b AND y.a < x.b")
def iv_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = logs.order_days(spark, sf_dir)
    return intervals.overlap(o, o, ["key"], 90).where("left_id < right_id")
