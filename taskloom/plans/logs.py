"""Access logs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.session import table


def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accesses: a handle for each user, purchases and signups write, the rest read."""
    mode = F.when(F.col("event_type").isin("purchase", "signup"), 2).otherwise(1)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("handle"), F.col("event_id").alias("seq"), mode.alias("mode"))


HANDLES = "acc AS (SELECT user_id AS handle, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 1 END AS mode FROM events)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As handles, but on the interval [floor(value), floor(value) + 20) of the user's memory."""
    mode = F.when(F.col("event_type").isin("purchase", "signup"), 2).otherwise(1)
    a = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("domain_id"), F.col("event_id").alias("seq"), mode.alias("mode"), a.alias("a"), (a + 20).alias("b"))


SEGMENTS = "seg AS (SELECT user_id AS domain_id, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 1 END AS mode, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + 20 AS b FROM events)"


def concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases write in sequence, signups write concurrently, the rest reads."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("handle"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("purchase", "signup"), 2).otherwise(1).alias("mode"), F.when(F.col("event_type") == "signup", "CONCURRENT").otherwise("SEQUENTIAL").alias("concurrency"))


PHASES = """cls AS (SELECT user_id AS handle, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'W' WHEN 'signup' THEN 'C' ELSE 'R' END AS c FROM events),
mark AS (SELECT *, CASE WHEN c = 'W' OR lag(c) OVER w IS DISTINCT FROM c THEN 1 ELSE 0 END AS new FROM cls WINDOW w AS (PARTITION BY handle ORDER BY seq)),
ph AS (SELECT handle, seq, c, CAST(sum(new) OVER (PARTITION BY handle ORDER BY seq) AS BIGINT) AS p FROM mark)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accesses to tiles of 9 x 7 cells of the user's matrix."""
    mode = F.when(F.col("event_type").isin("purchase", "signup"), 2).otherwise(1)
    x, y = F.pmod(F.floor("value"), F.lit(40)).cast("long"), F.pmod("event_id", F.lit(30)).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("domain_id"), F.col("event_id").alias("seq"), mode.alias("mode"), x.alias("x0"), (x + 9).alias("x1"), y.alias("y0"), (y + 7).alias("y1"))


TILES = "tile AS (SELECT user_id AS domain_id, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 1 END AS mode, CAST(floor(value) AS BIGINT) % 40 AS x0, event_id % 30 AS y0 FROM events)"


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accesses of devices 1 to 4 to a block for each user: purchase W, signup RW, else R."""
    mode = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(1)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("block"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 4).cast("int").alias("device"), mode.alias("mode"))


REPLICAS = "rep AS (SELECT user_id AS block, event_id AS seq, CAST(1 + event_id % 4 AS INTEGER) AS device, CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS mode FROM events)"


def order_days(spark: SparkSession, sf_dir: str, days: int = 60) -> DataFrame:
    """Orders as intervals of days of their customer."""
    a = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), a.alias("a"), (a + days).alias("b"))


ORDERS = "ord AS (SELECT o_custkey AS key, o_orderkey AS id, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS a, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 60 AS b FROM orders)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rectangles of 5 x 7 cells in a plane for each brand."""
    x, y = F.col("p_size").cast("long"), F.pmod(F.floor("p_retailprice"), F.lit(100)).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("plane"), F.col("p_partkey").alias("id"), x.alias("x0"), (x + 5).alias("x1"), y.alias("y0"), (y + 7).alias("y1"))


PARTS = "prt AS (SELECT p_brand AS plane, p_partkey AS id, CAST(p_size AS BIGINT) AS x0, CAST(p_size AS BIGINT) + 5 AS x1, CAST(floor(p_retailprice) AS BIGINT) % 100 AS y0, CAST(floor(p_retailprice) AS BIGINT) % 100 + 7 AS y1 FROM part)"
