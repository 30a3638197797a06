"""Queries of chunks, ranges, tiles and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators import placement
from taskloom.plans.registry import query
from taskloom.session import table


@query("""SELECT least((l_partkey % 1000) // 142, 6) AS chunk, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1""")
def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the chunk of 1,000 indices in 7."""
    c = placement.chunk_of(F.col("l_partkey") % 1000, 1000, 7)
    return table(spark, sf_dir, "lineitem").groupBy(c.alias("chunk")).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("keys"))


@query("SELECT i, 4096 + i * 142 AS a, CASE WHEN i = 6 THEN 4096 + 1000 ELSE 4096 + (i + 1) * 142 END AS b FROM range(7) t(i)")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.chunks(spark, 4096, 1000, 7)


@query("SELECT tid, min(i) AS a, max(i) + 1 AS b FROM (SELECT i, ntile(16) OVER (ORDER BY i) - 1 AS tid FROM range(297) t(i)) GROUP BY tid")
def pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10, 13, ... 900 over 16 threads."""
    return placement.parallel_for(spark, 10, 900, 3, 16)


@query("SELECT i, 8192 + i * 5 * 4096 AS a, least(8192 + (i + 1) * 5 * 4096, 10000 + 90000) AS b, false AS covered FROM range(4) t(i)")
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 pages from inside the third one on, over 4 tasks of 5, which leaves the end."""
    return placement.pages(spark, 10000, 90000, 4)


@query("""WITH RECURSIVE h(id, a, b) AS (SELECT l_orderkey, 0::BIGINT, CAST(sum(l_quantity) AS BIGINT) * 8 FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT id, CASE WHEN s THEN a + (b - a) // 2 ELSE a END, CASE WHEN s THEN b ELSE a + (b - a) // 2 END FROM h, (VALUES (true), (false)) v(s) WHERE b - a > 512) SELECT * FROM h WHERE b - a <= 512""")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each order, halved down to 512."""
    size = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.sum("l_quantity").cast("long") * 8).alias("b"))
    return placement.halves(size.select("id", F.lit(0).cast("long").alias("a"), "b"), 512)


@query("SELECT 1 + p_partkey % 3 AS device, count(*) AS n FROM part GROUP BY 1")
def dist1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(placement.cyclic_1d(F.col("p_partkey"), 3).alias("device")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, 1 + ((p_partkey // 10) * 10 + p_partkey % 10) % 6 AS cyclic, 1 + (((p_partkey // 10) % 3) * 2 + (p_partkey % 10) % 2) % 6 AS block FROM part")
def dist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 10 columns on 6 devices: cyclic, and block cyclic on a grid of 3 x 2."""
    tm, tn = F.floor(F.col("p_partkey") / 10), F.col("p_partkey") % 10
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), placement.cyclic_2d(tm, tn, 10, 6).alias("cyclic"), placement.block_cyclic(tm, tn, 6).alias("block"))


@query("SELECT p_partkey AS id, 1 + (((p_partkey // 10) // 2 % 2) * 1 + 0) % 2 AS device FROM part")
def dist2dblk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 2 x 3 tiles on two devices: a grid of 2 x 1."""
    tm, tn = F.floor(F.col("p_partkey") / 10), F.col("p_partkey") % 10
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), placement.block_cyclic(tm, tn, 2, 2, 3).alias("device"))


@query("SELECT vec_id AS t, vec_id * 4096 AS a, vec_id * 4096 + 1024 AS b, 1 + vec_id % 4 AS device FROM embeddings")
def distarr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of pointers to chunks of 1,024 bytes."""
    a = F.col("vec_id") * 4096
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), a.alias("a"), (a + 1024).alias("b"), placement.cyclic_1d(F.col("vec_id"), 4).alias("device"))


@query("SELECT t, greatest(t * 100 - 10, 0) AS a, least((t + 1) * 100 + 10, 1005) AS b, 1 + t % 3 AS device FROM range(11) r(t)")
def halo1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.halo_1d(spark, 1005, 100, 10, 3)


@query("""SELECT tm, tn, greatest(tm * 16 - 2, 0) AS x0, least(tm * 16 + 18, 50) AS x1, greatest(tn * 8 - 1, 0) AS y0, least(tn * 8 + 9, 30) AS y1, 1 + (tm * 4 + tn) % 3 AS device
FROM range(4) a(tm), range(4) b(tn)""")
def halo2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.halo_2d(spark, 50, 30, 16, 8, 2, 1, 3)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("access"), (1 + F.pmod("l_suppkey", F.lit(4))).cast("int").alias("device"), (F.col("l_quantity") * 8).cast("long").alias("bytes"))


_OWN = "own AS (SELECT l_partkey AS access, CAST(1 + l_suppkey % 4 AS INTEGER) AS device, CAST(sum(l_quantity * 8) AS BIGINT) AS bytes FROM lineitem GROUP BY 1, 2), best AS (SELECT *, rank() OVER (PARTITION BY access ORDER BY bytes DESC) AS r FROM own)"


@query(f"WITH {_OWN} SELECT access, device, bytes FROM best WHERE r = 1 AND bytes > 0")
def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.owners(_parts(spark, sf_dir), ["access"])


@query(f"WITH {_OWN} SELECT access, bit_or(1 << device) AS owners FROM best WHERE r = 1 GROUP BY access")
def owner_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.owner_mask(owners(spark, sf_dir), ["access"])


@query("""WITH valid AS (SELECT DISTINCT l_partkey AS block, l_suppkey % 4 AS device FROM lineitem), q AS (SELECT block, dst, device, CASE WHEN device = dst THEN -1 WHEN device = 0 THEN 3 ELSE (device + dst) % 3 END AS s FROM valid, (SELECT unnest(range(1, 4)) AS dst)),
w AS (SELECT *, row_number() OVER (PARTITION BY block, dst ORDER BY s, device) AS r FROM q) SELECT block, dst, device AS src FROM w WHERE r = 1""")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources for devices 1 to 3; devices have ranks (src + dst) mod 3 to each other, the host has none."""
    dst = spark.range(1, 4).select(F.col("id").alias("dst"))
    ranks = dst.select("dst", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("src")).select("dst", "src", ((F.col("src") + F.col("dst")) % 3).alias("rank"))
    valid = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("block"), (F.col("l_suppkey") % 4).alias("device")).distinct()
    valid = valid.withColumn("dst", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    return placement.route(valid, ranks)


@query("""WITH t AS (SELECT event_id AS task, CASE WHEN event_id % 3 = 0 THEN 6 ELSE 0 END AS sug, (event_id * 7) % 32 AS own, CASE WHEN event_id % 4 = 0 THEN event_id % 5 END AS tgt FROM events),
s AS (SELECT *, CASE WHEN 31 & sug <> 0 THEN 31 & sug ELSE 31 END AS m FROM t), o AS (SELECT *, CASE WHEN m & (own & 30) <> 0 THEN m & (own & 30) ELSE m END AS n FROM s),
g AS (SELECT *, CASE WHEN tgt IS NOT NULL AND n & (1 << CAST(coalesce(tgt, 0) AS INTEGER)) <> 0 THEN 1 << CAST(tgt AS INTEGER) ELSE n END AS k FROM o)
SELECT task, CAST(CASE WHEN k = 1 THEN 0 WHEN k & 2 <> 0 THEN 1 WHEN k & 4 <> 0 THEN 2 WHEN k & 8 <> 0 THEN 3 ELSE 4 END AS INTEGER) AS device FROM g""")
def elect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices 0 to 4; suggestions, owners and targets by number of the event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("task"), placement.elect(5, F.when(e % 3 == 0, 6).otherwise(0), (e * 7) % 32, F.when(e % 4 == 0, e % 5)).alias("device"))
