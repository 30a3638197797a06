"""Queries of replicas and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators import coherence
from taskloom.plans import logs
from taskloom.plans.registry import query
from taskloom.session import table

_EP = """e AS (SELECT *, CAST(coalesce(sum(CASE WHEN mode & 2 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ep FROM rep),
h AS (SELECT *, ep + CASE WHEN mode & 2 <> 0 THEN 1 ELSE 0 END AS epoch FROM e)"""


@query(f"""WITH {logs.REPLICAS}, {_EP} SELECT x.block, x.seq, x.device, x.mode, x.epoch, array_to_string(list_sort(list(DISTINCT y.device)), ',') AS valid
FROM h x JOIN h y ON x.block = y.block AND x.epoch = y.epoch AND y.seq <= x.seq GROUP BY x.block, x.seq, x.device, x.mode, x.epoch""")
def coherence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence.validity(logs.replicas(spark, sf_dir)).withColumn("valid", F.array_join(F.col("valid").cast("array<string>"), ","))


@query(f"""WITH {logs.REPLICAS}, {_EP} SELECT r.block, r.seq, r.device, CASE WHEN EXISTS (SELECT 1 FROM h x WHERE x.block = r.block AND x.epoch = r.ep AND x.device = r.device AND x.seq < r.seq) THEN 'HIT'
WHEN EXISTS (SELECT 1 FROM h x WHERE x.block = r.block AND x.epoch = r.ep AND x.seq < r.seq) THEN 'D2D' ELSE 'H2D' END AS plan FROM e r WHERE mode & 1 <> 0""")
def fetchplan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence.fetch_plan(logs.replicas(spark, sf_dir))


_COPY = """c AS (SELECT l_orderkey % 3 AS src, l_partkey % 3 AS dst, l_linenumber AS m, CAST(l_quantity AS BIGINT) % 4 + 1 AS n, 4 AS ld FROM lineitem),
d AS (SELECT *, CASE WHEN n = 1 OR m = ld THEN 1 ELSE 2 END AS dims FROM c)"""


@query(f"""WITH {_COPY} SELECT src, dst, dims, CASE WHEN src = 0 AND dst = 0 THEN 'H2H' WHEN src = 0 THEN 'H2D' WHEN dst = 0 THEN 'D2H' ELSE 'D2D' END AS command,
CASE WHEN src = 0 THEN 'H2D' WHEN dst = 0 THEN 'D2H' WHEN src = dst THEN 'D2D' ELSE 'P2P' END AS queue, count(*) AS copies, CAST(sum(CASE WHEN dims = 1 THEN m * n * 8 ELSE m * n * 8 END) AS BIGINT) AS bytes FROM d GROUP BY ALL""")
def xfertype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies between the host and two devices: dimensions, command, queue and bytes."""
    line = table(spark, sf_dir, "lineitem")
    c = line.select((F.col("l_orderkey") % 3).alias("src"), (F.col("l_partkey") % 3).alias("dst"), F.col("l_linenumber").alias("m"), (F.col("l_quantity").cast("long") % 4 + 1).alias("n"), F.lit(4).alias("ld"))
    c = c.withColumn("dims", coherence.copy_dims(F.col("m"), F.col("n"), F.col("ld")))
    command, queue = coherence.transfer(F.col("src"), F.col("dst"))
    size = coherence.copy_bytes(F.col("dims"), F.col("m") * F.col("n") * 8, F.col("m"), F.col("n"), F.lit(8))
    return c.groupBy("src", "dst", "dims", command.alias("command"), queue.alias("queue")).agg(F.count("*").alias("copies"), F.sum(size).alias("bytes"))
