"""Views of the driver's tables as series and as hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES_KEYS, SERIES_ORDER = ["series_id"], ["cycle_ts", "event_id"]
HOP_KEYS, CYCLE = ["series_id"], ["cycle_ts", "cycle_id"]

SERIES_SQL = "v_series AS (SELECT user_id AS series_id, ts AS cycle_ts, event_id, event_type AS state, value AS rtt_ms FROM events)"
HOPS_SQL = """v_hops AS (
  SELECT c.c_nationkey AS series_id, o.o_orderdate AS cycle_ts, o.o_orderkey AS cycle_id, l.l_linenumber AS hop, 'ip_' || l.l_suppkey AS ip,
         CASE WHEN s.s_nationkey % 7 <> 0 THEN CAST(s.s_nationkey AS VARCHAR) END AS asn, l.l_quantity AS rtt_ms
  FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate DESC, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) = 1) l
  JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series_id"), F.col("ts").alias("cycle_ts"), "event_id", F.col("event_type").alias("state"), F.col("value").alias("rtt_ms"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt by order once, and a cycle is one order, so what groups or sorts within
    cycles finds its rows together (where suppliers are too many to be sent, dealt by them too)."""
    line, orders, customer, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    ties = ["l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_shipdate"), *ties)
    one = line.select("l_orderkey", "l_linenumber", "l_shipdate", *ties).repartition("l_orderkey").withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    cycles = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    joined = one.join(cycles, F.col("o_orderkey") == F.col("l_orderkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    asn = F.when(F.col("s_nationkey") % 7 != 0, F.col("s_nationkey").cast("string"))
    return joined.select(F.col("c_nationkey").alias("series_id"), F.col("o_orderdate").alias("cycle_ts"), F.col("o_orderkey").alias("cycle_id"), F.col("l_linenumber").alias("hop"), F.concat(F.lit("ip_"), "l_suppkey").alias("ip"), asn.alias("asn"), F.col("l_quantity").alias("rtt_ms"))
