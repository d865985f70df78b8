"""A road graph carried by the supplied tables: parts are nodes, consecutive lines of an order are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import stable_id

TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
BITS = 18
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir: str) -> DataFrame:
    """The lines of each order in one total order: pos from 0."""
    w = W.partitionBy("l_orderkey").orderBy(*TIES)
    return table(spark, sf_dir, "lineitem").withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


def edges(spark, sf_dir: str) -> DataFrame:
    """edge_id, route, pos, from_node, to_node, duration_ds, length_u."""
    w = W.partitionBy("l_orderkey").orderBy("pos")
    out = lines(spark, sf_dir).withColumn("to_node", F.lead("l_partkey").over(w)).where("to_node IS NOT NULL")
    return out.select(
        stable_id(F.col("l_orderkey"), F.col("pos"), F.lit(0), F.col("l_partkey"), F.col("to_node")).alias("edge_id"), F.col("l_orderkey").alias("route"), "pos",
        F.col("l_partkey").alias("from_node"), "to_node", F.round(F.col("l_quantity") * 10).cast("bigint").alias("duration_ds"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("length_u"),
    )


def marks(spark, sf_dir: str) -> DataFrame:
    """node, bit."""
    return table(spark, sf_dir, "part").where("p_size <= 18").select(F.col("p_partkey").alias("node"), (F.col("p_size") % BITS).alias("bit"))


def pairs(spark, sf_dir: str) -> DataFrame:
    """from_node, to_node, cost: the cheapest of parallel edges."""
    return edges(spark, sf_dir).groupBy("from_node", "to_node").agg(F.min("duration_ds").alias("cost"))


def hits(spark, sf_dir: str) -> DataFrame:
    """user_id, pos, mask: events in order, with the bit of their type."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    bit = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("pos"), F.call_function("shiftleft", F.lit(1), bit.cast("int")).alias("mask"), "event_type", "value")


_TIES = ", ".join(TIES)
LINES = f"lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) - 1 AS pos FROM lineitem)"
EDGES = f"""{LINES}, edges AS (
  SELECT l_orderkey || '/' || pos || '/0/' || l_partkey || '/' || to_node AS edge_id, l_orderkey AS route, pos, l_partkey AS from_node, to_node,
    CAST(round(l_quantity * 10) AS BIGINT) AS duration_ds, CAST(round(l_extendedprice * 100) AS BIGINT) AS length_u
  FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY pos) AS to_node FROM lines) WHERE to_node IS NOT NULL
)"""
MARKS = "marks AS (SELECT p_partkey AS node, p_size % 18 AS bit FROM part WHERE p_size <= 18)"
PAIRS = f"{EDGES}, pairs AS (SELECT from_node, to_node, min(duration_ds) AS cost FROM edges GROUP BY ALL)"
_LIST = ", ".join(f"'{e}'" for e in EVENT_TYPES)
HITS = f"""hits AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CAST(1 << CAST(list_position([{_LIST}], event_type) - 1 AS INTEGER) AS INTEGER) AS mask, event_type, value FROM events)"""
