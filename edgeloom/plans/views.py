"""Edge views over the TPC-H-like test tables, as Spark plans and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_returnflag").alias("program"),
        F.lit("ship").alias("tool"),
        F.concat(F.lit("v"), (F.year("l_shipdate") - 1994).cast("string")).alias("config_id"),
        F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("method"),
        F.col("l_linenumber").cast("long").alias("offset"),
        F.concat(F.lit("b/"), F.col("p_brand")).alias("target"),
        "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row_order"),
    )


IDENTITY = ("program", "method", "offset", "target")


def total_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """program, tool, config_id and key: a configuration is a ship year, a program a return flag."""
    return _edges(spark, sf_dir).select("program", "tool", "config_id", *IDENTITY[1:]).distinct()


def true_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter("l_linestatus = 'F' and l_quantity <= 15").select(*IDENTITY).distinct()


def false_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter("l_linestatus = 'O' and l_quantity >= 40").select(*IDENTITY).distinct()


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows before any dedupe, with row_order and the figures of the line item."""
    return _edges(spark, sf_dir)


RAW_SQL = """
raw_edges AS (
  SELECT l_returnflag AS program, 'ship' AS tool, 'v' || CAST(year(l_shipdate) - 1994 AS varchar) AS config_id,
         's/' || CAST(l_suppkey AS varchar) AS method, CAST(l_linenumber AS bigint) AS "offset", 'b/' || p_brand AS target,
         l_linestatus, l_quantity, l_discount, l_tax, l_extendedprice, CAST(l_orderkey * 10 + l_linenumber AS bigint) AS row_order
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EDGE_SQL = (
    RAW_SQL
    + """,
total_edges AS (SELECT DISTINCT program, tool, config_id, method, "offset", target FROM raw_edges),
true_edges AS (SELECT DISTINCT program, method, "offset", target FROM raw_edges WHERE l_linestatus = 'F' AND l_quantity <= 15),
false_edges AS (SELECT DISTINCT program, method, "offset", target FROM raw_edges WHERE l_linestatus = 'O' AND l_quantity >= 40),
labelled AS (
  SELECT t.*, y.program IS NOT NULL AS is_true, n.program IS NOT NULL AS is_false
  FROM total_edges t
  LEFT JOIN true_edges y USING (program, method, "offset", target)
  LEFT JOIN false_edges n USING (program, method, "offset", target))"""
)
