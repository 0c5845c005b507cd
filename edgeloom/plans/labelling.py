"""Queries of the labelling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import configs, labels, stats
from edgeloom.plans.registry import query
from edgeloom.plans.views import EDGE_SQL, false_edges, table, total_edges, true_edges
from edgeloom.schema import KEY
from edgeloom.storage import durable


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_edges(total_edges(spark, sf_dir), true_edges(spark, sf_dir), false_edges(spark, sf_dir))


COUNTS_SQL = """count(*) AS total_edges, count(*) FILTER (is_true) AS true_edges, count(*) FILTER (is_false) AS false_edges,
  count(*) FILTER (NOT is_true AND NOT is_false) AS unknown_edges"""


@query("label_class_counts", f"WITH {EDGE_SQL} SELECT program, tool, config_id, {COUNTS_SQL} FROM labelled GROUP BY ALL")
def label_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: label every edge of every configuration and count the classes."""
    return labels.class_counts(labelled(spark, sf_dir))


@query("label_edges", f"WITH {EDGE_SQL} SELECT *, CASE WHEN is_true AND is_false THEN 'conflict' WHEN is_true THEN 'true' WHEN is_false THEN 'false' ELSE 'unknown' END AS edge_class FROM labelled")
def label_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir)


@query("label_column", f'WITH {EDGE_SQL} SELECT program, tool, config_id, method, "offset", target, CASE WHEN is_false THEN 0 WHEN is_true THEN 1 ELSE -1 END AS label FROM labelled')
def label_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labelled(spark, sf_dir)
    return found.select("program", "tool", "config_id", *KEY, labels.label_column(F.col("is_true"), F.col("is_false")).alias("label"))


@query("label_unknown_edges", f'WITH {EDGE_SQL} SELECT program, tool, config_id, method, "offset", target FROM labelled WHERE NOT is_true AND NOT is_false')
def label_unknown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.unknown_edges(total_edges(spark, sf_dir), true_edges(spark, sf_dir), false_edges(spark, sf_dir))


@query("label_unknown_without_boot", f"WITH {EDGE_SQL} SELECT program, tool, config_id, method, \"offset\", target FROM labelled WHERE NOT is_true AND NOT is_false AND NOT starts_with(method, 's/1')")
def label_unknown_without_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.unknown_without_boot(total_edges(spark, sf_dir), true_edges(spark, sf_dir), false_edges(spark, sf_dir), "s/1")


def config_table(edges: DataFrame) -> DataFrame:
    """One configuration per ship year: option ``analysis`` is the year's place, ``reflection`` groups the years."""
    ids = edges.select("tool", "config_id").distinct()
    year = F.substring("config_id", 2, 3).cast("int")
    options = F.create_map(F.lit("analysis"), F.concat(F.lit("a"), (year - 1).cast("string")), F.lit("reflection"), F.when(year <= 4, "on").otherwise("off"))
    return ids.select("tool", "config_id", options.alias("options"))


ORDERS = [("analysis", "a3", "MPT", "a4"), ("analysis", "a4", "MPT", "a2"), ("analysis", "a1", "MPT", "a2"), ("analysis", "a6", "MPT", "a5"), ("reflection", "on", "MPT", "off")]
PAIR_SQL = """orders_given("left", "right") AS (VALUES ('a3', 'a4'), ('a4', 'a2'), ('a1', 'a2'), ('a6', 'a5')),
  conf AS (SELECT DISTINCT tool, config_id, 'a' || CAST(CAST(substr(config_id, 2) AS int) - 1 AS varchar) AS analysis, CAST(substr(config_id, 2) AS int) <= 4 AS reflection FROM total_edges),
  pairs AS (SELECT DISTINCT c.tool, c.config_id AS coarse, f.config_id AS fine FROM conf c JOIN conf f ON c.tool = f.tool AND c.reflection = f.reflection JOIN orders_given o ON o."left" = f.analysis AND o."right" = c.analysis)"""
DERIVED_SQL = f"""{PAIR_SQL},
  derived AS (SELECT p.tool, p.coarse, p.fine, e.program, e.method, e."offset", e.target FROM pairs p JOIN total_edges e ON e.tool = p.tool AND e.config_id = p.coarse
    WHERE EXISTS (SELECT 1 FROM total_edges x WHERE x.tool = p.tool AND x.config_id = p.fine AND x.program = e.program)
      AND NOT EXISTS (SELECT 1 FROM total_edges x WHERE x.tool = p.tool AND x.config_id = p.fine AND x.program = e.program AND x.method = e.method AND x."offset" = e."offset" AND x.target = e.target))"""


def orders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORDERS, "option string, left string, order string, right string")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = durable(total_edges(spark, sf_dir), "total-edges")
    return configs.derive_false_edges(edges, configs.config_pairs(config_table(edges), orders(spark)))


@query("config_pairs", f"WITH {EDGE_SQL}, {PAIR_SQL} SELECT * FROM pairs")
def config_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.config_pairs(config_table(total_edges(spark, sf_dir)), orders(spark))


@query("label_derive_false", f"WITH {EDGE_SQL}, {DERIVED_SQL} SELECT * FROM derived")
def label_derive_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir)


@query("label_union_false", f'WITH {EDGE_SQL}, {DERIVED_SQL} SELECT DISTINCT program, method, "offset", target FROM derived')
def label_union_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.union_false_edges(derived(spark, sf_dir))


@query("label_false_for_config", f"WITH {EDGE_SQL}, {DERIVED_SQL} SELECT DISTINCT program, method, \"offset\", target FROM derived WHERE coarse = 'v3'")
def label_false_for_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.false_for_config(derived(spark, sf_dir), "ship", "v3")


@query(
    "label_transitive_closure",
    """WITH RECURSIVE base AS (SELECT 'o' || o_orderkey AS "left", 'c' || o_custkey AS "right" FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
      UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    walk AS (SELECT * FROM base UNION SELECT w."left", b."right" FROM walk w JOIN base b ON w."right" = b."left")
    SELECT "left", "right" FROM walk WHERE "left" <> "right" """,
)
def label_transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order, customer, supplier and nation belongs to, directly or not."""
    named = lambda t, a, left, b, right: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(left).cast("string")).alias("left"), F.concat(F.lit(b), F.col(right).cast("string")).alias("right"))
    links = named("orders", "o", "o_orderkey", "c", "o_custkey").union(named("customer", "c", "c_custkey", "n", "c_nationkey"))
    links = links.union(named("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(named("nation", "n", "n_nationkey", "r", "n_regionkey"))
    return configs.transitive_closure(links.distinct())


@query(
    "stats_distinct_class_counts",
    f"""WITH {EDGE_SQL}, b AS (SELECT program, method, "offset", target, is_true, is_false FROM labelled UNION ALL SELECT '*', method, "offset", target, is_true, is_false FROM labelled),
    e AS (SELECT program, bool_or(is_true) AS t, bool_or(is_false) AS f, bool_or(NOT is_true AND NOT is_false) AS u FROM b GROUP BY program, method, "offset", target)
    SELECT program, count(*) FILTER (t) AS true_edges, count(*) FILTER (f) AS false_edges, count(*) FILTER (u) AS unknown_edges, count(*) AS total_edges FROM e GROUP BY program""",
)
def stats_distinct_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_class_counts(labelled(spark, sf_dir))
