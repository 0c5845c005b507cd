"""Queries of graph features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import filters, graph
from edgeloom.plans.registry import query
from edgeloom.plans.views import EDGE_SQL, raw_edges, table

GRAPH = ("program", "config_id")
SIMPLE_SQL = """simple AS (SELECT program, config_id, method, target, arg_max("offset", row_order * 10 + "offset") AS "offset", count(DISTINCT "offset") AS multi_edges FROM raw_edges GROUP BY program, config_id, method, target)"""
NODE_SQL = """ends AS (SELECT program, config_id, method AS node, 1 AS o, 0 AS i FROM simple UNION ALL SELECT program, config_id, target, 0, 1 FROM simple),
  nodes AS (SELECT program, config_id, node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM ends GROUP BY ALL)"""
SIZE_SQL = """sizes AS (SELECT program, config_id, node_count, edge_count, edge_count / node_count AS avg_degree, edge_count / sites AS avg_l_fanout
    FROM (SELECT program, config_id, count(*) AS edge_count, count(DISTINCT method || '|' || "offset") AS sites FROM simple GROUP BY ALL)
    JOIN (SELECT program, config_id, count(*) AS node_count FROM nodes GROUP BY ALL) USING (program, config_id))"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_edges(spark, sf_dir).select("program", "config_id", "method", "offset", "target", "row_order")


@query("graph_collapse", f"WITH {EDGE_SQL}, {SIMPLE_SQL} SELECT * FROM simple")
def graph_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collapse(_edges(spark, sf_dir), GRAPH)


@query("graph_degrees", f"WITH {EDGE_SQL}, {SIMPLE_SQL}, {NODE_SQL} SELECT * FROM nodes")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.collapse(_edges(spark, sf_dir), GRAPH), GRAPH)


@query("graph_sizes", f"WITH {EDGE_SQL}, {SIMPLE_SQL}, {NODE_SQL}, {SIZE_SQL} SELECT program, config_id, node_count, edge_count, round(avg_degree, 9) AS avg_degree, round(avg_l_fanout, 9) AS avg_l_fanout FROM sizes")
def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = graph.graph_sizes(graph.collapse(_edges(spark, sf_dir), GRAPH), GRAPH)
    return sizes.withColumns({c: F.round(c, 9) for c in ("avg_degree", "avg_l_fanout")})


@query(
    "graph_structural_features",
    f"""WITH {EDGE_SQL}, {SIMPLE_SQL}, {NODE_SQL}, {SIZE_SQL}, fan AS (SELECT program, config_id, method, "offset", count(*) AS n FROM simple GROUP BY ALL)
    SELECT e.program, e.config_id, e.method, e."offset", e.target, s.in_degree AS src_in_degree, s.out_degree AS src_out_degree, d.in_degree AS dest_in_degree, d.out_degree AS dest_out_degree,
      coalesce(fan.n, 0) AS l_fanout, -1 AS depth, 1 AS repeated_edges, m.multi_edges, z.node_count, z.edge_count, round(z.avg_degree, 9) AS avg_degree, round(z.avg_l_fanout, 9) AS avg_l_fanout
    FROM (SELECT DISTINCT program, config_id, method, "offset", target FROM raw_edges) e
    JOIN nodes s ON s.program = e.program AND s.config_id = e.config_id AND s.node = e.method
    JOIN nodes d ON d.program = e.program AND d.config_id = e.config_id AND d.node = e.target
    JOIN simple m ON m.program = e.program AND m.config_id = e.config_id AND m.method = e.method AND m.target = e.target
    LEFT JOIN fan ON fan.program = e.program AND fan.config_id = e.config_id AND fan.method = e.method AND fan."offset" = e."offset"
    JOIN sizes z ON z.program = e.program AND z.config_id = e.config_id""",
)
def graph_structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.structural_features(_edges(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("avg_degree", "avg_l_fanout")})


APP_SQL = SIMPLE_SQL.replace("FROM raw_edges", "FROM raw_edges WHERE NOT starts_with(method, 's/1') AND NOT starts_with(target, 's/1')")


@query("graph_without_platform", f"WITH {EDGE_SQL}, {APP_SQL}, {NODE_SQL} SELECT * FROM nodes")
def graph_without_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.drop_platform_edges(_edges(spark, sf_dir), "s/1")
    return graph.degrees(graph.collapse(kept, GRAPH), GRAPH)


WALK_SQL = """links AS (SELECT 's/' || l_suppkey AS method, 'p/' || l_partkey AS target FROM lineitem WHERE l_returnflag <> 'N'
    UNION SELECT 'p/' || l_partkey, 's/' || l_suppkey FROM lineitem WHERE l_returnflag = 'N'),
  starts AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM links WHERE 's/0' IN (method, target)) THEN 's/0' ELSE 's/1' END AS node),
  walk AS (SELECT node, 0 AS depth FROM starts UNION SELECT l.target, w.depth + 1 FROM walk w JOIN links l ON l.method = w.node WHERE w.depth < 12)"""


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    s, p = (F.concat(F.lit(c), F.col(n).cast("string")) for c, n in (("s/", "l_suppkey"), ("p/", "l_partkey")))
    order = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_order")
    there = line.filter("l_returnflag <> 'N'").select(s.alias("method"), F.col("l_linenumber").cast("long").alias("offset"), p.alias("target"), order)
    back = line.filter("l_returnflag = 'N'").select(p.alias("method"), F.col("l_linenumber").cast("long").alias("offset"), s.alias("target"), order)
    return there.union(back).withColumn("graph_id", F.lit("g"))


@query("graph_choose_roots", f"WITH RECURSIVE {WALK_SQL} SELECT 'g' AS graph_id, node AS root FROM starts")
def graph_choose_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.choose_roots(graph.collapse(walk_edges(spark, sf_dir), ["graph_id"]), ["graph_id"], ("s/0", "s/1"))


@query("graph_depths", f"WITH RECURSIVE {WALK_SQL} SELECT 'g' AS graph_id, node, min(depth) AS depth FROM walk GROUP BY node")
def graph_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    simple = graph.collapse(walk_edges(spark, sf_dir), ["graph_id"])
    return graph.depths(simple, graph.choose_roots(simple, ["graph_id"], ("s/0", "s/1")), ["graph_id"])
