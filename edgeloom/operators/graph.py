"""Structural features of edges, for many graphs in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import durable

#: Root methods by priority: fixed values.
ROOTS = ("Entrypoint.entrypoint:(Ljava/lang/String;)V", "Entrypoint.entrypoint:(Ljava/io/File;)V")


def collapse(edges: DataFrame, graph: Sequence[str], order: str = "row_order") -> DataFrame:
    """The simple digraph: one edge per (method, target) with the offset that came last, ties by larger offset.

    ``multi_edges`` counts the offsets that were merged. ``order`` must be given by the
    data (file and line, or a key), never by where a row happens to be read.
    """
    return edges.groupBy(*graph, "method", "target").agg(F.max_by("offset", F.struct(order, "offset")).alias("offset"), F.count_distinct("offset").alias("multi_edges"))


def degrees(simple: DataFrame, graph: Sequence[str]) -> DataFrame:
    """In and out degree of every node; a self-loop counts on both sides."""
    ends = simple.select(*graph, F.explode(F.array(F.struct(F.col("method").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(*graph, F.col("e.node").alias("node")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def graph_sizes(simple: DataFrame, graph: Sequence[str]) -> DataFrame:
    """Nodes, edges, edges per node, and edges per distinct (method, last offset), one row per graph."""
    return _sizes(degrees(simple, graph), simple.groupBy(*graph, "method", "offset").agg(F.count("*").alias("l_fanout")), graph)


def _sizes(node: DataFrame, fanout: DataFrame, graph: Sequence[str]) -> DataFrame:
    nodes = node.groupBy(*graph).agg(F.count("*").alias("node_count"))
    sites = fanout.groupBy(*graph).agg(F.sum("l_fanout").alias("edge_count"), F.count("*").alias("sites"))
    return sites.join(nodes, list(graph)).select(
        *graph, "node_count", "edge_count", (F.col("edge_count") / F.col("node_count")).alias("avg_degree"), (F.col("edge_count") / F.col("sites")).alias("avg_l_fanout")
    )


def choose_roots(simple: DataFrame, graph: Sequence[str], candidates: Sequence[str] = ROOTS) -> DataFrame:
    """The first of the candidates that is a node of each graph; graphs without one are left out."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("node"))
    nodes = simple.select(*graph, F.explode(F.array("method", "target")).alias("node")).filter(F.col("node").isin(list(candidates)))
    return nodes.groupBy(*graph).agg(F.min_by("node", rank).alias("root"))


def depths(simple: DataFrame, roots: DataFrame, graph: Sequence[str], most_rounds: int = 1000) -> DataFrame:
    """Distance of every reached node from its graph's root: breadth first, all graphs in one loop.

    Each round joins the frontier with the edges, drops what was reached before and is
    written to the shared folder, so that a lost executor costs one round. Raises an error
    rather than return a part when ``most_rounds`` isn't enough.
    """
    links = durable(simple.select(*graph, "method", F.col("target").alias("node")).distinct(), "graph-links")
    frontier = durable(roots.select(*graph, F.col("root").alias("node"), F.lit(0).alias("depth")), "graph-frontier")
    rounds = [frontier]
    reached = frontier
    for depth in range(1, most_rounds + 1):
        ahead = links.join(frontier.select(*graph, F.col("node").alias("method")), [*graph, "method"]).select(*graph, "node").distinct()
        frontier = durable(ahead.join(reached.select(*graph, "node"), [*graph, "node"], "left_anti").withColumn("depth", F.lit(depth)), "graph-frontier")
        if frontier.isEmpty():
            return reached
        rounds.append(frontier)
        reached = reached.unionByName(frontier)
        if depth % 20 == 0:
            reached = durable(reached, "graph-reached")
    raise RuntimeError(f"graph deeper than {most_rounds}")


def structural_features(edges: DataFrame, roots: DataFrame | None = None, graph: Sequence[str] = ("program", "config_id"), order: str = "row_order") -> DataFrame:
    """Eleven measures per input edge, taken on the collapsed graph.

    An edge whose offset was overwritten gets the fan-out of its own offset, possibly 0.
    ``repeated_edges`` is 1 by construction; ``multi_edges`` is the real number of
    offsets. ``depth`` is that of the calling end, -1 where the root doesn't reach it;
    graphs without a root are left out when roots are asked for.
    """
    keys = [*graph, "method", "offset", "target"]
    # one row per (method, target), with all its offsets; a null offset is one of them
    last = F.max_by("offset", F.struct(order, "offset")).alias("offset")
    pairs = edges.groupBy(*graph, "method", "target").agg(last, F.collect_set(F.struct("offset")).alias("offsets"))
    simple = durable(pairs, "graph-simple")
    node = durable(degrees(simple, graph), "graph-nodes")
    fanout = durable(simple.groupBy(*graph, "method", "offset").agg(F.count("*").alias("l_fanout")), "graph-fanout")
    sites = F.map_from_entries(F.collect_list(F.struct("offset", "l_fanout"))).alias("_sites")  # a method's own offsets
    at = fanout.filter("offset is not null").groupBy(*graph, "method").agg(sites)
    callers = node.filter("out_degree > 0").select(*graph, F.col("node").alias("method"), F.col("in_degree").alias("src_in_degree"), F.col("out_degree").alias("src_out_degree"))
    callees = durable(node.filter("in_degree > 0").select(*graph, F.col("node").alias("target"), F.col("in_degree").alias("dest_in_degree"), F.col("out_degree").alias("dest_out_degree")), "graph-callees")
    number = F.size(F.filter("offsets", lambda o: o["offset"].isNotNull())).cast("long")
    joined = simple.drop("offset").withColumn("multi_edges", number).join(callers.join(at, [*graph, "method"], "left"), [*graph, "method"], "left").join(callees, [*graph, "target"], "left")
    out = joined.join(_sizes(node, fanout, graph), list(graph), "left")
    if roots is not None:
        found = depths(simple, roots, graph)
        out = out.join(roots.select(*graph), list(graph), "left_semi").join(found.select(*graph, F.col("node").alias("method"), "depth"), [*graph, "method"], "left")
    else:
        out = out.withColumn("depth", F.lit(None).cast("int"))
    out = out.withColumn("_o", F.explode("offsets")).withColumn("offset", F.col("_o.offset"))
    out = out.withColumn("l_fanout", F.when(F.col("offset").isNotNull(), F.element_at("_sites", F.col("offset"))))
    zero = ["src_in_degree", "src_out_degree", "dest_in_degree", "dest_out_degree", "l_fanout"]
    return out.select(
        *keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.lit(1).alias("repeated_edges"), "multi_edges", "node_count", "edge_count", "avg_degree", "avg_l_fanout",
    )
