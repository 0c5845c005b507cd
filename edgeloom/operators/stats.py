"""Counts and sizes of edge sets, and the choice of a set of configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.operators.sets import membership
from edgeloom.schema import KEY


def distinct_class_counts(labelled: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Distinct true, false, unknown and total edges per program and overall.

    Overall (``program`` "*") the program isn't part of the key, so an edge of two programs
    counts once: it isn't the sum of the programs. Each level takes one grouping by key.
    """
    both = labelled.select("program", *key, "is_true", "is_false").unionByName(labelled.select(F.lit("*").alias("program"), *key, "is_true", "is_false"))
    per_edge = both.groupBy("program", *key).agg(F.bool_or("is_true").alias("t"), F.bool_or("is_false").alias("f"), F.bool_or(~F.col("is_true") & ~F.col("is_false")).alias("u"))
    return per_edge.groupBy("program").agg(
        F.count_if("t").alias("true_edges"), F.count_if("f").alias("false_edges"), F.count_if("u").alias("unknown_edges"), F.count("*").alias("total_edges")
    )


def union_intersection_sizes(edges: DataFrame, member: str = "config_id", group: Sequence[str] = ("program",), key: Sequence[str] = KEY) -> DataFrame:
    """Sizes of the union, the intersection and the disagreement of a group's sets, from one grouping."""
    return membership(edges, member, group, key).groupBy(*group).agg(
        F.count("*").alias("union_size"), F.count_if(F.col("n") == F.col("of")).alias("intersection_size"), F.count_if(F.col("n") < F.col("of")).alias("disagreement_size")
    )


def largest_sets(edges: DataFrame, per_tool: int = 5, tool: str = "tool", member: str = "config_id", key: Sequence[str] = ("program", *KEY)) -> DataFrame:
    """The largest sets of each tool by distinct edges; equal sizes by name. The ranking is over one row per set."""
    sizes = edges.select(tool, member, *key).distinct().groupBy(tool, member).agg(F.count("*").alias("edges"))
    rank = F.row_number().over(Window.partitionBy(tool).orderBy(F.desc("edges"), member))
    return sizes.withColumn("rank", rank).filter(F.col("rank") <= per_tool)


def class_shares(counts: DataFrame, value: str, by: Sequence[str] = (), label: str = "edge_class") -> DataFrame:
    """Count and percent of the group's total for each class."""
    sums = counts.groupBy(*by, label).agg(F.sum(value).alias("edges"))
    total = F.sum("edges").over(Window.partitionBy(*by)) if by else None
    if total is None:
        whole = sums.agg(F.sum("edges").alias("total"))
        return sums.crossJoin(F.broadcast(whole)).select(label, "edges", F.round(100 * F.col("edges") / F.col("total"), 2).alias("percent"))  # one row
    return sums.select(*by, label, "edges", F.round(100 * F.col("edges") / total, 2).alias("percent"))


def melt_mean_pivot(results: DataFrame, ids: Sequence[str], values: Sequence[str], across: str, across_values: Sequence[str]) -> DataFrame:
    """Long form of the value columns, their mean by ids and metric, with one column per value of ``across``."""
    long = results.unpivot([*ids, across], list(values), "metric", "value")
    return long.groupBy(*ids, "metric").pivot(across, list(across_values)).agg(F.avg("value"))
