"""Label edges true, false or unknown by set algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.sets import PROGRAM_KEY, flagged_union, keep_out, union_edges
from edgeloom.schema import FALSE, TRUE, UNKNOWN


def label_edges(total: DataFrame, true: DataFrame, false: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """``total`` with ``is_true``, ``is_false`` and ``edge_class``.

    An edge in both truth sets bears both flags and the class "conflict", so either view
    can be taken. The truth sets are merged by one grouping and joined once, however many
    configurations ``total`` holds.
    """
    truth = flagged_union({"is_true": true, "is_false": false}, key)
    flag = lambda name: F.coalesce(F.col(name) == 1, F.lit(False))
    joined = total.join(truth, list(key), "left").withColumns({"is_true": flag("is_true"), "is_false": flag("is_false")})
    return joined.withColumn("edge_class", edge_class(F.col("is_true"), F.col("is_false")))


def edge_class(is_true: Column, is_false: Column) -> Column:
    """Name of the class that two flags make."""
    return F.when(is_true & is_false, "conflict").when(is_true, "true").when(is_false, "false").otherwise("unknown")


def label_column(is_true: Column, is_false: Column) -> Column:
    """1 true, 0 false, -1 unknown; an edge in both sets is false."""
    return F.when(is_false, F.lit(FALSE)).when(is_true, F.lit(TRUE)).otherwise(F.lit(UNKNOWN)).cast("int")


def unknown_edges(total: DataFrame, true: DataFrame, false: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Rows of ``total`` in neither truth set."""
    return keep_out(total, union_edges(true, false, key=key), key)


def class_counts(labelled: DataFrame, by: Sequence[str] = ("program", "tool", "config_id")) -> DataFrame:
    """Edges in all, true, false and unknown by group; an edge in both truth sets counts in both."""
    return labelled.groupBy(*by).agg(
        F.count("*").alias("total_edges"),
        F.count_if("is_true").alias("true_edges"),
        F.count_if("is_false").alias("false_edges"),
        F.count_if(~F.col("is_true") & ~F.col("is_false")).alias("unknown_edges"),
    )
