"""Configurations, precision orders and the false edges that they imply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.sets import dedupe_edges, keep_out, union_edges
from edgeloom.schema import KEY
from edgeloom.storage import durable

#: Pairs of configurations that are sent to every task at most.
MOST_BROADCAST = 100_000


def rest_of_options(options: str | Column, name: str = "analysis") -> Column:
    """A configuration's options without one of them, as a sorted array that can be joined on."""
    entries = F.map_entries(F.col(options) if isinstance(options, str) else options)
    return F.array_sort(F.filter(entries, lambda e: e["key"] != name))


def config_pairs(configs: DataFrame, orders: DataFrame, option: str = "analysis", by: Sequence[str] = ("tool",)) -> DataFrame:
    """Pairs (``coarse``, ``fine``) of configurations that differ only in ``option``, as an order ranks it.

    ``configs``: ``by``, ``config_id``, ``options`` (map). ``orders``: ``option``,
    ``left``, ``right``, where right is the coarser value: the pair is kept if the finer
    configuration has left and the coarser has right. An equality join on the other
    options, instead of comparing all pairs.
    """
    own = configs.select(*by, "config_id", F.col("options")[option].alias("value"), rest_of_options("options", option).alias("rest"))
    coarse = own.select(*by, F.col("config_id").alias("coarse"), F.col("value").alias("right"), "rest")
    fine = own.select(*by, F.col("config_id").alias("fine"), F.col("value").alias("left"), "rest")
    pairs = coarse.join(fine, [*by, "rest"]).filter("coarse <> fine")
    ranked = orders.filter(F.col("option") == option).select("left", "right").distinct()
    return pairs.join(ranked, ["left", "right"], "left_semi").select(*by, "coarse", "fine").distinct()


def derive_false_edges(edges: DataFrame, pairs: DataFrame, by: Sequence[str] = ("tool",), key: Sequence[str] = ("program", *KEY), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Edges of the coarser configuration of each pair that the finer one lacks.

    A configuration that reports nothing counts as empty; a pair for which the finer one
    reports nothing for a program is left out for this program, since nothing can be said.
    One grouping by key gathers which configurations have an edge, a handful each; the
    pairs of its tool are held against that set. The list of pairs is broadcast, so that a
    tool with most edges isn't one key of a shuffle, if it has ``most_broadcast`` rows at
    most; a longer one is joined as Spark sees fit, skewed keys split.
    """
    few = pairs.count() <= most_broadcast
    reported = edges.select(*by, F.col("config_id").alias("fine"), "program").distinct()
    ranked = pairs.groupBy(*by).agg(F.collect_set(F.struct("coarse", "fine")).alias("_pairs"))
    own = edges.groupBy(*by, *key).agg(F.collect_set("config_id").alias("_own"))
    lacking = F.filter("_pairs", lambda p: F.array_contains("_own", p["coarse"]) & ~F.array_contains("_own", p["fine"]))
    made = own.join(F.broadcast(ranked) if few else ranked, list(by)).select(*by, F.explode(lacking).alias("_p"), *key).select(*by, "_p.coarse", "_p.fine", *key)
    return made.join(reported, [*by, "fine", "program"], "left_semi")


def union_false_edges(derived: DataFrame, key: Sequence[str] = ("program", *KEY)) -> DataFrame:
    """Distinct false edges over all tools and pairs."""
    return dedupe_edges(derived.select(*key), key)


def false_for_config(derived: DataFrame, tool: str, config_id: str, key: Sequence[str] = ("program", *KEY)) -> DataFrame:
    """False edges of the pairs whose coarser side is exactly this configuration."""
    return dedupe_edges(derived.filter((F.col("tool") == tool) & (F.col("coarse") == config_id)).select(*key), key)


def transitive_closure(pairs: DataFrame, left: str = "left", right: str = "right", most_rounds: int = 30) -> DataFrame:
    """All pairs that follow by chaining, without self pairs.

    Semi-naive: only pairs found in the last round are chained, to pairs known before and
    after them, so the length covered doubles each round. ``most_rounds`` rounds cover
    chains of 2 ** most_rounds; beyond it an error is raised rather than a part returned.
    """
    known = durable(pairs.select(F.col(left).alias("l"), F.col(right).alias("r")).filter("l <> r").distinct(), "closure")
    for _ in range(most_rounds):
        ahead = known.select(F.col("l").alias("m"), F.col("r").alias("r2"))
        found = known.join(ahead, F.col("r") == F.col("m")).select("l", F.col("r2").alias("r")).filter("l <> r").distinct()
        fresh = durable(keep_out(found, known, ("l", "r")), "closure-round")
        if fresh.isEmpty():
            return known.select(F.col("l").alias(left), F.col("r").alias(right)).orderBy(left, right)
        known = durable(known.unionByName(fresh), "closure")
    raise RuntimeError(f"not closed after {most_rounds} rounds")


def unknown_without_boot(total: DataFrame, true: DataFrame, false: DataFrame, boot: str = "<boot>", key: Sequence[str] = ("program", *KEY)) -> DataFrame:
    """Edges outside both truth sets, boot callers left out."""
    return keep_out(total.filter(~F.col("method").startswith(boot)), union_edges(true, false, key=key), key)
