"""Set algebra on edge tables: one shuffle on the key wherever one is enough.

``key`` names the columns that identify an edge, the group (program) included. Grouping
and joining always use the whole key, never the program alone, so that one large program
is dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.schema import KEY

PROGRAM_KEY = ("program", *KEY)
#: Sets that one long of a mask holds.
MASK_BITS = 63


def dealt(edges: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """``edges`` dealt by ``key`` to as many tasks as ``spark.sql.shuffle.partitions`` names, for all groupings by the key that follow.

    The number is given, since Spark merges parts that it numbers itself until there is
    about one a core, and then what a task holds grows with the table.
    """
    return edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    """Equality on a key in which null equals null."""
    conditions = [left[c].eqNullSafe(right[c]) for c in key]
    return reduce(Column.__and__, conditions)


def dedupe_edges(edges: DataFrame, key: Sequence[str] = PROGRAM_KEY, order: str | None = None) -> DataFrame:
    """One row per key. With ``order``, the row that comes first by it; else any."""
    if order is None:
        return edges.dropDuplicates(list(key))
    rest = [c for c in edges.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(F.col(order), *[F.col(c) for c in rest if c != order])).alias("first")
    return edges.groupBy(*key).agg(first).select(*key, *[F.col("first")[c].alias(c) for c in rest]).select(*edges.columns)


def duplicated(edges: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """All rows whose key occurs more than once."""
    keys = edges.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return keep_in(edges, keys, key)


def keep_in(left: DataFrame, right: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``."""
    other = right.select(*key).alias("right_side")
    return left.join(other, same(left, other, key), "left_semi")


def keep_out(left: DataFrame, right: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``; null keys compare as equal, and no row is repeated."""
    other = right.select(*key).alias("right_side")
    return left.join(other, same(left, other, key), "left_anti")


def difference(left: DataFrame, right: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Distinct keys of ``left`` that aren't in ``right``."""
    return left.select(*key).subtract(right.select(*key))


def union_edges(*sets: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Distinct keys of all sets."""
    return reduce(DataFrame.unionByName, [s.select(*key) for s in sets]).dropDuplicates(list(key))


def flagged_union(sides: dict[str, DataFrame], key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Distinct keys of all sides with a 0/1 column per side: a full outer join as one grouping."""
    parts = [df.select(*key, *[F.lit(int(name == other)).alias(other) for other in sides]) for name, df in sides.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(*key).agg(*[F.max(name).alias(name) for name in sides])


def symmetric_difference(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right"), key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Keys on one side only, with a 0/1 column per side."""
    both = flagged_union({names[0]: left, names[1]: right}, key)
    return both.filter(F.col(names[0]) + F.col(names[1]) == 1)


def membership(edges: DataFrame, member: str = "config_id", group: Sequence[str] = ("program",), key: Sequence[str] = KEY) -> DataFrame:
    """Per key, in how many sets it lies (``n``), of how many that aren't empty in its group (``of``). Repeated rows count once."""
    per_key = dealt(edges.select(*group, *key, member), [*group, *key]).groupBy(*group, *key).agg(F.count_distinct(member).alias("n"))
    total = edges.select(*group, member).distinct().groupBy(*group).agg(F.count("*").alias("of"))
    return per_key.join(total, list(group))


def intersection(edges: DataFrame, member: str = "config_id", group: Sequence[str] = ("program",), key: Sequence[str] = KEY) -> DataFrame:
    """Keys that lie in every set of their group: one grouping instead of a chain of joins."""
    return membership(edges, member, group, key).filter("n = of").drop("n", "of")


def disagreement(edges: DataFrame, member: str = "config_id", group: Sequence[str] = ("program",), key: Sequence[str] = KEY) -> DataFrame:
    """Keys of the union that some set of their group lacks."""
    return membership(edges, member, group, key).filter("n < of").drop("n", "of")


def membership_masks(edges: DataFrame, members: Sequence[str], member: str = "config_id", key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Per key, a long whose bit i says that it lies in the set ``members[i]`` (63 sets at most)."""
    if len(members) > 63:
        raise ValueError("a mask holds 63 sets")
    bits = F.create_map(*[x for i, m in enumerate(members) for x in (F.lit(m), F.lit(1 << i).cast("long"))])
    return edges.filter(F.col(member).isin(list(members))).groupBy(*key).agg(F.bit_or(bits[F.col(member)]).alias("mask"))


def exclusive_counts(edges: DataFrame, members: Sequence[str], member: str = "config_id", key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """How many edges lie in exactly each subset of the sets."""
    return membership_masks(edges, members, member, key).groupBy("mask").agg(F.count("*").alias("edges"))


def wide_masks(edges: DataFrame, members: Sequence[str], member: str = "config_id", key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Per key, ``mask``: an array of longs of ``MASK_BITS`` bits each; bit i says that it lies in the set ``members[i]``. For any number of sets.

    Each long is merged by its own "or", so masks are put together where the rows are and
    again after the shuffle. The list of sets is a table with a row for each.
    """
    numbered = [(m, i // MASK_BITS, 1 << i % MASK_BITS) for i, m in enumerate(members)]
    places = edges.sparkSession.createDataFrame(numbered, "_member string, _word int, _bit long")
    words = range(-(-len(members) // MASK_BITS))
    placed = edges.select(*key, F.col(member).cast("string").alias("_member")).join(F.broadcast(places), "_member")  # a row for each set of the caller's list
    merged = placed.groupBy(*key).agg(*[F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"_word{w}") for w in words])
    return merged.select(*key, F.array(*[F.col(f"_word{w}") for w in words]).alias("mask"))


def wide_exclusive_counts(edges: DataFrame, members: Sequence[str], member: str = "config_id", key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """How many edges lie in exactly each subset of the sets, for any number of sets; ``sets``: the numbers of those in the subset, from 0."""
    counts = wide_masks(edges, members, member, key).groupBy("mask").agg(F.count("*").alias("edges"))
    places = F.flatten(F.transform("mask", lambda word, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(MASK_BITS - 1)), lambda b: F.getbit(word, b) == 1), lambda b: w * MASK_BITS + b)))
    return counts.select("mask", places.alias("sets"), "edges")


def compare_sets(left: DataFrame, right: DataFrame, group: Sequence[str] = ("program",), key: Sequence[str] = PROGRAM_KEY, extra: Sequence[str] = ()) -> DataFrame:
    """Per group, the edges in both sets, in the left only and in the right only."""
    by = [*group, *extra]
    both = flagged_union({"in_left": left, "in_right": right}, [*key, *extra])
    return both.groupBy(*by).agg(
        F.count_if((F.col("in_left") == 1) & (F.col("in_right") == 1)).alias("both"),
        F.count_if((F.col("in_left") == 1) & (F.col("in_right") == 0)).alias("only_left"),
        F.count_if((F.col("in_left") == 0) & (F.col("in_right") == 1)).alias("only_right"),
    )
