"""Choice of a few of many edge sets, by counts over membership masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.sets import MASK_BITS, PROGRAM_KEY, wide_masks
from edgeloom.storage import durable

#: Candidates and distinct masks that meet in one task.
BLOCK_SUBSETS, BLOCK_MASKS = 2_048, 50_000


def _bits(masks: pa.Array, members: int) -> np.ndarray:
    """Masks as rows of zeros and ones."""
    words = masks.flatten().to_numpy(zero_copy_only=False).reshape(len(masks), -1)
    places = np.arange(members)
    return (words[:, places // MASK_BITS] >> (places % MASK_BITS) & 1).astype(np.float64)


def _shared(batches: Iterator[pa.RecordBatch], members: int) -> Iterator[pa.RecordBatch]:
    """(left, right, edges) of this task's masks: one row for each two sets."""
    total = np.zeros((members, members))
    for batch in batches:
        if not batch.num_rows:
            continue
        bits = _bits(batch.column(0), members)
        total += bits.T @ (bits * batch.column(1).to_numpy()[:, None])
    left, right = np.triu_indices(members)
    yield pa.RecordBatch.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(total[left, right].astype(np.int64))], names=["left", "right", "edges"])


def shared_counts(histogram: DataFrame, members: int) -> DataFrame:
    """``left``, ``right``, ``edges``: for each two sets (by number, left <= right) the edges in both; a set with itself gives its size.

    ``histogram``: ``mask`` and ``edges``. Each task adds up a table of all pairs from the
    masks it has, so what is shuffled is a table a task, whatever the number of masks.
    """
    shape = "left int, right int, edges long"
    return histogram.select("mask", "edges").mapInArrow(partial(_shared, members=members), shape).groupBy("left", "right").agg(F.sum("edges").alias("edges"))


def _met(_: tuple, table: pa.Table, members: int) -> pa.Table:
    """Union and intersection sizes of a block of candidates over a block of masks."""
    shape = pa.schema([("subset", pa.list_(pa.int32())), ("union_size", pa.int64()), ("intersection_size", pa.int64())])
    asks = pa.compute.is_valid(table["subset"])
    subsets = table.filter(asks)["subset"].combine_chunks()
    own = table.filter(pa.compute.invert(asks))
    if not len(subsets) or not own.num_rows:
        return shape.empty_table()
    bits, edges = _bits(own["mask"].combine_chunks(), members), own["edges"].to_numpy().astype(np.float64)
    chosen = subsets.flatten().to_numpy().reshape(len(subsets), -1)
    wanted = np.zeros((members, len(subsets)))
    wanted[chosen.T, np.arange(len(subsets))] = 1
    union, both = np.zeros(len(subsets)), np.zeros(len(subsets))
    for start in range(0, len(bits), 2_048):
        hits = bits[start : start + 2_048] @ wanted
        part = edges[start : start + 2_048]
        union += part @ (hits > 0)
        both += part @ (hits == chosen.shape[1])
    return pa.table([subsets, pa.array(union.astype(np.int64)), pa.array(both.astype(np.int64))], schema=shape)


def subset_counts(histogram: DataFrame, subsets: DataFrame, members: int) -> DataFrame:
    """``subset`` (array of set numbers, all of one length), ``union_size``, ``intersection_size``.

    Candidates and masks are dealt into blocks, each block of one meets each block of the
    other in a task, and the counts are added up.
    """
    n_masks, n_subsets = -(-histogram.count() // BLOCK_MASKS) or 1, -(-subsets.count() // BLOCK_SUBSETS) or 1
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = histogram.select(deal("mask", n_masks).alias("m"), every(n_subsets).alias("s"), "mask", "edges", F.lit(None).cast("array<int>").alias("subset"))
    ask = subsets.select(deal("subset", n_subsets).alias("s"), every(n_masks).alias("m"), F.lit(None).cast("array<bigint>").alias("mask"), F.lit(None).cast("long").alias("edges"), "subset")
    met = own.unionByName(ask).groupBy("m", "s").applyInArrow(lambda name, table: _met(name, table, members), "subset array<int>, union_size long, intersection_size long")
    return met.groupBy("subset").agg(F.sum("union_size").alias("union_size"), F.sum("intersection_size").alias("intersection_size"))


def _grown(subsets: DataFrame, members: int) -> DataFrame:
    """Each subset with one more set of a higher number."""
    last = F.element_at("subset", -1)
    wider = subsets.filter(last < members - 1).select("subset", F.explode(F.sequence(last + 1, F.lit(members - 1))).alias("_more"))
    return wider.select(F.concat("subset", F.array("_more")).alias("subset"))


def _reached(histogram: DataFrame, pairs: DataFrame, members: int, size: int, least: int) -> int | None:
    """The score of one allowed subset of a size, made from the best pair by adding the set that costs least each time; None if that leads to none."""
    best = pairs.orderBy("score", "subset").first()
    while best is not None and len(best["subset"]) < size:
        own = best["subset"]
        more = [(sorted([*own, i]),) for i in range(members) if i not in own]  # as many as there are sets
        if not more:
            return None
        counts = subset_counts(histogram, histogram.sparkSession.createDataFrame(more, "subset array<int>"), members)
        best = _scored(counts, least).orderBy("score", "subset").first()
    return None if best is None else best["score"]


def _scored(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("intersection_size") >= least).withColumn("score", F.col("union_size") - F.col("intersection_size"))


def best_config_subset(edges: DataFrame, members: Sequence[str], min_intersection: int = 300, max_size: int = 8, member: str = "config_id", key: Sequence[str] = PROGRAM_KEY, min_size: int = 2) -> DataFrame:
    """The subset of ``min_size`` to ``max_size`` sets with the least union minus intersection, for any number of sets.

    Edges are counted by membership mask in one grouping; all else works on the distinct
    masks. One more set never makes the union smaller nor the intersection larger, so a
    subset costs at least as much as each of its own subsets, which share at least as many
    edges. Hence some subset of ``min_size`` sets is as good as any larger one and comes
    before it, and larger ones aren't looked at. Pairs are read off a table of what each
    two sets share. For a greater ``min_size`` subsets grow set by set: those that share
    fewer than ``min_intersection`` edges, or cost more already than an allowed subset
    that is known, can't lead to the best and are left out (branch and bound).

    Of equal costs the smaller subset wins, then the first in order of ``members``.
    Columns: ``members``, ``union_size``, ``intersection_size``, ``score``; no row if no
    subset shares ``min_intersection`` edges.
    """
    shape = "members string, union_size long, intersection_size long, score long"
    if min_size < 2 or min_size > max_size:
        raise ValueError("subsets have 2 sets at least, and max_size at most")
    if len(members) < min_size:
        return edges.sparkSession.createDataFrame([], shape)
    n, names = len(members), F.array(*[F.lit(m) for m in members])
    histogram = durable(wide_masks(edges, members, member, key).groupBy("mask").agg(F.count("*").alias("edges")), "subset-masks")
    shared = durable(shared_counts(histogram, n), "subset-pairs")
    size_of = shared.filter(F.col("left") == F.col("right")).select(F.col("left").alias("i"), F.col("edges").alias("size"))
    pairs = shared.filter(F.col("left") < F.col("right")).join(size_of.toDF("left", "left_size"), "left").join(size_of.toDF("right", "right_size"), "right")
    found = pairs.select(F.array("left", "right").alias("subset"), (F.col("left_size") + F.col("right_size") - F.col("edges")).alias("union_size"), F.col("edges").alias("intersection_size"))
    found = durable(_scored(found, min_intersection), "subset-frontier")
    if min_size > 2:
        most = _reached(histogram, found, n, min_size, min_intersection)
        for _ in range(3, min_size + 1):
            grown = durable(_grown(found if most is None else found.filter(F.col("score") <= most), n), "subset-candidates")
            found = durable(_scored(subset_counts(histogram, grown, n), min_intersection), "subset-frontier")
    best = found.orderBy("score", "subset").limit(1)
    return best.select(F.array_join(F.transform("subset", lambda i: F.element_at(names, i + 1)), ",").alias("members"), "union_size", "intersection_size", "score")
