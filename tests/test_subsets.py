from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from edgeloom.operators import sets, subsets

SHAPE = "program string, method string, offset long, target string, config_id string"


def table(spark, n_sets, n_edges, seed):
    """Edges in blocks that lie in similar sets; and, by edge, its sets."""
    rng = np.random.default_rng(seed)
    kinds = rng.random((9, n_sets)) < rng.random(n_sets) * 0.8
    rows, members = [], {}
    for e in range(n_edges):
        own = np.flatnonzero(kinds[e % 9] ^ (rng.random(n_sets) < 0.1))
        if len(own):
            members[e] = frozenset(own.tolist())
            rows += [("p", f"m{e}", e % 7, "t", f"c{i}") for i in own]
    return spark.createDataFrame(rows + rows[:50], SHAPE), members, [f"c{i}" for i in range(n_sets)]


def plain(members, names, least, low, high):
    """Every subset in turn; strictly less wins."""
    best = None
    for size in range(low, high + 1):
        for chosen in combinations(range(len(names)), size):
            wanted = set(chosen)
            both = sum(wanted <= own for own in members.values())
            if both >= least:
                union = sum(bool(wanted & own) for own in members.values())
                if best is None or union - both < best[3]:
                    best = (",".join(names[i] for i in chosen), union, both, union - both)
    return [best] if best else []


@pytest.mark.parametrize(("least", "low", "high", "seed"), [(5, 2, 4, 1), (1, 3, 4, 2), (8, 4, 5, 3), (10_000, 2, 3, 4), (10_000, 4, 4, 4), (0, 3, 3, 5)])
def test_the_best_subset_of_ten_as_by_trying_all(spark, least, low, high, seed):
    edges, members, names = table(spark, 10, 120, seed)
    found = subsets.best_config_subset(edges, names, least, high, min_size=low)
    assert [tuple(r) for r in found.collect()] == plain(members, names, least, low, high)


def test_fifteen_sets_as_by_trying_all(spark):
    edges, members, names = table(spark, 15, 90, 7)
    found = subsets.best_config_subset(edges, names, 3, 8)
    assert [tuple(r) for r in found.collect()] == plain(members, names, 3, 2, 4)


def test_forty_sets_and_more_than_a_long_holds(spark, monkeypatch):
    monkeypatch.setattr(subsets, "BLOCK_SUBSETS", 50)
    monkeypatch.setattr(subsets, "BLOCK_MASKS", 40)
    for n in (40, 70):
        edges, members, names = table(spark, n, 200, n)
        assert [tuple(r) for r in subsets.best_config_subset(edges, names, 4, 8).collect()] == plain(members, names, 4, 2, 2)
    assert [tuple(r) for r in subsets.best_config_subset(edges, names, 4, 8, min_size=3).collect()] == plain(members, names, 4, 3, 3)


def test_few_sets_and_empty_tables(spark):
    edges, _, names = table(spark, 5, 30, 1)
    assert subsets.best_config_subset(edges.limit(0), names, 1).count() == 0
    assert subsets.best_config_subset(edges, names[:1], 0).count() == 0
    with pytest.raises(ValueError):
        subsets.best_config_subset(edges, names, 1, 8, min_size=1)


@pytest.mark.parametrize("n_sets", [5, 63, 64, 200])
def test_exclusive_counts_of_any_number_of_sets(spark, n_sets):
    edges, members, names = table(spark, n_sets, 150, n_sets)
    found = sets.wide_exclusive_counts(edges, names)
    assert {tuple(r["sets"]): r["edges"] for r in found.collect()} == Counter(tuple(sorted(own)) for own in members.values())
    if n_sets <= 63:
        narrow = sets.exclusive_counts(edges, names)
        assert {r["mask"]: r["edges"] for r in narrow.collect()} == {r["mask"][0]: r["edges"] for r in found.collect()}


def test_a_batch_without_masks_adds_nothing():
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.list_(pa.int64())), pa.array([], pa.int64())], names=["mask", "edges"])
    full = pa.RecordBatch.from_arrays([pa.array([[3], [1]], pa.list_(pa.int64())), pa.array([5, 2], pa.int64())], names=["mask", "edges"])
    shared = [r for b in subsets._shared(iter([empty, full, empty]), 2) for r in b.to_pylist()]
    assert [(r["left"], r["right"], r["edges"]) for r in shared] == [(0, 0, 7), (0, 1, 5), (1, 1, 5)]
