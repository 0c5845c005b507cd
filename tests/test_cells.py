import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import cells, cluster

SHAPE = "id long, vector array<double>"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], SHAPE).repartition(5)


def plain(rows, seeds, epsilon):
    return [i for i, r in enumerate(rows) if any(sum((a - b) ** 2 for a, b in zip(r, s, strict=True)) <= epsilon**2 for s in seeds)]


def shares(n, rng, width=5):
    """Vectors whose components add up to 1."""
    made = rng.random((n, width))
    return made / made.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("heavy", [4_000, 20])
@pytest.mark.parametrize("epsilon", [0.05, 1e-8])
def test_as_by_comparing_all(spark, monkeypatch, heavy, epsilon):
    monkeypatch.setattr(cells, "BLOCK", 30)
    rng = np.random.default_rng(2)
    seeds = shares(300, rng)
    rows = np.concatenate([shares(150, rng), seeds[:40] + rng.normal(0, epsilon / 3, (40, 5)), seeds[:5], seeds[:5]])
    found = cells.vectors_near(frame(spark, rows), frame(spark, seeds), epsilon, heavy=heavy)
    expected = {tuple(rows[i]) for i in plain(rows, seeds, epsilon)}
    assert {tuple(r["vec"]) for r in found.collect()} == expected and found.count() == len(expected) > 0
    matched = cluster.near_matches(frame(spark, rows), frame(spark, seeds), epsilon=epsilon)
    assert sorted(r["id"] for r in matched.collect()) == plain(rows, seeds, epsilon)


def test_vectors_with_one_sum_are_spread_and_heavy_cells_are_cut_again(spark):
    rng = np.random.default_rng(3)
    # a sample sees the wide part; nine tenths lie in one corner of it
    points = np.concatenate([shares(400, rng), 0.2 + rng.normal(0, 1e-3, (3_600, 5))])
    known = frame(spark, points).select(F.col("vector").alias("vec"))
    tree = cells.fit_cells(known, 5, 1e-8, heavy=100)
    _, counts = np.unique(tree.home(points), return_counts=True)
    assert counts.max() <= 100 and len(counts) >= 40
    row, cell = tree.halo(points, 1e-8)
    assert set(zip(range(len(points)), tree.home(points), strict=True)) <= set(zip(row.tolist(), cell.tolist(), strict=True))
    assert len(row) < 1.1 * len(points)


def test_points_that_cannot_be_told_apart_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 50)
    rng = np.random.default_rng(4)
    points = 0.5 + rng.normal(0, 1e-4, (600, 3))
    rows = np.concatenate([0.5 + rng.normal(0, 1e-4, (400, 3)), rng.random((100, 3))])
    found = cells.vectors_near(frame(spark, rows), frame(spark, points), 2e-4, heavy=50)
    assert {tuple(r["vec"]) for r in found.collect()} == {tuple(rows[i]) for i in plain(rows, points, 2e-4)}


def test_nulls_lengths_and_empty_tables(spark):
    rows = frame(spark, [[1.0, 2.0], None, [1.0], [9.0, 9.0], [1.0, 2.0], []])
    seeds = frame(spark, [[1.0, 2.0], None, [1.0, 2.0]])
    assert sorted(r["id"] for r in cluster.near_matches(rows, seeds).collect()) == [0, 4]
    assert cluster.near_matches(rows, seeds.limit(0)).count() == 0
    assert cluster.near_matches(rows.limit(0), seeds).count() == 0
    assert sorted(r["id"] for r in cluster.near_matches(rows, seeds, epsilon=0.0).collect()) == [0, 4]
    assert [r["id"] for r in cluster.near_matches(rows, frame(spark, [[]])).collect()] == [5]
