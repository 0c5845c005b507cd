import numpy as np
import pytest

from edgeloom.operators import cells, density
from edgeloom.operators.components import linked_components


def plain(vectors, epsilon, min_points, min_size):
    """Every row by itself: (core, group as a frozenset) by the definition."""
    n = len(vectors)
    gap = np.zeros((n, n))
    for left in vectors.T:
        gap += (left[:, None] - left[None, :]) ** 2
    near = gap <= epsilon * epsilon
    core = near.sum(axis=1) >= min_points
    of = np.full(n, -1)
    for i in range(n):
        if core[i] and of[i] < 0:
            todo = [i]
            of[i] = i
            while todo:
                at = todo.pop()
                for j in np.flatnonzero(near[at] & core & (of < 0)):
                    of[j] = i
                    todo.append(j)
    out = of.copy()
    for i in np.flatnonzero(~core):
        some = [j for j in np.flatnonzero(near[i] & core)]
        if some:
            out[i] = of[min(some, key=lambda j: (gap[i, j], tuple(vectors[j])))]
    for g in set(out) - {-1}:
        if (out == g).sum() < min_size:
            out[out == g] = -1
    return out


def clusters(labels):
    groups = {}
    for i, label in labels.items():
        groups.setdefault(label, set()).add(i)
    return {frozenset(g) for label, g in groups.items() if label != -1}, groups.get(-1, set())


def blobs(n, rng):
    """Two moons of points, a dense dot, some copies, and scattered noise."""
    angle = rng.random(n) * np.pi
    moons = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    moons[n // 2 :] = [1.0, 0.4] - moons[n // 2 :]
    dot = [3.0, 3.0] + rng.normal(0, 0.01, (n // 5, 2))
    noise = rng.random((n // 10, 2)) * 8 - 4
    made = np.concatenate([moons + rng.normal(0, 0.03, (n, 2)), dot, noise])
    return np.concatenate([made, made[: n // 10], np.repeat([[7.0, 7.0]], 6, axis=0), np.repeat([[9.0, 9.0]], 3, axis=0)])


@pytest.mark.parametrize(("n", "heavy", "block"), [(1_500, 4_000, 4_000), (300, 25, 20)])
def test_as_a_plain_version(spark, monkeypatch, n, heavy, block):
    monkeypatch.setattr(density, "BLOCK", block)
    vectors = blobs(n, np.random.default_rng(6))
    epsilon = 0.12 if n > 1_000 else 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>").repartition(6)
    found = {r["id"]: r["cluster_id"] for r in density.density_clusters(df, epsilon, min_points=5, min_size=5, heavy=heavy).collect()}
    expected = clusters(dict(enumerate(plain(vectors, epsilon, 5, 5).tolist())))
    assert clusters(found) == expected and len(expected[0]) >= 4 and expected[1]


def test_nulls_copies_and_empty_tables(spark):
    rows = [(i, [1.0, 1.0]) for i in range(5)] + [(5, None), (6, [1.0, 1.05]), (7, [4.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found = {r["id"]: r["cluster_id"] for r in density.density_clusters(df, 0.1).collect()}
    assert clusters(found) == ({frozenset({0, 1, 2, 3, 4, 6})}, {5, 7})
    assert density.density_clusters(df.limit(0), 0.1).count() == 0
    none = density.density_clusters(df.filter("id = 5"), 0.1).collect()
    assert [(r["id"], r["cluster_id"]) for r in none] == [(5, -1)]
    only = {r["id"]: r["cluster_id"] for r in density.density_clusters(df, 0.0).collect()}
    assert clusters(only) == ({frozenset(range(5))}, {5, 6, 7})
    assert {r["cluster_id"] for r in density.density_clusters(df, 0.0, min_size=6).collect()} == {-1}


def test_a_chain_is_one_component(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (700, 700)]
    found = linked_components(spark.createDataFrame(links, "src long, dst long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}


def test_cells_hold_all_neighbours():
    rng = np.random.default_rng(1)
    vectors = rng.random((500, 3))
    tree = cells.KdTree(3)
    tree.grow(0, vectors, 0.05, size=20)
    home = tree.home(vectors)
    row, cell = tree.halo(vectors, 0.05)
    inside = set(zip(row.tolist(), cell.tolist(), strict=True))
    for i in range(0, 500, 7):
        for j in np.flatnonzero(np.linalg.norm(vectors - vectors[i], axis=1) <= 0.05):
            assert (j, home[i]) in inside
