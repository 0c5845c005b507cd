import numpy as np


from edgeloom.llm import rp_forest


def brute(ids, vectors, query, k):
    scores = vectors @ vectors[query]
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), scores[i]) for i in order if ids[i] != ids[query]][:k]


def test_small_tables_are_exact_with_copies_and_ties(spark):
    rng = np.random.default_rng(0)
    base = np.rint(rng.normal(size=(150, 6)) * 3)  # whole numbers: ties are exact
    base[20:60] = base[0]
    base[base.any(axis=1) == 0] = 1
    base[70] = 3 * base[71]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)]
    extra = [(1000, None, 1), (1001, [0.0] * 6, 1), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1003, [float("nan")] * 6, 1), (1004, [float("inf")] + [1.0] * 5, 1), (1020, [1.0, 2.0], 1), (None, base[0].tolist(), 1), rows[5]]
    df = spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<double>, rank int")
    found = {}
    for r in rp_forest.nearest(df, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.arange(150)
    assert sorted(found) == list(range(0, 150, 20))
    for q, got in found.items():
        wanted = brute(ids, base, q, 20)
        assert [(i + 1, v) for i, (v, _) in enumerate(wanted)] == [(rank, v) for rank, v, _ in sorted(got)]
        assert np.allclose([s for _, s in wanted], [s for _, _, s in sorted(got)], atol=1e-12)


def test_fewer_rows_than_asked_for_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in rp_forest.nearest(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert rp_forest.nearest(df.limit(0)).count() == 0
    assert rp_forest.nearest(df.filter("vec_id = 0")).count() == 0


def test_recall_of_a_searched_forest():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    points = (centers[rng.integers(40, size=8000)] + 0.3 * rng.normal(size=(8000, 16))).astype(np.float64)
    longest = float(np.linalg.norm(points, axis=1).max())
    lifted = rp_forest.lifted(points, longest)
    forest = rp_forest.fit_forest(lifted[::4], len(points), 8, 64)
    leaves = forest.leaves(lifted)
    hits = total = visited = 0
    for q in range(0, 8000, 400):
        own = rp_forest.np.append(points[q] / np.linalg.norm(points[q]), 0)
        seen = np.zeros(len(points), bool)
        for tree, leaf in forest.visits(own, 120):
            seen |= leaves[:, tree] == leaf
        scores = points @ points[q]
        best = np.argsort(-scores)[:20]
        hits, total, visited = hits + seen[best].sum(), total + 20, visited + seen.sum()
    assert hits / total >= 0.9 and visited / 20 < 0.6 * len(points)


def measured(points, sample_rows, leaf_rows):
    """Recall of the 20 nearest, and share of rows looked at, with as many visits as the operator makes."""
    longest = float(np.linalg.norm(points, axis=1).max())
    lifted = rp_forest.lifted(points, longest)
    step = max(1, len(points) // sample_rows)
    forest = rp_forest.fit_forest(lifted[::step], len(points), leaf_rows=leaf_rows)
    most = rp_forest.visits_needed(forest, points[::step], longest, 20)
    leaves, hits, looked = forest.leaves(lifted), 0, 0
    for q in range(7, len(points), len(points) // 40):
        seen = np.zeros(len(points), bool)
        for tree, leaf in forest.visits(np.append(points[q] / np.linalg.norm(points[q]), 0), most):
            seen |= leaves[:, tree] == leaf
        scores = points @ points[q]
        scores[q] = -np.inf
        hits, looked = hits + seen[np.argsort(-scores)[:20]].sum(), looked + seen.mean()
    return hits / (41 * 20), looked / 41


def test_visits_follow_the_data():
    rng = np.random.default_rng(5)
    free = rng.normal(size=(16_000, 64))
    centers = rng.normal(size=(40, 64))
    dense = centers[rng.integers(40, size=16_000)] + 0.1 * rng.normal(size=(16_000, 64))
    recall, looked = measured(free, 4_000, 16)
    assert recall >= 0.9
    recall, less = measured(dense, 4_000, 16)
    assert recall >= 0.9 and less < 0.8 * looked, (less, looked)


