import numpy as np

from edgeloom.operators.independent import independent_components


def sources(n, rng):
    t = np.arange(n)
    made = np.stack([np.sign(np.sin(t / 7.0)), rng.uniform(-1, 1, n), rng.laplace(size=n)], axis=1)
    return (made - made.mean(axis=0)) / made.std(axis=0)


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>").repartition(4)


def test_mixed_sources_are_found_again_up_to_order_and_sign(spark):
    rng = np.random.default_rng(0)
    known = sources(3_000, rng)
    mixed = known @ np.array([[1.0, 2.0, 0.5, 0.1], [0.3, -1.0, 1.5, 0.7], [0.8, 0.2, -0.6, 1.1]]) + [5.0, -3.0, 0.0, 100.0]
    rows = {r["id"]: r["s"] for r in independent_components(frame(spark, mixed), "vector", "s", 3).collect()}
    found = np.array([rows[i] for i in range(len(known))])
    assert np.abs(found.mean(axis=0)).max() < 1e-9 and np.allclose(np.cov(found.T), np.eye(3), atol=1e-9)
    match = np.abs(np.corrcoef(known.T, found.T)[:3, 3:])
    assert sorted(match.argmax(axis=1)) == [0, 1, 2] and match.max(axis=1).min() > 0.98
    # principal components alone don't part them
    centred = mixed - mixed.mean(axis=0)
    turned = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    assert np.abs(np.corrcoef(known.T, turned.T)[:3, 3:]).max(axis=1).min() < 0.9


def test_fitted_on_training_rows_and_odd_tables(spark):
    rng = np.random.default_rng(1)
    rows = frame(spark, [*(sources(200, rng) @ rng.normal(size=(3, 3))), None])
    train = rows.filter("id < 100")
    found = {r["id"]: r["s"] for r in independent_components(rows, "vector", "s", 2, train, steps=5).collect()}
    assert found[200] is None and len(found) == 201 and {len(v) for v in found.values() if v} == {2}
    own = np.array([found[i] for i in range(100)])
    assert np.allclose(np.cov(own.T), np.eye(2), atol=1e-9)
    assert independent_components(rows.limit(0), "vector", "s").count() == 0
    same = independent_components(frame(spark, [[1.0, 2.0]] * 5), "vector", "s").collect()
    assert [r["s"] for r in same] == [[]] * 5
    # a component that follows from others is left out
    flat = independent_components(frame(spark, [[x, y, x + y] for x, y in rng.normal(size=(50, 2))]), "vector", "s", steps=3).first()
    assert len(flat["s"]) == 2
