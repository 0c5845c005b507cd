import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import models, training


def ring(n, rng):
    """Two classes that no line parts: a dot within a ring."""
    angle, inside = rng.random(n) * 2 * np.pi, rng.random(n) < 0.5
    radius = np.where(inside, rng.random(n) * 0.8, 1.6 + rng.random(n) * 0.5)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), inside.astype(int)


def frame(spark, x, y, **more):
    rows = [(i, v.tolist(), int(t), *[c[i] for c in more.values()]) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ", ".join(["id long, vector array<double>, label int", *[f"{k} {t}" for k, t in zip(more, ("double", "int", "string"), strict=False)]])).repartition(4)


def accuracy(df):
    return df.filter(F.col("predicted_label") == F.col("label")).count() / df.count()


@pytest.mark.parametrize("attention", [True, False])
def test_the_network_parts_what_a_line_cannot(spark, attention):
    x, y = ring(900, np.random.default_rng(1))
    df = frame(spark, x, y, strength=np.random.default_rng(2).random(900).tolist()).withColumnRenamed("label", "cluster_label").withColumn("label", F.col("cluster_label"))
    train, test = df.filter("id < 600"), df.filter("id >= 600")
    network = training.weighted_network(train, test, attention=attention, steps=50)
    assert accuracy(network) > 0.95 > 0.7 > accuracy(models.weighted_by_confidence(train, test))
    assert network.filter("confidence < 0 or confidence > 1").count() == 0


def test_weights_decide_whom_the_network_believes(spark):
    rng = np.random.default_rng(3)
    x, y = ring(400, rng)
    # as many rows with the wrong label, which weigh nothing
    both = frame(spark, np.concatenate([x, x]), np.concatenate([y, 1 - y]), strength=[1.0] * 400 + [0.0] * 400).withColumnRenamed("label", "cluster_label")
    test = frame(spark, *ring(200, rng))
    assert accuracy(training.weighted_network(both, test, steps=40)) > 0.95
    none = training.weighted_network(both.withColumn("strength", F.lit(None).cast("double")), test, steps=2)
    assert {(r["predicted_label"], r["confidence"]) for r in none.collect()} == {(0, 0.0)}
    assert {r["predicted_label"] for r in training.weighted_network(both.limit(0), test).collect()} == {0}


def test_slopes_as_by_small_differences():
    rng = np.random.default_rng(4)
    x, y, w, hidden = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float), rng.random(7), 4
    params = rng.normal(size=(1, 3 * hidden + 2 * hidden + 1))
    mean, spread = np.zeros((1, 3)), np.ones((1, 3))

    def loss(p):
        chance = training.network_output(x, p, hidden)[1]
        return -(w * (y * np.log(chance) + (1 - y) * np.log(1 - chance))).sum()

    slope = training._network_slope(0, x, y, w, params, mean, spread, hidden)
    for i in range(params.shape[1]):
        step = np.zeros(params.shape[1])
        step[i] = 1e-6
        assert slope[i] == pytest.approx((loss(params[0] + step) - loss(params[0] - step)) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("nu", [0.1, 0.3])
def test_one_class_rejects_nu_of_its_rows_and_all_far_ones(spark, nu):
    rng = np.random.default_rng(5)
    inside = np.concatenate([rng.normal(0, 0.3, (400, 2)), [3.0, 0.0] + rng.normal(0, 0.3, (400, 2))])
    far = np.concatenate([[1.5, 0.0] + rng.normal(0, 0.1, (50, 2)), [-4.0, 4.0] + rng.normal(0, 0.3, (50, 2))])
    true = frame(spark, inside, np.ones(800))
    own = training.one_class(true, true, nu=nu, steps=25, gamma=2.0)
    assert abs(own.filter("predicted_label = 0").count() / 800 - nu) <= 0.02
    others = training.one_class(true, frame(spark, far, np.zeros(100)), nu=nu, steps=25, gamma=2.0)
    # also what lies between two clouds, near their common mean
    assert others.filter("predicted_label = 1").count() <= 5
    assert own.filter("(confidence >= 0) <> (predicted_label = 1)").count() == 0


def test_one_class_without_rows_or_vectors(spark):
    rows = frame(spark, np.zeros((3, 2)), np.ones(3))
    found = training.one_class(rows.limit(0), rows).collect()
    assert [(r["predicted_label"], r["confidence"]) for r in found] == [(0, None)] * 3
    more = rows.unionByName(spark.createDataFrame([(9, None, 1)], rows.schema))
    assert {(r["id"], r["predicted_label"]) for r in training.one_class(more, more, steps=2).collect()} == {(0, 1), (1, 1), (2, 1), (9, 0)}


def folded(spark, folds, rng):
    x = np.concatenate([rng.normal(0, 0.5, (60, 2)), [2.0, 2.0] + rng.normal(0, 0.5, (60, 2))])
    rows = frame(spark, x, np.repeat([0, 1], 60))
    every = rows.crossJoin(spark.range(folds).select(F.col("id").cast("int").alias("fold")))
    return every.withColumn("role", F.when(F.col("id") % folds == F.col("fold"), "test").otherwise("train"))


def test_folds_in_the_same_jobs_give_what_they_give_one_by_one(spark):
    rows = folded(spark, 3, np.random.default_rng(6))
    show = lambda df: sorted((r["fold"], r["id"], r["predicted_label"], round(r["confidence"], 9)) for r in df.collect())
    for learn in (lambda df, n: training.cluster_folds(df, n), lambda df, n: training.weighted_network(df.filter("role = 'train'"), df.filter("role = 'test'"), label="label", attention=False, confidence="id", fold="fold", folds=n, steps=5)):
        together = show(learn(rows, 3))
        single = [row for i in range(3) for row in show(learn(rows.filter(F.col("fold") == i).withColumn("fold", F.lit(0)), 1).withColumn("fold", F.lit(i)))]
        assert together == single and len(together) == 120
    assert accuracy(training.cluster_folds(rows, 3)) > 0.95


def test_the_number_of_jobs_does_not_grow_with_the_folds(spark):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for folds in (2, 6):
        rows = folded(spark, folds, np.random.default_rng(7))
        spark.sparkContext.setJobGroup(f"folds-{folds}", "")
        training.fit_network(training.staged(rows.filter("role = 'train'"), "vector", F.col("label"), fold="fold"), folds, steps=3)
        jobs.append(len(tracker.getJobIdsForGroup(f"folds-{folds}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] > 0
