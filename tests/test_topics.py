import numpy as np
from pyspark.sql import functions as F

from edgeloom.operators import features, models, topics


def texts(n, rng):
    """Two subjects, each with many words of its own of which a text has few, among common ones."""
    label = rng.integers(0, 2, n)
    words = [[*(f"s{y}w{i}" for i in rng.integers(0, 150, 6)), *(f"common{i}" for i in rng.integers(0, 40, 14)), "[PAD]"] for y in label]
    return [(i, w, int(y)) for i, (w, y) in enumerate(zip(words, label, strict=True))]


def f1(df):
    t, p, r = (df.filter(x).count() for x in ("label = 1 and predicted_label = 1", "predicted_label = 1", "label = 1"))
    return 2 * t / (p + r)


def test_directions_are_those_of_the_table(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(texts(150, rng), "id long, tokens array<string>, label int").repartition(3)
    terms = 64
    idf = np.linspace(1, 2, terms)
    weighed = topics._weighed(df, "tokens", idf, terms).select("_ids", "_weights")
    dense = np.zeros((150, terms))
    for i, r in enumerate(weighed.collect()):
        dense[i, r["_ids"]] = r["_weights"]
    assert np.allclose((dense**2).sum(axis=1), 1)
    basis = topics.topic_basis(weighed, 3, terms, 12, 0)
    right = np.linalg.svd(dense, full_matrices=False)[2][:3]
    assert np.allclose(np.abs((basis.T * right).sum(axis=1)), 1, atol=1e-3) and np.allclose(basis.T @ basis, np.eye(3), atol=1e-9)


def test_held_out_rows_are_told_apart_better_than_by_hashed_counts(spark):
    df = spark.createDataFrame(texts(700, np.random.default_rng(2)), "id long, tokens array<string>, label int").repartition(4).cache()
    known = lambda d: d.filter("id < 60")
    rest = lambda d: d.filter("id >= 60")
    # all texts are there to learn which words go together; few are labelled
    made = topics.pair_text_topics(df, width=8).cache()
    hashed = features.pair_text_features(df).cache()
    by_topics = models.linear(known(made), rest(made), "text_features", weighted=False)
    by_counts = models.linear(known(hashed), rest(hashed), "text_features", weighted=False)
    assert f1(by_topics) > max(0.8, f1(by_counts) + 0.05)


def test_odd_texts_and_columns(spark):
    rows = [(1, ["a", "b", "a"], 7), (2, None, 7), (3, [], 7), (4, ["[PAD]", None], 7), (5, ["a", "b", "a"], 7)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, `x.y` int").withColumnRenamed("x.y", "other")
    found = {r["id"]: (r["text_features"], r["other"]) for r in topics.pair_text_topics(df, width=2, terms=32).collect()}
    assert found[1] == found[5] and any(found[1][0]) and all(found[i] == ([0.0, 0.0], 7) for i in (2, 3, 4))
    none = topics.pair_text_topics(df, width=2, terms=32, fit_rows=df.limit(0))
    assert {tuple(r["text_features"]) for r in none.collect()} == {(0.0, 0.0)}
    assert topics.pair_text_topics(df.limit(0), width=2, terms=32).filter(F.col("id") > 0).count() == 0


def test_texts_are_made_once_and_sums_do_not_grow_with_parts(spark):
    """Counting, weighing and features read one kept table, and tasks that add up are as many as cores allow, not as the table has parts."""
    made, rng = spark.sparkContext.accumulator(0), np.random.default_rng(3)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(texts(120, rng), "id long, tokens array<string>, label int").repartition(60)
    found = topics.pair_text_topics(df.mapInArrow(counted, df.schema), width=4, terms=256)
    assert found.count() == 120 and found.filter("size(text_features) = 4").count() == 120
    assert made.value == 120
