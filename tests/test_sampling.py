from pyspark.sql import functions as F

from edgeloom.operators import sampling

KEY = ["id"]


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_exact_sizes_and_same_answer_for_any_partitioning(spark):
    df = spark.range(5000)
    first = ids(sampling.sample_exact(df, 333, KEY))
    assert len(first) == len(set(first)) == 333
    assert first == ids(sampling.sample_exact(df.repartition(17), 333, KEY))
    assert first != ids(sampling.sample_exact(df, 333, KEY, seed=7))
    assert len(ids(sampling.sample_exact(df.limit(10), 333, KEY))) == 10


def test_ranks_are_a_permutation_per_stratum(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 3)
    for row in sampling.hash_rank(df, KEY, by=["s"]).groupBy("s").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect():
        assert row["r"] == list(range(1, len(row["r"]) + 1))


def test_strata_do_not_lend_budget(spark):
    df = spark.range(100).withColumn("source_category", F.when(F.col("id") < 5, "intersection").otherwise("disagreement"))
    found = sampling.stratified_sample(df, 41, key=KEY).groupBy("source_category").count().collect()
    assert {r["source_category"]: r["count"] for r in found} == {"intersection": 5, "disagreement": 21}


def test_refresh_draws_each_row_once(spark):
    df = spark.range(60).withColumn("source_category", F.lit("s"))
    old = sampling.sample_exact(df, 30, KEY).drop("rank")
    now = df.join(old.orderBy("id").limit(20).select("id"), "id", "left_anti")
    new = sampling.refresh_sample(old, now, key=KEY)
    assert len(ids(new)) == len(set(ids(new))) == 30
    assert new.filter("status = 'replaced'").count() == 20
    assert set(ids(new)) <= set(ids(now))
    assert sampling.refresh_sample(old, now.limit(0), key=KEY).filter("status = 'unmatched'").count() == 30


def test_balancing(spark):
    df = spark.range(100).withColumn("label", (F.col("id") < 20).cast("int"))
    count = lambda d: {r["label"]: r["n"] for r in d.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert count(sampling.undersample(df, "label", 0.5, KEY)) == {1: 20, 0: 40}
    assert count(sampling.undersample(df, "label", 0.1, KEY)) == {1: 20, 0: 80}
    assert count(sampling.oversample(df, "label", 1.0, KEY)) == {1: 80, 0: 80}
    assert count(sampling.oversample(df, "label", 0.1, KEY)) == {1: 20, 0: 80}


def test_folds_cover_and_manual_rows_always_test(spark):
    df = spark.range(200).withColumns({"label": F.when(F.col("id") < 50, -1).when(F.col("id") < 120, 1).otherwise(0), "manual": F.col("id") < 5})
    found = sampling.k_fold(df, key=KEY)
    known_tests = found.filter("role = 'test' and label <> -1")
    assert ids(known_tests) == list(range(50, 200))
    assert found.filter("manual and role = 'test'").groupBy("id").count().filter("count = 5").count() == 5
    assert found.filter("role = 'train' and label = -1").count() == 0
