import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import cluster, evaluate, features, models, neighbours, ranks

KEY = ["id"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two well separated groups, a third of them unknown."""
    side = F.when(F.col("id") % 2 == 0, 3.0).otherwise(-3.0)
    noise = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0) - 0.5
    vector = F.array(side + noise(1), noise(2), noise(3))
    label = F.when(F.col("id") % 3 == 0, -1).otherwise((F.col("id") % 2 == 0).cast("int"))
    return spark.range(240).select("id", vector.alias("vector"), label.alias("label"))


def right(df):
    known = df.filter("label <> -1")
    return known.filter("label = predicted_label").count() / known.count()


def test_supervised_models_separate(rows):
    train = rows.filter("label <> -1")
    for fit in (lambda a, b: models.forest(a, b, trees=5), models.linear):
        assert right(fit(train, rows)) > 0.97
    assert right(models.cluster_then_label(train, rows)) > 0.97


def test_one_class_keeps_the_stated_share(rows):
    true = rows.filter("label = 1")
    found = models.one_class(true, rows, nu=0.1)
    kept = found.filter("label = 1 and predicted_label = 1").count() / true.count()
    assert 0.85 <= kept <= 0.95 and found.filter("label = 0 and predicted_label = 1").count() == 0


def test_seed_votes(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 0, True), (2, 1, True), (2, 1, True), (2, 0, True), (3, 1, False), (-1, 1, True)], "cluster_id int, label int, is_seed boolean")
    assert {r[0]: r[1] for r in cluster.seed_vote(df).collect()} == {1: 0, 2: 1, 3: 0}
    assert {r[0]: r[1] for r in cluster.seed_vote(df, true_only=True).collect()} == {1: 1, 2: 1, 3: 0}


def test_cluster_rules(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (2, 1), (3, -1)], "cluster_id int, label int")
    by = lambda rule: {r[0]: r[1] for r in cluster.label_clusters(df, rule).collect()}
    assert by("majority") == {1: 1, 2: 0, 3: 1} and by("any") == {1: 1, 2: 1, 3: 0} and by("relative") == {1: 1, 2: 0, 3: 1}


def test_near_matches(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0 + 1e-9]), (3, [1.0, 2.1]), (4, [2.0, 1.0])], "id long, vector array<double>")
    seeds = df.filter("id = 1")
    assert sorted(r["id"] for r in cluster.near_matches(df, seeds).collect()) == [1, 2]
    assert [r["id"] for r in cluster.exact_matches(df, seeds).collect()] == [1]


@pytest.mark.parametrize("cell_points", [2_000, 5])
def test_neighbours_equal_brute_force(spark, monkeypatch, cell_points):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(neighbours, "CELL_POINTS", cell_points)
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 20)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 15)
    points = np.rint(rng.normal(size=(150, 3)) * 4) + rng.integers(3, size=(150, 1)) * 50.0
    points[:40] = points[0]  # copies and ties
    seeds = spark.createDataFrame([(int(i), p.tolist()) for i, p in enumerate(points)] + [(999, None)], "sid long, vector array<double>")
    asked = np.rint(rng.normal(size=(30, 3)) * 30)
    rows = spark.createDataFrame([(int(i), p.tolist()) for i, p in enumerate(asked)], "id long, vector array<double>")
    found = neighbours.nearest_points(rows, seeds, ["id"], 7, order=["sid"], columns=["sid"]).collect()
    for i, p in enumerate(asked):
        gaps = np.sqrt(((points - p) ** 2).sum(axis=1))
        wanted = np.lexsort((np.arange(150), gaps))[:7]
        assert [(r["seed_sid"], r["place"]) for r in sorted(found, key=lambda r: r["place"]) if r["id"] == i] == [(int(w), k + 1) for k, w in enumerate(wanted)]
    assert neighbours.nearest_points(rows, seeds.limit(0), ["id"], 7, order=["sid"], columns=["sid"]).count() == 0
    few = neighbours.nearest_points(rows, seeds.filter("sid in (3, 120)"), ["id"], 7, order=["sid"], columns=["sid"])
    assert few.count() == 60


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(9, size=50)] + [("c", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranked = ranks.ordered_rank(df.filter("v is not null"), ["g"], [F.col("v")])
    for g in ("a", "b", None, "c"):
        own = sorted((r["place"], r["v"]) for r in ranked.collect() if r["g"] == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for _, v in own)
    found = {r["g"]: r for r in ranks.quantiles(df, "v", {"low": 0.1, "mid": 0.5}, ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        own = [v for k, v in rows if k == g and v is not None]
        assert (found[g]["n"], found[g]["low"], found[g]["mid"]) == pytest.approx((len(own), np.quantile(own, 0.1), np.quantile(own, 0.5)))
    assert ranks.quantiles(df, "v", {"mid": 0.5}).first()["mid"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))


def test_programs_stay_apart(spark):
    rows = [(i, p, [1.0], int(i < 4), i < 5) for p in ("x", "y") for i in range(6)] + [(9, "z", [1.0], 1, True)]
    df = spark.createDataFrame([(f"{p}{i}", p, v, lab, s) for i, p, v, lab, s in rows], "id string, program string, vector array<double>, label int, is_seed boolean")
    found = cluster.program_pipeline(df, KEY)
    assert found.count() == 12 and {r["program"] for r in found.collect()} == {"x", "y"}
    assert found.filter("cluster_id <> -1").select("cluster_id").distinct().count() == 2


def test_synthetic_rows_balance_and_lie_between(rows):
    few = rows.filter("label = 0 or (label = 1 and id < 40)")
    made = models.synthetic_minority(few, KEY)
    sizes = {r["label"]: r["n"] for r in few.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert made.count() == sizes[0] - sizes[1]
    assert made.filter(F.col("vector")[0] < 2).count() == 0


def test_standardise_on_training_rows(rows):
    train = rows.filter("id < 100")
    first = features.standardise(rows, "vector", "scaled", train).filter("id < 100").select(F.col("scaled")[0].alias("x"))
    row = first.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert abs(row["m"]) < 1e-9 and abs(row["s"] - 1) < 1e-9


@pytest.mark.parametrize("name", ["feature_standardise", "balance_synthetic"])
def test_small_negative_numbers_round_to_zero_in_sql_too(spark, tmp_path, name):
    import __spark_entry__ as entry

    vectors = {1: [-1.0] * 64, 2: [1.0] * 64, 3: [-3e-7] * 64, 4: [-1e-7] * 64, 5: [-1e-7] * 64}
    spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, int(i > 3), 0) for i in vectors], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = entry.queries()[name](spark, str(tmp_path))
    last = found.columns[-1]
    ours = sorted(repr(list(r[last])) for r in found.collect())
    told = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in told.description].index(last)
    assert ours and ours == sorted(repr(list(r[at])) for r in told.fetchall())


def test_visits_of_many_cells_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(neighbours, "VISITS", 50, raising=False)
    rng = np.random.default_rng(1)
    centres, rows = rng.normal(size=(8, 3)), rng.normal(size=(40, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], names=["_row", "_vec"])
    found = list(neighbours._visited(iter([batch]), centres, np.full(8, 5), np.full(8, 10.0), 3))
    assert max(b.num_rows for b in found) == 50
    visits = [(r["cell"], r["row"], tuple(r["vec"])) for b in found for r in b.to_pylist()]
    assert sorted(visits) == sorted((c, i, tuple(v)) for c in range(8) for i, v in enumerate(rows))


def test_scores_of_configurations_keep_no_vectors(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(evaluate, "durable", lambda df, label: kept.append(df.columns) or df)
    shape = "tool string, config_id string, program string, method string, offset long, target string, true_label int, ground_truth int, predicted_label int, vector array<double>"
    made = spark.createDataFrame([("t", "c", "p", "m", 1, "x", 1, None, 1, [1.0]), ("t", "c", "p", "m", 2, "x", 0, None, 0, [2.0])], shape)
    found = evaluate.per_config_evaluation(made, made.filter("true_label = 1")).collect()
    assert [(r["TP"], r["TN"], r["graph_recall"]) for r in found] == [(1, 1, 1.0)]
    assert kept and all("vector" not in columns for columns in kept)
