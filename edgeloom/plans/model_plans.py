"""Queries of features, clusters and models, over embeddings and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import cluster, evaluate, features, graph, models, sampling, training
from edgeloom.operators.texts import token_windows
from edgeloom.plans.evaluation_plans import predictions
from edgeloom.plans.graph_plans import GRAPH, _edges
from edgeloom.plans.registry import query
from edgeloom.plans.text_plans import _coded
from edgeloom.plans.views import EDGE_SQL, raw_edges, table, total_edges, true_edges
from edgeloom.storage import durable

KEY = ["vec_id"]
#: Distance at which two vectors of the table count as near.
NEAR = 6e-8


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, program (the embedding's group), vector, and label (quality; -1 where there is none)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("program"), F.col("embedding").cast("array<double>").alias("vector"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("label"))
    return vectors.join(labels, "vec_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


INSTANCE_SQL = "inst AS (SELECT vec_id, e.label AS program, CAST(embedding AS double[]) AS vector, coalesce(l.quality, -1) AS label FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id)"


def block_sums() -> list[Column]:
    """Sums of the four quarters of a vector of 64 components."""
    return [F.aggregate(F.slice("vector", 16 * i + 1, 16), F.lit(0.0), lambda a, x: a + x) for i in range(4)]


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with vectors of the signs of four sums over all components, so that many are equal."""
    signs = F.array(*[F.when(x > 0, 1.0).otherwise(0.0) for x in block_sums()])
    return instances(spark, sf_dir).withColumn("vector", signs).withColumn("is_seed", F.col("vec_id") % 2 == 0)


COARSE_SQL = f"{INSTANCE_SQL}, coarse AS (SELECT vec_id, program, label, list_transform([list_sum(vector[1:16]), list_sum(vector[17:32]), list_sum(vector[33:48]), list_sum(vector[49:64])], lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vector, vec_id % 2 = 0 AS is_seed FROM inst), groups AS (SELECT *, count(*) OVER (PARTITION BY vector) AS n FROM coarse)"


@query("feature_attach", f"""WITH {EDGE_SQL}, f AS (SELECT program, config_id, method, "offset", target, min(l_tax)::DOUBLE AS tax FROM raw_edges GROUP BY ALL), s AS (SELECT program, config_id, method, "offset", target, max(l_discount)::DOUBLE AS discount FROM raw_edges WHERE l_quantity > 25 GROUP BY ALL)
    SELECT t.*, f.tax, s.discount FROM total_edges t JOIN f USING (program, config_id, method, "offset", target) LEFT JOIN s USING (program, config_id, method, "offset", target)""")
def feature_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["program", "config_id", "method", "offset", "target"]
    raw = raw_edges(spark, sf_dir)
    structural = raw.groupBy(*key).agg(F.min("l_tax").cast("double").alias("tax"))
    semantic = raw.filter("l_quantity > 25").groupBy(*key).agg(F.max("l_discount").cast("double").alias("discount"))
    return features.attach_features(total_edges(spark, sf_dir), structural, semantic, key)


@query("feature_standardise", f"WITH {INSTANCE_SQL}, x AS (SELECT vec_id, unnest(vector) AS v, generate_subscripts(vector, 1) AS i FROM inst), z AS (SELECT vec_id, i, round((v - avg(v) OVER (PARTITION BY i)) / stddev_pop(v) OVER (PARTITION BY i), 6) + 0.0::DOUBLE AS v FROM x) SELECT vec_id, list(v ORDER BY i) AS scaled FROM z GROUP BY vec_id")
def feature_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = features.standardise(instances(spark, sf_dir), "vector", "scaled")
    return scaled.select("vec_id", F.transform("scaled", lambda x: F.round(x, 6)).alias("scaled"))


@query("feature_combine", f"WITH {INSTANCE_SQL} SELECT vec_id, list_concat(CASE WHEN vec_id % 3 = 0 THEN list_resize([0.0::DOUBLE], 32, 0.0::DOUBLE) ELSE vector[1:32] END, vector[33:64]) AS combined FROM inst")
def feature_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instances(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.slice("vector", 1, 32)).alias("semantic"), F.slice("vector", 33, 32).alias("structural"))
    return features.combine(rows, "semantic", "structural", "combined", 32, 32).select("vec_id", "combined")


@query("feature_reduce")
def feature_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.reduce_width(instances(spark, sf_dir), "vector", "reduced", 50).select("vec_id", "reduced")


@query("feature_reduce_distances", f"WITH {INSTANCE_SQL} SELECT a.vec_id, round(list_distance(a.vector, b.vector), 6) AS distance FROM inst a JOIN inst b ON b.vec_id = a.vec_id + 1")
def feature_reduce_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All principal components of every vector: a rotation, so neighbours are as far apart as before, which SQL can check."""
    turned = features.reduce_width(instances(spark, sf_dir), "vector", "turned", 64).select("vec_id", "turned")
    after = turned.select((F.col("vec_id") - 1).alias("vec_id"), F.col("turned").alias("next"))
    gap = F.sqrt(F.aggregate(F.zip_with("turned", "next", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    return turned.join(after, "vec_id").select("vec_id", F.round(gap, 6).alias("distance"))


@query("feature_project")
def feature_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.project(instances(spark, sf_dir).select("vec_id", "vector", "label"), "vector", 64, "label")


@query("feature_pair_text")
def feature_pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["program", "method", "offset", "target"]
    return features.pair_text_features(token_windows(_coded(spark, sf_dir), keys, 64)).select(*keys, "text_features")


@query("cluster_exact_match", f"WITH {COARSE_SQL} SELECT vec_id FROM coarse c WHERE NOT is_seed AND EXISTS (SELECT 1 FROM coarse s WHERE s.is_seed AND s.label = 0 AND s.vector = c.vector)")
def cluster_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coarse(spark, sf_dir)
    return cluster.exact_matches(rows.filter("not is_seed"), rows.filter("is_seed and label = 0")).select("vec_id")


@query("cluster_near_match", f"WITH {INSTANCE_SQL}, seeds AS (SELECT list_transform(vector, lambda x: x + (vec_id % 3) * 5e-9::DOUBLE) AS vector FROM inst WHERE vec_id % 2 = 0) SELECT a.vec_id FROM inst a WHERE EXISTS (SELECT 1 FROM seeds s WHERE list_distance(a.vector, s.vector) <= {NEAR})")
def cluster_near_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against those of even ids, each moved by nothing, a little, or too far."""
    rows = instances(spark, sf_dir)
    seeds = rows.filter("vec_id % 2 = 0").select(F.transform("vector", lambda x: x + (F.col("vec_id") % 3) * F.lit(5e-9)).alias("vector"))
    return cluster.near_matches(rows, seeds, epsilon=NEAR).select("vec_id")


DISTANCE_SQL = f"""{INSTANCE_SQL}, near AS (SELECT q.vec_id, s.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.vector, s.vector)) AS place FROM inst q, inst s WHERE q.label = -1 AND s.label <> -1)"""


@query("cluster_nearest_seed", f"WITH {DISTANCE_SQL} SELECT vec_id, label AS predicted_label, 0.5 AS confidence FROM near WHERE place = 1")
def cluster_nearest_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instances(spark, sf_dir)
    return cluster.nearest_seed_label(rows.filter("label = -1"), rows.filter("label <> -1"), KEY)


@query("cluster_neighbour_vote", f"WITH {DISTANCE_SQL}, v AS (SELECT vec_id, avg(label) AS s FROM near WHERE place <= 5 GROUP BY vec_id) SELECT vec_id, CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS predicted_label, round(greatest(s, 1 - s), 6) AS confidence FROM v")
def cluster_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instances(spark, sf_dir)
    return cluster.neighbour_vote(rows.filter("label = -1"), rows.filter("label <> -1"), KEY).withColumn("confidence", F.round("confidence", 6))


@query("cluster_two_means")
def cluster_two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.two_means(instances(spark, sf_dir)).select("vec_id", "cluster_id")


@query("cluster_dense_groups", f"WITH {COARSE_SQL} SELECT vec_id, n >= 30 AS clustered, CASE WHEN n >= 30 THEN n ELSE 0 END AS size FROM groups")
def cluster_dense_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.dense_groups(coarse(spark, sf_dir), min_size=30)
    sizes = found.filter("cluster_id <> -1").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return found.join(sizes, "cluster_id", "left").select("vec_id", (F.col("cluster_id") != -1).alias("clustered"), F.coalesce("size", F.lit(0)).alias("size"))


def _labelled_clusters(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    named = coarse(spark, sf_dir).withColumn("cluster_id", F.conv(F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ""), 2, 10).cast("int"))
    return cluster.label_clusters(named, rule)


NUMBER_SQL = f"{COARSE_SQL}, named AS (SELECT *, (8 * vector[1] + 4 * vector[2] + 2 * vector[3] + vector[4])::INT AS cluster_id FROM coarse), cells AS (SELECT cluster_id, count(*) FILTER (label = 1) AS t, count(*) FILTER (label = 0) AS f, count(*) FILTER (is_seed AND label = 1) AS st, count(*) FILTER (is_seed) AS sn FROM named GROUP BY cluster_id)"


@query("cluster_label_majority", f"WITH {NUMBER_SQL} SELECT cluster_id, CASE WHEN t >= f THEN 1 ELSE 0 END AS cluster_label FROM cells")
def cluster_label_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_clusters(spark, sf_dir, "majority")


@query("cluster_label_relative", f"WITH {NUMBER_SQL} SELECT cluster_id, CASE WHEN t / (SELECT sum(t) FROM cells) >= f / (SELECT sum(f) FROM cells) THEN 1 ELSE 0 END AS cluster_label FROM cells")
def cluster_label_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_clusters(spark, sf_dir, "relative")


@query("cluster_label_any", f"WITH {NUMBER_SQL} SELECT cluster_id, CASE WHEN t > 0 THEN 1 ELSE 0 END AS cluster_label FROM cells")
def cluster_label_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_clusters(spark, sf_dir, "any")


@query("cluster_seed_vote", f"WITH {NUMBER_SQL} SELECT cluster_id, CASE WHEN sn > 0 AND st > sn // 2 THEN 1 ELSE 0 END AS cluster_label FROM cells")
def cluster_seed_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = coarse(spark, sf_dir).withColumn("cluster_id", F.conv(F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ""), 2, 10).cast("int"))
    return cluster.seed_vote(named)


@query(
    "cluster_flat_pipeline",
    f"""WITH {COARSE_SQL}, votes AS (SELECT vector, CASE WHEN count(*) FILTER (is_seed) > 0 AND count(*) FILTER (is_seed AND label = 1) > count(*) FILTER (is_seed) // 2 THEN 1 ELSE 0 END AS vote FROM groups WHERE n >= 30 GROUP BY vector)
    SELECT g.vec_id, CASE WHEN n >= 30 THEN v.vote WHEN EXISTS (SELECT 1 FROM coarse s WHERE s.is_seed AND s.label = 1 AND s.vector = g.vector) THEN 1 ELSE 0 END AS predicted_label, CASE WHEN n >= 30 THEN 1.0 ELSE 0.0 END AS confidence
    FROM groups g LEFT JOIN votes v ON v.vector = g.vector""",
)
def cluster_flat_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.flat_pipeline(coarse(spark, sf_dir), KEY, min_size=30).select("vec_id", "predicted_label", "confidence")


@query(
    "cluster_program_pipeline",
    f"""WITH {COARSE_SQL}, own AS (SELECT *, count(*) OVER (PARTITION BY program, vector) AS m FROM coarse QUALIFY count(*) OVER (PARTITION BY program) >= 5),
    votes AS (SELECT program, vector, CASE WHEN count(*) FILTER (is_seed) > 0 AND count(*) FILTER (is_seed AND label = 1) > count(*) FILTER (is_seed) // 2 THEN 1 ELSE 0 END AS vote FROM own WHERE m >= 5 GROUP BY program, vector)
    SELECT g.vec_id, CASE WHEN m >= 5 THEN v.vote WHEN EXISTS (SELECT 1 FROM own s WHERE s.is_seed AND s.label = 1 AND s.vector = g.vector AND s.program = g.program) THEN 1 ELSE 0 END AS predicted_label, CASE WHEN m >= 5 THEN 1.0 ELSE 0.0 END AS confidence
    FROM own g LEFT JOIN votes v ON v.vector = g.vector AND v.program = g.program""",
)
def cluster_program_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.program_pipeline(coarse(spark, sf_dir), KEY).select("vec_id", "predicted_label", "confidence")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known instances, dealt to folds, with equal classes kept."""
    rows = instances(spark, sf_dir).filter("label <> -1").withColumn("manual", F.lit(False))
    return sampling.k_fold(rows, folds=2, key=KEY)


def _scores(predictions: DataFrame) -> DataFrame:
    return evaluate.folds_and_overall(predictions.withColumnRenamed("label", "true_label"))


@query("model_forest")
def model_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(models.by_fold(_known(spark, sf_dir), lambda train, test: models.forest(train, test, trees=20), 2))


@query("model_linear")
def model_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(models.by_fold(_known(spark, sf_dir), models.linear, 2))


@query("model_weighted_by_confidence")
def model_weighted_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.two_means(instances(spark, sf_dir))
    named = rows.join(cluster.label_clusters(rows, "relative"), "cluster_id", "left").withColumn("strength", F.when(F.col("label") != -1, 1.0).otherwise(0.5))
    return models.weighted_by_confidence(named, named).select("vec_id", "predicted_label", F.round("confidence", 4).alias("confidence"))


@query("model_one_class")
def model_one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instances(spark, sf_dir)
    return models.one_class(rows.filter("label = 1"), rows).select("vec_id", "label", "predicted_label", F.round("confidence", 4).alias("confidence"))


@query("model_cluster_folds")
def model_cluster_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(training.cluster_folds(_known(spark, sf_dir), 2))


SYNTHETIC_SQL = f"""{INSTANCE_SQL}, known AS (SELECT * FROM inst WHERE label <> -1),
  sizes AS (SELECT count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros FROM known),
  minor AS (SELECT CASE WHEN ones <= zeros THEN 1 ELSE 0 END AS label, least(ones, zeros) AS n, abs(ones - zeros) AS need FROM sizes),
  placed AS (SELECT row_number() OVER (ORDER BY md5(concat(vec_id, '|42')), vec_id) AS start, vector FROM known WHERE label = (SELECT label FROM minor)),
  near AS (SELECT a.start, a.vector AS a, b.vector AS b, row_number() OVER (PARTITION BY a.start ORDER BY list_distance(a.vector, b.vector), b.start) AS place FROM placed a JOIN placed b ON a.start <> b.start),
  draws AS (SELECT draw, draw % n + 1 AS start, ('0x' || substr(md5(concat(draw, '|42|near')), 1, 7))::BIGINT % least(3, n - 1) + 1 AS place, ('0x' || substr(md5(concat(draw, '|42|share')), 1, 7))::BIGINT / 268435456.0::DOUBLE AS share
    FROM (SELECT unnest(range(need)) AS draw FROM minor), minor WHERE n > 1)"""


@query("balance_synthetic", f"WITH {SYNTHETIC_SQL} SELECT draw, (SELECT label FROM minor) AS label, list_transform(list_zip(a, b), lambda p: round(p[1] + share * (p[2] - p[1]), 6) + 0.0::DOUBLE) AS vector FROM draws JOIN near USING (start, place)")
def balance_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = models.synthetic_minority(instances(spark, sf_dir).filter("label <> -1"), KEY)
    return made.withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


@query("model_structural_forest")
def model_structural_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on graph features of labelled edges, predict every edge, and score each configuration's kept graph."""
    found = graph.structural_features(_edges(spark, sf_dir), graph=GRAPH)
    names = [c for c in found.columns if c not in ("program", "config_id", "method", "offset", "target")]
    key = ["program", "config_id", "method", "offset", "target"]
    rows = predictions(spark, sf_dir).select(*key, "tool", "true_label", "ground_truth").join(found, key)
    # the learner goes over its rows several times
    rows = durable(rows.select(*key, "tool", "true_label", "ground_truth", F.array(*[F.col(c).cast("double") for c in names]).alias("vector")), "structural-rows")
    train = rows.filter("true_label <> -1").withColumnRenamed("true_label", "label")
    kept = models.forest(train, rows, trees=20)
    return evaluate.per_config_evaluation(kept, true_edges(spark, sf_dir))
