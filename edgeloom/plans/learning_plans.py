"""Queries of learners that have no closed form: each shows what its result must fulfil, beside its rows or sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import cluster, features, models, training
from edgeloom.operators.density import density_clusters
from edgeloom.operators.hierarchy import hierarchical_clusters
from edgeloom.operators.independent import independent_components
from edgeloom.operators.texts import token_windows
from edgeloom.operators.topics import pair_text_topics
from edgeloom.plans.model_plans import INSTANCE_SQL, _known, instances
from edgeloom.plans.registry import query
from edgeloom.plans.text_plans import CODE_SQL, SIGNED_SQL, WINDOW_SQL, _coded
from edgeloom.plans.views import EDGE_SQL
from edgeloom.storage import durable

#: Radius of the density query, in sums of half the components.
RADIUS = 0.09


@query(
    "cluster_density",
    f"""WITH RECURSIVE {INSTANCE_SQL}, flat AS (SELECT vec_id, [list_sum(vector[1:32]), list_sum(vector[33:64])] AS v FROM inst),
    near AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d, b.v AS bv FROM flat a, flat b WHERE list_distance(a.v, b.v) <= {RADIUS}),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
    links AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
    reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    groups AS (SELECT a AS id, min(b) AS g FROM reach GROUP BY a),
    members AS (SELECT id, g FROM groups UNION ALL SELECT a, arg_min(g, (d, bv)) FROM near JOIN groups ON groups.id = near.b WHERE a NOT IN (FROM core) GROUP BY a),
    large AS (SELECT g FROM members GROUP BY g HAVING count(*) >= 5),
    named AS (SELECT id, min(id) OVER (PARTITION BY g) AS cluster_first FROM members WHERE g IN (FROM large))
    SELECT vec_id, coalesce(cluster_first, -1) AS cluster_first FROM inst LEFT JOIN named ON named.id = inst.vec_id""",
)
def cluster_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of near but unequal vectors, each named by its first member; -1 is noise."""
    total = lambda at: F.aggregate(F.slice("vector", at, 32), F.lit(0.0), lambda a, x: a + x)
    rows = instances(spark, sf_dir).select("vec_id", F.array(total(1), total(33)).alias("vector"))
    found = durable(density_clusters(rows, RADIUS), "density-query")
    firsts = found.filter("cluster_id <> -1").groupBy("cluster_id").agg(F.min("vec_id").alias("cluster_first"))
    return found.join(firsts, "cluster_id", "left").select("vec_id", F.coalesce("cluster_first", F.lit(-1).cast("long")).alias("cluster_first"))


@query("cluster_hierarchy", "SELECT vec_id, true AS consistent FROM embeddings")
def cluster_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the density hierarchy: each has its least size, a strength over 0 and a row of strength 1; noise has none."""
    total = lambda at: F.aggregate(F.slice("vector", at, 32), F.lit(0.0), lambda a, x: a + x)
    rows = instances(spark, sf_dir).select("vec_id", F.array(total(1), total(33)).alias("vector"))
    found = durable(hierarchical_clusters(rows, min_size=8), "hierarchy-query")
    sizes = found.groupBy("cluster_id").agg(F.count("*").alias("size"), F.max("strength").alias("most"), F.min("strength").alias("least"))
    noise = F.col("cluster_id") == -1
    fits = F.when(noise, F.col("most") == 0).otherwise((F.col("size") >= 8) & (F.col("least") > 0) & (F.col("most") == 1))
    return found.join(sizes.select("cluster_id", fits.alias("consistent")), "cluster_id").select("vec_id", "consistent")


TOTALS_SQL = f"WITH {INSTANCE_SQL} SELECT count(*) FILTER (label = 1) AS true_rows, count(*) FILTER (label = 0) AS false_rows, true AS consistent FROM inst WHERE label <> -1"


def _totals(predictions: DataFrame) -> DataFrame:
    """Rows of each class among the test rows of all folds, and whether every row has one prediction that follows from its confidence."""
    known = predictions.groupBy("vec_id", "label").agg(F.count("*").alias("n"), F.min("predicted_label").alias("low"), F.max("predicted_label").alias("high"))
    single = (F.col("n") == 1) & (F.col("low") == F.col("high")) & F.col("low").isin(0, 1)
    return known.agg(F.count_if(F.col("label") == 1).alias("true_rows"), F.count_if(F.col("label") == 0).alias("false_rows"), F.bool_and(single).alias("consistent"))


@query("model_forest_totals", TOTALS_SQL)
def model_forest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known row is predicted once over all folds, at the threshold."""
    found = models.by_fold(_known(spark, sf_dir), lambda train, test: models.forest(train, test, trees=20), 2)
    kept = F.when((F.col("confidence") >= models.KEEP_AT) == (F.col("predicted_label") == 1), F.col("predicted_label")).otherwise(-1)
    return _totals(found.withColumn("predicted_label", kept))


@query("model_cluster_folds_totals", TOTALS_SQL)
def model_cluster_folds_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for clusters of all folds, fitted in the same jobs."""
    return _totals(training.cluster_folds(_known(spark, sf_dir), 2))


@query("model_linear_slope", f"WITH {INSTANCE_SQL} SELECT count(*) AS known_rows, true AS flat FROM inst WHERE label <> -1")
def model_linear_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression is at its optimum: no component, nor the offset, would gain by a change of its weight."""
    rows = durable(instances(spark, sf_dir).filter("label <> -1"), "linear-rows")
    miss = F.col("confidence") - F.col("label")
    found = models.linear(rows, rows, weighted=False)
    slopes = [F.sum(miss * F.get("vector", F.lit(i))) for i in range(64)]
    largest = F.greatest(*[F.abs(s) for s in [F.sum(miss), *slopes]])
    return found.agg(F.count("*").alias("known_rows"), (largest / F.count("*") < 1e-3).alias("flat"))


@query("model_network", f"WITH {INSTANCE_SQL} SELECT vec_id, true AS follows FROM inst")
def model_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network with a hidden layer, trained on the labels of two clusters, known labels weighing double; every row's label follows from its confidence."""
    rows = durable(cluster.two_means(instances(spark, sf_dir)), "network-rows")
    named = rows.join(cluster.label_clusters(rows, "relative"), "cluster_id", "left").withColumn("strength", F.when(F.col("label") != -1, 1.0).otherwise(0.5))
    found = training.weighted_network(named, rows, steps=30)
    follows = F.col("confidence").between(0, 1) & ((F.col("confidence") > 0.5) == (F.col("predicted_label") == 1))
    return found.select("vec_id", follows.alias("follows"))


@query("model_network_learns", f"WITH {INSTANCE_SQL} SELECT count(*) AS test_rows, true AS beats_linear FROM inst WHERE vec_id % 3 = 0")
def model_network_learns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows of two classes that no plane parts (how long a part of the vector is): the network is right more often than the linear model."""
    square = F.aggregate(F.slice("vector", 1, 2), F.lit(0.0), lambda a, x: a + x * x)
    rows = instances(spark, sf_dir).select("vec_id", F.slice("vector", 1, 2).alias("vector"), square.alias("square"))
    middle = rows.agg(F.percentile("square", F.lit(0.5)).alias("middle"))
    made = durable(rows.crossJoin(F.broadcast(middle)).select("vec_id", "vector", (F.col("square") > F.col("middle")).cast("int").alias("cluster_label"), F.lit(1.0).alias("strength")), "ring-rows")  # one row
    train, test = made.filter("vec_id % 3 <> 0"), made.filter("vec_id % 3 = 0")
    right = F.count_if(F.col("predicted_label") == F.col("cluster_label"))
    both = [f(train, test).agg(F.count("*").alias("test_rows"), right.alias(name)) for f, name in ((training.weighted_network, "network"), (models.weighted_by_confidence, "line"))]
    return both[0].join(both[1], "test_rows").select("test_rows", (F.col("network") > F.col("line")).alias("beats_linear"))


@query("model_one_class_kernel", f"WITH {INSTANCE_SQL} SELECT label, count(*) AS n, CASE WHEN label = 1 THEN true END AS share_is_nu FROM inst GROUP BY label")
def model_one_class_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel one-class machine fitted on true rows: of these it rejects a tenth, within 2 points."""
    rows = durable(instances(spark, sf_dir), "one-class-rows")
    found = training.one_class(rows.filter("label = 1"), rows, steps=20)
    share = F.count_if(F.col("predicted_label") == 0) / F.count("*")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.when(F.col("label") == 1, F.abs(share - 0.1) <= 0.02).alias("share_is_nu"))


def _moments(values: list[Column]) -> Column:
    """Whether values have mean 0 and deviation 1 and don't go together."""
    alone = [(F.abs(F.avg(v)) < 1e-6) & (F.abs(F.stddev_samp(v) - 1) < 1e-6) for v in values]
    pairs = [F.abs(F.covar_samp(a, b)) < 1e-6 for i, a in enumerate(values) for b in values[i + 1 :]]
    out = F.lit(True)
    for holds in [*alone, *pairs]:
        out = out & holds
    return out


@query("feature_independent", "SELECT count(*) AS n, 10 AS width, true AS uncorrelated FROM embeddings")
def feature_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten independent components of every vector: of mean 0 and deviation 1, and uncorrelated."""
    found = independent_components(instances(spark, sf_dir), "vector", "parts", 10, steps=30).select("parts")
    return found.agg(F.count("*").alias("n"), F.max(F.size("parts")).alias("width"), _moments([F.get("parts", F.lit(i)) for i in range(10)]).alias("uncorrelated"))


@query("feature_project_axes", f"WITH {INSTANCE_SQL} SELECT label, count(*) AS n, true AS axes FROM inst GROUP BY label")
def feature_project_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane of the projection: its axes go together in nothing, the first spreads most, and no component of the vectors spreads more than it."""
    rows = durable(instances(spark, sf_dir).select("vec_id", "vector", "label"), "project-rows")
    flat = durable(features.project(rows, "vector", 64, "label"), "projected")
    spread = rows.agg(F.greatest(*[F.var_samp(F.get("vector", F.lit(i))) for i in range(64)]).alias("widest"))
    seen = flat.agg(F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"))
    holds = (F.abs(F.col("c")) < 1e-9) & (F.col("vx") >= F.col("vy")) & (F.col("vx") >= F.col("widest") - 1e-12)
    axes = seen.crossJoin(spread).select(holds.alias("axes"))  # one row each
    return flat.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(axes))


@query("cluster_two_means_stable", f"WITH {INSTANCE_SQL} SELECT count(*) AS n, 2 AS clusters, true AS stable FROM inst")
def cluster_two_means_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly every vector lies nearest to the mean of its own cluster: k-means has settled."""
    rows = durable(cluster.two_means(instances(spark, sf_dir)).select("vec_id", "vector", "cluster_id"), "two-means")
    centre = F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(64)])
    centres = rows.groupBy("cluster_id").agg(centre.alias("centre")).withColumnRenamed("cluster_id", "of")
    gap = F.aggregate(F.zip_with("vector", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    nearest = rows.crossJoin(F.broadcast(centres)).groupBy("vec_id", "cluster_id").agg(F.min_by("of", gap).alias("near"))  # two rows
    return nearest.agg(F.count("*").alias("n"), F.count_distinct("cluster_id").cast("int").alias("clusters"), (F.count_if(F.col("near") == F.col("cluster_id")) >= 0.99 * F.count("*")).alias("stable"))


@query("feature_pair_text_topics", f"WITH {EDGE_SQL}, {SIGNED_SQL}, {CODE_SQL}, {WINDOW_SQL} SELECT program, method, \"offset\", target, true AS within FROM win")
def feature_pair_text_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen text features of every edge; a text's terms have length 1 together, so its features have no more."""
    keys = ["program", "method", "offset", "target"]
    found = pair_text_topics(token_windows(_coded(spark, sf_dir), keys, 64).select(*keys, "tokens"), width=16)
    length = F.aggregate("text_features", F.lit(0.0), lambda a, x: a + x * x)
    return found.select(*keys, ((F.size("text_features") == 16) & (length <= 1 + 1e-9)).alias("within"))
