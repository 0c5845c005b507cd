"""Keep-or-drop models, trained as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.cluster import label_clusters, two_means
from edgeloom.operators.neighbours import nearest_points
from edgeloom.operators.ranks import quantiles
from edgeloom.operators.sampling import hash_rank

KEEP_AT = 0.45


def balanced_weights(train: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Each row weighs n / (2 * rows of its class)."""
    sizes = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    weight = F.lit(1.0)
    for value, size in sizes.items():
        weight = F.when(F.col(label) == value, F.lit(n / (2 * size))).otherwise(weight)
    return train.withColumn(out, weight)


def _predicted(model, rows: DataFrame, vector: str, at: float, strict: bool = False) -> DataFrame:
    scored = model.transform(rows.withColumn("_v", array_to_vector(vector)))
    p = vector_to_array("probability")[1]
    named = scored.withColumn("confidence", p).drop("_v", "rawPrediction", "probability", "prediction")
    return named.withColumn("predicted_label", ((F.col("confidence") > at) if strict else (F.col("confidence") >= at)).cast("int"))


def forest(train: DataFrame, rows: DataFrame, vector: str = "vector", label: str = "label", trees: int = 100, at: float = KEEP_AT, seed: int = 42) -> DataFrame:
    """Random forest (depth 10, entropy, square root of features, no bootstrap, balanced weights): keep where p is at least ``at``."""
    weighted = balanced_weights(train, label).withColumn("_v", array_to_vector(vector))
    learner = RandomForestClassifier(featuresCol="_v", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=10, impurity="entropy", featureSubsetStrategy="sqrt", bootstrap=False, seed=seed)
    return _predicted(learner.fit(weighted), rows, vector, at)


def linear(train: DataFrame, rows: DataFrame, vector: str = "vector", label: str = "label", at: float = 0.5, weighted: bool = True) -> DataFrame:
    """Logistic regression, class 0 weighing positives / negatives; unweighted for one class. What stacked linear layers amount to."""
    sizes = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / sizes[0] if weighted and sizes.get(0) and sizes.get(1) else 1.0
    staged = train.withColumns({"_v": array_to_vector(vector), "_w": F.when(F.col(label) == 0, F.lit(share)).otherwise(1.0)})
    return _predicted(LogisticRegression(featuresCol="_v", labelCol=label, weightCol="_w", family="binomial").fit(staged), rows, vector, at)


def weighted_by_confidence(train: DataFrame, rows: DataFrame, vector: str = "vector", label: str = "cluster_label", confidence: str = "strength", attention: bool = True) -> DataFrame:
    """Logistic regression on cluster labels, weighed by confidence; keep where p > 0.5. ``training.weighted_network`` has a hidden layer. Rows without a cluster: label 0, weight 0."""
    staged = train.withColumns({"_v": array_to_vector(vector), "_y": F.coalesce(F.col(label), F.lit(0)).cast("double"), "_w": F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)) if attention else F.lit(1.0)})
    return _predicted(LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="_w", family="binomial").fit(staged), rows, vector, 0.5, strict=True)


def one_class(true_rows: DataFrame, rows: DataFrame, vector: str = "vector", nu: float = 0.1, width: int = 16) -> DataFrame:
    """Keep rows near the true ones: distance in whitened principal components, cut at the (1 - nu) quantile of the true rows.

    ``confidence`` is cut minus distance. A plainer method than ``training.one_class``, the
    kernel machine. Without true rows nothing is kept and confidence is null.
    """
    first = true_rows.select(F.size(vector).alias("n")).first()
    if first is None:
        return rows.withColumns({"confidence": F.lit(None).cast("double"), "predicted_label": F.lit(0)})
    pca = PCA(k=min(width, first["n"]), inputCol="_v", outputCol="_p").fit(true_rows.withColumn("_v", array_to_vector(vector)))
    inner = lambda df: pca.transform(df.withColumn("_v", array_to_vector(vector)))
    scaler = StandardScaler(inputCol="_p", outputCol="_s", withMean=True, withStd=True).fit(inner(true_rows))
    far = F.sqrt(F.aggregate(vector_to_array("_s"), F.lit(0.0), lambda a, x: a + x * x))
    measured = lambda df: scaler.transform(inner(df)).withColumn("_d", far).drop("_v", "_p", "_s")
    cut = quantiles(measured(true_rows), "_d", {"cut": 1 - nu}).first()["cut"]
    return measured(rows).withColumns({"confidence": F.lit(cut) - F.col("_d"), "predicted_label": (F.col("_d") <= cut).cast("int")}).drop("_d")


def by_fold(folded: DataFrame, fit: Callable[[DataFrame, DataFrame], DataFrame], folds: int, fold: str = "fold", role: str = "role") -> DataFrame:
    """Fit on the training rows and predict the test rows of every fold: a loop over fits, each of them a Spark job."""
    out = None
    for i in range(folds):
        own = folded.filter(F.col(fold) == i)
        part = fit(own.filter(F.col(role) == "train"), own.filter(F.col(role) == "test"))
        out = part if out is None else out.unionByName(part)
    return out


def cluster_then_label(train: DataFrame, test: DataFrame, vector: str = "vector", label: str = "label", k: int = 2) -> DataFrame:
    """Clusters over training and test rows, labelled by the training rows' relative majority."""
    both = train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False)))
    clustered = two_means(both, vector, k)
    named = label_clusters(clustered.withColumn("_known", F.when(F.col("_train"), F.col(label))), "relative", "_known")
    return clustered.filter("not _train").join(named, "cluster_id", "left").withColumns({"predicted_label": F.coalesce("cluster_label", F.lit(0)), "confidence": F.lit(1.0)}).drop("_train", "cluster_label")


def synthetic_minority(rows: DataFrame, key: Sequence[str], vector: str = "vector", label: str = "label", k: int = 3, seed: int = 42) -> DataFrame:
    """Minority rows' synthetic companions up to the majority's size: each lies between a minority row and one of its k nearest.

    Draw i starts from the row whose hash rank is i modulo the class's size plus 1, and a
    hash of i picks the neighbour and the place between them, so reruns agree. Neighbours
    are exact within the minority, whatever its size; a row isn't its own neighbour. Null
    vectors draw nothing.
    """
    rows = rows.filter(F.col(vector).isNotNull())
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    minor = min((0, 1), key=lambda c: (sizes.get(c, 0), -c))
    n, need = sizes.get(minor, 0), sizes.get(1 - minor, 0) - sizes.get(minor, 0)
    own = rows.filter(F.col(label) == minor).select(*key, F.col(vector).cast("array<double>").alias(vector))
    if n < 2 or need <= 0:
        return own.limit(0).select(F.lit(0).cast("long").alias("draw"), F.lit(minor).alias(label), vector)
    placed = hash_rank(own, key, seed, rank="start").select("start", F.col(vector).alias("vec"))
    kk = min(k, n - 1)
    near = nearest_points(placed, placed, ["start"], kk + 1, "vec", order=["start"], columns=["start", "vec"], prefix="to_")
    others = near.filter("start <> to_start").groupBy("start").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "to_vec"))), 1, kk).alias("near"))  # kk + 1 at most
    h = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.lit(str(seed)), F.lit(salt)).cast("binary")), 1, 7), 16, 10).cast("long")
    draws = rows.sparkSession.range(need).select(F.col("id").alias("draw"))
    drawn = draws.withColumns({"start": (F.col("draw") % n + 1).cast("long"), "_r": (h("near") % kk + 1).cast("int"), "_u": h("share") / float(1 << 28)})
    both = drawn.join(placed.withColumn("start", F.col("start").cast("long")), "start").join(others.withColumn("start", F.col("start").cast("long")), "start").withColumn("_to", F.element_at("near", F.col("_r"))["to_vec"])
    pairs = F.zip_with(F.col("vec"), F.col("_to"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return both.select("draw", F.lit(minor).alias(label), F.transform(pairs, lambda p: p["a"] + F.col("_u") * (p["b"] - p["a"])).alias(vector))
