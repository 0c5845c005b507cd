"""Cluster edges by their vectors, label clusters, and decide outliers by their neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.cells import vectors_near
from edgeloom.operators.neighbours import nearest_points
from edgeloom.storage import durable

NOISE = -1
EPSILON = 1e-8


def exact_matches(rows: DataFrame, seeds: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector equals a seed's: an equality join on the vector."""
    return rows.join(seeds.select(vector).distinct(), vector, "left_semi")


def near_matches(rows: DataFrame, seeds: DataFrame, vector: str = "vector", epsilon: float = EPSILON) -> DataFrame:
    """Rows within ``epsilon`` (Euclidean) of a seed, see ``vectors_near``. Seeds must have one length."""
    near = vectors_near(rows, seeds, epsilon, vector)
    return rows.join(near, F.col(vector).cast("array<double>") == F.col("vec"), "left_semi")


def seed_neighbours(rows: DataFrame, seeds: DataFrame, key: Sequence[str], k: int, vector: str = "vector", label: str = "label") -> DataFrame:
    """The ``k`` nearest seeds of every row: key, ``place``, ``seed_label``, ``distance``; equal distances go by label, null first. Exact, for any number of seeds."""
    known = seeds.select(F.col(vector), F.col(label).alias("label"))
    return nearest_points(rows, known, key, k, vector, order=["label"], columns=["label"])


def nearest_seed_label(rows: DataFrame, seeds: DataFrame, key: Sequence[str], vector: str = "vector", label: str = "label") -> DataFrame:
    """Label of the nearest seed; 0 if that seed is noise or has none; confidence 0.5."""
    near = seed_neighbours(rows, seeds, key, 1, vector, label)
    known = F.col("seed_label").isNotNull() & (F.col("seed_label") != NOISE)
    return near.select(*key, F.when(known, F.col("seed_label")).otherwise(0).cast("int").alias("predicted_label"), F.lit(0.5).alias("confidence"))


def neighbour_vote(rows: DataFrame, seeds: DataFrame, key: Sequence[str], k: int = 5, vector: str = "vector", label: str = "label") -> DataFrame:
    """Majority label of the k nearest seeds, and the share of the larger class as confidence; a tie is 0."""
    share = F.avg("seed_label")
    votes = seed_neighbours(rows, seeds, key, k, vector, label).groupBy(*key).agg(share.alias("_share"))
    return votes.select(*key, (F.col("_share") > 0.5).cast("int").alias("predicted_label"), F.greatest(F.col("_share"), 1 - F.col("_share")).alias("confidence"))


def two_means(rows: DataFrame, vector: str = "vector", k: int = 2, seed: int = 42) -> DataFrame:
    """``cluster_id`` by k-means."""
    staged = rows.withColumn("_v", array_to_vector(vector))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster_id").fit(staged).transform(staged).drop("_v")


def dense_groups(rows: DataFrame, vector: str = "vector", min_size: int = 5) -> DataFrame:
    """``cluster_id`` of groups of at least ``min_size`` equal vectors, -1 for all others.

    Density clustering at radius 0; ``density`` has that at any radius, ``hierarchy`` that
    without one. The id is a hash of the vector, so it doesn't depend on the other rows.
    """
    groups = rows.groupBy(vector).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    marked = groups.select(F.col(vector).alias("_g"), F.xxhash64(vector).bitwiseAND(F.lit((1 << 63) - 1)).alias("_id"))
    return rows.join(marked, F.col(vector) == F.col("_g"), "left").withColumn("cluster_id", F.coalesce("_id", F.lit(NOISE))).drop("_g", "_id")


def label_clusters(clustered: DataFrame, rule: str = "majority", label: str = "label", cluster: str = "cluster_id") -> DataFrame:
    """``cluster_label`` per cluster, noise left out.

    "majority": more true than false rows, a tie is 1. "relative": the cluster's share of
    all true rows is at least its share of all false rows (a total of zero gives share 0).
    "any": some row is true.
    """
    t, f = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    counts = clustered.filter(F.col(cluster) != NOISE).groupBy(cluster).agg(t.alias("t"), f.alias("f"))
    if rule == "majority":
        made = F.col("t") >= F.col("f")
    elif rule == "relative":
        totals = clustered.filter(F.col(cluster) != NOISE).agg(t.alias("all_t"), f.alias("all_f"))
        counts = counts.crossJoin(F.broadcast(totals))  # one row
        made = F.coalesce(F.try_divide("t", "all_t"), F.lit(0.0)) >= F.coalesce(F.try_divide("f", "all_f"), F.lit(0.0))
    elif rule == "any":
        made = F.col("t") > 0
    else:
        raise ValueError(f"no rule {rule}")
    return counts.select(cluster, made.cast("int").alias("cluster_label"))


def seed_vote(clustered: DataFrame, true_only: bool = False, label: str = "label", is_seed: str = "is_seed", cluster: str = "cluster_id") -> DataFrame:
    """``cluster_label`` by the seeds in a cluster: any true seed, or a strict majority of more than half rounded down; none gives 0."""
    seeds = F.col(is_seed)
    counts = clustered.filter(F.col(cluster) != NOISE).groupBy(cluster).agg(F.count_if(seeds & (F.col(label) == 1)).alias("t"), F.count_if(seeds).alias("n"))
    made = F.col("t") > 0 if true_only else F.col("t") > F.floor(F.col("n") / 2)
    return counts.select(cluster, (made & (F.col("n") > 0)).cast("int").alias("cluster_label"))


def assign_labels(clustered: DataFrame, labels: DataFrame, key: Sequence[str], fallback: DataFrame | None = None, cluster: str = "cluster_id", strength: str | None = None) -> DataFrame:
    """``predicted_label`` and ``confidence``: those of the cluster; for noise the fallback's label with confidence 0, else 0."""
    joined = clustered.join(labels, cluster, "left")
    noise = F.col(cluster) == NOISE
    other = F.lit(0)
    if fallback is not None:
        joined = joined.join(fallback.select(*key, F.col("predicted_label").alias("_other")), list(key), "left")
        other = F.coalesce("_other", F.lit(0))
    made = F.when(noise, other).otherwise(F.coalesce("cluster_label", F.lit(0))).cast("int")
    sure = F.when(noise, F.lit(0.0)).otherwise(F.col(strength).cast("double") if strength else F.lit(1.0))
    return joined.withColumns({"predicted_label": made, "confidence": sure}).drop("cluster_label", "_other")


def flat_pipeline(rows: DataFrame, key: Sequence[str], vector: str = "vector", label: str = "label", is_seed: str = "is_seed", min_size: int = 5, true_only: bool = False, clusters: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Dense groups, seed vote, and for noise an exact match with a true seed: one job over all programs.

    ``clusters`` gives rows a ``cluster_id``, -1 for noise, in place of groups of equal
    vectors, and may give a ``strength``, which is then the confidence: for instance
    ``hierarchy.hierarchical_clusters``.
    """
    clustered = durable(clusters(rows) if clusters else dense_groups(rows, vector, min_size), "flat-clusters")
    truths = clustered.filter(F.col(is_seed) & (F.col(label) == 1))
    matched = exact_matches(clustered.filter(F.col("cluster_id") == NOISE), truths, vector).select(*key).withColumn("predicted_label", F.lit(1))
    strength = "strength" if clusters and "strength" in clustered.columns else None
    return assign_labels(clustered, seed_vote(clustered, true_only, label, is_seed), key, matched, strength=strength)


def program_pipeline(rows: DataFrame, key: Sequence[str], program: str = "program", least: int = 5, vector: str = "vector", label: str = "label", is_seed: str = "is_seed", min_size: int = 5, true_only: bool = False) -> DataFrame:
    """``flat_pipeline`` for each program by itself: groups, votes and matches never cross programs; programs of fewer than ``least`` rows are left out.

    All programs in one job: the program is part of a group's identity, so one with most
    of the rows is dealt by its vectors like any other.
    """
    sizes = rows.groupBy(program).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= least).select(F.col(program).alias("_program"))
    kept = rows.join(sizes, F.col(program).eqNullSafe(F.col("_program")), "left_semi")
    counts = kept.groupBy(F.col(program).alias("_p"), F.col(vector).alias("_g")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    marked = counts.select("_p", "_g", F.xxhash64("_p", "_g").bitwiseAND(F.lit((1 << 63) - 1)).alias("_id"))
    clustered = kept.join(marked, F.col(program).eqNullSafe(F.col("_p")) & (F.col(vector) == F.col("_g")), "left").withColumn("cluster_id", F.coalesce("_id", F.lit(NOISE))).drop("_p", "_g", "_id")
    clustered = durable(clustered, "program-clusters")
    truths = clustered.filter(F.col(is_seed) & (F.col(label) == 1)).select(F.col(program).alias("_p"), F.col(vector).alias("_g")).distinct()
    matched = clustered.filter(F.col("cluster_id") == NOISE).join(truths, F.col(program).eqNullSafe(F.col("_p")) & (F.col(vector) == F.col("_g")), "left_semi")
    return assign_labels(clustered, seed_vote(clustered, true_only, label, is_seed), key, matched.select(*key).withColumn("predicted_label", F.lit(1)))
