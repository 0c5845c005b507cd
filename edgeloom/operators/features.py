"""Attach, scale and combine feature vectors of edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, HashingTF, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.signatures import fixed_vector
from edgeloom.operators.sets import dedupe_edges


def attach_features(edges: DataFrame, structural: DataFrame, semantic: DataFrame, key: Sequence[str], tokens: DataFrame | None = None) -> DataFrame:
    """Edges with structural features (inner), tokens (inner, if asked for) and semantic features (left); each side one row per key."""
    out = edges.join(dedupe_edges(structural, key), list(key))
    if tokens is not None:
        out = out.join(dedupe_edges(tokens, key), list(key))
    return out.join(dedupe_edges(semantic, key), list(key), "left")


def standardise(rows: DataFrame, vector: str, out: str, fit_rows: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation per component, fitted on ``fit_rows`` (the training rows) or on all.

    Spark divides by the sample deviation; the result is scaled back by sqrt(n / (n - 1)).
    """
    fitted = rows if fit_rows is None else fit_rows
    n = fitted.count()
    model = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(fitted.select(array_to_vector(vector).alias("_v")))
    scale = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    scaled = model.transform(rows.withColumn("_v", array_to_vector(vector)))
    return scaled.withColumn(out, F.transform(vector_to_array("_s"), lambda x: x * F.lit(scale))).drop("_v", "_s")


def reduce_width(rows: DataFrame, vector: str, out: str, width: int = 50) -> DataFrame:
    """At most ``width`` principal components; ``independent`` has independent ones."""
    first = rows.select(F.size(vector).alias("n")).first()
    k = min(width, first["n"] if first else width)
    staged = rows.withColumn("_v", array_to_vector(vector))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(staged)
    return model.transform(staged).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def combine(rows: DataFrame, semantic: str, structural: str, out: str, semantic_width: int, structural_width: int) -> DataFrame:
    """Semantic then structural features; a missing or odd vector counts as zeros."""
    return rows.withColumn(out, F.concat(fixed_vector(F.col(semantic), semantic_width), fixed_vector(F.col(structural), structural_width)))


def project(rows: DataFrame, vector: str, width: int, label: str) -> DataFrame:
    """``x``, ``y`` (two principal components) and the class of every row whose vector has the right width."""
    fit = rows.filter(F.size(vector) == width)
    flat = reduce_width(fit, vector, "_xy", 2)
    return flat.select(*[c for c in rows.columns if c not in (vector, label)], F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y"), label)


def pair_text_features(windows: DataFrame, tokens: str = "tokens", out: str = "text_features", width: int = 256) -> DataFrame:
    """Hashed token counts of an edge's text: fixed-length features where there is no language model. ``topics`` has fewer numbers that say more."""
    words = windows.withColumn("_t", F.filter(tokens, lambda t: t != "[PAD]"))
    return HashingTF(numFeatures=width, inputCol="_t", outputCol="_h").transform(words).withColumn(out, vector_to_array("_h")).drop("_t", "_h")
