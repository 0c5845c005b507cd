"""Independent components of vectors, by fixed-point steps that Spark adds up."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.training import staged, sum_by_fold

#: A component that spreads less than this share of the widest is left out: it is noise of the arithmetic.
LEAST_SPREAD = 1e-9


def _fixed_point(fold: int, z: np.ndarray, y: np.ndarray, w: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Sums of g(s) z, g'(s) and rows for g = tanh and the sources s = turns z."""
    g = np.tanh(z @ turns.T)
    return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(axis=0), [len(z)]])


def _orthonormal(turns: np.ndarray) -> np.ndarray:
    """The nearest matrix with orthonormal rows: no component is favoured."""
    left, _, right = np.linalg.svd(turns, full_matrices=False)
    return left @ right


def independent_components(rows: DataFrame, vector: str, out: str, width: int = 50, fit_rows: DataFrame | None = None, steps: int = 200, tolerance: float = 1e-4, seed: int = 42) -> DataFrame:
    """``rows`` with at most ``width`` independent components of ``vector``, each of mean 0 and deviation 1 over the fitted rows.

    Vectors are centred, turned to their ``width`` widest principal components and scaled
    to one spread; then a rotation is sought under which the components are as far from
    normal as can be (fixed-point iteration with tanh, all components at once). Each step
    is one sum of width * width numbers over the rows. It ends when no component turns by
    more than ``tolerance``, or after ``steps``. The order of the components is that of
    the iteration; the sign makes the greatest weight of each positive.

    Fitted on ``fit_rows`` or on all. Null vectors stay null, and rows of one vector only,
    or none, give components of width 0.
    """
    fitted = (rows if fit_rows is None else fit_rows).filter(F.col(vector).isNotNull())
    first = fitted.select(F.size(vector).alias("n")).first()
    empty = F.when(F.col(vector).isNotNull(), F.array().cast("array<double>")).alias(out)
    if first is None or not first["n"]:
        return rows.withColumn(out, empty)
    given = fitted.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(given)
    pca = PCA(k=min(width, first["n"]), inputCol="_c", outputCol="_p").fit(centre.transform(given))
    spread = StandardScaler(inputCol="_p", outputCol="_z", withMean=True, withStd=True).fit(pca.transform(centre.transform(given)))
    deviations = np.asarray(spread.std.toArray())
    k = int((deviations > LEAST_SPREAD * max(deviations.max(), 1e-300)).sum()) if deviations.max() > 0 else 0
    if not k:
        return rows.withColumn(out, empty)

    def whitened(df: DataFrame) -> DataFrame:
        found = spread.transform(pca.transform(centre.transform(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))))))
        return found.withColumn(out, F.slice(vector_to_array("_z"), 1, k)).drop("_v", "_c", "_p", "_z")

    ready = staged(whitened(fitted), out)
    turns = _orthonormal(np.random.default_rng(seed).normal(size=(k, k)))
    for _ in range(steps):
        sums = sum_by_fold(ready, partial(_fixed_point, turns=turns), 1, k * k + k + 1)[0]
        n = sums[-1]
        moved = _orthonormal(sums[: k * k].reshape(k, k) / n - (sums[k * k : -1] / n)[:, None] * turns)
        change = np.abs(np.abs((moved * turns).sum(axis=1)) - 1).max()
        turns = moved
        if change < tolerance:
            break
    turns *= np.sign(turns[np.arange(k), np.abs(turns).argmax(axis=1)])[:, None]
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in turns])
    dot = lambda row: F.aggregate(F.zip_with(row, F.col(out), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    known = whitened(rows.filter(F.col(vector).isNotNull())).withColumn(out, F.transform(weights, dot))
    return known.unionByName(rows.filter(F.col(vector).isNull()).withColumn(out, F.lit(None).cast("array<double>")))
