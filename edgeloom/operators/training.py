"""Models whose gradients Spark's tasks add up: all folds at once, a job for each step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.neighbours import _matrix
from edgeloom.operators.ranks import quantiles
from edgeloom.storage import durable

#: A function of a fold's number, vectors, targets and weights that gives numbers to be added up over all rows.
Part = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Rows of a batch that are worked on at once.
ROWS = 4_096


def _parts(batches: Iterator[pa.RecordBatch], part: Part) -> Iterator[pa.RecordBatch]:
    """(fold, at, value): this task's sums for each fold."""
    sums: dict[int, np.ndarray] = {}
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            folds, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
            targets, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for fold in np.unique(folds).tolist():
                own = folds == fold
                found = part(fold, vectors[own], targets[own], weights[own])
                sums[fold] = sums[fold] + found if fold in sums else found
    for fold, values in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), fold, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(np.float64))], names=["fold", "at", "value"])


def sum_by_fold(rows: DataFrame, part: Part, folds: int, width: int) -> np.ndarray:
    """``width`` sums over the rows (``fold``, ``vec``, ``y``, ``w``) of each of ``folds`` folds, in one job.

    Tasks add up their own rows; what is shuffled is ``width`` numbers a task and fold,
    which are added in the order of their size, so that the sums don't depend on which
    task ends first. Only the sums reach the driver: they are as many as the model's parameters.
    """
    found = rows.select("fold", "vec", "y", "w").mapInArrow(partial(_parts, part=part), "fold int, at int, value double")
    added = F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, x: a + x)  # a number a task
    out = np.zeros((folds, width))
    for r in found.groupBy("fold", "at").agg(added.alias("value")).collect():
        out[r["fold"], r["at"]] = r["value"]
    return out


def staged(rows: DataFrame, vector: str, target: Column | None = None, weight: Column | None = None, fold: str | None = None) -> DataFrame:
    """``fold``, ``vec``, ``y``, ``w`` of rows with a vector, written so that each step reads them again."""
    kept = rows.filter(F.col(vector).isNotNull())
    columns = [(F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), F.col(vector).cast("array<double>").alias("vec")]
    columns += [(target if target is not None else F.lit(0.0)).cast("double").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w")]
    return durable(kept.select(*columns), "training-rows")


def _moments(fold: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), w.sum(), (w > 0).sum()]])


def moments(rows: DataFrame, folds: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of each component, the number of rows, and the sum of weights, by fold; a component without spread gets 1."""
    sums = sum_by_fold(rows, _moments, folds, 2 * width + 3)
    n = np.maximum(sums[:, 2 * width], 1)
    mean = sums[:, :width] / n[:, None]
    spread = np.sqrt(np.maximum(sums[:, width : 2 * width] / n[:, None] - mean**2, 0))
    return mean, np.where(spread > 1e-12, spread, 1.0), sums[:, 2 * width], sums[:, 2 * width + 1]


def width_of(rows: DataFrame) -> int | None:
    """Length of the vectors of staged rows; None without rows."""
    first = rows.select(F.size("vec").alias("n")).first()
    return first["n"] if first else None


class Adam:
    """Steps that follow the mean slope, scaled by its size so far."""

    def __init__(self, shape: tuple[int, ...], rate: float):
        self.rate, self.turn, self.mean, self.size = rate, 0, np.zeros(shape), np.zeros(shape)

    def step(self, slope: np.ndarray) -> np.ndarray:
        self.turn += 1
        self.mean = 0.9 * self.mean + 0.1 * slope
        self.size = 0.999 * self.size + 0.001 * slope**2
        return self.rate * (self.mean / (1 - 0.9**self.turn)) / (np.sqrt(self.size / (1 - 0.999**self.turn)) + 1e-8)


# ---- a network with one hidden layer


def network_output(x: np.ndarray, params: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """The hidden layer's values and the chance of label 1 of standardised vectors."""
    width = x.shape[1]
    inner, rest = params[: width * hidden].reshape(width, hidden), params[width * hidden :]
    layer = np.tanh(x @ inner + rest[:hidden])
    return layer, 1 / (1 + np.exp(-np.clip(layer @ rest[hidden : 2 * hidden] + rest[2 * hidden], -500, 500)))


def _network_slope(fold: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, params: np.ndarray, mean: np.ndarray, spread: np.ndarray, hidden: int) -> np.ndarray:
    """Slope of the weighted cross-entropy of some rows."""
    x = (x - mean[fold]) / spread[fold]
    own = params[fold]
    layer, p = network_output(x, own, hidden)
    miss = w * (p - y)
    outer = own[x.shape[1] * hidden + hidden :][:hidden]
    back = miss[:, None] * outer * (1 - layer**2)
    return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), layer.T @ miss, [miss.sum()]])


class Network:
    """Networks of all folds, fitted together."""

    def __init__(self, params: np.ndarray, mean: np.ndarray, spread: np.ndarray, hidden: int, trained: np.ndarray):
        self.params, self.mean, self.spread, self.hidden, self.trained = params, mean, spread, hidden, trained

    def chances(self, fold: int, x: np.ndarray) -> np.ndarray:
        if not self.trained[fold]:
            return np.zeros(len(x))
        return network_output((x - self.mean[fold]) / self.spread[fold], self.params[fold], self.hidden)[1]


def fit_network(rows: DataFrame, folds: int = 1, hidden: int = 16, steps: int = 60, rate: float = 0.1, decay: float = 1e-4, seed: int = 42) -> Network | None:
    """A network with one hidden layer for each fold of staged rows, by Adam on slopes that Spark adds up; None without rows.

    One job a step for all folds. Weights that sum to nothing leave a fold untrained.
    """
    width = width_of(rows)
    if width is None:
        return None
    mean, spread, _, total = moments(rows, folds, width)
    size = width * hidden + 2 * hidden + 1
    rng = np.random.default_rng(seed)
    params = np.zeros(size)
    params[: width * hidden] = rng.normal(0, 1 / np.sqrt(width), width * hidden)
    params[width * hidden + hidden : -1] = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    params = np.tile(params, (folds, 1))
    by = Adam(params.shape, rate)
    for turn in range(steps):
        slope = sum_by_fold(rows, partial(_network_slope, params=params, mean=mean, spread=spread, hidden=hidden), folds, size)
        slope = slope / np.maximum(total, 1e-300)[:, None] + decay * params
        params = params - by.step(slope) * (1 - turn / steps) ** 0.5
    return Network(params, mean, spread, hidden, total > 0)


def _judged(batches: Iterator[pa.RecordBatch], score: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns of a batch and ``_score``; the last two are fold and vector."""
    for batch in batches:
        folds, vectors = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1)
        out = np.full(batch.num_rows, np.nan)
        known = np.flatnonzero(np.asarray(vectors.is_valid()))
        if len(known):
            matrix = _matrix(vectors.take(pa.array(known)))
            for fold in np.unique(folds[known]).tolist():
                own = known[folds[known] == fold]
                out[own] = score(int(fold), matrix[folds[known] == fold])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, from_pandas=True)], names=[*batch.schema.names[:-2], "_score"])


def scored(rows: DataFrame, vector: str, score: Callable[[int, np.ndarray], np.ndarray], fold: str | None = None) -> DataFrame:
    """``rows`` with ``_score`` of each vector by its fold's model; null vectors have none."""
    plain = [f"c{i}" for i in range(len(rows.columns))]
    own = rows.toDF(*plain)
    names = dict(zip(rows.columns, plain, strict=True))
    ready = own.select(*plain, (F.col(names[fold]) if fold else F.lit(0)).cast("int").alias("_fold"), F.col(names[vector]).cast("array<double>").alias("_vec"))
    shape = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own.schema), "_score double"])
    found = ready.mapInArrow(partial(_judged, score=score), shape)
    return found.select(*[F.col(p).alias(c) for c, p in names.items()], "_score")


def weighted_network(train: DataFrame, rows: DataFrame, vector: str = "vector", label: str = "cluster_label", confidence: str = "strength", attention: bool = True, fold: str | None = None, folds: int = 1, hidden: int = 16, steps: int = 60, seed: int = 42) -> DataFrame:
    """``rows`` with ``confidence`` and ``predicted_label`` of a network with one hidden layer, trained on cluster labels weighed by their confidence; keep where it is over 0.5.

    Rows without a cluster have label 0 and weight 0. Without ``attention`` all weigh 1.
    With ``fold`` there is a network for each fold 0 to ``folds`` - 1, trained on its rows of
    ``train`` and used for its rows of ``rows``; all are trained in the same jobs. Null
    vectors, and all rows if nothing was trained, are dropped edges with confidence 0.
    """
    weight = F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)) if attention else F.lit(1.0)
    model = fit_network(staged(train, vector, F.coalesce(F.col(label), F.lit(0)), weight, fold), folds, hidden, steps, seed=seed)
    found = rows.withColumn("_score", F.lit(0.0)) if model is None else scored(rows, vector, model.chances, fold)
    chance = F.coalesce("_score", F.lit(0.0))
    return found.withColumns({"confidence": chance, "predicted_label": (chance > 0.5).cast("int")}).drop("_score")


# ---- one class


class Kernel:
    """Random Fourier features of a Gaussian kernel: their products come near exp(-gamma * squared distance)."""

    def __init__(self, width: int, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.turns, self.shift = rng.normal(size=(width, features)), rng.random(features) * 2 * np.pi

    def of(self, x: np.ndarray, gamma: float) -> np.ndarray:
        return np.sqrt(2 / len(self.shift)) * np.cos(np.sqrt(2 * gamma) * (x @ self.turns) + self.shift)


def _kernel_mean(fold: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, kernel: Kernel, gamma: np.ndarray) -> np.ndarray:
    return kernel.of(x, gamma[fold]).sum(axis=0)


def _one_class_slope(fold: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, kernel: Kernel, gamma: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Sum of the features of rows beyond the boundary, and how many they are."""
    z = kernel.of(x, gamma[fold])
    out = z @ params[fold, :-1] < params[fold, -1]
    return np.append(z[out].sum(axis=0), out.sum())


def one_class(true_rows: DataFrame, rows: DataFrame, vector: str = "vector", nu: float = 0.1, features: int = 256, steps: int = 40, rate: float = 0.02, gamma: float | None = None, fold: str | None = None, folds: int = 1, seed: int = 42) -> DataFrame:
    """``rows`` with ``confidence`` and ``predicted_label`` of a one-class machine with a Gaussian kernel, trained on true rows only; keep where confidence isn't negative.

    The kernel is that of random Fourier features; ``gamma`` is 1 / (width * variance of all
    components) if not given. The
    objective |w|^2 / 2 - rho + sum max(0, rho - w z) / (nu n) is solved by subgradients
    that Spark adds up, one job a step for all folds. Then the boundary is put at the
    exact ``nu`` quantile of the training rows' scores, where the solution has it, so a
    share of ``nu`` of them is rejected. ``confidence`` is the score less the boundary.

    Without training rows nothing is kept and confidence is null, as for null vectors.
    """
    train = staged(true_rows, vector, fold=fold)
    width = width_of(train)
    if width is None:
        return rows.withColumns({"confidence": F.lit(None).cast("double"), "predicted_label": F.lit(0)})
    mean, spread, n, _ = moments(train, folds, width)
    whole = (spread**2 + mean**2).mean(axis=1) - mean.mean(axis=1) ** 2
    gammas = np.full(folds, gamma) if gamma else 1 / (width * np.where(whole > 1e-12, whole, 1.0))
    kernel = Kernel(width, features, seed)
    params = np.zeros((folds, features + 1))
    params[:, :-1] = sum_by_fold(train, partial(_kernel_mean, kernel=kernel, gamma=gammas), folds, features) / np.maximum(n, 1)[:, None]
    params[:, -1] = 0.8 * (params[:, :-1] ** 2).sum(axis=1)  # a row like the mean scores its square
    by = Adam(params.shape, rate)
    for turn in range(steps):
        found = sum_by_fold(train, partial(_one_class_slope, kernel=kernel, gamma=gammas, params=params), folds, features + 1)
        found = found / (nu * np.maximum(n, 1))[:, None]
        slope = np.concatenate([params[:, :-1] - found[:, :-1], found[:, -1:] - 1], axis=1)
        params = params - by.step(slope) * (1 - turn / steps)
    score = partial(_one_class_score, kernel=kernel, gamma=gammas, params=params)
    cuts = {r["fold"]: r["cut"] for r in quantiles(scored(train.select("fold", "vec"), "vec", score, "fold"), "_score", {"cut": nu}, ["fold"]).collect()}  # a row a fold
    cut = F.coalesce(*[F.when((F.col(fold) if fold else F.lit(0)) == k, F.lit(v)) for k, v in sorted(cuts.items())], F.lit(None).cast("double"))
    confidence = F.col("_score") - cut
    return scored(rows, vector, score, fold).withColumns({"confidence": confidence, "predicted_label": F.coalesce((confidence >= 0).cast("int"), F.lit(0))}).drop("_score")


def _one_class_score(fold: int, x: np.ndarray, kernel: Kernel, gamma: np.ndarray, params: np.ndarray) -> np.ndarray:
    return kernel.of(x, gamma[fold]) @ params[fold, :-1]


# ---- means of all folds


def _nearest(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    square = np.zeros((len(x), len(centres)))
    for k, centre in enumerate(centres):
        for left, right in zip(x.T, centre, strict=True):
            square[:, k] += (left - right) ** 2
    return square.argmin(axis=1)


def _cluster_sums(fold: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, centres: np.ndarray) -> np.ndarray:
    at, k = _nearest(centres[fold], x), centres.shape[1]
    return np.concatenate([np.stack([x[at == i].sum(axis=0) for i in range(k)]).ravel(), np.bincount(at, minlength=k)])


def fold_means(rows: DataFrame, folds: int, k: int = 2, steps: int = 20) -> np.ndarray | None:
    """``k`` centres for each fold of staged rows, all folds in one job a step; None without rows.

    They begin at the mean, moved along the spread to both sides, and stop when no centre
    moves. So they depend neither on the order of rows nor on other folds.
    """
    width = width_of(rows)
    if width is None:
        return None
    mean, spread, _, _ = moments(rows, folds, width)
    offsets = np.linspace(-1, 1, k) if k > 1 else np.zeros(1)
    centres = mean[:, None, :] + offsets[None, :, None] * spread[:, None, :]
    for _ in range(steps):
        sums = sum_by_fold(rows, partial(_cluster_sums, centres=centres), folds, k * width + k)
        sizes = sums[:, k * width :]
        moved = np.where(sizes[:, :, None] > 0, sums[:, : k * width].reshape(folds, k, width) / np.maximum(sizes, 1)[:, :, None], centres)
        if np.allclose(moved, centres, rtol=0, atol=1e-9):
            break
        centres = moved
    return centres


def _cluster_of(fold: int, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _nearest(centres[fold], x).astype(np.float64)


def cluster_folds(folded: DataFrame, folds: int, vector: str = "vector", label: str = "label", k: int = 2, fold: str = "fold", role: str = "role") -> DataFrame:
    """Test rows of every fold with ``predicted_label``: clusters over a fold's rows, labelled by its training rows' relative majority.

    All folds are clustered in the same jobs, and one grouping by fold and cluster labels
    them all; how many jobs run doesn't depend on ``folds``. A cluster without training
    rows, and a null vector, is 0.
    """
    centres = fold_means(staged(folded, vector, fold=fold), folds, k)
    if centres is None:
        return folded.filter(F.col(role) == "test").withColumns({"predicted_label": F.lit(0), "confidence": F.lit(1.0)})
    placed = scored(folded, vector, partial(_cluster_of, centres=centres), fold).withColumn("_cluster", F.col("_score").cast("int")).drop("_score")
    placed = durable(placed, "fold-clusters")
    known = placed.filter((F.col(role) == "train") & F.col("_cluster").isNotNull())
    counts = known.groupBy(fold, "_cluster").agg(F.count_if(F.col(label) == 1).alias("t"), F.count_if(F.col(label) == 0).alias("f"))
    totals = counts.groupBy(fold).agg(F.sum("t").alias("all_t"), F.sum("f").alias("all_f"))
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    named = counts.join(totals, fold).select(F.col(fold).alias("_fold"), F.col("_cluster").alias("_of"), (share("t", "all_t") >= share("f", "all_f")).cast("int").alias("_label"))
    tests = placed.filter(F.col(role) == "test").join(F.broadcast(named), (F.col(fold) == F.col("_fold")) & (F.col("_cluster") == F.col("_of")), "left")  # folds times k rows
    return tests.withColumns({"predicted_label": F.coalesce("_label", F.lit(0)), "confidence": F.lit(1.0)}).drop("_fold", "_of", "_label", "_cluster")

