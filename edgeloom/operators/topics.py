"""Text features of fixed length: the widest directions of a table of weighted terms, by block power iterations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import durable

#: Slots that terms are hashed to; directions sought besides those wanted, which makes few steps enough.
TERMS, SPARE = 1 << 14, 8
#: Groups of terms whose sums are added up side by side.
SUM_GROUPS = 64


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of all entries of a batch of (ids, weights)."""
    ids, weights = batch.column(0), batch.column(1)
    sizes = np.diff(ids.offsets.to_numpy()) if isinstance(ids, pa.ListArray) else np.array([len(x) for x in ids])
    return np.repeat(np.arange(len(sizes)), sizes), ids.flatten().to_numpy(), weights.flatten().to_numpy()


def _onto(batch: pa.RecordBatch, basis: np.ndarray) -> np.ndarray:
    """Each row of a batch, expressed by the basis."""
    rows, ids, weights = _entries(batch)
    out = np.zeros((batch.num_rows, basis.shape[1]))
    filled, starts = np.unique(rows, return_index=True)
    if len(filled):
        out[filled] = np.add.reduceat(weights[:, None] * basis[ids], starts, axis=0)
    return out


def _powered(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, values): this task's part of the table's transpose times the table times the basis, terms that occur."""
    total, seen = np.zeros_like(basis), np.zeros(len(basis), bool)
    for whole in batches:
        for start in range(0, whole.num_rows, 1_024):
            batch = whole.slice(start, 1_024)
            rows, ids, weights = _entries(batch)
            if len(ids):
                order = np.argsort(ids, kind="stable")
                found, starts = np.unique(ids[order], return_index=True)
                total[found] += np.add.reduceat((weights[:, None] * _onto(batch, basis)[rows])[order], starts, axis=0)
                seen[found] = True
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["term", "values"])


def term_ids(tokens: str, terms: int = TERMS) -> Column:
    """Slots of the tokens of a text, repeats included; padding is no token."""
    words = F.filter(tokens, lambda t: t.isNotNull() & (t != "[PAD]"))
    return F.transform(words, lambda t: F.pmod(F.xxhash64(t), F.lit(terms)).cast("int"))


def _weighed_batch(all_ids: pa.Array, idf: np.ndarray) -> pa.RecordBatch:
    """Of texts' slots with repeats: ``_ids`` and ``_weights``, the distinct slots, how often (as 1 + log) times how rare, scaled to length 1."""
    sizes = np.diff(all_ids.offsets.to_numpy())
    pairs, often = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(idf) + all_ids.flatten().to_numpy(), return_counts=True)
    rows, ids = np.divmod(pairs, len(idf))
    raw = (1 + np.log(often)) * idf[ids]
    length = np.sqrt(np.bincount(rows, raw * raw, minlength=len(sizes)))
    ends = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(sizes)))).astype(np.int32))
    weights = raw / np.maximum(length[rows], 1e-300)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weights))], names=["_ids", "_weights"])


def _weights(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _weighed_batch(batch.column(0), idf)


def _slots(tokens: str, terms: int) -> Column:
    return F.coalesce(term_ids(tokens, terms), F.array().cast("array<int>")).alias("_all")


def _weighed_slots(slots: DataFrame, idf: np.ndarray) -> DataFrame:
    return slots.select("_all").mapInArrow(partial(_weights, idf=idf), "_ids array<int>, _weights array<double>")


def _weighed(rows: DataFrame, tokens: str, idf: np.ndarray, terms: int) -> DataFrame:
    """``_ids`` and ``_weights`` of the texts of ``rows``."""
    return _weighed_slots(rows.select(_slots(tokens, terms)), idf)


def _features(batches: Iterator[pa.RecordBatch], basis: np.ndarray, idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns of a batch but the last, slots with repeats, with the features."""
    for batch in batches:
        n = batch.num_columns - 1
        own = _onto(_weighed_batch(batch.column(n), idf), basis)
        ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.ListArray.from_arrays(ends, pa.array(own.ravel()))], names=[*batch.schema.names[:n], "features"])


def _summed(table: pa.Table) -> pa.Table:
    """(term, values): the sums of all tasks' values of each term, each number's parts added from the least up, so that their order doesn't matter."""
    terms = table["term"].to_numpy()
    values = table["values"].combine_chunks().flatten().to_numpy().reshape(len(terms), -1)
    found, starts = np.unique(np.sort(terms), return_index=True)
    sums = [np.add.reduceat(v[np.lexsort((v, terms))], starts) for v in values.T]
    return pa.table({"term": found, "values": pa.array(list(np.stack(sums, axis=1)), pa.list_(pa.float64()))})


def topic_basis(weighed: DataFrame, width: int, terms: int, steps: int, seed: int) -> np.ndarray:
    """The ``width`` widest directions of the table of weights, as columns.

    A random block is multiplied by the table and back in each step, one job that adds up
    ``terms`` times ``width`` numbers a task, in twice as many tasks as there are cores
    at most, and made orthonormal; then the directions are put in the order of how much
    of the table they carry.
    """
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(terms, width + SPARE)))[0]
    most = 2 * weighed.sparkSession.sparkContext.defaultParallelism
    for _ in range(steps):
        parts = weighed.select("_ids", "_weights").coalesce(most).mapInArrow(partial(_powered, basis=basis), "term int, values array<double>")
        found = parts.groupBy((F.col("term") % SUM_GROUPS).alias("of")).applyInArrow(_summed, "term int, values array<double>").toArrow()  # as many as the basis has numbers
        moved = np.zeros_like(basis)
        if found.num_rows:
            moved[found["term"].to_numpy()] = found["values"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
        small = basis.T @ moved
        turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
        basis = np.linalg.qr(moved @ turn)[0]
    basis = basis[:, :width]
    return basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(width)] < 0, -1, 1)


def pair_text_topics(windows: DataFrame, tokens: str = "tokens", out: str = "text_features", width: int = 32, terms: int = TERMS, steps: int = 4, fit_rows: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``windows`` with ``out``: ``width`` numbers for each text, its weighted terms seen along the directions in which texts differ most.

    Terms are hashed to ``terms`` slots and weigh by how often a text has them and how few
    texts do. Texts that share no term but terms that go together elsewhere come near each
    other, which counts of terms don't show. Fitted on ``fit_rows`` or on all. Null or
    empty texts have zeros, as all have where nothing was fitted. Columns may not begin with an underscore.
    """
    plain = [f"c{i}" for i in range(len(windows.columns))]
    slots = _slots(tokens, terms)
    ready = windows.select(*[F.col(c).alias(p) for c, p in zip(windows.columns, plain, strict=True)], slots)
    if fit_rows is None:
        ready = fitted = durable(ready, "topic-texts")
    else:
        fitted = durable(fit_rows.select(slots), "topic-texts")
    seen = fitted.select(F.explode(F.array_distinct("_all")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()  # a row a slot
    n, idf = fitted.count(), np.zeros(terms)
    for r in seen:
        idf[r["term"]] = np.log((1 + n) / (1 + r["n"])) + 1
    weighed = durable(_weighed_slots(fitted, idf), "topic-terms")
    basis = topic_basis(weighed, width, terms, steps, seed) if seen else np.zeros((terms, width))
    kinds = [f"{p} {ready.schema[p].dataType.simpleString()}" for p in plain]
    found = ready.mapInArrow(partial(_features, basis=basis, idf=idf), ", ".join([*kinds, "features array<double>"]))
    return found.select(*[F.col(p).alias(c) for c, p in zip(windows.columns, plain, strict=True) if c != out], F.col("features").alias(out))
