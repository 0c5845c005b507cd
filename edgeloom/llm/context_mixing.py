"""Score texts by online logistic context mixing of hashed-context bit predictors.

A text is coded bit by bit. For each of several contexts (the last 1, 2, 3, 4 and 6 bytes,
and the word so far) a predictor knows how often a bit was 0 or 1 after this context and
the bits of the byte so far. Two mixers add up the predictors' log odds with weights that
a gate picks (how many long contexts were seen, with the bits so far; the last byte); their
weights follow the coding error online. A map from (last byte, mixed log odds) to what was
observed refines the first. While a text is coded, a last mixer adapts along it: its two
weights follow the coding error block by block. The total in bits over the bytes is the
text's bits per byte.

The model is a Spark table that grows with the corpus. A window is a byte with the six
before it; every distinct window is counted once, and windows are dealt to learners by the
hash of their last three context bytes, so that all counts of a long context lie in one
learner's row. What a window's bits come to in each mixer is computed once per distinct
window. Tasks hold these values for the commonest windows; all others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, durable, id_hash, slices, utf8

FOLDS = 10
#: Training documents of this remainder set the mixers' weights and the refining map on counts of the others, and enter the counts after that.
MIXING_FOLD = 1
#: Bytes of context of the predictors; a last one takes the word so far with the blank before it, at least ROUTE bytes and at most the longest.
ORDERS, ROUTE = (1, 2, 3, 4, 6), 3
WINDOW = max(ORDERS) + 1
PREDICTORS = len(ORDERS) + 1
#: A byte that UTF-8 never holds stands for the end of a text and for what is before it.
MARK = b"\xff"
#: Bytes of text that are worked on at once, and bytes of training text whose windows one learner gets, about.
CHUNK_BYTES, LEARNER_BYTES = 1 << 20, 1 << 23
#: Distinct windows that a task counts before it sends them, and windows whose values every task holds; all others are joined.
MAX_WINDOWS, MAX_HELD = 1_500_000, 1 << 21
#: Windows that are made or looked up at once.
PART_WINDOWS = 1 << 16
#: What is added to the counts of zeros and ones; windows after which the weights move, and how often and how fast.
SOFT, BATCH, UPDATES, RATE = 0.2, 1 << 12, 2, 0.3
LEVELS, LONGEST, REFINED = 4, (2, 3, 4), 33
#: Steps of one log odd in the values of a window.
STEPS = 12
#: Bytes of a text after which the last mixer's weights move, how fast, and where they start.
BLOCK, PACE, START = 256, 1.0, 0.5
#: Parts of a bit in which code lengths are summed, so that sums don't depend on their order; and of a token's logarithm.
BIT_PARTS, LOG_PARTS = 1 << 20, 10**10
SMOOTHING = 0.1
#: Tokens whose counts every task holds, and distinct tokens kept in a partial sum.
MAX_HOT, PARTIALS = 1 << 16, 300_000
END_TOKEN = b" "


def tokens_of(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, then one end token."""
    return [*text.lower().split(), END_TOKEN]


def stream_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of several texts, A-Z lower-cased, each after six marks and before one; where each text's windows begin, and their number.

    A text has a window for each byte and one for its end, which begin at its first mark.
    """
    stream = np.frombuffer(b"".join(MARK * (WINDOW - 1) + t.lower() + MARK for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    return stream, np.cumsum(sizes + WINDOW - 1) - sizes - WINDOW + 1, sizes


def windows_at(stream: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The windows that begin from ``start`` to ``stop``: seven bytes as one 56-bit number."""
    part = stream[start : stop + WINDOW - 1].astype(np.uint64)
    two = part[:-1] << np.uint64(8) | part[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    three = two[:-1] << np.uint64(8) | part[2:]
    return four[:-3] << np.uint64(24) | three[4:]


def pieces(stream: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """The places at which windows begin, ``most`` at a time."""
    ends = len(stream) - WINDOW + 1
    for start in range(0, ends, most):
        yield start, min(ends, start + most)


def windows(text: bytes) -> np.ndarray:
    """The windows of one text."""
    stream, _, sizes = stream_of([text])
    return windows_at(stream, 0, int(sizes[0]))


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in slices(batches, 2048):
        texts, start, size = utf8(batch.column(column)), 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= most or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def squeezed(values: np.ndarray) -> bytes:
    """An array as bytes for shuffles and tables: first bytes of all values, second bytes and so on, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def opened(data: bytes, kind: np.dtype | type) -> np.ndarray:
    """What ``squeezed`` made bytes of."""
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


# ---- counts of distinct windows


def learner_of(keys: np.ndarray, learners: int) -> np.ndarray:
    """Which learner has a window: by the hash of its last three context bytes."""
    last = keys >> np.uint64(8) & np.uint64((1 << 8 * ROUTE) - 1)
    return ((last * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(learners)).astype(np.int64)


def by_learner(learner: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The learners that occur, and for each array its parts by learner, in the order they had."""
    order = np.argsort(learner, kind="stable")
    some, sizes = tallied(learner[order])
    cuts = np.cumsum(sizes)[:-1]
    return some, [np.split(x[order], cuts) if len(x) else [] for x in values]


def tallied(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted list, with the sums of their counts, or else how often they stand there."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several sorted lists in order, with their counts summed."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    both = np.concatenate(keys)
    order = np.argsort(both, kind="stable")  # merges runs that are in order already
    return tallied(both[order], np.concatenate(counts)[order])


#: Roles of documents, as they stand above a window's 56 bits: they fill the counts, set the weights, or are held out.
FILL, MIX, HELD = range(3)
ROLE = np.uint64(56)
PURE = np.uint64((1 << 56) - 1)


def _window_counts(batches: Iterator[pa.RecordBatch], learners: int) -> Iterator[pa.RecordBatch]:
    """A task's distinct windows by role with their counts, packed by learner."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        found, often = merged(keys, counts)
        some, (found, often) = by_learner(learner_of(found, learners), found, often.astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([squeezed(x) for x in parts], pa.binary()) for parts in (found, often))], names=["learner", "windows", "counts"])

    for batch, texts in chunks(batches, 1):
        stream, starts, sizes = stream_of(texts)
        role = np.full(len(stream), 255, np.uint8)
        for start, size, own in zip(starts.tolist(), sizes.tolist(), batch.column(0).to_pylist(), strict=True):
            role[start : start + size] = own
        for start, stop in pieces(stream, 2 * CHUNK_BYTES):
            parts = ((role[start + a : start + b], windows_at(stream, start + a, start + b)) for a, b in pieces(stream[start : stop + WINDOW - 1], PART_WINDOWS))
            own = np.concatenate([(w | r.astype(np.uint64) << ROLE)[r < 255] for r, w in parts])
            own.sort()
            found, often = tallied(own)
            keys.append(found)
            counts.append(often)
            if sum(map(len, keys)) > MAX_WINDOWS:
                keys[:], counts[:] = ([x] for x in merged(keys, counts))
                if len(keys[0]) > MAX_WINDOWS // 2:
                    yield packed()
                    keys.clear()
                    counts.clear()
    if keys:
        yield packed()
    pa.default_memory_pool().release_unused()


@dataclass(frozen=True)
class Windows:
    """Distinct windows in order, with how often they occur in documents of each role."""

    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, keys: bytes, counts: bytes) -> Windows:
        return cls(opened(keys, np.uint64), opened(counts, np.uint64).reshape(3, -1).astype(np.float64))

    @property
    def past(self) -> np.ndarray:
        return self.keys >> np.uint64(8)

    @property
    def byte(self) -> np.ndarray:
        return (self.keys & np.uint64(255)).astype(np.int64)

    @property
    def last(self) -> np.ndarray:
        return (self.keys >> np.uint64(8) & np.uint64(255)).astype(np.int64)


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    """One row of a learner's distinct windows and their counts by role."""
    found, often = merged([opened(x.as_py(), np.uint64) for x in rows["windows"]], [opened(x.as_py(), np.uint32).astype(np.int64) for x in rows["counts"]])
    pure, at = np.unique(found & PURE, return_inverse=True)
    counts = np.zeros((3, len(pure)), np.uint64)
    counts[(found >> ROLE).astype(np.int64), at] = often
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([squeezed(pure)], pa.binary()), pa.array([squeezed(counts.reshape(-1))], pa.binary())], names=["learner", "windows", "counts"])


def window_table(texts: DataFrame, learners: int) -> DataFrame:
    """A row per learner with its distinct windows (sorted) and their counts, from ``role`` and ``text``.

    Tasks count before they send; a learner's share follows from ``learners``, which grows
    with the corpus. The windows of one three-byte context can't be told apart by it, so
    they stay together: their number is that of the windows seen after those three bytes,
    however often.
    """
    partial = texts.mapInArrow(lambda batches: _window_counts(batches, learners), "learner int, windows binary, counts binary")
    return partial.groupBy("learner").applyInArrow(_summed, "learner int, windows binary, counts binary")


# ---- the predictors


def word_context(past: np.ndarray) -> np.ndarray:
    """The bytes since the last blank, line end or mark, that one included; ROUTE bytes at least."""
    size = np.full(len(past), WINDOW - 1, np.uint64)
    for k in range(WINDOW - 2, -1, -1):
        byte = past >> np.uint64(8 * k) & np.uint64(255)
        size[(byte == 32) | (byte == 10) | (byte == 255)] = max(k + 1, ROUTE)
    return past & (np.uint64(1) << size * np.uint64(8)) - np.uint64(1)


def node_odds(context: np.ndarray, byte: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a 1 at each of a byte's eight bits after its context, and whether this point was ever met; each (8, n).

    Sorted by context and byte, all bytes that begin with the same bits lie together, so
    each step is a sum over runs.
    """
    odds, met = np.zeros((8, len(byte)), np.float32), np.zeros((8, len(byte)), bool)
    key = (context * np.uint64(0x9E3779B97F4A7C15) & ~np.uint64(255)) | byte.astype(np.uint64)
    order = np.argsort(key)
    key, counts = key[order], counts[order]
    for k in range(8):
        node = key >> np.uint64(8 - k)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        if not len(first):
            break
        total = np.add.reduceat(counts, first)
        ones = np.add.reduceat(np.where(key >> np.uint64(7 - k) & np.uint64(1), counts, 0.0), first)
        value = np.log((ones + SOFT) / (total - ones + SOFT))
        long = np.diff(np.append(first, len(node)))
        odds[k, order], met[k, order] = np.repeat(value, long), np.repeat(total > 0, long)
    return odds, met


@dataclass(frozen=True)
class ShortContexts:
    """Counts of the two shortest contexts: (two bytes, next byte) as a sorted number, and how often by role. At most 2 ** 24 rows."""

    pairs: np.ndarray
    counts: np.ndarray

    @cached_property
    def fill_odds(self) -> np.ndarray:
        return self._odds(self.counts[FILL])

    @cached_property
    def all_odds(self) -> np.ndarray:
        return self._odds(self.counts[FILL] + self.counts[MIX])

    def _odds(self, counts: np.ndarray) -> np.ndarray:
        """Log odds of the orders 1 and 2 at each bit; (2, 8, rows)."""
        byte = self.pairs & np.uint64(255)
        return np.stack([node_odds(self.pairs >> np.uint64(8) & np.uint64(255), byte, counts)[0], node_odds(self.pairs >> np.uint64(8), byte, counts)[0]])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            own = Windows.of(keys, counts)
            pairs, at = np.unique(own.keys & np.uint64(0xFFFFFF), return_inverse=True)
            sums = [pa.array(np.bincount(at, own.counts[r], len(pairs)).astype(np.int64)) for r in (FILL, MIX)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), *sums], names=["pair", "fill", "mix"])


def short_contexts(table: DataFrame) -> ShortContexts:
    """Counts by the last two bytes and the next, over all learners."""
    sums = table.select("windows", "counts").mapInArrow(_pair_counts, "pair int, fill long, mix long").groupBy("pair").agg(F.sum("fill").alias("fill"), F.sum("mix").alias("mix"))
    rows = sums.toArrow()
    pairs = rows["pair"].to_numpy().astype(np.uint64)
    order = np.argsort(pairs)
    return ShortContexts(pairs[order], np.stack([rows[c].to_numpy().astype(np.float64)[order] for c in ("fill", "mix")]))


# ---- mixing

INPUTS = PREDICTORS + 1
#: Gates of the two mixers: long contexts seen and the bits so far; the last byte and the bit's place.
GATES = (LEVELS * 256, 256 * 8)


class Steps:
    """The eight coding steps of some windows: the predictors' log odds with a bias, and the gates."""

    def __init__(self, own: Windows, counts: np.ndarray, short: ShortContexts, short_odds: np.ndarray):
        at = np.searchsorted(short.pairs, own.keys & np.uint64(0xFFFFFF))
        past = own.past
        contexts = [past & np.uint64((1 << 8 * n) - 1) for n in ORDERS[2:]] + [word_context(past)]
        long = [node_odds(c, own.byte, counts) for c in contexts]
        self.odds = [short_odds[0][:, at], short_odds[1][:, at], *(o for o, _ in long)]
        self.level = sum(long[i - 2][1].astype(np.int8) for i in LONGEST)
        self.byte, self.last = own.byte, own.last

    def __call__(self, k: int, chosen: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Inputs (INPUTS, n), the gate of each mixer, and the bit at step ``k``."""
        byte = self.byte[chosen]
        rows = np.stack([*(o[k][chosen] for o in self.odds), np.full(len(byte), 0.3, np.float32)])
        return rows, (self.level[k][chosen].astype(np.int64) * 256 + ((1 << k) | byte >> (8 - k)), self.last[chosen] * 8 + k), byte >> (7 - k) & 1


def _mixed(weights: np.ndarray, rows: np.ndarray, gate: np.ndarray) -> np.ndarray:
    total = weights[0][gate] * rows[0]
    for i in range(1, INPUTS):
        total += weights[i][gate] * rows[i]
    return np.clip(total, -12, 12)


def _scattered(keys: np.ndarray) -> np.ndarray:
    """An order of windows that has nothing to do with their bytes and is the same in every run."""
    mixed = (keys ^ keys >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.argsort((mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")


def learn(own: Windows, short: ShortContexts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights of both mixers by one learner, and how often each gate was used: its mixing windows, batch after batch."""
    weights, memory, use = ([np.full((INPUTS, n), x) for n in GATES] for x in (0.3, 1e-3, 0.0))
    use = [u[0] for u in use]
    steps = Steps(own, own.counts[FILL], short, short.fill_odds)
    mixing = np.flatnonzero(own.counts[MIX])
    mixing = mixing[_scattered(own.keys[mixing])]
    for start in range(0, len(mixing), BATCH):
        chosen = mixing[start : start + BATCH]
        counts = own.counts[MIX][chosen]
        for k in range(8):
            rows, gates, bit = steps(k, chosen)
            for m, gate in enumerate(gates):
                often = np.bincount(gate, counts, GATES[m])
                for _ in range(UPDATES):
                    error = (bit - 1 / (1 + np.exp(-_mixed(weights[m], rows, gate)))) * counts
                    slope = np.stack([np.bincount(gate, error * r, GATES[m]) for r in rows]) / np.maximum(often, 1)
                    memory[m] += slope**2
                    weights[m] += RATE * slope / np.sqrt(memory[m]) * (often > 0)
                use[m] += often
    return weights, use


def _learned(batches: Iterator[pa.RecordBatch], short: ShortContexts) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            weights, use = learn(Windows.of(keys, counts), short)
            for m in range(len(GATES)):
                used = np.flatnonzero(use[m])
                columns = [pa.array(np.full(len(used), m), pa.int32()), pa.array(used, pa.int32()), pa.array(use[m][used].astype(np.int64)), *(pa.array(np.rint(w[used] * (1 << 20)).astype(np.int64)) for w in weights[m])]
                yield pa.RecordBatch.from_arrays(columns, names=["mixer", "gate", "n", *(f"w{i}" for i in range(INPUTS))])


def learn_weights(table: DataFrame, short: ShortContexts) -> list[np.ndarray]:
    """Weights of both mixers: each learner's follow the coding error online, and learners are averaged by use, in whole numbers."""
    names = [f"w{i}" for i in range(INPUTS)]
    learned = table.select("windows", "counts").mapInArrow(lambda batches: _learned(batches, short), ", ".join(["mixer int, gate int, n long", *(f"{c} long" for c in names)]))
    share = F.col("n").cast("decimal(20,0)")
    weights = [np.full((INPUTS, n), 0.3) for n in GATES]
    for row in learned.groupBy("mixer", "gate").agg(F.sum(share).alias("n"), *[F.sum(share * F.col(c)).alias(c) for c in names]).collect():
        weights[row["mixer"]][:, row["gate"]] = [float(row[c] / row["n"]) / (1 << 20) for c in names]
    return [w.astype(np.float32) for w in weights]


def _place(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the refining map below some log odds, and how far they lie towards the next."""
    at = (np.clip(total, -7.999, 7.999) + 8) * ((REFINED - 1) / 16)
    low = at.astype(np.int64)
    return low, at - low


def _observed(batches: Iterator[pa.RecordBatch], short: ShortContexts, weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """How often each cell of the refining map met a 0 and a 1."""
    seen = np.zeros(256 * REFINED * 2)
    for batch in batches:
        for keys, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            own = Windows.of(keys, counts)
            steps, mixing = Steps(own, own.counts[FILL], short, short.fill_odds), np.flatnonzero(own.counts[MIX])
            for k in range(8):
                rows, gates, bit = steps(k, mixing)
                low, up = _place(_mixed(weights[0], rows, gates[0]))
                seen += np.bincount((own.last[mixing] * REFINED + low + (up >= 0.5)) * 2 + bit, own.counts[MIX][mixing], len(seen))
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used].astype(np.int64))], names=["cell", "n"])


def learn_refinement(table: DataFrame, short: ShortContexts, weights: list[np.ndarray]) -> np.ndarray:
    """Probability of a 1 by last byte and mixed log odds, from what the mixing texts show; the odds themselves where little was seen."""
    found = table.select("windows", "counts").mapInArrow(lambda batches: _observed(batches, short, weights), "cell int, n long")
    seen = np.zeros(256 * REFINED * 2)
    for row in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        seen[row["cell"]] = row["n"]
    seen = seen.reshape(256, REFINED, 2)
    plain = 1 / (1 + np.exp(-np.linspace(-8, 8, REFINED)))
    return ((seen[:, :, 1] + 30 * plain) / (seen.sum(axis=2) + 30)).astype(np.float32)


# ---- values of windows


def window_values(own: Windows, short: ShortContexts, weights: list[np.ndarray], refinement: np.ndarray) -> np.ndarray:
    """What both mixers say for each bit of a window's byte, in STEPS of a log odd towards the bit; (2, n, 8) small integers.

    They depend on the context and the bits so far alone, but for their sign, so the two
    values of a bit stand for probabilities that sum to one.
    """
    steps, flat = Steps(own, own.counts[FILL] + own.counts[MIX], short, short.all_odds), refinement.reshape(-1)
    values = np.empty((2, len(own.keys), 8), np.int8)
    for k in range(8):
        rows, gates, bit = steps(k)
        first, second = (_mixed(w, rows, g) for w, g in zip(weights, gates, strict=True))
        low, up = _place(first)
        at = own.last * REFINED + low
        refined = np.clip(0.5 / (1 + np.exp(-first)) + 0.5 * (flat[at] * (1 - up) + flat[at + 1] * up), 1e-5, 1 - 1e-5)
        for m, odds in enumerate((np.log(refined / (1 - refined)), second)):
            values[m, :, k] = np.clip(np.rint(odds * STEPS), -127, 127) * (2 * bit - 1)
    return values


def _valued(batches: Iterator[pa.RecordBatch], short: ShortContexts, weights: list[np.ndarray], refinement: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """A learner's windows and values: those that occur ``least`` times or more in training texts, and the others."""
    for batch in batches:
        for learner, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = Windows.of(keys, counts)
            values = window_values(own, short, weights, refinement)
            trained = own.counts[FILL] + own.counts[MIX]
            hold = (trained > 0) & (trained >= least)
            data = [squeezed(x) for side in (hold, ~hold) for x in (own.keys[side], *(np.ascontiguousarray(v[side]).reshape(-1).view(np.uint64) for v in values))]
            yield pa.RecordBatch.from_arrays([pa.array([learner], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["learner", "held", "held_a", "held_b", "windows", "a", "b"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            parts = opened(counts, np.uint64).reshape(3, -1)
            total = parts[FILL] + parts[MIX]
            size, n = np.unique(np.floor(np.log2(total[total > 0]) * 8).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n.astype(np.int64))], names=["size", "n"])


def least_held(table: DataFrame, most: int = MAX_HELD) -> float:
    """How often a window must occur in training texts for tasks to hold it, so that they hold ``most`` at most. What held-out texts hold has no say."""
    sizes = table.select("counts").mapInArrow(_sizes, "size int, n long").groupBy("size").agg(F.sum("n").alias("n")).collect()
    room, least = most, math.inf
    for row in sorted(sizes, key=lambda r: -r["size"]):
        if (room := room - row["n"]) < 0:
            break
        least = 2 ** (row["size"] / 8) * (1 - 1e-12)
    return least


class HeldWindows:
    """Values of the commonest windows, in the order of a hash, with where each value of its first bits begins."""

    def __init__(self, keys: np.ndarray, values: tuple[np.ndarray, np.ndarray]):
        self.bits = max(4, len(keys).bit_length())
        hashed = self._hashed(keys)
        order = np.argsort(hashed)
        self.size = len(keys)
        #: The key and the values past the last stand for every window that isn't held.
        self.keys = np.append(keys[order], ~np.uint64(0))
        self.values = tuple(np.append(v[order], np.uint64(0)) for v in values)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self._bucket(hashed), minlength=1 << self.bits))]).astype(np.int32)

    @staticmethod
    def _hashed(keys: np.ndarray) -> np.ndarray:
        return (keys ^ keys >> np.uint64(27)) * np.uint64(0x9E3779B97F4A7C15)

    def _bucket(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each window; ``size`` where it isn't held."""
        bucket = self._bucket(self._hashed(keys))
        at = self.first[bucket]
        todo = np.flatnonzero(self.keys[at] != keys)
        ends, rest = self.first[bucket[todo] + 1], keys[todo]
        while len(todo):
            at[todo] += 1
            place = at[todo]
            over = place >= ends
            at[todo[over]] = self.size
            more = ~over & (self.keys[np.minimum(place, self.size)] != rest)
            todo, ends, rest = todo[more], ends[more], rest[more]
        return at


# ---- coding texts

REST = np.dtype([("row", "<i8"), ("window", "<u8"), ("w0", "<f4"), ("w1", "<f4")])
SUM = np.dtype([("row", "<i8"), ("bits", "<i8")])
#: Windows that aren't held and travel together, about.
PACK_WINDOWS = 1 << 17


def coded(texts: list[bytes], held: HeldWindows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code length in nats of each text's held windows; and of its other windows the text, the window and the weights there.

    All texts are coded side by side, block by block: a block of ``BLOCK`` bytes is coded
    with the weights as they stand, then they move along the mean slope of its coding
    error, between 0 and 1. Windows that aren't held move nothing.
    """
    stream, starts, sizes = stream_of(texts)
    blocks = -(-sizes // BLOCK)
    order = np.argsort(-blocks, kind="stable")
    first = np.zeros(len(texts), np.int64)
    first[order] = np.cumsum([0, *blocks[order][:-1].tolist()])
    dummy, (a, b) = held.size, held.values
    at = np.empty(len(stream) - WINDOW + 1, np.int32)
    for start, stop in pieces(stream, PART_WINDOWS):
        at[start:stop] = held.find(windows_at(stream, start, stop))
    places = np.full((int(blocks.sum()), BLOCK), dummy, np.int32)
    flat = places.reshape(-1)
    for to, start, size in zip((first * BLOCK).tolist(), starts.tolist(), sizes.tolist(), strict=True):
        flat[to : to + size] = at[start : start + size]
    dummies = np.count_nonzero(places == dummy, axis=1) * (8 * math.log(2))
    weights = np.full((len(texts), 2), START, np.float32)
    history = np.empty((len(places), 2), np.float32)
    nats = np.zeros(len(texts))
    firsts, many = first[order], blocks[order]
    active, wide = len(texts), 8 * BLOCK
    for j in range(int(many[0])):
        while many[active - 1] <= j:
            active -= 1
        rows = firsts[:active] + j
        w = history[rows] = weights[:active]
        where = places[rows]
        za, zb = (x.take(where).view(np.int8).astype(np.float32) for x in (a, b))
        odds = za * (w[:, :1] / -STEPS)
        odds += zb * (w[:, 1:] / -STEPS)
        np.exp(odds, out=odds)
        whole = odds + 1
        odds /= whole
        # the logarithm of a product of four: weights up to 1 keep it in range
        whole = whole[:, : wide // 2] * whole[:, wide // 2 :]
        whole = whole[:, : wide // 4] * whole[:, wide // 4 :]
        nats[:active] += np.add.reduce(np.log(whole, out=whole), axis=1, dtype=np.float64) - dummies[rows]
        for m, z in enumerate((za, zb)):
            z *= odds
            weights[:active, m] += z.sum(axis=1) * np.float32(PACE / (wide * STEPS))
        np.clip(weights[:active], 0, 1, out=weights[:active])
    found = np.zeros(len(texts))
    found[order] = nats
    # windows that aren't held: where they begin, and whose they are
    missed = np.flatnonzero(at == dummy)
    owner = np.searchsorted(starts, missed, side="right") - 1
    inside = missed - starts[owner]
    real = inside < sizes[owner]
    missed, owner, inside = missed[real], owner[real], inside[real]
    window = np.zeros(len(missed), np.uint64)
    for k in range(WINDOW):
        window = window << np.uint64(8) | stream[missed + k]
    return found, owner, window, history[first[owner] + inside // BLOCK]


def rest_bits(windows: np.ndarray, weights: np.ndarray, keys: np.ndarray, values: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Code length in bits of single windows at given weights, from a sorted list of windows with values."""
    at = np.searchsorted(keys, windows)
    total = weights[:, :1].astype(np.float64) * values[0][at] + weights[:, 1:].astype(np.float64) * values[1][at]
    return np.log1p(np.exp(total / -STEPS)).sum(axis=1) / math.log(2)


def _coded_rest(key: tuple, asked: pa.Table, table: pa.Table) -> pa.Table:
    """Sums of code lengths by row, for each pack of texts, of the windows that one learner has."""
    shape = pa.schema([("pack", pa.int64()), ("sums", pa.binary())])
    if not asked.num_rows:
        return shape.empty_table()
    keys = opened(table["windows"][0].as_py(), np.uint64)
    values = tuple(opened(table[c][0].as_py(), np.uint64).view(np.int8).reshape(-1, 8) for c in ("a", "b"))
    sums = []
    for data in asked["data"]:
        rows = opened(data.as_py(), REST)
        bits = np.concatenate([rest_bits(r["window"], np.stack([r["w0"], r["w1"]], axis=1), keys, values) for r in np.array_split(rows, max(1, len(rows) >> 17))])
        sums.append(squeezed(_by_row(rows["row"], np.rint(bits * BIT_PARTS).astype(np.int64))))
    return pa.table([asked["pack"], pa.chunked_array([pa.array(sums, pa.binary())])], schema=shape)


def _by_row(row: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rows with the sums of their bits."""
    order = np.argsort(row, kind="stable")
    row, bits = tallied(row[order], bits[order])
    found = np.empty(len(row), SUM)
    found["row"], found["bits"] = row, bits
    return found


def _rest_sums(key: tuple, packs: pa.Table) -> pa.Table:
    """Sums over all learners for the texts of one pack."""
    both = np.concatenate([opened(x.as_py(), SUM) for x in packs["sums"]])
    found = _by_row(both["row"], both["bits"])
    zeros = np.zeros(len(found), np.int64)
    return pa.table([np.ascontiguousarray(found["row"]), zeros, zeros, np.ascontiguousarray(found["bits"])], names=["row", "known", "logs", "bits"])


# ---- the base: single tokens


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    for batch in slices(batches):
        for text in utf8(batch.column(0)):
            counts.update(tokens_of(text))
        if len(counts) > PARTIALS:
            yield row()
            counts.clear()
    yield row()


def token_counts(texts: DataFrame) -> DataFrame:
    """``token`` and ``n`` over all texts (one column), summed within tasks before the shuffle."""
    return texts.mapInArrow(_token_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def hot_tokens(counts: DataFrame, most: int = MAX_HOT) -> dict[bytes, int]:
    """The commonest tokens with their counts, ``most`` at most: all those above a count that the sizes of count classes give."""
    classes = counts.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count("*").alias("tokens")).collect()
    room, least = most, None
    for row in sorted(classes, key=lambda r: -r["c"]):
        if (room := room - row["tokens"]) < 0:
            break
        least = row["c"]
    if least is None:
        return {}
    return {bytes(r["token"]): r["n"] for r in counts.filter(F.floor(F.log2("n") * 8) >= least).collect()}


# ---- the model and the scores


@dataclass(frozen=True)
class MixingModel:
    """``held`` for every task, and a table (``learner``, ``windows``, ``a``, ``b``) of all other windows' values."""

    held: HeldWindows
    table: DataFrame
    learners: int


def fit_mixing(texts: DataFrame, train_bytes: int, most: int = MAX_HELD) -> MixingModel:
    """A model of ``role`` and ``text``: counts, mixers and refining map, and the values of every window of any role."""
    learners = 1 + train_bytes // LEARNER_BYTES
    table = durable(window_table(texts, learners), "mixing-windows")
    short = short_contexts(table)
    weights = learn_weights(table, short)
    refinement = learn_refinement(table, short, weights)
    least = least_held(table, most)
    shape = "learner int, held binary, held_a binary, held_b binary, windows binary, a binary, b binary"
    values = durable(table.mapInArrow(lambda batches: _valued(batches, short, weights, refinement, least), shape), "mixing-values")
    some = F.length("held") > len(squeezed(np.zeros(0, np.uint64)))  # of learners that hold windows at all
    rows = values.filter(some).select("learner", "held", "held_a", "held_b").orderBy("learner").toArrow()
    joined = lambda c: np.concatenate([np.zeros(0, np.uint64), *(opened(x.as_py(), np.uint64) for x in rows[c])])
    return MixingModel(HeldWindows(joined("held"), (joined("held_a"), joined("held_b"))), values.select("learner", "windows", "a", "b"), learners)


SCORED = "held_out boolean, n_tokens long, known long, logs long, bits long, n_bytes long, rest array<binary>, often array<long>, pack long, learner int, data binary"


def _scored(batches: Iterator[pa.RecordBatch], held: HeldWindows, learners: int, hot: dict[bytes, int], total: float) -> Iterator[pa.RecordBatch]:
    """Per text its figures over hot tokens and held windows, with its other tokens; and rows of other windows, packed by learner."""
    logs = {token: math.log10((n + SMOOTHING) / total) for token, n in hot.items()}
    shape = pa.schema([("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.int64()), ("bits", pa.int64()), ("n_bytes", pa.int64()), ("rest", pa.list_(pa.binary())), ("often", pa.list_(pa.int64())), ("pack", pa.int64()), ("learner", pa.int32()), ("data", pa.binary())])
    left: list[np.ndarray] = []
    ids: pa.DataType | None = None

    def packed() -> pa.RecordBatch:
        rows = np.concatenate(left)
        some, (parts,) = by_learner(learner_of(rows["window"], learners), rows)
        data = [squeezed(x) for x in parts]
        known = {"pack": pa.array(np.full(len(some), rows["row"].min()), pa.int64()), "learner": pa.array(some, pa.int32()), "data": pa.array(data, pa.binary())}
        left.clear()
        return pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), ids), *(known.get(f.name, pa.nulls(len(some), f.type)) for f in shape)], names=["row", "doc_id", *shape.names])

    for batch, texts in chunks(batches, 3):
        ids = batch.column(1).type
        nats, owner, missed, weights = coded(texts, held)
        if len(missed):
            rows = np.empty(len(missed), REST)
            rows["row"], rows["window"], rows["w0"], rows["w1"] = batch.column(0).to_numpy()[owner], missed, weights[:, 0], weights[:, 1]
            left.append(rows)
        n_tokens, known, base, rest, often = [], [], [], [], []
        for text in texts:
            tokens = tokens_of(text)
            found = [x for x in map(logs.get, tokens) if x is not None]
            others = Counter(t for t in tokens if t not in logs) if len(found) < len(tokens) else {}
            n_tokens.append(len(tokens))
            known.append(len(found))
            base.append(round(math.fsum(found) * LOG_PARTS))
            rest.append(list(others))
            often.append(list(others.values()))
        bits = np.rint(nats / math.log(2) * BIT_PARTS).astype(np.int64)
        made = [batch.column(2), n_tokens, known, base, bits, [len(t) + 1 for t in texts], rest, often, *(pa.nulls(len(texts), shape.field(c).type) for c in ("pack", "learner", "data"))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, shape, strict=True))], names=["row", "doc_id", *shape.names])
        if sum(map(len, left)) > PACK_WINDOWS:
            yield packed()
    if left:
        yield packed()
    pa.default_memory_pool().release_unused()


def _role(doc_id: Column) -> Column:
    fold = id_hash(doc_id) % FOLDS
    return F.when(fold == 0, F.lit(HELD)).when(fold == MIXING_FOLD, F.lit(MIX)).otherwise(F.lit(FILL))


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_HELD) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte``.

    ``score`` is the model's log10 probability of the whole text with A-Z lower-cased and
    of its end. Counts, weights and map come from every document whose crc32(id) mod 10
    isn't 0; held-out documents only add the windows that must have a value, and change no other
    document's score. Tasks hold the
    values of ``most`` windows at most, the commonest in training; each other window of a text is
    joined by learner and coded with the weights at its place, which it doesn't move.
    Learners are made of windows in an order of their own and sums are of whole numbers,
    so scores don't depend on how the rows are partitioned.

    ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; counts of
    the commonest tokens (at most ``MAX_HOT``) are held by every task, those of all others
    are joined by token, so no token's rows meet in one task because it is common.

    Nulls: a null text counts as empty and is scored by its end alone; a null id counts
    as the empty text for its fold (0: held out). Repeated rows are scored alike. An empty
    table gives an empty one. Other columns aren't read.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), _role(F.col(doc_id)).alias("role"), F.col(text).cast("string").alias("text"))
    counts = durable(token_counts(narrow.filter(F.col("role") != HELD).select("text")), "mixing-tokens")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.col("n") * (F.octet_length("token") + 1)).alias("bytes")).first()
    n, v = sums["n"] or 0, sums["v"]
    total = n + SMOOTHING * (v + 1)
    model, hot = fit_mixing(narrow.select("role", "text"), sums["bytes"] or 0, most), hot_tokens(counts)
    kind = docs.schema[doc_id].dataType.simpleString()
    held, learners = docs.sparkSession.sparkContext.broadcast(model.held), model.learners
    texts = narrow.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.col("role") == HELD).alias("held_out"), "text")
    scored = durable(texts.mapInArrow(lambda batches: _scored(batches, held.value, learners, hot, total), f"row long, doc_id {kind}, {SCORED}"), "mixing-scored")
    rows = scored.filter("row is not null")
    rare = rows.select("row", F.explode(F.arrays_zip("rest", "often")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.often").alias("times"))
    log = F.log10((F.coalesce("n", F.lit(0)) + SMOOTHING) / F.lit(total))
    tokens = rare.join(counts, "token", "left").select(
        "row",
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(F.lit(0)).cast("long").alias("known"),
        (F.col("times") * F.round(log * LOG_PARTS).cast("long")).alias("logs"),
        F.lit(0).cast("long").alias("bits"),
    )
    asked = scored.filter("row is null").select("learner", "pack", "data").groupBy("learner")
    packs = asked.cogroup(model.table.groupBy("learner")).applyInArrow(_coded_rest, "pack long, sums binary")
    others = packs.groupBy("pack").applyInArrow(_rest_sums, "row long, known long, logs long, bits long")
    more = tokens.unionByName(others).groupBy(F.col("row").alias("of")).agg(*[F.sum(c).alias(f"more_{c}") for c in ("known", "logs", "bits")])
    both = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("known", "logs", "bits")}
    return rows.join(more, F.col("row") == F.col("of"), "left").select(
        "doc_id", "held_out", "n_tokens",
        both["known"].alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (both["logs"] / LOG_PARTS).alias("base_score"),
        (-both["bits"] / BIT_PARTS * F.lit(math.log10(2))).alias("score"),
        (both["bits"] / BIT_PARTS / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document, learned from nine tenths of the table."""
    return score_texts(documents(spark, sf_dir))
