"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, durable, id_hash, slices, texts

GRAMS = (3, 4, 5)
BUCKET_BITS, WIDTH = 16, 8
BUCKETS = 1 << BUCKET_BITS
#: Labelled documents of each class that the model is fitted on at most, and entries of their bags together.
MAX_PER_CLASS, MAX_ENTRIES = 2_500, 16_000_000
FOLDS = 5
ROUNDS, BATCH, RATE, DECAY, SEED = 30, 128, 0.05, 1e-5, 42
#: Characters that are worked on at once; a run without a break counts as a new word after so many characters.
PIECE_CHARS, LONGEST_WORD = 1 << 19, 1_000
#: Characters between words, besides the null byte: ASCII white space and signs.
_BETWEEN = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>#*$%&|-_/\\"
_IS_BETWEEN = np.isin(np.arange(256), [0, *map(ord, _BETWEEN)])
_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash factor, and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (_FACTOR, inverse))


@dataclass(frozen=True)
class Words:
    """The words of a piece of text: where each begins, and its subwords as (bucket, counts or not) by the place of their second character."""

    starts: np.ndarray
    subwords: list[tuple[np.ndarray, np.ndarray]]
    whole: np.ndarray

    def sums(self, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the slopes of each word's subwords, and their number; a word as a whole is one of them."""
        if not len(self.starts):
            return np.zeros(0), np.zeros(0)
        total, many = np.zeros(len(self.subwords[0][0]) + 2), np.zeros(len(self.subwords[0][0]) + 2, np.int32)
        for buckets, counts in self.subwords:
            total[1 : len(buckets) + 1] += np.where(counts, slopes[buckets], 0)
            many[1 : len(buckets) + 1] += counts
        return np.add.reduceat(total, self.starts) + slopes[self.whole], np.add.reduceat(many, self.starts) + 1


def words_of(text: str) -> Words:
    """The words of a text and the hash buckets of their character n-grams.

    A word is a run without white space or signs, lower-cased; after ``LONGEST_WORD``
    characters a run goes on as another word. An n-gram lies in a word with a break before
    and after, so beginnings and ends are n-grams of their own; the whole word is one too.
    Every character counts, whatever the length of text and words.
    """
    codes = np.frombuffer(("\0" + text.lower() + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    apart = _IS_BETWEEN[np.minimum(codes, 255)] & (codes < 256)
    codes[apart] = 0
    inside = ~apart
    first = inside[1:] & apart[:-1]
    begin = np.flatnonzero(first) + 1
    if not len(begin):
        return Words(begin, [], begin)
    # a long run begins anew
    run = np.zeros(len(codes), np.int64)
    run[begin] = begin
    run = np.maximum.accumulate(run)
    starts = np.flatnonzero(inside & ((np.arange(len(codes)) - run) % LONGEST_WORD == 0))
    subwords, hashed, counts = [], codes[:-1] * _FACTOR + codes[1:], np.ones(len(codes) - 1, bool)
    for n in range(3, max(GRAMS) + 1):
        hashed = hashed[:-1] * _FACTOR + codes[n - 1 :]
        counts = counts[:-1] & inside[n - 2 : -1]
        if n in GRAMS:
            mixed = (hashed ^ hashed >> np.uint64(29)) * _SPREAD
            subwords.append(((mixed >> np.uint64(64 - BUCKET_BITS)).view(np.int64), counts))
    powers, inverse = _powers(1 << max(20, int(len(codes)).bit_length()))
    # sums of powers give a word's hash from two places of one running sum
    running = np.cumsum(codes * powers[: len(codes)])
    ends = np.append(starts[1:], len(codes)) - 1
    words = (running[ends] - running[starts - 1]) * inverse[starts]
    words = (words ^ words >> np.uint64(31)) * _SPREAD + np.uint64(1)
    return Words(starts, subwords, ((words ^ words >> np.uint64(29)) * _SPREAD >> np.uint64(64 - BUCKET_BITS)).view(np.int64))


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """A text in parts of ``most`` characters at most, cut at a blank or line end where there is one in the last tenth.

    Where there is none a run of at least ``most`` / 10 characters is cut as well:
    it loses the n-grams across the cut and gets those of an end, a few among as many as
    it has characters.
    """
    start = 0
    while len(text) - start > most:
        near = start + most - most // 10
        cut = max(text.rfind(" ", near, start + most), text.rfind("\n", near, start + most))
        cut = cut + 1 if cut > 0 else start + most
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text as buckets and weights that sum to 1: the mean over its words of the mean over a word's subwords."""
    bag, total = np.zeros(BUCKETS), 0
    for part in pieces(text):
        words = words_of(part)
        if not len(words.starts):
            continue
        total += len(words.starts)
        _, many = words.sums(np.zeros(BUCKETS))
        share = 1 / many
        bag += np.bincount(words.whole, share, BUCKETS)
        spans = np.diff(np.append(words.starts, len(words.subwords[0][0]) + 2))
        at = np.concatenate([np.zeros(words.starts[0]), np.repeat(share, spans)])
        for buckets, counts in words.subwords:
            bag += np.bincount(buckets[counts], at[1 : len(buckets) + 1][counts], BUCKETS)
    used = np.flatnonzero(bag)
    return used, bag[used] / max(1, total)


@dataclass(frozen=True)
class ToxicityModel:
    """What the embeddings and the softmax come to: a text's log odds are a mean over words of a mean over n-grams."""

    slopes: np.ndarray
    offset: float

    def log_odds(self, group: list[str]) -> np.ndarray:
        """Log odds of each of several texts: the offset alone for one without words."""
        found = np.full(len(group), self.offset)
        if sum(map(len, group)) > PIECE_CHARS and len(group) == 1:
            parts = [words_of(p).sums(self.slopes) for p in pieces(group[0])]
            means = np.concatenate([total / many for total, many in parts])
            return found + (means.sum() / len(means) if len(means) else 0)
        words = words_of("\0".join(group))
        if len(words.starts):
            total, many = words.sums(self.slopes)
            ends = np.cumsum([len(t.lower()) + 1 for t in group])
            owner = np.searchsorted(ends, words.starts - 1, side="right")
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            found[owner[first]] += np.add.reduceat(total / many, first) / np.diff(np.append(first, len(owner)))
        return found


@dataclass(frozen=True)
class Batch:
    """Bags that are learned from together: their entries as row of the table, document and share."""

    toxic: np.ndarray
    weight: np.ndarray
    rows: np.ndarray
    owner: np.ndarray
    shares: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, bags: list[tuple[np.ndarray, np.ndarray]], used: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Batch:
        sizes = np.array([len(slots) for slots, _ in bags])
        rows = np.searchsorted(used, np.concatenate([slots for slots, _ in bags])).astype(np.int32)
        owner = np.repeat(np.arange(len(bags), dtype=np.int32), sizes)
        return cls(toxic, (weight / weight.sum()).astype(np.float32), rows, owner, np.concatenate([s for _, s in bags]).astype(np.float32), sizes)

    def means(self, table: np.ndarray) -> np.ndarray:
        """The mean embedding of each document; zero for one without words."""
        found, filled = np.zeros((len(self.toxic), table.shape[1]), np.float32), np.flatnonzero(self.sizes)
        if len(filled):
            entries = table.take(self.rows, axis=0)
            entries *= self.shares[:, None]
            found[filled] = np.add.reduceat(entries, (np.cumsum(self.sizes) - self.sizes)[filled], axis=0)
        return found

    def slopes(self, back: np.ndarray, size: int) -> np.ndarray:
        """The slopes of the table's rows, from those of the documents' means."""
        entries = np.ascontiguousarray(back.T).take(self.owner, axis=1)
        entries *= self.shares
        return np.stack([np.bincount(self.rows, e, size) for e in entries], axis=1).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Embeddings of the buckets and softmax weights, trained jointly by Adam on the cross-entropy.

    The prior odds of the whole labelled population come back through ``weight``. Without
    rows of both classes the model gives the prior.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(4 * toxic[0] - 2) * 2 if len(toxic) else -4.0)
    rng = np.random.default_rng(SEED)
    # only buckets that the bags hold are learned; all others stay at zero
    used = np.unique(np.concatenate([slots for slots, _ in bags]))
    order = rng.permutation(len(toxic))
    batches = [Batch.of([bags[i] for i in chosen], used, toxic[chosen], weight[chosen]) for chosen in np.array_split(order, max(1, len(order) // BATCH))]
    table, soft, bias = rng.normal(0, 1 / WIDTH, (len(used), WIDTH)).astype(np.float32), rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    params = [table, soft, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for turn in range(ROUNDS):
        rate = RATE * (1 - turn / ROUNDS)
        for at in rng.permutation(len(batches)):
            batch = batches[at]
            mean = batch.means(table)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), batch.toxic] -= 1
            p *= batch.weight[:, None]
            step += 1
            slopes = batch.slopes((p @ soft.T).astype(np.float32), len(table))
            slopes += np.float32(DECAY) * table
            for i, g in enumerate((slopes, mean.T @ p, p.sum(axis=0))):
                first[i] += np.float32(0.1) * (g - first[i])
                second[i] += np.float32(0.01) * (g * g - second[i])
                params[i] -= np.float32(rate / (1 - 0.9**step)) * first[i] / (np.sqrt(second[i] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    slopes = np.zeros(BUCKETS, np.float32)
    slopes[used] = table @ (soft[:, 1] - soft[:, 0])
    return ToxicityModel(slopes, float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bags = [bag_of(t) for t in texts(batch.column(2))]
        columns = [*batch.columns[:2], pa.array([b.astype(np.int32) for b, _ in bags], pa.list_(pa.int32())), pa.array([w.astype(np.float32) for _, w in bags], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "slots", "shares"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_entries: int = MAX_ENTRIES) -> ToxicityModel:
    """A model fitted on the labelled rows whose crc32(doc_id) mod 5 isn't 0.

    Of each class about ``max_per_class`` documents are taken, chosen by a hash of their
    id; their whole texts become bags in Spark's tasks. Of an id with several texts the
    first in order is taken. The bags reach the driver, with ``max_entries`` entries
    together at most: bags are taken in the order of a hash while there is room. Rows
    without a label are left out; an id with several labels is toxic if one says so.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & (id_hash(F.col("doc_id")) % FOLDS != 0))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = F.lit(0)
    for label, n in sizes.items():
        parts = F.when(F.col("toxic") == label, math.ceil(1_000_003 * min(1.0, max_per_class / n))).otherwise(parts)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < parts)
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_per_class rows of a class
    one = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = durable(one.mapInArrow(_bags, f"doc_id {kind}, toxic int, slots array<int>, shares array<float>"), "toxicity-bags")
    order = F.xxhash64(F.lit("entries"), "doc_id")
    room, last = max_entries, None
    for row in made.select(order.alias("at"), F.size("slots").alias("n")).orderBy("at").collect():  # a row for each chosen id
        if (room := room - row["n"]) < 0:
            break
        last = row["at"]
    rows = made.filter(order <= F.lit(last)).select("toxic", "slots", "shares").toArrow()
    toxic = np.array(rows["toxic"].to_pylist(), np.int64)
    slots, shares = ([c.values.to_numpy(zero_copy_only=False)[a:b] for c in rows[name].chunks for a, b in zip(c.offsets.to_pylist(), c.offsets.to_pylist()[1:], strict=False)] for name in ("slots", "shares"))
    seen = np.bincount(toxic, minlength=2)
    weight = np.array([sizes.get(t, 0) / max(1, seen[t]) for t in toxic])
    del rows
    # the same bags in the same order give the same model, however tasks finish
    order = sorted(range(len(toxic)), key=lambda i: (toxic[i], len(slots[i]), slots[i].tobytes()))
    return train([(slots[i], shares[i]) for i in order], toxic[order], weight[order])


def _groups(group: list[str], most: int = PIECE_CHARS) -> Iterator[list[str]]:
    """Texts in order, about ``most`` characters at a time; a longer text alone."""
    own, size = [], 0
    for text in group:
        if own and size + len(text) > most:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        odds = [model.log_odds(g) for g in _groups(texts(batch.column(2)))]
        scores = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *odds]), -500, 500)))
        columns = [*batch.columns[:2], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every whole text.

    A null text counts as empty and, like it, gets the score of the offset alone; a null
    id counts as the empty text when it is dealt to a fold. Repeated rows score alike and
    an empty table gives an empty one. Only the text enters a score.
    """
    narrow = docs.select("doc_id", (id_hash(F.col("doc_id")) % FOLDS == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(lambda batches: _scored(batches, model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from four fifths of the labels."""
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
