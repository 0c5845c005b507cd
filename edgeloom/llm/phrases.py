"""Fingerprints of texts from the names of locally consistent phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, durable, others, own_names, quoted, slices, texts, utf8

#: Levels of phrases: those of level 1 are a few bytes long, each further level's about three times as long.
LEVELS = 4
#: Levels whose phrases a fingerprint is drawn from.
PRINTED = (2, 3, 4)
#: Slots of a fingerprint, each 4 hexadecimal digits; 0000 is an empty one.
SLOTS = 128
#: UTF-8 bytes of texts that are parsed together, unless one text has more; symbols that are named together.
BATCH_BYTES, NAMED = 1 << 20, 1 << 18

#: Rows of a range that a task sorts and compares, while that makes fewer ranges than stated.
RANGE_ROWS, MOST_RANGES = 1_000, 10_000

#: The byte between texts, which UTF-8 never holds, and its name on all higher levels.
GAP, GAP_NAME = 0xFF, (1 << 64) - 1
_DEBRUIJN = 0x03F79D71B4CB0A89
_LOW = np.zeros(64, np.uint8)
_LOW[[(_DEBRUIJN << i & GAP_NAME) >> 58 for i in range(64)]] = np.arange(64)
_LOW_OF_BYTE = np.array([(x & -x).bit_length() - 1 if x else 0 for x in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTE_VALUES = mixed(np.arange(256, dtype=np.uint64))
_FACTOR = 0xD6E8FEB86659FD93


def _toss(symbols: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing: twice the lowest bit in which a symbol differs from the one before, plus that bit.

    Neighbours that differ get labels that differ. A gap's label is a constant.
    """
    change = symbols[1:] ^ symbols[:-1]
    if symbols.dtype == np.uint8:
        low = _LOW_OF_BYTE[change]
        bit = symbols[1:] >> low & 1
    else:
        low = _LOW[((change & -change) * np.uint64(_DEBRUIJN)) >> np.uint64(58)]
        bit = (symbols[1:] >> low.astype(np.uint64) & np.uint64(1)).astype(np.uint8)
    labels = np.full(len(symbols), 255, np.uint8)
    labels[1:] = 2 * low + bit
    labels[gaps] = 255
    return labels


def _named(values: np.ndarray, runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A name for each phrase, from the values and repetitions of its symbols and their order."""
    sizes = np.diff(np.append(first, len(values)))
    powers = np.cumprod(np.full(int(sizes.max()), _FACTOR, np.uint64))
    repeated = runs > 1
    values = values.copy()
    values[repeated] = mixed(values[repeated] + runs[repeated].astype(np.uint64) * np.uint64(_FACTOR))
    place = np.arange(len(values)) - np.repeat(first, sizes)
    names = mixed(np.add.reduceat(values * powers[place], first) + sizes.astype(np.uint64))
    return np.minimum(names, np.uint64(GAP_NAME - 1))


def next_level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first bytes of the phrases that symbols (bytes or names) are parsed into.

    Repetitions of one symbol count as one with a number. Two rounds of coin tossing turn
    each symbol into a label under 16 that depends on it and the two before; a phrase
    begins where a label is greater than its neighbours. So where a phrase begins depends
    on the few symbols around it, and equal stretches are parsed alike but near their ends,
    wherever they stand. Gaps stay as they are and no phrase extends over one; the first
    and the last symbol must be gaps.
    """
    gap = symbols.dtype.type(GAP if symbols.dtype == np.uint8 else GAP_NAME)
    change = np.ones(len(symbols), bool)
    change[1:] = (symbols[1:] != symbols[:-1]) | (symbols[1:] == gap)
    heads = np.flatnonzero(change)
    runs = np.diff(np.append(heads, len(symbols)))
    symbols = symbols[heads]
    gaps = symbols == gap
    labels = _toss(_toss(symbols, gaps), gaps)
    begins = gaps.copy()
    begins[1:] |= gaps[:-1]
    begins[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    first = np.flatnonzero(begins)
    names = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):  # some at a time, so that a very long text needs little more room than its bytes
        end = max(at + 1, int(np.searchsorted(first, first[at] + NAMED)))
        low, high = int(first[at]), int(first[end]) if end < len(first) else len(symbols)
        own = symbols[low:high]
        names[at:end] = _named(_BYTE_VALUES[own] if own.dtype == np.uint8 else own, runs[low:high], first[at:end] - low)
        at = end
    names[gaps[first]] = GAP_NAME
    return names, starts[heads[first]]


def phrase_levels(some: list[bytes], levels: int = LEVELS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, text, start, length, name) of all phrases of UTF-8 texts, level by level; places count all bytes from the first gap on."""
    gap = bytes([GAP])
    symbols = np.frombuffer(gap + gap.join(some) + gap, np.uint8)
    starts = np.arange(len(symbols), dtype=np.int32 if len(symbols) < 1 << 31 else np.int64)
    total = len(symbols)
    for level in range(1, levels + 1):
        symbols, starts = next_level(symbols, starts)
        real = symbols != np.uint64(GAP_NAME)
        owner = np.cumsum(~real) - 1
        lengths = np.diff(np.append(starts, total))
        yield level, owner[real], starts[real], lengths[real], symbols[real]


def sketches(some: list[bytes], slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` 16-bit numbers for each UTF-8 text.

    A phrase falls into a slot by its name, and the slot keeps of its phrases the one
    whose exponential variate, drawn from the name with the phrase's length as its rate,
    is least. So two texts agree in a slot as often as their phrases' bytes are shared,
    each distinct phrase counting once; all levels weigh alike.
    """
    kept = np.full(len(some) * slots, np.iinfo(np.uint64).max, np.uint64)
    for level, owner, _, lengths, names in phrase_levels(some):
        if level in PRINTED and len(names):
            share = ((mixed(names ^ np.uint64(_FACTOR)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            rank = (-np.log(share) / lengths).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            slot = (names >> np.uint64(40)).astype(np.int64) % slots
            np.minimum.at(kept, owner * slots + slot, rank | (names % np.uint64(65535) + np.uint64(1)))
    kept[kept == np.iinfo(np.uint64).max] = 0
    return (kept & np.uint64(0xFFFF)).astype(">u2").reshape(len(some), slots)


def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each two rows of sketches the share of equal slots among those that either fills; 1 if both are empty."""
    filled = ((left != 0) | (right != 0)).sum(axis=1)
    equal = ((left == right) & (left != 0)).sum(axis=1)
    return np.where(filled == 0, 1.0, equal / np.maximum(filled, 1))


def hexed(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows]


def unhexed(prints: Iterable[str]) -> np.ndarray:
    return np.array([np.frombuffer(bytes.fromhex(p), ">u2") for p in prints]).reshape(-1, SLOTS)


def likeness(left: Column, right: Column) -> Column:
    """How alike two fingerprints are, 0 to 1, as ``alike`` says; null if one is null."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.struct(F.substring(left, i * 4 + 1, F.lit(4)).alias("a"), F.substring(right, i * 4 + 1, F.lit(4)).alias("b")))
    filled = F.filter(pairs, lambda p: (p["a"] != "0000") | (p["b"] != "0000"))
    equal = F.size(F.filter(filled, lambda p: p["a"] == p["b"]))
    return F.when(left.isNotNull() & right.isNotNull(), F.coalesce(F.try_divide(equal, F.size(filled)), F.lit(1.0)))


def _grouped(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of about ``most`` bytes of text in their last column, and the texts."""
    for batch in slices(batches, 512, most):
        yield batch, utf8(batch.column(batch.num_columns - 1))


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, some in _grouped(batches):
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hexed(sketches(some)), pa.string())], names=[*batch.schema.names[:-1], "fingerprint"])


def document_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``fingerprint``.

    Equal texts have equal fingerprints, and texts that share much of their content, at
    whatever place, share many slots (see ``likeness``). A null text counts as empty; its
    slots are all empty. Texts are parsed whole. Repeated rows are kept and an empty
    table gives an empty table. A column ``fingerprint``, in whatever case, is replaced;
    others may bear any name.
    """
    kept = others(docs.columns, (text, "fingerprint"))
    plain = [f"column_{i}" for i in range(len(kept))]
    narrow = docs.select(*[F.col(quoted(c)).alias(p) for c, p in zip(kept, plain, strict=True)], F.col(quoted(text)).cast("string").alias(own_names(docs, "_text")[0]))
    kinds = [f"{p} {narrow.schema[p].dataType.simpleString()}" for p in plain]
    found = narrow.mapInArrow(_printed, ", ".join([*kinds, "fingerprint string"]))
    return found.select(*[F.col(p).alias(c) for c, p in zip(kept, plain, strict=True)], "fingerprint")


def _listed(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for batch, some in _grouped(batches):
        offsets = np.cumsum([1, *(len(t) + 1 for t in some)])
        for level, owner, starts, lengths, names in phrase_levels(some, levels):
            columns = [batch.column(0).take(pa.array(owner)), pa.array(np.full(len(owner), level, np.int32)), pa.array(starts - offsets[owner]), pa.array(lengths.astype(np.int64)), pa.array(names.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "level", "start", "length", "name"])


def document_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", levels: int = LEVELS) -> DataFrame:
    """``doc_id``, ``level``, ``start`` and ``length`` (UTF-8 bytes) and ``name`` of every phrase of every text.

    Grouped by level and name this finds passages that documents share. Null and empty
    texts have no phrases.
    """
    narrow = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(lambda batches: _listed(batches, levels), f"doc_id {kind}, level int, start long, length long, name long")


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by as much of the beginning of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(rows: list[tuple[str, str]], prints: np.ndarray | None = None) -> list:
    """Columns of ``COMPARED`` for pairs of a text and the next; ``prints``: sketches of both, if there are any yet."""
    own, following = [t for t, _ in rows], [t for _, t in rows]
    changed = [edited(t, n).encode() for t, n in rows]
    of_own, of_next = prints if prints is not None else (sketches([t.encode() for t in own]), sketches([t.encode() for t in following]))
    of_changed = sketches(changed)
    digests = [hashlib.sha256(t).digest() for t in changed]
    packed = [pa.array([row.tobytes() for row in rows], pa.binary()) for rows in (of_own, of_changed)]
    return [pa.array(list(map(len, own)), pa.int64()), pa.array(digests, pa.binary()), *packed, pa.array(alike(of_own, of_changed)), pa.array(alike(of_own, of_next))]


#: What is computed for each row; binary columns are shown as lower-case hexadecimal text.
COMPARED = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in COMPARED.split(", ")]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, each compared with its next.

    The first and the last of a range come with their text, for what follows the last is
    the first of another range.
    """
    ids, part, kind = pa.array([]), None, None
    held: tuple[str, np.ndarray] | None = None  # the text before, and its sketch
    for batch, some in _grouped(batches):
        own = texts(batch.column(2))
        if part is None:
            part, kind, ids = batch.column(1)[0], batch.column(0).type, batch.column(0).slice(0, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([part.as_py()], pa.int32()), pa.array(["first"]), pa.array([own[0]], pa.string()), *[pa.nulls(1, t) for t in _TYPES]], names=_ROW)
        prints = sketches(some)
        run = [held[0], *own] if held else own
        lines = np.concatenate([held[1][None], prints]) if held else prints
        ids = pa.concat_arrays([ids, batch.column(0)])
        if len(run) > 1:
            columns = _compared(list(zip(run, run[1:], strict=False)), (lines[:-1], lines[1:]))
            n = len(run) - 1
            yield pa.RecordBatch.from_arrays([ids.slice(0, n), pa.array([part.as_py()] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), *columns], names=_ROW)
        held, ids = (run[-1], lines[-1]), ids.slice(len(run) - 1)
    if held:
        yield pa.RecordBatch.from_arrays([ids, pa.array([part.as_py()], pa.int32()), pa.array(["last"]), pa.array([held[0]], pa.string()), *[pa.nulls(1, t) for t in _TYPES]], names=_ROW)


_TYPES = [{"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]] for c in COMPARED.split(", ")]
_ROW = ["doc_id", "part", "edge", "text", *_NAMES]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        rows = list(zip(texts(batch.column(1)), texts(batch.column(2)), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), *_compared(rows)], names=["doc_id", *_NAMES])


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the columns of ``COMPARED`` of every row: the fingerprints of a text and of its edited text, and how alike.

    The edited text has the last half of the characters (rounded down) replaced by as many
    of the beginning of the next text (or all), in descending order of the ids; after the
    last row comes the first. ``near_edited`` compares the text's fingerprint with the
    edited text's, ``near_next`` with the next text's.

    Rows are dealt by ranges of ids and sorted in them, so each text moves once, beside
    the next; only the rows at the ends of ranges meet in a join.

    Nulls: a null text counts as empty; null ids come last. Rows of one id go by a hash
    of their text, and rows equal in both as they come, which makes no difference. Of one
    row the next is itself. An empty table gives an empty table. Other columns aren't
    read, so their names can't clash. Texts are parsed whole.
    """
    narrow = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    keyed = narrow.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("row")]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, docs.count() // RANGE_ROWS))
    dealt = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", F.spark_partition_id().alias("part"), "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    rows = durable(dealt.mapInArrow(_in_order, f"doc_id {kind}, part int, edge string, text string, {COMPARED}"), "phrase-rows")
    ends = rows.filter("edge is not null")
    parts = sorted(r["part"] for r in ends.filter("edge = 'first'").select("part").collect())  # one number a range
    follows = docs.sparkSession.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, following int")
    lasts = ends.filter("edge = 'last'").select("doc_id", "text", "part").join(follows, "part")
    firsts = ends.filter("edge = 'first'").select(F.col("text").alias("next_text"), F.col("part").alias("following"))
    met = lasts.join(firsts, "following").select("doc_id", "text", "next_text").mapInArrow(_joined, f"doc_id {kind}, {COMPARED}")
    both = rows.filter("edge is null").select("doc_id", *_NAMES).unionByName(met)
    return both.select("doc_id", *[F.lower(F.hex(c)).alias(c) if f"{c} binary" in COMPARED else F.col(c) for c in _NAMES])


def op11_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, compared with that and with the next document's."""
    return compare_with_next(documents(spark, sf_dir))
