"""Periodic runs of words, found with a run-length grammar made by recompression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, others, own_names, quoted, slices, utf8

#: A run is at least so many words and so many periods long.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words of texts that are compressed together, unless one text has more.
BATCH_WORDS = 1 << 18
#: (place, period) pairs that are looked at together.
GRID_PAIRS = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass
class Level:
    """One level of the grammar: its symbols, and for each symbol of the next the first of this level that it stands for."""

    symbols: np.ndarray
    first: np.ndarray | None = None
    parent: np.ndarray | None = None
    blocks: bool = False


def _names(*columns: np.ndarray) -> np.ndarray:
    """Small numbers that are equal where all columns are."""
    left, *rest = columns
    for right in rest:
        left = left * (int(right.max()) + 1) + right
    return np.unique(left, return_inverse=True)[1].astype(np.int64)


def _parted(symbols: np.ndarray, fixed: int, turn: int) -> np.ndarray:
    """Which neighbours (place, place + 1) are paired: the first is a left symbol, the second a right one.

    A hash of the symbol says to which side it belongs, so equal stretches are parted
    alike; of the two ways to name the sides the one with more pairs is taken. Symbols
    below ``fixed`` are separators and never paired.
    """
    hashed = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    side = (hashed >> np.uint64(63)).astype(bool)
    real = symbols >= fixed
    both = real[:-1] & real[1:]
    ways = both & ~side[:-1] & side[1:], both & side[:-1] & ~side[1:]
    return max(ways, key=np.count_nonzero)


class Grammar:
    """A run-length grammar of a sequence, by recompression.

    Rounds of two steps: block compression gives each maximal repetition of one symbol a
    name for (symbol, times); pair compression parts the symbols in two sides and names
    each (left, right) pair. Names depend on what they stand for only, so equal stretches
    get equal names but for some at their ends. Symbols below ``separators`` occur once
    and stay as they are: nothing extends over one. The first and the last must be such.
    """

    def __init__(self, symbols: np.ndarray, separators: int):
        self.levels = [Level(symbols.astype(np.int64))]
        self.fixed, turn = separators, 0
        while True:
            now, before = self.levels[-1].symbols, len(self.levels[-1].symbols)
            if before <= 2 * separators:  # one symbol a text is left
                break
            starts = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
            self._lift(starts, True)
            now = self.levels[-1].symbols
            paired = _parted(now, separators, turn)
            second = np.concatenate([[False], paired])
            self._lift(np.flatnonzero(~second), False)
            turn += 1
            if len(self.levels[-1].symbols) == before and turn > 64:
                break  # cannot happen but by chance: what is left is compared symbol by symbol

    def _lift(self, starts: np.ndarray, blocks: bool) -> None:
        """Add the level whose symbols begin at ``starts`` of the last."""
        level = self.levels[-1]
        now = level.symbols
        ends = np.concatenate([starts[1:], [len(now)]])
        sizes = ends - starts
        heads = now[starts]
        joined = sizes > 1
        up = np.empty(len(starts), np.int64)
        # names: separators as they are, then all others numbered anew
        tails = sizes if blocks else np.where(joined, now[ends - 1] + 1, 0)
        real = heads >= self.fixed
        up[~real] = heads[~real]
        if real.any():
            up[real] = self.fixed + _names(heads[real], tails[real])
        level.first = np.concatenate([starts, [len(now)]])
        level.parent = np.repeat(np.arange(len(starts)), sizes)
        level.blocks = blocks
        self.levels.append(Level(up))

    def extension(self, left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from each pair of places on, forwards (``step`` 1) or backwards (-1).

        Both places climb from level to level as long as they agree: to the parents where
        both stand at the near end of equal ones, else over the symbols up to the parents'
        border. Where they differ they descend, and at each level pass what still agrees.
        A level takes a constant number of steps, whatever the length that agrees.
        """
        a, b = left.copy(), right.copy()
        top = np.full(len(a), -1)
        active = np.arange(len(a))
        last = len(self.levels) - 1
        for depth, level in enumerate(self.levels):
            x, y = a[active], b[active]
            same = level.symbols[x] == level.symbols[y]
            top[active[~same]] = depth
            active, x, y = active[same], x[same], y[same]
            if not len(active):
                break
            if depth == last:
                top[active] = depth
                while len(active):
                    a[active] += step
                    b[active] += step
                    active = active[level.symbols[a[active]] == level.symbols[b[active]]]
                break
            up_x, up_y = level.parent[x], level.parent[y]
            rest_x, rest_y = self._rest(level, x, up_x, step), self._rest(level, y, up_y, step)
            above = self.levels[depth + 1].symbols
            whole = (above[up_x] == above[up_y]) & (rest_x == level.first[up_x + 1] - level.first[up_x]) & (rest_y == level.first[up_y + 1] - level.first[up_y])
            go = np.where(whole, 0, np.minimum(rest_x, rest_y) if level.blocks else 1)
            climbs = whole | ((rest_x == go) & (rest_y == go))
            x, y = x + step * go, y + step * go
            a[active], b[active] = x, y
            top[active[~climbs]] = depth
            active = active[climbs]
            a[active], b[active] = level.parent[x[climbs]], level.parent[y[climbs]]
        for depth in range(last - 1, -1, -1):
            level = self.levels[depth]
            falls = np.flatnonzero(top > depth)
            if not len(falls):
                continue
            x, y = a[falls], b[falls]
            x, y = (level.first[x], level.first[y]) if step > 0 else (level.first[x + 1] - 1, level.first[y + 1] - 1)
            same = np.flatnonzero(level.symbols[x] == level.symbols[y])
            if level.blocks:
                go = np.minimum(self._rest(level, x[same], level.parent[x[same]], step), self._rest(level, y[same], level.parent[y[same]], step))
            else:
                go = 1
            x[same] += step * go
            y[same] += step * go
            a[falls], b[falls] = x, y
        return (a - left) * step

    @staticmethod
    def _rest(level: Level, place: np.ndarray, parent: np.ndarray, step: int) -> np.ndarray:
        """Symbols from a place to the far end of its parent, itself included."""
        return level.first[parent + 1] - place if step > 0 else place - level.first[parent] + 1


def _grid(symbols: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the harmonic grid where the symbol at the place recurs one period later.

    Of the places at which a run of period q agrees with what follows q later there are at
    least three times q in a row, so one is a multiple of three times q.
    """
    n, held, pairs = len(symbols), [], 0
    for period in range(1, longest // MIN_PERIODS + 1):
        stride = (MIN_PERIODS - 1) * period
        ahead = symbols[period::stride]
        at = np.flatnonzero(symbols[: n - period : stride] == ahead) * stride
        if len(at):
            held.append((at, np.full(len(at), period)))
            pairs += len(at)
        if pairs >= GRID_PAIRS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, pairs = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """(start, length, period) of all runs of each text, given as word numbers from 0; by start, then period.

    A run is a maximal stretch with a smallest period q of at least ``MIN_WORDS`` words and
    ``MIN_PERIODS`` times q. A stretch that is found with several periods has the least.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    separators = len(texts) + 1
    # separator, text, separator, ..., text, separator
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.empty(int(starts[-1]) + 1, np.int64)
    symbols[starts] = np.arange(separators)
    for start, text in zip(starts, texts, strict=False):
        symbols[start + 1 : start + 1 + len(text)] = text + separators
    found = [np.empty((0, 3), np.int64)]
    longest = int(sizes.max(initial=0))
    grammar = None
    for at, period in _grid(symbols, longest):
        grammar = grammar or Grammar(symbols, separators)
        ahead = grammar.extension(at, at + period, 1)
        behind = grammar.extension(at - 1, at + period - 1, -1)
        length = behind + ahead + period
        good = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
        found.append(np.stack([at - behind, length, period], axis=1)[good])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] -= starts[owner] + 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    drops = np.zeros(n + 1, np.int64)
    np.add.at(drops, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drops, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(drops[:n]) == 0


def _batched(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Batches whose texts hold about ``BATCH_WORDS`` words together, and the words of each text."""
    held, words, total = [], [], 0
    for batch in slices(batches, 128):
        found = [t.split() for t in utf8(batch.column(column))]
        held.append(batch)
        words += found
        total += sum(map(len, found))
        if total >= BATCH_WORDS:
            yield held, words
            held, words, total = [], [], 0
    if held:
        yield held, words


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words, or, where 10 divides the hash, the words with a stretch of them repeated to the end."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start : start + period]
    return (words[:start] + unit * ((n - start) // period + 1))[:n]


def _found(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    """The columns but the last, the text, with ``n_words``, ``runs`` and ``collapsed``; with ``plant`` the last but one is the id as text."""
    for held, words in _batched(batches, -1):
        if plant:
            ids = [t for b in held for t in utf8(b.column(-2))]
            words = [planted(w, zlib.crc32(i)) for w, i in zip(words, ids, strict=True)]
        number: dict[bytes, int] = {}
        texts = [np.fromiter((number.setdefault(w, len(number)) for w in text), np.int64, len(text)) for text in words]
        runs = runs_of(texts)
        collapsed = [b" ".join(text) if not len(own) else b" ".join([text[i] for i in np.flatnonzero(kept_words(len(text), own)).tolist()]) for text, own in zip(words, runs, strict=True)]
        ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
        items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0]
        rest = whole.drop_columns(whole.schema.names[-1 - plant :])
        columns = [*rest.columns, pa.array(list(map(len, words)), pa.int64()), pa.ListArray.from_arrays(ends, items), pa.array(collapsed, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", plant: str | None = None) -> DataFrame:
    """The other columns of ``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    Words are runs of characters without ASCII white space. ``runs``: start (word number
    from 0), length and period in words of every maximal stretch whose smallest period q
    recurs at least ``MIN_PERIODS`` times in at least ``MIN_WORDS`` words, by start, then
    period. ``collapsed``: the words, joined by blanks, without those that a run holds
    after its first q. ``plant`` names an id column: where 10 divides the crc32 of the id
    as text, a stretch of the words is first repeated to the end (see ``planted``).

    Texts are searched whole, whatever their length, some together at a time: a table of
    many short texts costs no more than a few long ones. A null text counts as empty: no
    words, no runs, an empty ``collapsed``. A null id hashes as empty. Repeated rows are
    kept and an empty table gives an empty table. Columns named like the added ones, in
    whatever case, are replaced; others may bear any name.
    """
    kept = others(docs.columns, (text, "n_words", "runs", "collapsed"))
    plain = [f"column_{i}" for i in range(len(kept))]
    own = own_names(docs, "_id", "_text")
    narrow = docs.select(*[F.col(quoted(c)).alias(p) for c, p in zip(kept, plain, strict=True)], *([F.col(quoted(plant)).cast("string").alias(own[0])] if plant else []), F.col(quoted(text)).cast("string").alias(own[1]))
    kinds = [f"{p} {narrow.schema[p].dataType.simpleString()}" for p in plain]
    found = narrow.mapInArrow(lambda batches: _found(batches, plant is not None), ", ".join([*kinds, "n_words long", f"runs {RUNS}", "collapsed string"]))
    return found.select(*[F.col(p).alias(c) for c, p in zip(kept, plain, strict=True)], "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period; of equal ones the first in order. Null without runs."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, run: F.when(better(best, run), run).otherwise(best))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole document, every tenth of them with a planted one, as counts, the strongest run and digests."""
    found = periodic_runs(documents(spark, sf_dir).select("doc_id", "text"), plant="doc_id").withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
