"""Quality rules: repetition and length rules, and divergence from language references."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, durable, others, quoted, restored, slices, utf8

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Common words of a language's reference, and languages (the largest) whose references every task holds; those of all others are joined.
COMMON_WORDS, MAX_LANGUAGES = 100, 256
#: Below so many characters or words a histogram is too thin to judge a text.
MIN_CLASS_CHARS, MIN_JUDGED_WORDS = 200, 40
#: Jensen-Shannon distances (square root, base 2, 0 to 1) above which a text fails.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.52

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
PARTIALS = 200_000


def _class_table() -> np.ndarray:
    """Class of each byte; -1 for the bytes that continue a UTF-8 character."""
    table = np.full(256, CLASSES.index("other"))
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", SPACES), ("punctuation", b".,;:!?'\"()-"), ("symbol", b"#*$%&|<>@^_~`+=/\\{}[]")):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = -1
    return table


CLASS_OF = _class_table()


def class_counts(octets: np.ndarray) -> np.ndarray:
    """Characters of each class, from a histogram of the bytes."""
    kept = CLASS_OF >= 0
    return np.bincount(CLASS_OF[kept], octets[kept], len(CLASSES)).astype(np.int64)


def byte_histogram(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def repeated_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = end = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + width - max(at, end)
            end = at + width
    return covered


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; 0 if either is empty."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return math.sqrt(max(0.0, float(parts.sum()) / 2))


@dataclass
class Reference:
    """Histograms of one language: characters by class, its common words in order, and all its words."""

    classes: np.ndarray = field(default_factory=lambda: np.zeros(len(CLASSES)))
    words: list[bytes] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @cached_property
    def place(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def distances(self, classes: np.ndarray, words: list[bytes]) -> tuple[float | None, float | None]:
        """Distance by character class and by common word; None where the text is too short to tell."""
        by_class = jensen_shannon(classes, self.classes) if classes.sum() >= MIN_CLASS_CHARS else None
        if len(words) < MIN_JUDGED_WORDS:
            return by_class, None
        found = np.bincount(np.array([self.place[w] for w in words if w in self.place], np.int64), minlength=len(self.words))
        return by_class, jensen_shannon(np.append(found, len(words) - found.sum()), self.counts)


def _letters(word: bytes) -> bytes:
    """A word lower-cased, without signs around it; all words of signs alone count as one, the empty word."""
    return word.lower().strip(b".,;:!?'\"()-#*$%&|<>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, kind, word, n): kind 0 a word, 1 a character class."""

    def rows(counts: Counter) -> pa.RecordBatch:
        keys, n = list(counts), list(counts.values())
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=["lang", "kind", "word", "n"])

    counts: Counter = Counter()
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            counts.update((lang, 0, w) for w in map(_letters, text.split()))
            for name, n in zip(CLASSES, class_counts(byte_histogram(text)).tolist(), strict=True):
                counts[lang, 1, name.encode()] += n
        if len(counts) > PARTIALS:
            yield rows(counts)
            counts.clear()
    yield rows(counts)


def _reference(parts: list, total: int) -> Reference:
    """A reference of (kind, word, n, rank) of its classes and common words, and the number of all words."""
    ref = Reference()
    for row in sorted(parts, key=lambda r: (r["kind"], r["rank"])):
        if row["kind"]:
            ref.classes[CLASSES.index(bytes(row["word"]).decode())] = row["n"]
        else:
            ref.words.append(bytes(row["word"]))
            ref.counts = np.append(ref.counts[:-1], [row["n"], 0])
    ref.counts[-1] = total - ref.counts.sum()
    return ref


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MAX_LANGUAGES) -> tuple[dict[str | None, Reference], DataFrame | None]:
    """References of the ``most`` largest languages, one of all documents under None; and a table of those of all other languages.

    All texts are counted, into partial sums before any shuffle. What reaches the driver
    is bounded: ``COMMON_WORDS`` words and a few classes for ``most`` languages at most.
    The table (``_of``, ``_parts``, ``_total``) has a row for each further language and is
    None if there is none.
    """
    narrow = docs.select(F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text)).cast("string").alias("text"))
    partial = narrow.mapInArrow(_counted, "lang string, kind int, word binary, n long")
    of = F.explode(F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), F.col("lang"))))).alias("of")
    counts = durable(partial.select(of, "kind", "word", "n").groupBy("of", "kind", "word").agg(F.sum("n").alias("n")), "quality-counts")
    totals = counts.filter("kind = 0").groupBy("of").agg(F.sum("n").alias("total"))
    largest = totals.orderBy(F.expr("of <> '*'"), F.desc("total"), "of").limit(most + 2).collect()
    held, more = {r["of"]: r["total"] for r in largest[: most + 1]}, len(largest) > most + 1
    rank = F.row_number().over(Window.partitionBy("of", "kind").orderBy(F.desc("n"), "word"))
    common = counts.withColumn("rank", rank).filter(F.col("rank") <= COMMON_WORDS)
    found: dict[str, list] = {}
    for row in common.filter(F.col("of").isin(list(held))).collect():
        found.setdefault(row["of"], []).append(row)
    references = {None if name == "*" else name[1:]: _reference(parts, held[name]) for name, parts in found.items()}
    if not more:
        return references, None
    rest = common.filter(~F.col("of").isin(list(held))).groupBy("of").agg(F.collect_list(F.struct("kind", "word", "n", "rank")).alias("_parts")).join(totals, "of")
    return references, durable(rest.select(F.substring("of", 2, 1 << 30).alias("_of"), "_parts", F.col("total").alias("_total")), "quality-references")


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def judge(text: bytes, reference: Reference | None) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    octets = byte_histogram(text)
    words = text.split()
    characters = int(octets.sum() - octets[0x80:0xC0].sum())
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * len(words)
    by_class, by_word = reference.distances(class_counts(octets), list(map(_letters, words))) if reference else (None, None)
    far = (by_class or 0) > MAX_CLASS_DISTANCE or (by_word or 0) > MAX_WORD_DISTANCE
    return (len(words), characters - int(octets[list(SPACES)].sum()), int(octets[list(SYMBOLS)].sum()), repeated_lines(text), repeats, failed, by_class, by_word, not (failed or far))


def _judged(batches: Iterator[pa.RecordBatch], references: dict[str | None, Reference], width: int) -> Iterator[pa.RecordBatch]:
    """The first ``width`` columns and the verdicts; text and language follow them, and, where it was joined, the language's reference."""
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in COLUMNS.split(", ")])
    joined: dict[str, Reference] = {}
    for batch in slices(batches):
        texts, langs = utf8(batch.column(width)), batch.column(width + 1).to_pylist()
        if batch.num_columns > width + 2:
            joined.clear()
            for i, lang in enumerate(langs):
                if lang not in joined and (parts := batch.column(width + 2)[i].as_py()) is not None:
                    joined[lang] = _reference(parts, batch.column(width + 3)[i].as_py())
        found = [judge(t, joined.get(lang) or references.get(lang) or references.get(None)) for lang, t in zip(langs, texts, strict=True)]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], names=[*batch.schema.names[:width], *schema.names])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, most: int = MAX_LANGUAGES) -> DataFrame:
    """The columns ``keep`` (all if None) of ``docs`` and those of ``COLUMNS``.

    A text is kept if it has at least ``MIN_WORDS`` words, at most a fifth of them in
    repeated 5-word windows, and if its histograms over character classes and over the
    common words of its language lie near those of all documents of that language:
    Jensen-Shannon distance up to ``MAX_CLASS_DISTANCE`` and ``MAX_WORD_DISTANCE``. Texts
    under ``MIN_CLASS_CHARS`` characters or ``MIN_JUDGED_WORDS`` words aren't judged by
    the histogram in question, whose distance is then null.

    Every language has its own reference: tasks hold those of the ``most`` largest, and
    documents of all others are joined with a table of theirs.

    Nulls: a null text counts as empty and isn't kept; a null language is compared with the
    reference of all documents. Repeated rows are judged alike. An empty table gives an
    empty table. Columns named like the added ones, in whatever case, are replaced; others
    may bear any name.
    """
    added = [c.split()[0] for c in COLUMNS.split(", ")]
    kept = others(docs.columns if keep is None else keep, added)
    references, rest = language_references(docs, text, lang, most)
    own_text, own_lang, of = "_text", "_lang", "_of"
    plain = [f"column_{i}" for i in range(len(kept))]
    narrow = docs.select(*[F.col(quoted(c)).alias(p) for c, p in zip(kept, plain, strict=True)], F.col(quoted(text)).cast("string").alias(own_text), F.col(quoted(lang)).cast("string").alias(own_lang))
    kinds = [f"{p} {narrow.schema[p].dataType.simpleString()}" for p in plain]
    shape, width = ", ".join([*kinds, COLUMNS]), len(kept)
    verdicts = lambda df: restored(df.mapInArrow(lambda batches: _judged(batches, references, width), shape), dict(zip(kept, plain, strict=True)), added)
    if rest is None:
        return verdicts(narrow)
    held = F.col(own_lang).isNull() | F.col(own_lang).isin([x for x in references if x is not None])
    rest = rest.toDF(of, "_parts", "_total")
    joined = narrow.filter(~held).join(rest, F.col(own_lang) == F.col(of), "left").drop(of)
    return verdicts(narrow.filter(held)).unionByName(verdicts(joined))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every whole document."""
    found = quality_rules(documents(spark, sf_dir), keep=["doc_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


_JS = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
OP3_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
figures AS (
  SELECT d.rid, d.doc_id, d.lang, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(text) AS chars,
    [length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')),
     length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')), length(regexp_replace(text, '[^#*$%&|<>@^_~`+=/\\{{}}\[\]]', '', 'g'))] AS six
  FROM docs d JOIN split USING (rid)),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
copies AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
windows AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, array_to_string(w[i : i + 4], ' ') AS five FROM split WHERE len(w) >= 5),
found AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
repeats AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS pos FROM found) GROUP BY rid),
letters AS (SELECT rid, lang, trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?''"()-#*$%&|<>') AS word FROM (SELECT rid, lang, unnest(w) AS x FROM split)),
own AS (SELECT rid, word, count(*) AS n FROM letters GROUP BY rid, word),
corpus AS (SELECT CASE g WHEN 0 THEN '*' ELSE '=' || lang END AS of, word, count(*) AS n FROM letters, range(2) t(g) WHERE g = 0 OR lang IS NOT NULL GROUP BY 1, 2),
totals AS (SELECT of, sum(n) AS total FROM corpus GROUP BY of),
common AS (SELECT of, word, n FROM corpus QUALIFY row_number() OVER (PARTITION BY of ORDER BY n DESC, word) <= {COMMON_WORDS}),
places AS (SELECT f.rid, CASE WHEN EXISTS (SELECT 1 FROM totals t WHERE t.of = '=' || f.lang) THEN '=' || f.lang ELSE '*' END AS of FROM figures f),
sevens AS (SELECT rid, unnest(list_append(six, chars - list_sum(six))) AS n, generate_subscripts(list_append(six, 0), 1) AS k, lang FROM figures),
classes AS (SELECT CASE g WHEN 0 THEN '*' ELSE '=' || lang END AS of, k, sum(n) AS n FROM sevens, range(2) t(g) WHERE g = 0 OR lang IS NOT NULL GROUP BY 1, 2),
by_class AS (SELECT rid, {_JS} AS class_distance FROM (
    SELECT s.rid, s.n / sum(s.n) OVER (PARTITION BY s.rid) AS p, c.n / sum(c.n) OVER (PARTITION BY s.rid) AS q FROM sevens s JOIN figures f USING (rid) JOIN places USING (rid) JOIN classes c USING (of, k) WHERE f.chars >= {MIN_CLASS_CHARS}) GROUP BY rid),
hits AS (SELECT p.rid, p.of, c.n AS ref, coalesce(o.n, 0) AS n FROM places p JOIN common c USING (of) LEFT JOIN own o ON o.rid = p.rid AND o.word = c.word),
rest AS (SELECT rid, ref, n FROM hits UNION ALL SELECT h.rid, any_value(total) - sum(ref), any_value(n_words) - sum(n) FROM hits h JOIN totals USING (of) JOIN figures USING (rid) GROUP BY h.rid),
by_word AS (SELECT rid, {_JS} AS word_distance FROM (
    SELECT rid, n / sum(n) OVER (PARTITION BY rid) AS p, ref / sum(ref) OVER (PARTITION BY rid) AS q FROM rest JOIN figures f USING (rid) WHERE f.n_words >= {MIN_JUDGED_WORDS}) GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED_PERCENT} * n_words AS base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
  NOT (n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED_PERCENT} * n_words OR coalesce(class_distance, 0) > {MAX_CLASS_DISTANCE} OR coalesce(word_distance, 0) > {MAX_WORD_DISTANCE}) AS kept
FROM figures LEFT JOIN copies USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN by_class USING (rid) LEFT JOIN by_word USING (rid)
"""
