import math
import struct
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeloom.llm import phrases as ph

MASK = (1 << 64) - 1


def mix(x):
    x = x + 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def toss(symbols, gap):
    """Labels of symbols between two gaps, by the definition."""
    out = []
    for left, own in zip([gap, *symbols], symbols, strict=False):
        low = ((own ^ left) & -(own ^ left)).bit_length() - 1
        out.append(2 * low + (own >> low & 1))
    return out


def plain_level(symbols, first):
    """One level of one text, symbol by symbol: (symbols or names, lengths) to (names, lengths)."""
    gap = 0xFF if first else MASK
    runs = []
    for s, n in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
            runs[-1][2] += n
        else:
            runs.append([s, 1, n])
    labels = toss(toss([r[0] for r in runs], gap), 255)
    padded = [255, *labels, 255]
    phrases = []
    for i, run in enumerate(runs):
        if i == 0 or padded[i + 1] > padded[i] and padded[i + 1] > padded[i + 2]:
            phrases.append([])
        phrases[-1].append(run)
    out = []
    for phrase in phrases:
        total, power = 0, 1
        for s, times, _ in phrase:
            value = mix(s) if first else s
            if times > 1:
                value = mix(value + times * 0xD6E8FEB86659FD93 & MASK)
            power = power * 0xD6E8FEB86659FD93 & MASK
            total = total + value * power & MASK
        out.append((min(mix(total + len(phrase) & MASK), MASK - 1), sum(n for _, _, n in phrase)))
    return out


def plain_levels(text):
    symbols, out = [(b, 1) for b in text], []
    for level in range(1, ph.LEVELS + 1):
        symbols = plain_level(symbols, level == 1) if symbols else []
        out.append(symbols)
    return out


def plain_fingerprint(text):
    best = {}
    for level, found in enumerate(plain_levels(text.encode()), 1):
        if level in ph.PRINTED:
            for name, length in found:
                share = ((mix(name ^ 0xD6E8FEB86659FD93) >> 11) + 0.5) * 2.0**-53
                rank = struct.unpack("<I", struct.pack("<f", -math.log(share) / length))[0]
                best.setdefault((name >> 40) % ph.SLOTS, []).append((rank, name % 65535 + 1))
    return "".join(f"{min(best[i])[1]:04x}" if i in best else "0000" for i in range(ph.SLOTS))


def plain_alike(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, 4 * ph.SLOTS, 4)]
    filled = [p for p in pairs if p != ("0000", "0000")]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def plain(rows):
    """Rows in order of the ids, which must differ."""
    rows = sorted(rows, key=lambda r: math.inf if r[0] is None else -r[0])
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        half = len(t) // 2
        other = t[: len(t) - half] + n[:half]
        a, b, c = map(plain_fingerprint, (t, other, n))
        out.append((i, len(t), sha256(other.encode()).hexdigest(), a, b, round(plain_alike(a, b), 9), round(plain_alike(a, c), 9)))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, df.collect())), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab", max_size=200), st.builds(lambda c, n: c * n, st.text(max_size=3), st.integers(0, 300))), min_size=1, max_size=6))
def test_phrases_and_fingerprints_as_a_plain_version(some):
    some = [t.encode("utf-8", "ignore").decode() for t in some]
    levels = {(level, i): [] for level in range(1, ph.LEVELS + 1) for i in range(len(some))}
    for level, owner, _, lengths, names in ph.phrase_levels([t.encode() for t in some]):
        for i, n, x in zip(owner.tolist(), lengths.tolist(), names.tolist(), strict=True):
            levels[level, i].append((x, n))
    for i, text in enumerate(some):
        assert [levels[level, i] for level in range(1, ph.LEVELS + 1)] == plain_levels(text.encode())
    assert ph.hexed(ph.sketches([t.encode() for t in some])) == [plain_fingerprint(t) for t in some]


WORDS = "der Fluss und die Brücke unter grünen Hügeln wandern oft mit Brot und Wasser für alle die kommen wollen heute abend".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + ("\n" * (seed % 3))


ROWS = [(i, text(i, (i * 37) % 400)) for i in range(1, 90)] + [(200, None), (201, ""), (202, "x"), (203, "日本"), (204, "y" * 5_000), (205, text(7, (7 * 37) % 400)), (None, "the last one " * 9)]


@pytest.mark.parametrize("n", [len(ROWS), 2, 1])
def test_the_query_as_a_plain_version(spark, tmp_path, n):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in ROWS[:n]], "doc_id long, text string, part int, `a.b` int").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert shown(ph.op11_phrase_fingerprints(spark, str(tmp_path))) == plain(ROWS[:n])


def test_many_ranges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert shown(ph.compare_with_next(docs)) == plain(ROWS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_repeated_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "same text here")] * 7 + [(4, None)] * 3, "doc_id long, text string")
    found = ph.compare_with_next(docs).collect()
    assert len(found) == 10 and len({r["fingerprint"] for r in found}) == 2
    assert sorted(r["near_next"] for r in found if r["doc_id"] == 5) == [0.0] + [1.0] * 6
    assert [r["near_edited"] for r in found if r["doc_id"] == 4] == [1.0] * 3
    assert ph.compare_with_next(docs.limit(0)).count() == 0
    assert ph.document_fingerprints(docs.limit(0)).count() == 0


def test_equal_stretches_share_interior_names_at_any_offset():
    shared = text(1, 400)
    left, right = text(2, 63) + shared + text(3, 40), "zz" + text(4, 200) + shared + text(5, 11)
    for level, owner, starts, lengths, names in ph.phrase_levels([left.encode(), right.encode()]):
        found = [set(), set()]
        for i, s, n, x in zip(owner.tolist(), starts.tolist(), lengths.tolist(), names.tolist(), strict=True):
            place = s - 1 - (len(left.encode()) + 1) * i - (left, right)[i].encode().index(shared.encode())
            if 0 <= place and place + n <= len(shared.encode()):
                found[i].add((place, n, x))
        assert len(found[0] & found[1]) >= len(found[0]) - 6 * level, level
        assert len(found[0]) > 20 or level == ph.LEVELS


def test_likeness_tells_edited_from_other_texts_and_has_a_column_form(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3_000)]
    some = [" ".join(rng.choice(vocabulary, 300)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    found = ph.compare_with_next(docs)
    column = found.withColumn("other", ph.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()
    assert all(abs(r["other"] - r["near_edited"]) < 1e-12 for r in column)
    assert min(r["near_edited"] for r in column) > 0.15 > 0.1 > max(r["near_next"] for r in column)
    prints = ph.document_fingerprints(docs.withColumn("a`b.c", F.lit(3))).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in prints} == {r["doc_id"]: r["fingerprint"] for r in column} and prints[0]["a`b.c"] == 3


def test_the_table_of_phrases_covers_each_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    sums = ph.document_phrases(docs.filter("doc_id is not null")).groupBy("doc_id", "level").agg(F.sum("length").alias("n"), F.min("start").alias("s"))
    assert {(r["doc_id"], r["level"]): (r["n"], r["s"]) for r in sums.collect()} == {(i, level): (len(t.encode()), 0) for i, t in ROWS if t and i is not None for level in range(1, 5)}


def test_a_very_long_text(monkeypatch):
    long = text(9, 60_000)
    whole = ph.hexed(ph.sketches([long.encode()]))
    monkeypatch.setattr(ph, "NAMED", 1_000)
    assert ph.hexed(ph.sketches([b"", long.encode(), b"x"]))[1] == whole[0] == plain_fingerprint(long)
