import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import periodic_runs as pr


def plain_runs(words):
    """Every period by itself, left to right."""
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q):
                least.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


texts = st.builds(lambda head, unit, times, tail: head + unit * times + tail, st.lists(st.integers(0, 2), max_size=12), st.lists(st.integers(0, 3), max_size=5), st.integers(0, 9), st.lists(st.integers(0, 2), max_size=12))


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8))
def test_runs_as_a_plain_version(some):
    found = pr.runs_of([np.array(t, np.int64) for t in some])
    assert [list(map(tuple, r.tolist())) for r in found] == [plain_runs(t) for t in some]


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4), st.data())
def test_extensions_both_ways(some, data):
    sizes = [len(t) for t in some]
    flat, count = [0], len(some) + 1
    for i, t in enumerate(some):
        flat += [x + count for x in t] + [i + 1]
    grammar = pr.Grammar(np.array(flat), count)
    n = sum(sizes) + count
    a, b = (data.draw(st.integers(0, n - 1)) for _ in range(2))
    if a == b:
        return
    ahead = next(k for k in range(n) if flat[a + k] != flat[b + k]) if flat[a] == flat[b] else 0
    behind = next(k for k in range(n) if flat[a - k] != flat[b - k]) if flat[a] == flat[b] else 0
    places = np.array([a]), np.array([b])
    assert (grammar.extension(*places, 1)[0], grammar.extension(*places, -1)[0]) == (ahead, behind)


def test_the_grammar_shrinks_to_a_symbol_a_text_and_spells_the_text():
    rng = np.random.default_rng(3)
    text = np.concatenate([[0], rng.integers(2, 40, 5_000), np.full(4_000, 7), np.tile(np.arange(2, 9), 500), [1]])
    grammar = pr.Grammar(text, 2)
    assert len(grammar.levels[-1].symbols) <= 4 and len(grammar.levels) < 90
    for level, upper in zip(grammar.levels, grammar.levels[1:], strict=False):
        assert len(level.first) == len(upper.symbols) + 1 and level.first[-1] == len(level.symbols)
        # a name stands for one spelling
        spelt = {}
        for name, i, j in zip(upper.symbols.tolist(), level.first, level.first[1:], strict=False):
            assert spelt.setdefault(name, tuple(level.symbols[i:j])) == tuple(level.symbols[i:j])


ROWS = [
    (1, "the river and the stone " * 9),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b "),
    (5, "no " * 6),
    (6, "no " * 5),
    (7, "a b a b a b a b a"),
    (8, "a b a b a b a"),
    (9, "x x x x x x y x x x x x x z z z z z z z z"),
    (10, "été x " * 12 + "日本 " * 7),
    (None, "one two three four five six seven eight nine ten eleven twelve"),
    (1, "the river and the stone " * 9),
    (12, " ".join(f"w{i % 97}" for i in range(3_000))),
    *((i, " ".join(f"w{(i * j) % 13}" for j in range(i % 90))) for i in range(13, 140)),
]


@pytest.mark.parametrize("batch", [1 << 18, 40])
def test_the_query_as_a_plain_version(spark, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(pr, "BATCH_WORDS", batch)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in ROWS], "doc_id long, text string, `a.b` int, `Runs` int, `x``y` int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = pr.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_row(*r) for r in ROWS), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in ROWS)


def test_whole_texts_and_columns_of_any_name(spark):
    rows = [(i, t, 7, 8, 9) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `_text` int, `x``y z` int")
    found = pr.periodic_runs(docs)
    assert found.columns == ["doc_id", "a.b", "_text", "x`y z", "n_words", "runs", "collapsed"]
    got = sorted((r["doc_id"] or 0, r["a.b"], r["x`y z"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in found.collect())
    assert got == sorted((i or 0, 7, 9, len((t or "").encode().split()), plain_runs((t or "").encode().split())) for i, t in ROWS)
    by_id = {r["doc_id"]: r["collapsed"] for r in found.collect()}
    assert (by_id[5], by_id[6], by_id[7], by_id[2]) == ("no", "no no no no no", "a b", "")
    assert pr.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text():
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(0, 5_000, 60_000), np.tile(rng.integers(0, 5_000, 777), 9), rng.integers(0, 5_000, 60_000)])
    (runs,) = pr.runs_of([text])
    assert [r for r in runs.tolist() if r[2] > 4] == [[60_000, 777 * 9, 777]] or [r[2] for r in runs.tolist() if r[2] > 4] == [777]
