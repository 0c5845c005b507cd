import random
import zlib

import numpy as np
import pytest

from edgeloom.llm import toxicity


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    plain = ["the", "river", "stone", "walks", "under", "green", "hills", "often", "quiet", "bread"]
    bad = ["idiot", "scumbag", "worthless"]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randrange(15, 60))]
        for at in range(0, len(words), 12) if toxic else ():
            word = rng.choice(bad)
            words[at] = word if rng.random() < 0.5 else word[:3] + rng.choice("xyz") + word[3:]
        return " ".join(words)

    labels = {i: int(i % 3 == 0) for i in range(900)}
    docs = [(i, text(t), "en", "s", t) for i, t in labels.items()] + [(2000, "", "en", "s", 0), (2001, None, "en", "s", 0), (None, "quiet river", "en", "s", 0), (1, "dup", "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, label int")
    known = spark.createDataFrame([(i, 1, t) for i, t in labels.items()] + [(None, 1, 1), (5, 1, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    return labels, df, known, toxicity.score_toxicity(df, toxicity.fit_toxicity(df, known)).collect()


def test_held_out_accuracy_with_misspellings(scored):
    labels, _, _, rows = scored
    held = [r for r in rows if r["doc_id"] in labels and r["held_out"] and r["doc_id"] != 1]
    assert len(held) > 100 and sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_columns_and_edge_cases(scored, spark):
    labels, df, known, rows = scored
    assert len(rows) == df.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
    assert len({r["score"] for r in rows if r["doc_id"] in (2000, 2001)}) == 1
    model = toxicity.fit_toxicity(df, known.limit(0))
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(df, model).collect())


def test_held_out_labels_are_never_learned(scored, spark):
    _, df, known, rows = scored
    flipped = known.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, flipped)).collect()
    assert sorted((r["doc_id"] or -1, r["score"]) for r in again) == sorted((r["doc_id"] or -1, r["score"]) for r in rows)


def plain_words(text):
    """Words with the sum of their subwords' slopes and their number, character by character."""
    found, word = [], ""
    for c in text.lower() + " ":
        if c == "\0" or c in toxicity._BETWEEN:
            found += [word] * bool(word)
            word = ""
        else:
            word += c
    return found


def bucket(codes):
    h = 0
    for c in codes:
        h = (h * int(toxicity._FACTOR) + c) % (1 << 64)
    return (((h ^ h >> 29) * int(toxicity._SPREAD)) % (1 << 64)) >> (64 - toxicity.BUCKET_BITS)


def test_subwords_equal_a_plain_version():
    rng = random.Random(8)
    slopes = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    for text in ("", "...", "a", "Idiot!", "foo-bar  BAZ\n\u00e9t\u00e9 \U0001f600x", " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(50))):
        words, own = plain_words(text), toxicity.words_of(text)
        total, many = own.sums(slopes)
        assert len(total) == len(words)
        for word, t, n, whole in zip(words, total, many, own.whole, strict=True):
            marked = [0, *map(ord, word), 0]
            grams = [marked[i : i + k] for k in toxicity.GRAMS for i in range(len(marked) - k + 1)]
            assert n == len(grams) + 1
            assert abs(t - sum(float(slopes[bucket(g)]) for g in grams) - slopes[whole]) < 1e-4
        assert [a == b for a in words for b in words] == [a == b for a in own.whole for b in own.whole]
        slots, shares = toxicity.bag_of(text)
        model = toxicity.ToxicityModel(slopes, 0.5)
        expected = 0.5 + float((slopes[slots] * shares).sum())
        assert abs(model.log_odds([text])[0] - expected) < 1e-4
    group = ["a bad one", "", "x", "\u0130stanbul river", "..."]
    assert np.allclose(model.log_odds(group), [model.log_odds([t])[0] for t in group])


def test_pieces_lose_no_character(monkeypatch):
    text = " ".join(["word"] * 300) + "x" * 500 + " end"
    assert "".join(toxicity.pieces(text, 100)) == text
    slopes = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    whole = toxicity.ToxicityModel(slopes, 0.0).log_odds(["river stone " * 500])
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 1000)
    assert np.allclose(whole, toxicity.ToxicityModel(slopes, 0.0).log_odds(["river stone " * 500]))


def test_a_long_word_counts_to_its_end(spark):
    run = "quietriver" * 300
    slopes = np.zeros(toxicity.BUCKETS, np.float32)
    slopes[bucket(map(ord, "umba"))] = 5000
    df = spark.createDataFrame([(1, run + "scumbag"), (2, run + "gardens")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, toxicity.ToxicityModel(slopes, -1.0)).collect()}
    assert found[1] > found[2]


def test_fitting_is_bounded_by_ids_and_entries(spark):
    rows = [(i, f"river word{i} stone") for i in range(200)] + [(7, f"again {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    seen = []
    original, toxicity.train = toxicity.train, lambda bags, toxic, weight: seen.append(bags) or original(bags, toxic, weight)
    try:
        toxicity.fit_toxicity(docs, labels)
        toxicity.fit_toxicity(docs, labels, max_entries=1000)
    finally:
        toxicity.train = original
    assert len(seen[0]) < 200 and 0 < sum(len(b) for b, _ in seen[1]) <= 1000
