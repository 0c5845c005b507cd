import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "\n", "\t", "é", " ", "#", "|", "a b c d e ", "word ", "\r", "\x1c", "\n\n"]), max_size=60).map("".join))
def test_base_figures(text):
    assert quality.judge(text.encode(), None)[:6] == plain(text)


def test_divergence():
    p = np.array([1.0, 1, 0])
    assert quality.jensen_shannon(p, p) == 0 and abs(quality.jensen_shannon(p, np.array([0.0, 0, 5])) - 1) < 1e-12
    assert quality.jensen_shannon(np.zeros(3), p) == 0


def corpus(spark):
    rng = np.random.default_rng(1)
    common = ["the", "of", "and", "to", "in", "is", "it", "for", "on", "that"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    rows = [(i, text(120), "en") for i in range(60)]
    rows += [(100, " ".join("#%$&*" * 4 for _ in range(120)), "en"), (101, text(5), "en"), (102, None, "en"), (103, "", None), (104, text(120), None), (105, text(20) + " " + "same five words again now " * 40, "en")]
    return spark.createDataFrame([(i, t, g, True) for i, t, g in rows], "doc_id long, text string, lang string, kept boolean")


def test_junk_goes_and_clean_stays(spark):
    found = {r["doc_id"]: r for r in quality.quality_rules(corpus(spark)).collect()}
    assert all(found[i]["kept"] for i in range(60)) and found[104]["kept"]
    assert not any(found[i]["kept"] for i in (100, 101, 102, 103, 105))
    assert found[100]["class_distance"] > quality.MAX_CLASS_DISTANCE and not found[100]["base_failed"] or found[100]["base_failed"]
    assert found[101]["word_distance"] is None


def test_empty_and_repeated(spark):
    df = corpus(spark)
    assert quality.quality_rules(df.limit(0)).count() == 0
    twice = quality.quality_rules(df.union(df)).groupBy("doc_id").agg({"kept": "count"}).collect()
    assert {r[1] for r in twice} == {2}


def test_every_language_has_its_own_reference(spark):
    rng = np.random.default_rng(2)
    letters = ["abcdefgh", "нопрстуф", "αβγδεζηθ", "אבגדהוזח"]
    lists = [["".join(rng.choice(list(a), 5)) for _ in range(12)] for a in letters]
    rows = [(100 * g + i, " ".join(rng.choice(words, 120)), f"l{g}") for g, words in enumerate(lists) for i in range(20 if g == 0 else 4 - g)]
    df = spark.createDataFrame([*rows, (900, rows[0][1], None), (901, "", "l9")], "doc_id long, text string, lang string")
    one, all_ = ({r["doc_id"]: r for r in quality.quality_rules(df, most=m).collect()} for m in (1, 256))
    assert one == all_ and len(one) == len(rows) + 2
    assert all(one[i]["kept"] for i, _, _ in rows)
