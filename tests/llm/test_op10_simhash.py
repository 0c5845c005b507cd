import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgeloom.llm import simhash


def plain_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_the_definition():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["Ab", "c", "dé", "EÉ"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_print(text)
    assert simhash.fingerprint(b"x y z " * 70_000) == plain_print("x y z " * 70_000)


def components(prints):
    least = {i: i for i in range(len(prints))}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                a_root, b_root = root(i), root(j)
                least[max(a_root, b_root)] = min(a_root, b_root)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("heavy", [0, 2, 1000])
def test_links_and_components_equal_brute_force(spark, heavy, monkeypatch):
    original = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda prints: original(prints, heavy))
    rng = random.Random(5)
    prints = [0, (1 << 64) - 1]
    for _ in range(12):
        center = rng.getrandbits(64)
        prints += [center ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(25)]
    chain = rng.getrandbits(64)
    for i in range(30):
        chain ^= 3 << (2 * (i % 31))
        prints.append(chain)
    prints = [p & (1 << 64) - 1 for p in prints]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, print long")
    found = {r["print"]: r["component_id"] for r in simhash.print_components(rows).collect()}
    assert [found[s] for s in signed] == components(prints)


def test_edge_cases(spark):
    rows = [(5, "a b c d"), (3, "A B C D"), (None, "a b c d"), (9, None), (8, ""), (7, " \t"), (4, "q r s"), (4, "q r s"), (None, "only nameless")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, print string")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert {c for _, c in by[5] | by[3]} == {3} and {c for _, c in by[7] | by[8] | by[9]} == {7}
    assert {f for f, _ in by[9]} == {"0" * 16} and {c for _, c in by[None]} == {3, None}
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.one_of_each(df).collect())
    assert kept == [(-1, "only nameless"), (3, "A B C D"), (4, "q r s"), (7, " \t")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_with_unique_ids(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "p"), (1, "a b c d e f", "q"), (3, "u v w x y z", "r")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["source"]) for r in simhash.one_of_each(df).collect()) == [(1, "q"), (3, "r")]


def test_ids_may_be_strings_and_columns_bear_any_name(spark):
    rows = [("b", "a b c d e f", "p", 1), ("a", "a b c d e f", "q", 2), ("c", "u v w x y z", "r", 3), ("c", "u v w x y z", "r", 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _Print string, _kept int").withColumn("_component", F.lit(7)).withColumn("_LEAST", F.lit(8)).withColumn("_rank", F.lit(9))
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [("a", "a b c d e f", "q", 2, 7, 8, 9), ("c", "u v w x y z", "r", 3, 7, 8, 9)]
    unique = simhash.one_of_each(df.filter("doc_id <> 'c'"))
    assert [tuple(r)[:4] for r in unique.collect()] == [("a", "a b c d e f", "q", 2)]
