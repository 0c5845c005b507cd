import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Levels of a tree, and of each leaf its (left, right) siblings."""
    levels, paths, at = [leaves], [[] for _ in leaves], list(range(len(leaves)))
    while len(levels[-1]) > 1:
        last = levels[-1]
        for i, place in enumerate(at):
            run = place - place % 3
            paths[i].append(("".join(last[run:place]), "".join(last[place + 1 : run + 3])))
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
        at = [place // 3 for place in at]
    return levels[-1][0], paths


def plain(rows, tampered=lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 2 == 0):
    by = defaultdict(list)
    for row in rows:
        by[b"" if row[1] is None else b"1" + row[1].encode()].append(row)
    order = sorted(by)
    sources = []
    for key in order:
        own = sorted(by[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        sources.append((own, *tree([leaf(r, r[4]) for r in own])))
    root, above = tree([s[1] for s in sources])
    out = []
    for (own, sub, paths), top in zip(sources, above, strict=True):
        for row, path in zip(own, paths, strict=True):
            digest = leaf(row, row[4] if not tampered(row[0]) or row[4] is None else row[4].replace("\n", ""))
            whole = path + top
            for left, right in whole:
                digest = h(left, digest, right)
            out.append((row[0], leaf(row, row[4]), sub, root, h(*(a + b for a, b in whole)), digest, digest == root))
    return sorted(out, key=repr)


def table(n, sources):
    rows = [(i, sources[i % len(sources)], "en" if i % 5 else None, i * 7 if i % 3 else None, None if i % 11 == 0 else f"Zeile {i}\nété {i % 4}\n" * (i % 3)) for i in range(n)]
    return [*rows, rows[-1], rows[-1], (None, "b", None, None, ""), (2, None, None, None, None)] if n else []


@pytest.mark.parametrize(("n", "sources", "lift"), [(100, ["a", "é", "Z", "a", None], 2), (1, ["x"], 6), (60, ["one"], 1), (40, [f"s{i}" for i in range(31)], 2), (130, ["a"], 6)])
def test_every_row_as_a_plain_version(spark, n, sources, lift):
    rows = table(n, sources)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    bare = merkle.record_digest([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    changed = F.when(merkle.id_hash(F.col("doc_id")) % 2 == 0, bare)
    found = merkle.verify_documents(docs, changed, lift=lift)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_the_query_and_clashing_columns(spark, tmp_path):
    rows = table(70, ["a", "b"])
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "place", "digest", "Leaf", "row", "a.b", "x`y", "_n"):
        docs = docs.withColumn(name, F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert found == plain(rows)
    assert {r[6] for r in found} == {True, False}


def test_an_untouched_table_is_verified_and_an_empty_one_is_empty(spark):
    docs = spark.createDataFrame(table(30, ["a", "b", None]), SCHEMA)
    assert {r["verified"] for r in merkle.verify_documents(docs).collect()} == {True}
    assert merkle.verify_documents(docs.limit(0)).count() == 0


def test_a_very_long_text_is_hashed_whole(spark):
    rows = [(1, "a", "en", 1, "x" * 3_000_000 + "\n"), (2, "a", "en", 1, "y")]
    found = {r["doc_id"]: r["leaf"] for r in merkle.verify_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {r[0]: leaf(r, r[4]) for r in rows}


def test_the_layout_gives_each_node_one_place_and_keeps_subtrees_together():
    for levels in range(1, 8):
        places = np.concatenate([merkle.veb_address(levels, d, np.arange(3**d)) for d in range(levels)])
        assert sorted(places.tolist()) == list(range(merkle.tree_size(levels)))
    assert merkle.veb_address(7, 0, np.array([0])).tolist() == [0]
    # the subtrees below the upper half are contiguous
    upper, lower = 3, 4
    for root in range(3**upper):
        below = np.concatenate([merkle.veb_address(7, upper + d, np.arange(root * 3**d, (root + 1) * 3**d)) for d in range(lower)])
        assert below.max() - below.min() == merkle.tree_size(lower) - 1


def test_paths_as_text():
    path = [("ab", ""), ("", ""), ("", "cd")]
    assert merkle.read_path(merkle.write_path(path)) == path and merkle.read_path("") == []
