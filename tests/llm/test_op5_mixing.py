import duckdb
import pytest

from edgeloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def mixed(df):
    sized = df.select("doc_id", "source", mixing.word_count(df["text"]).alias("size"))
    return mixing.mix_sources(sized)


def test_targets_clamp_and_reshare(spark):
    # three sources of 10, 100 and 1000 words: weights 3, 1, 2 share 1665 words
    df = docs(spark, [(1, "a " * 10, "a"), (2, "b " * 100, "b"), *[(10 + i, "c " * 10, "c") for i in range(100)]])
    found = {r["source"]: r for r in mixed(df).select("source", "target", "source_size").distinct().collect()}
    assert found["a"]["target"] == 20 and found["b"]["target"] == 200 and found["c"]["target"] == 1445


def test_taken_meets_targets_and_bounds(spark):
    df = docs(spark, [(i, "w " * (i % 37), ["a", "b", "c", None][i % 4]) for i in range(800)])
    rows = mixed(df).collect()
    for s in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    again = {r["doc_id"]: r["taken"] for r in mixed(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_edge_cases(spark):
    assert mixed(docs(spark, [])).count() == 0
    rows = mixed(docs(spark, [(None, None, None), (None, "", "a"), (1, "x y", "a"), (1, "x y", "a")])).collect()
    assert len(rows) == 4 and sorted(r["taken"] for r in rows) == [0, 0, 3, 3] or sum(r["taken"] for r in rows) == 6
    clash = docs(spark, [(1, "x y", "a")]).selectExpr("doc_id", "source", "2L as size", "'old' as target", "1 as start", "2 as whole", "3 as rest")
    found = mixing.mix_sources(clash).first()
    assert (found["target"], found["start"], found["whole"], found["rest"]) == (3.0, 1, 2, 3)


def test_word_count_splits_on_ascii_blanks_only(spark):
    df = spark.createDataFrame([("a b c\x1cd\te\n\x0bf", 4), ("", 0), (None, 0), (" \t", 0), ("x" * 100_000, 1)], "t string, n long")
    assert all(r["got"] == r["n"] for r in df.select("n", mixing.word_count(df["t"]).alias("got")).collect())


@pytest.mark.parametrize("n", [1, 40])
def test_sql_agrees(spark, tmp_path, n):
    df = docs(spark, [(i, "w " * (i * 7 % 50), f"s{i % 5}" if i % 6 else None) for i in range(n * 10)])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP5_SQL})").fetchall())
    assert sorted(map(tuple, mixing.op5_mix_sources(spark, str(tmp_path)).collect())) == theirs


def test_repetitions_follow_taken(spark):
    rows = spark.createDataFrame([(1, 10, 20), (2, 10, 4), (3, 10, 5), (4, 0, 0), (5, 10, 10)], "doc_id long, size long, taken long")
    found = sorted(r["doc_id"] for r in mixing.repetitions(rows, "size", ["doc_id"]).collect())
    assert found == [1, 1, 3, 5]
