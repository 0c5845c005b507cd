import pytest
from pyspark.sql import functions as F

from edgeloom.functions import signatures as sig
from edgeloom.operators import evaluate, texts


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("shop.Cart: shop.Item[] items(int)", "shop/Cart.items:(I)[Lshop/Item;"),
        (" shop.Cart :\tvoid   put( shop.Item , long[] )", "shop/Cart.put:(Lshop/Item;[J)V"),
        ("shop.Cart:int size()", "shop/Cart.size:()I"),
        ("shop.Cart: int size ()", "shop.Cart: int size ()"),
        ("shop.Cart: int gr\u00f6\u00dfe()", "shop.Cart: int gr\u00f6\u00dfe()"),
        ("shop.Cart: size()", "shop.Cart: size()"),
        ("shop.Cart: int size(", "shop.Cart: int size("),
        ("a.B: void <init>(int,a.C[][],boolean)", "a/B.<init>:(I[[La/C;Z)V"),
        ("no signature", "no signature"),
    ],
)
def test_canonical_signature(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "s string").select(sig.canonical_signature(F.col("s"))).first()[0] == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("a/B.m:(Ljava/lang/String;ISLjava/lang/String;)V", "class B { void m ( String a0, int a1, short a2, String a3, ) { return void1; }"),
        ("A$1B.m:([[I)[Ljava/lang/String;", "class A$B { String[] m ( int[][] a0, ) { return String[]1; }"),
        ("A.m:()V", "class A { void m ( ) { return void1; }"),
        ("x", None),
    ],
)
def test_stub_code(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "s string").select(sig.stub_code(F.col("s"))).first()[0] == wanted


@pytest.mark.parametrize(("a", "b"), [(3, 4), (10, 2), (2, 10), (10, 10), (0, 30), (0, 0)])
def test_token_pair_fills_its_room(spark, a, b):
    row = spark.range(1).select(sig.token_pair(F.array_repeat(F.lit("a"), a), F.array_repeat(F.lit("b"), b), 12).alias("w")).first()["w"]
    used = sum(row["mask"])
    assert len(row["tokens"]) == len(row["mask"]) == 12 and used == min(12, a + b + 3)
    room = 9
    if a + b > room:
        short = min(a, b) * room // (a + b)
        wanted = (short, room - short) if a < b else (room - short, short)
        assert (row["tokens"].count("a"), row["tokens"].count("b")) == wanted


def test_packed_and_fixed_vectors(spark):
    df = spark.createDataFrame([("1,2.5",), ("1,x",), (None,)], "s string").select(sig.packed_vector(F.col("s")).alias("v"))
    assert [r["v"] for r in df.collect()] == [[1.0, 2.5], None, None]
    assert [r[0] for r in df.select(sig.fixed_vector(F.col("v"), 2)).collect()] == [[1.0, 2.5], [0.0, 0.0], [0.0, 0.0]]


def test_blank_code_falls_to_the_stub(spark):
    edges = spark.createDataFrame([("A.m:()V", 1, "B.n:()V")], "method string, offset long, target string")
    code = spark.createDataFrame([("A.m:()V", " \n "), ("B.n:()V", "int  n;\n")], "signature string, code string")
    row = texts.edge_text(edges, code, ["method", "offset", "target"]).first()
    assert row["method_code"].startswith("class A") and row["target_code"] == "int n;"


def test_scores_without_positives_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "true_label int, predicted_label int")
    row = evaluate.confusion(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["FN"], row["TN"]) == (0, 0, 0, 1, 1)


def test_raw_edges_of_any_dialect(spark):
    lines = spark.createDataFrame([("c\t<a.B: void m()>/x/3\tc\t<a.C: int n()>",), ("c\tno site\tc\t<a.C: int n()>",), ("two\tfields",), (None,)], "value string")
    edges, rejects = texts.normalize_raw(lines, "text")
    assert [tuple(r) for r in edges.select("method", "offset", "target").collect()] == [("a/B.m:()V", 3, "a/C.n:()I")]
    assert sorted(r["reason"] for r in rejects.collect()) == ["call site", "fields", "fields"]
    plain = spark.createDataFrame([("A.m:()V", 1, "B.n:()V"), ("A.m:()V", None, "B.n:()V")], "method string, offset long, target string")
    edges, rejects = texts.normalize_raw(plain, "edges")
    assert edges.count() == 1 and [r["reason"] for r in rejects.collect()] == ["offset"]
    with pytest.raises(ValueError):
        texts.normalize_raw(plain, "other")


def test_the_parts_of_a_line_are_computed_once(spark):
    lines = spark.createDataFrame([("c\t<a.b.S: int[] m(java.lang.String,long)>/x.y/7\tc\t<a.P: a.Q g()>",), ("c\t<a.S: int m>/x\tc\t<a.P: a.Q g()>",), ("short",), (None,), ("c\t<a.S: int m()>/y/n\tc\t<b>",), ("c\t<a.S: int m()>/y/3\tc\t<no signature>",)], "value string")
    edges, rest = texts.parse_text_edges(lines), texts.rejected_lines(lines)
    assert {tuple(r) for r in edges.collect()} == {("a/b/S.m:(Ljava/lang/String;J)[I", 7, "a/P.g:()La/Q;"), ("a/S.m:()I", 3, "no signature")}
    assert sorted(r["reason"] for r in rest.collect()) == ["call site", "fields", "fields", "index"]
    for found, most in ((edges, 5), (rest, 1)):  # the line's fields; words and parameters of two signatures
        assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= most
