import pytest
from pyspark.sql import functions as F

from edgeloom.operators import configs, filters, labels, sets, stats, subsets

EDGE = "program string, config_id string, method string, offset long, target string"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("p", c, m, o, t) for c, keys in (("v1", "abc"), ("v2", "bcd"), ("v3", "bd")) for k in keys for m, o, t in [(f"m/{k}", 1, f"t/{k}")]]
    return spark.createDataFrame([*rows, ("q", "v1", "m/a", 1, "t/a")], EDGE)


def keys(df):
    return sorted((r["program"], r["method"]) for r in df.select("program", "method").collect())


def test_classes_and_conflicts(spark, edges):
    total = edges.filter("program = 'p'").withColumn("tool", F.lit("x"))
    true, false = total.filter("method in ('m/a', 'm/b')"), total.filter("method in ('m/b', 'm/d')")
    found = {(r["config_id"], r["method"]): r for r in labels.label_edges(total, true, false).collect()}
    assert found["v1", "m/a"]["edge_class"] == "true" and found["v1", "m/b"]["edge_class"] == "conflict"
    assert found["v2", "m/d"]["edge_class"] == "false" and found["v1", "m/c"]["edge_class"] == "unknown"
    one = labels.label_edges(total, true, false).select(labels.label_column(F.col("is_true"), F.col("is_false")).alias("y"), "method")
    assert {r["method"]: r["y"] for r in one.collect()} == {"m/a": 1, "m/b": 0, "m/c": -1, "m/d": 0}
    counts = labels.class_counts(labels.label_edges(total, true, false), ("config_id",))
    assert {r["config_id"]: (r["total_edges"], r["true_edges"], r["false_edges"], r["unknown_edges"]) for r in counts.collect()}["v1"] == (3, 2, 1, 1)


def test_empty_false_set(spark, edges):
    found = labels.label_edges(edges, edges, edges.limit(0))
    assert {r["edge_class"] for r in found.collect()} == {"true"}


def test_union_is_intersection_and_disagreement(edges):
    both = keys(sets.intersection(edges)) + keys(sets.disagreement(edges))
    assert sorted(both) == keys(sets.union_edges(edges))
    assert keys(sets.intersection(edges)) == [("p", "m/b"), ("q", "m/a")]
    sizes = {r["program"]: (r["union_size"], r["intersection_size"]) for r in stats.union_intersection_sizes(edges).collect()}
    assert sizes == {"p": (4, 1), "q": (1, 1)}


def test_masks_add_up(edges):
    masks = sets.exclusive_counts(edges, ["v1", "v2", "v3"]).collect()
    assert sum(r["edges"] for r in masks) == sets.union_edges(edges).count()
    assert {r["mask"]: r["edges"] for r in masks} == {1: 2, 7: 1, 3: 1, 6: 1}


def test_null_keys_meet_in_anti_and_semi_joins(spark):
    left = spark.createDataFrame([("p", None, 1, "t"), ("p", "m", 1, "t")], "program string, method string, offset long, target string")
    right = left.filter("method is null")
    assert sets.keep_out(left, right).count() == 1 and sets.keep_in(left, right).count() == 1
    assert sets.keep_out(left, right.union(right)).count() == 1


def test_best_subset_prefers_least_disagreement(edges):
    best = subsets.best_config_subset(edges.filter("program = 'p'"), ["v1", "v2", "v3"], min_intersection=1).collect()
    assert [(r["members"], r["score"]) for r in best] == [("v2,v3", 1)]
    assert subsets.best_config_subset(edges, ["v1", "v2", "v3"], min_intersection=100).count() == 0


def test_prefix_filters(spark):
    edges = spark.createDataFrame([("p", "a/B.m", 1, "x/Y"), ("p", "a/BC.m", 1, "x/Y"), ("q", "a/B.m", 1, "c/D"), ("p", "<boot>", 0, "java/X")], "program string, method string, offset long, target string")
    prefixes = spark.createDataFrame([("p", "a/B.")], "program string, prefix string")
    assert [r["method"] for r in filters.keep_app_edges(edges, prefixes).collect()] == ["a/B.m"]
    libs = spark.createDataFrame([("a/B",)], "prefix string")
    assert filters.drop_library_edges(edges, libs).count() == 1
    assert filters.drop_library_edges(edges, spark.createDataFrame([("c/",)], "prefix string"), packages=True).count() == 3
    assert filters.drop_platform_edges(edges).count() == 3 and filters.drop_boot_edges(edges).count() == 3


def test_false_edges_need_both_sides(spark):
    edges = spark.createDataFrame([("x", "c1", "p", "m1", 1, "t"), ("x", "c1", "p", "m2", 1, "t"), ("x", "c2", "p", "m1", 1, "t"), ("x", "c1", "q", "m3", 1, "t")], "tool string, config_id string, program string, method string, offset long, target string")
    table = spark.createDataFrame([("x", "c1", {"analysis": "coarse", "k": "1"}), ("x", "c2", {"analysis": "fine", "k": "1"}), ("x", "c3", {"analysis": "fine", "k": "2"})], "tool string, config_id string, options map<string,string>")
    orders = spark.createDataFrame([("analysis", "fine", "MPT", "coarse")], "option string, left string, order string, right string")
    pairs = configs.config_pairs(table, orders)
    assert [(r["coarse"], r["fine"]) for r in pairs.collect()] == [("c1", "c2")]
    found = configs.derive_false_edges(edges, pairs)
    assert [(r["program"], r["method"]) for r in found.collect()] == [("p", "m2")]
    assert configs.false_for_config(found, "x", "c1").count() == 1 and configs.false_for_config(found, "x", "c").count() == 0


def test_closure_of_chain_and_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "left string, right string")
    found = {(r["left"], r["right"]) for r in configs.transitive_closure(pairs).collect()}
    assert found == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")}


def test_manual_labels(spark):
    given = spark.createDataFrame([("p", "m", 1, "t", "?", 1), ("p", "m", 1, "t", "1", 2), ("p", "n", 1, "t", " ", 3), ("p", "o", 1, "t", "1a", 4)], "program string, method string, offset long, target string, label string, row_order long")
    found = {r["method"]: (r["label"], r["label_status"]) for r in filters.parse_manual_labels(given, order="row_order").collect()}
    assert found == {"m": (1, "used"), "n": (None, "blank"), "o": (None, "unreadable")}


def test_app_edges_are_joined_by_equal_starts(spark):
    edges = spark.createDataFrame([(p, m, o, t) for p in ("P", "Q", None) for o, (m, t) in enumerate([("a/B", "c/D"), ("a/BC", None), ("x", "a/B"), ("", "é/𝄞x"), (None, "a")])], "program string, method string, offset long, target string")
    lists = {"P": ["a/B", "é/𝄞", "a/BCDEFG", None], "Q": ["", "zz"], "R": ["a"]}
    prefixes = spark.createDataFrame([(p, x) for p, own in lists.items() for x in [*own, own[0]]], "program string, prefix string")
    found = filters.flag_app_edges(edges, prefixes, "own")
    starts = lambda name, program: any(x is not None and name is not None and name.startswith(x) for x in lists.get(program, []))
    rows = found.collect()
    assert len(rows) == 15 and all(r["own"] == (starts(r["method"], r["program"]) or starts(r["target"], r["program"])) for r in rows)
    kept = filters.keep_app_edges(edges, prefixes)
    assert kept.columns == edges.columns and kept.count() == sum(r["own"] for r in rows)
    assert "StartsWith" not in kept._jdf.queryExecution().optimizedPlan().toString()  # no list of prefixes is gone through for each edge
