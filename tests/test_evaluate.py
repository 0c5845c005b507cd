"""Scores of configurations against all truth edges of their programs."""

from edgeloom.operators import evaluate

LABELLED = "program string, tool string, config_id string, method string, offset long, target string, is_true boolean, is_false boolean, predicted_label int"
TRUTH = "program string, method string, offset long, target string"


def _widest_join(df, column):
    """Joins that Spark's optimised plan makes on this column alone between tables of edges (those that have a target)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        todo += children
        if node.nodeName() == "Join":
            condition = node.condition().get().toString()
            edges = any("target" in str(c.output().apply(i).name()) for c in children for i in range(c.output().size()))
            if edges and column in condition and "target" not in condition:
                found.append(condition)
    return found


def _tables(spark):
    labelled = [
        ("p", "t", "a", "m", 1, "x", True, False, 1),
        ("p", "t", "a", "m", 2, "x", False, True, 1),
        ("p", "t", "a", None, 3, "x", True, False, 1),  # a null in a key is equal to another
        ("p", "t", "b", "m", 1, "x", True, False, 0),
        ("q", "t", "b", "m", 9, "y", False, True, 1),
        (None, "t", "b", "m", 1, "x", True, False, 1),  # a null program has no truth edges
        ("r", "t", "c", "m", 1, "x", False, False, 0),  # neither found nor true
    ]
    truth = [("p", "m", 1, "x"), ("p", "m", 1, "x"), ("p", None, 3, "x"), ("p", "far", 7, "z"), (None, "m", 1, "x"), ("q", "m", 4, "y")]
    return spark.createDataFrame(labelled, LABELLED), spark.createDataFrame(truth, TRUTH)


def test_kept_graph_counts_all_truth_edges_without_joining_on_the_program(spark):
    rows, truth = _tables(spark)
    found = evaluate.kept_graph_scores(rows, truth)
    assert {r["config_id"]: (r["precision"], r["recall"], r["f1"]) for r in found.collect()} == {"a": (0.67, 0.67, 0.67), "b": (0.0, 0.0, 0.0)}
    assert _widest_join(found, "program") == []


def test_baseline_counts_all_truth_edges_without_joining_on_the_program(spark):
    rows, truth = _tables(spark)
    manual = spark.createDataFrame([("p", "m", 1, "x", 1), ("p", "m", 2, "x", 0), ("p", "far", 7, "z", 1), (None, "m", 1, "x", 1)], TRUTH + ", label int")
    found = evaluate.baseline_metrics(rows, truth, manual)
    shown = {r["config_id"]: tuple(r[f"{h}_{c}"] for h in ("auto", "manual") for c in ("precision", "recall")) for r in found.collect()}
    # b: programs p (1 of 1, 1 of 3), q (0) and null (0); by hand p (1 of 1, 1 of 2) and null
    assert shown == {"a": (0.67, 0.67, 0.5, 0.5), "b": (0.33, 0.11, 0.5, 0.25)}
    pooled = {r["config_id"]: (r["auto_precision"], r["auto_recall"]) for r in evaluate.baseline_metrics(rows, truth, manual, micro=True).collect()}
    assert pooled == {"a": (0.67, 0.67), "b": (0.33, 0.25)}
    assert _widest_join(found, "program") == []
