from edgeloom.operators import graph
from edgeloom.storage import durable

SHAPE = "g string, method string, offset long, target string, row_order long"


def test_last_offset_wins_and_loops_count_twice(spark):
    rows = [("g", "a", 1, "b", 1), ("g", "a", 5, "b", 2), ("g", "a", 5, "c", 3), ("g", "c", 1, "c", 4), ("g", "z", 1, "a", 5)]
    edges = spark.createDataFrame(rows, SHAPE)
    roots = spark.createDataFrame([("g", "a")], "g string, root string")
    found = {(r["method"], r["offset"], r["target"]): r for r in graph.structural_features(edges, roots, ["g"]).collect()}
    assert len(found) == 5
    assert found["a", 5, "b"]["l_fanout"] == 2 and found["a", 1, "b"]["l_fanout"] == 0
    assert found["a", 1, "b"]["repeated_edges"] == 1 and found["a", 1, "b"]["multi_edges"] == 2
    assert (found["c", 1, "c"]["src_in_degree"], found["c", 1, "c"]["src_out_degree"]) == (2, 1)
    assert found["z", 1, "a"]["depth"] == -1 and found["a", 5, "c"]["depth"] == 0 and found["c", 1, "c"]["depth"] == 1
    row = found["a", 5, "b"]
    assert (row["node_count"], row["edge_count"], row["avg_degree"]) == (4, 4, 1.0) and abs(row["avg_l_fanout"] - 4 / 3) < 1e-12


def test_roots_by_priority(spark):
    edges = spark.createDataFrame([("g", "r2", 1, "r1", 1), ("h", "r2", 1, "x", 2), ("i", "x", 1, "y", 3)], SHAPE)
    found = {r["g"]: r["root"] for r in graph.choose_roots(graph.collapse(edges, ["g"]), ["g"], ("r1", "r2")).collect()}
    assert found == {"g": "r1", "h": "r2"}


def test_depths_of_several_graphs_with_cycles(spark):
    edges = spark.createDataFrame([("g", "a", 1, "b", 1), ("g", "b", 1, "a", 2), ("g", "b", 1, "c", 3), ("h", "a", 1, "c", 4)], SHAPE)
    roots = spark.createDataFrame([("g", "a"), ("h", "a")], "g string, root string")
    found = {(r["g"], r["node"]): r["depth"] for r in graph.depths(graph.collapse(edges, ["g"]), roots, ["g"]).collect()}
    assert found == {("g", "a"): 0, ("g", "b"): 1, ("g", "c"): 2, ("h", "a"): 0, ("h", "c"): 1}


def test_features_take_one_shuffle_of_the_edges_and_know_null_offsets(spark, monkeypatch):
    rows = [("g", "a", 1, "b", 1), ("g", "a", None, "b", 2), ("g", "a", 3, "b", 3), ("g", "a", 3, "b", 3), ("g", "a", 3, "c", 4), ("h", "b", 3, "b", 5)]
    edges = spark.createDataFrame(rows, SHAPE)
    kept = []
    monkeypatch.setattr(graph, "durable", lambda df, label: kept.append((label, df)) or durable(df, label))
    found = {(r["g"], r["method"], r["offset"], r["target"]): r for r in graph.structural_features(edges, graph=["g"]).collect()}
    assert {k: (r["l_fanout"], r["multi_edges"]) for k, r in found.items()} == {("g", "a", 1, "b"): (0, 2), ("g", "a", None, "b"): (0, 2), ("g", "a", 3, "b"): (2, 2), ("g", "a", 3, "c"): (2, 1), ("h", "b", 3, "b"): (1, 1)}
    whole = [df for label, df in kept if label == "graph-simple"][0]
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
