"""Groupings of edges keep the number of tasks that the session names."""

from edgeloom.operators import sets


def test_membership_is_dealt_by_key_and_repeats_count_once(spark):
    rows = [("p", f"m{i % 50}", 1, "t", f"g{i % 3}") for i in range(600)] + [("p", "m0", 1, "t", "g0")] * 40
    edges = spark.createDataFrame(rows, "program string, method string, offset long, target string, config_id string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = sets.membership(edges)
        assert "hashpartitioning(program" in found._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
        assert {(r["method"], r["n"], r["of"]) for r in found.collect()} == {(f"m{i}", 3, 3) for i in range(50)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_predictions_label_each_edge_without_a_second_pass(spark):
    from edgeloom.plans.evaluation_plans import predictions

    plan = predictions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3
