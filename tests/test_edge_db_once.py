"""The labelled edges of the database query are computed once, however often they are written."""

from edgeloom.plans import text_plans


def test_labels_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    rows = [("p", "t", "a", "m", 1, "x", True, False, "true"), ("p", "t", "b", "m", 2, "x", False, False, "unknown")]
    df = spark.createDataFrame(rows, "program string, tool string, config_id string, method string, offset long, target string, is_true boolean, is_false boolean, edge_class string")

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(text_plans, "labelled", lambda *_: df.mapInArrow(counted, df.schema))
    assert sorted(r["edge_class"] for r in text_plans.source_edge_db(spark, "").collect()) == ["true", "unknown"]
    assert made.value == 2
