from types import SimpleNamespace

import pytest

from edgeloom import storage
from edgeloom.operators import texts
from edgeloom.sources import edges as sources


def test_read_edges_takes_identity_from_the_path(spark, tmp_path):
    for program, name in (("p", "toolx_v1_3"), ("q", "toolx_v1_39")):
        (tmp_path / program).mkdir()
        (tmp_path / program / f"{name}.csv").write_text(f"method,offset,target\nm/{name},7,t\n")
    found = {(r["program"], r["tool"], r["version"], r["config_id"], r["offset"]) for r in sources.read_edges(spark, str(tmp_path)).collect()}
    assert found == {("p", "toolx", "v1", "3", 7), ("q", "toolx", "v1", "39", 7)}


def test_missing_table_is_empty(spark, tmp_path):
    assert sources.read_or_empty(spark, str(tmp_path / "none")).count() == 0


def test_rerun_replaces_statistics(spark, tmp_path):
    df = spark.createDataFrame([("a", "p", 1), ("a", "q", 2)], "tool string, program string, edges long")
    for _ in range(2):
        sources.append_stats(df, str(tmp_path / "s"), ("tool", "program"))
    sources.append_stats(df.filter("program = 'q'").selectExpr("tool", "program", "edges + 1 as edges"), str(tmp_path / "s"), ("tool", "program"))
    assert sorted((r["program"], r["edges"]) for r in sources.read_stats(spark, str(tmp_path / "s"), ("tool", "program")).collect()) == [("p", 1), ("q", 3)]


def test_metric_files_bear_their_name(spark, tmp_path):
    for name in ("a.csv", "overall_evaluation.csv"):
        (tmp_path / name).write_text("f1\n0.5\n")
    from pyspark.sql import types as T

    rows = sources.load_metric_files(spark, str(tmp_path), T.StructType([T.StructField("f1", T.DoubleType())])).collect()
    assert [(r["f1"], r["file_name"]) for r in rows] == [(0.5, "a.csv")]


def test_packed_vectors_keep_the_last_good_row(spark):
    rows = [("p", "m", 1, "t", "1,2", 1), ("p", "m", 1, "t", "3,4", 2), ("p", "m", 1, "t", "5,x", 3)]
    df = spark.createDataFrame(rows, "program string, method string, offset long, target string, packed string, row_order long")
    assert [r["vector"] for r in sources.load_packed_vectors(df).collect()] == [[3.0, 4.0]]


def test_text_lines(spark):
    good = "c\t<a.B: void <init>(int)>/some.site/42\tc\t<a.C: int m()>"
    bad = ["c\t<a.B: void f()>/x/n\tc\t<a.C: int m()>", "three\tfields\tonly", "c\t<a.B: void f(>/x/1\tc\t<a.C: int m()>", "c\tno slash\tc\td", "c\t<register-finalize <a.B: void f()>/x/1\tc\t<a.C: int m()>"]
    df = spark.createDataFrame([(x,) for x in [good, *bad]], "value string")
    assert [tuple(r) for r in texts.parse_text_edges(df).collect()] == [("a/B.<init>:(I)V", 42, "a/C.m:()I")]


def test_raw_names(spark):
    rows = [("wala/lambda$a$b$C$7.run:(I)V", 3, "x"), (texts.BOOT_CALLERS[0], 9, "y"), ("m", 1, texts.BOOT_TARGET), ("m", 2, texts.ARRAY_COPY), ("m", 2, texts.LAMBDA_FACTORY + "f:()V")]
    df = spark.createDataFrame(rows, "method string, offset long, target string")
    found = sorted(tuple(r) for r in texts.normalize_edges(df).collect())
    assert found == sorted([("a/b/C.<lambda/run$7>:()V", 3, "x"), ("<boot>", 0, "y"), ("m", 2, texts.JAVA_ARRAY_COPY)])


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context))


def test_release_deletes_what_durable_wrote(spark):
    kept = storage.durable(spark.range(3), "kept")
    assert kept.count() == 3
    storage.release(spark)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        kept.count()
    assert storage.durable(spark.range(3), "again").count() == 3


def test_edges_of_many_sets_are_written_in_one_job_and_read_by_name(spark, tmp_path):
    rows = [(p, "opal", "v1", c, "A.m:()V", 1, f"B.n{i}:()V") for i, (p, c) in enumerate((p, c) for p in ("x", "y") for c in ("0", "12"))]
    df = spark.createDataFrame(rows, "program string, tool string, version string, config_id string, method string, offset long, target string")
    sources.write_edges(df, str(tmp_path / "edges"))
    assert sorted(map(tuple, sources.read_edges(spark, str(tmp_path / "edges")).select(*df.columns).collect())) == sorted(rows)


def test_only_the_end_of_a_path_is_matched(spark, tmp_path):
    deep = f"{tmp_path}/x_y=z/wala_v0_9.csv.d/a_b_c"
    edges = spark.createDataFrame([("P", "t", "v1", "3", "m", 1, "x")], "program string, tool string, version string, config_id string, method string, offset long, target string")
    sources.write_edges(edges, deep)
    found = sources.read_edges(spark, deep)
    assert [tuple(r) for r in found.collect()] == [("P", "t", "v1", "3", "m", 1, "x")]
    assert "substring_index" in found._jdf.queryExecution().optimizedPlan().toString()
