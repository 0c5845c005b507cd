import uuid

import pytest

from edgeloom.sources import commits
from edgeloom.sources import edges as sources

SHAPE = "tool string, program string, version string, config_id string, method string, offset long, target string, edge_class string"


def rows_of(spark, *sets):
    rows = [(tool, program, version, config, f"{program}/m", i, mark, "true" if i % 2 else "unknown") for tool, program, version, config, mark, n in sets for i in range(n)]
    return spark.createDataFrame(rows, SHAPE)


def held(df):
    found = {}
    for r in df.collect():
        key = (r["tool"], r["program"], r["version"], r["config_id"])
        found.setdefault(key, []).append(r["target"])
    return {k: (len(v), *sorted(set(v), key=str)) for k, v in found.items()}


def test_versions_written_in_turn_are_all_there_and_a_rerun_replaces_only_its_own(spark, tmp_path):
    path = str(tmp_path / "db")
    assert sources.write_edge_db(rows_of(spark, ("t", "p", "v1", "0", "a", 3), ("t", "q", "v1", "0", "a", 2)), path) == 1
    assert sources.write_edge_db(rows_of(spark, ("t", "p", "v2", "0", "b", 4), ("t", "p", "v1", "1", "b", 1)), path) == 2
    assert held(sources.read_edge_db(spark, path)) == {("t", "p", "v1", "0"): (3, "a"), ("t", "q", "v1", "0"): (2, "a"), ("t", "p", "v2", "0"): (4, "b"), ("t", "p", "v1", "1"): (1, "b")}
    sources.write_edge_db(rows_of(spark, ("t", "p", "v1", "0", "c", 1)), path)
    now = {("t", "p", "v1", "0"): (1, "c"), ("t", "q", "v1", "0"): (2, "a"), ("t", "p", "v2", "0"): (4, "b"), ("t", "p", "v1", "1"): (1, "b")}
    assert held(sources.read_edge_db(spark, path)) == now
    assert held(sources.read_edge_db(spark, path, version=1)) == {("t", "p", "v1", "0"): (3, "a"), ("t", "q", "v1", "0"): (2, "a")}
    assert held(sources.read_edge_db(spark, path, only={"program": "q"})) == {("t", "q", "v1", "0"): (2, "a")}
    assert held(sources.read_edge_db(spark, path, only={"version": "v2"})) == {("t", "p", "v2", "0"): (4, "b")}
    assert sources.read_edge_db(spark, path, only={"program": "none"}).count() == 0
    # the first batch still holds q, the second its sets, the third the rerun
    assert commits.vacuum(spark, path) == 0
    sources.write_edge_db(rows_of(spark, ("t", "q", "v1", "0", "d", 2)), path)
    assert commits.vacuum(spark, path) == 1
    assert held(sources.read_edge_db(spark, path)) == now | {("t", "q", "v1", "0"): (2, "d")}
    assert commits.versions(spark, path) == [4]


def test_consolidating_leaves_what_is_there(spark, tmp_path):
    path = str(tmp_path / "final")
    sources.consolidate(rows_of(spark, ("t", "p", "v1", "0", "a", 3)), path)
    sources.consolidate(rows_of(spark, ("t", "p", "v1", "0", "b", 9), ("t", "p", "v2", "0", "b", 2)), path)
    sources.consolidate(rows_of(spark, ("u", "p", "v1", "0", "c", 1)), path)
    assert held(commits.read_sets(spark, path)) == {("t", "p", "v1", "0"): (3, "a"), ("t", "p", "v2", "0"): (2, "b"), ("u", "p", "v1", "0"): (1, "c")}


def test_null_and_empty_names_are_names(spark, tmp_path):
    path = str(tmp_path / "odd")
    sources.write_edge_db(rows_of(spark, ("", None, "v1", "0", "a", 3), (None, "", "v1", "0", "b", 2), ("", "", None, "", "c", 1)), path)
    sources.write_edge_db(rows_of(spark, ("", None, "v1", "0", "d", 1), ("7", "007", "1", "00", "e", 1)), path)
    assert held(sources.read_edge_db(spark, path)) == {("", None, "v1", "0"): (1, "d"), (None, "", "v1", "0"): (2, "b"), ("", "", None, ""): (1, "c"), ("7", "007", "1", "00"): (1, "e")}
    assert held(sources.read_edge_db(spark, path, only={"program": None})) == {("", None, "v1", "0"): (1, "d")}
    assert held(sources.read_edge_db(spark, path, only={"program": "007"})) == {("7", "007", "1", "00"): (1, "e")}


def test_a_set_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "empty")
    sources.write_edge_db(rows_of(spark, ("t", "p", "v1", "0", "a", 3), ("t", "p", "v1", "1", "a", 1)), path)
    sets = spark.createDataFrame([("t", "p", "v1", "0")], "tool string, program string, version string, config_id string")
    sources.write_edge_db(rows_of(spark).limit(0), path, sets=sets)
    assert held(sources.read_edge_db(spark, path)) == {("t", "p", "v1", "1"): (1, "a")}
    assert {(r["config_id"], r["rows"]) for r in commits.manifest(spark, path).collect()} == {("0", 0), ("1", 1)}
    with pytest.raises(ValueError, match="nothing was published"):
        commits.read_sets(spark, str(tmp_path / "none"))


def test_what_isnt_published_isnt_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    sources.write_edge_db(rows_of(spark, ("t", "p", "v1", "0", "a", 3)), path)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(commits, "_renamed", fails)
        with pytest.raises(OSError, match="lost"):
            sources.write_edge_db(rows_of(spark, ("t", "p", "v1", "0", "b", 1)), path)
    assert held(sources.read_edge_db(spark, path)) == {("t", "p", "v1", "0"): (3, "a")}
    assert commits.vacuum(spark, path) == 1


@pytest.mark.parametrize("replace", [True, False])
def test_two_writers_at_once(spark, tmp_path, monkeypatch, replace):
    path, real, raced = str(tmp_path / "db"), commits._renamed, []
    commits.commit_sets(rows_of(spark, ("t", "p", "v0", "0", "a", 1)), path)

    def slow(session, source, target):
        if not raced:  # another writer publishes first
            raced.append(uuid.uuid4())
            commits.commit_sets(rows_of(spark, ("t", "p", "v1", "0", "other", 2), ("t", "p", "v2", "0", "other", 2)), path)
        return real(session, source, target)

    monkeypatch.setattr(commits, "_renamed", slow)
    assert commits.commit_sets(rows_of(spark, ("t", "p", "v1", "0", "mine", 3), ("t", "p", "v3", "0", "mine", 3)), path, replace=replace) == 3
    both = (3, "mine") if replace else (2, "other")
    assert held(commits.read_sets(spark, path)) == {("t", "p", "v0", "0"): (1, "a"), ("t", "p", "v1", "0"): both, ("t", "p", "v2", "0"): (2, "other"), ("t", "p", "v3", "0"): (3, "mine")}


def test_statistics_of_versions(spark, tmp_path):
    path = str(tmp_path / "stats")
    shape = "tool string, program string, version string, config_id string, edges long"
    for rows in ([("t", "p", "v1", "0", 1)], [("t", "p", "v2", "0", 2), ("t", "p", "v1", "1", 3)], [("t", "p", "v1", "0", 9)]):
        sources.append_stats(spark.createDataFrame(rows, shape), path)
    assert sorted((r["version"], r["config_id"], r["edges"]) for r in sources.read_stats(spark, path).collect()) == [("v1", "0", 9), ("v1", "1", 3), ("v2", "0", 2)]


def test_the_view_without_platform_edges(spark, tmp_path):
    path = str(tmp_path / "db")
    prefixes = spark.createDataFrame([("p", "p/"), ("p", "lib/")], "program string, prefix string")
    sources.write_edge_db(rows_of(spark, ("t", "p", "v1", "0", "java/x", 3), ("t", "q", "v1", "0", "lib/y", 2)), path, prefixes)
    assert held(sources.read_edge_db(spark, path, platform=False)) == {("t", "p", "v1", "0"): (3, "java/x")}
    assert len(held(sources.read_edge_db(spark, path))) == 2
