import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import ranks

SHARES = {"low": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 0.99}


def table(n=20_000):
    """Half of all rows have one value; the rest are spread; one group has a value only, one a row only."""
    rng = np.random.default_rng(8)
    value = np.where(rng.random(n) < 0.5, 1.0, np.round(rng.normal(0, 3, n), 2))
    group = rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05])
    value[group == "c"] = 0.25
    more = pd.DataFrame({"g": ["d", None, None, "e"], "v": [7.0, 1.0, 3.0, None]})
    return pd.concat([pd.DataFrame({"g": group, "v": value}), more], ignore_index=True)


def by_duckdb(frame):
    con = duckdb.connect()
    con.register("t", frame.astype({"g": object}).where(frame.notna(), None))
    parts = ", ".join(f"quantile_cont(v, {s}) AS {name}" for name, s in SHARES.items())
    rows = con.execute(f"SELECT g, count(v) AS n, {parts} FROM t WHERE v IS NOT NULL GROUP BY g").fetchall()
    return {r[0]: r[1:] for r in rows}


def spread(spark, frame, parts=9):
    rows = [(None if pd.isna(g) else g, None if pd.isna(v) else float(v)) for g, v in zip(frame["g"], frame["v"], strict=True)]
    return spark.createDataFrame(rows, "g string, v double").repartition(parts)


def test_exact_quantiles_as_duckdb(spark):
    frame = table()
    found = {r["g"]: tuple(r)[1:] for r in ranks.quantiles(spread(spark, frame), "v", SHARES, ["g"]).collect()}
    expected = by_duckdb(frame)
    assert found.keys() == expected.keys()
    for g, row in expected.items():
        assert found[g] == pytest.approx(row)
    whole = ranks.quantiles(spread(spark, frame), "v", {"median": 0.5, "all": 1.0, "none": 0.0}).first()
    assert tuple(whole) == pytest.approx((frame["v"].count(), frame["v"].median(), frame["v"].max(), frame["v"].min()))
    assert ranks.quantiles(spread(spark, frame.head(0)), "v", SHARES, ["g"]).count() == 0


def test_weights_stand_for_repeated_rows(spark):
    rows = [("x", 1.0, 3), ("x", 2.0, 0), ("x", 5.0, 4), ("y", 9.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, times long")
    found = {r["g"]: tuple(r)[1:] for r in ranks.quantiles(df, "v", {"q1": 0.25, "median": 0.5}, ["g"], "times").collect()}
    own = np.repeat([1.0, 5.0], [3, 4])
    assert found == {"x": (7, np.quantile(own, 0.25), np.quantile(own, 0.5)), "y": (2, 9.0, 9.0)}


def test_sketches_merge_and_stay_near(spark):
    frame = table()
    df = spread(spark, frame).withColumn("day", F.pmod(F.hash("v"), F.lit(7)))
    kept = ranks.quantile_sketches(df, "v", ["g", "day"])
    found = {r["g"]: r for r in ranks.sketched_quantiles(kept, SHARES, ["g"]).collect()}
    for g, own in frame.dropna(subset=["v"]).groupby(frame["g"].fillna("-"))["v"]:
        row, own = found[None if g == "-" else g], np.sort(own)
        assert row["n"] == len(own)
        for name, share in SHARES.items():
            low, high = np.searchsorted(own, row[name], "left") / len(own), np.searchsorted(own, row[name], "right") / len(own)
            assert row[name] in own and low - 0.02 <= share <= high + 0.02
    assert ranks.quantile_sketches(df.limit(0), "v", ["g"]).count() == 0


def test_one_value_is_counted_where_it_is(spark):
    same = spark.range(100_000).repartition(8).select(F.lit("g").alias("g"), F.lit(0.5).alias("v"))
    counts = same.groupBy("g", "v").agg(F.count("*").alias("n"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("hashpartitioning(g")  # counted below, that is before, the exchange
    assert [tuple(r) for r in ranks.value_counts(same, "v", ["g"]).collect()] == [("g", 0.5, 100_000, 0)]
    assert ranks.quantiles(same, "v", {"median": 0.5}, ["g"]).first()["median"] == 0.5


def test_rows_of_one_value_are_dealt_over_tasks(spark):
    df = spark.range(100_000).select(F.lit(1.0).alias("v"), "id")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        dealt = ranks._dealt(df.withColumn("_tie", F.xxhash64("v", "id")), [], [F.col("v"), F.col("_tie")])
        sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 4 and max(sizes) < 40_000
    ranked = ranks.ordered_rank(df, [], [F.col("v")])
    assert ranked.select(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (1, 100_000, 100_000)


def test_running_counts(spark):
    frame = table(3_000)
    found = {(r["g"], r["v"]): (r["n"], r["before"]) for r in ranks.value_counts(spread(spark, frame), "v", ["g"]).collect()}
    for g, own in frame.dropna().groupby("g")["v"]:
        for v, n in own.value_counts().items():
            assert found[g, v] == (n, (own < v).sum())
