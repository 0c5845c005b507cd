"""Queries of evaluation: predictions are a fixed rule over line items, so that every figure can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import evaluate, ranks
from edgeloom.operators.labels import label_edges
from edgeloom.operators.sets import dealt
from edgeloom.plans.labelling import labelled
from edgeloom.plans.registry import query
from edgeloom.plans.views import EDGE_SQL, false_edges, raw_edges, true_edges
from edgeloom.storage import durable

K = 'program, method, "offset", target'
PREDICTION_SQL = f"""facts AS (SELECT {K}, tool, config_id, min(l_discount)::DOUBLE AS discount, max(l_tax)::DOUBLE AS confidence, min(row_order) AS row_order FROM raw_edges GROUP BY {K}, tool, config_id),
  predictions AS (SELECT f.*, CASE WHEN l.is_false THEN 0 WHEN l.is_true THEN 1 ELSE -1 END AS true_label, CASE WHEN discount >= 0.05 THEN 1 ELSE 0 END AS predicted_label,
    CASE WHEN f.row_order % 11 = 0 THEN 1 WHEN f.row_order % 11 = 1 THEN 0 END AS ground_truth, CAST(f.row_order % 5 AS int) AS fold
    FROM facts f JOIN labelled l USING ({K}, tool, config_id))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["program", "method", "offset", "target", "tool", "config_id"]
    rows = dealt(raw_edges(spark, sf_dir).select(*keys, "l_discount", "l_tax", "row_order"))
    facts = rows.groupBy(*keys).agg(F.min("l_discount").cast("double").alias("discount"), F.max("l_tax").cast("double").alias("confidence"), F.min("row_order").alias("row_order"))
    joined = label_edges(facts.dropna(subset=keys), dealt(true_edges(spark, sf_dir)), dealt(false_edges(spark, sf_dir)))  # facts have a row for each edge of a configuration
    label = F.when(F.col("is_false"), 0).when(F.col("is_true"), 1).otherwise(-1)
    at = F.col("row_order") % 11
    return joined.select(*keys, "discount", "confidence", "row_order", label.alias("true_label"), (F.col("discount") >= 0.05).cast("int").alias("predicted_label"), F.when(at == 0, 1).when(at == 1, 0).alias("ground_truth"), (F.col("row_order") % 5).cast("int").alias("fold"))


def rates_sql(tp: str, fp: str, fn: str, pre: str = "", digits: int | None = 4) -> str:
    p, r = f"(CASE WHEN {tp} + {fp} = 0 THEN 0 ELSE {tp} / ({tp} + {fp}) END)", f"(CASE WHEN {tp} + {fn} = 0 THEN 0 ELSE {tp} / ({tp} + {fn}) END)"
    f = f"(CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END)"
    return ", ".join(f"{x if digits is None else f'round({x}, {digits})'} AS {pre}{n}" for n, x in (("precision", p), ("recall", r), ("f1", f)))


CELLS_SQL = """count(*) FILTER (true_label = 1 AND predicted_label = 1) AS TP, count(*) FILTER (true_label = 0 AND predicted_label = 0) AS TN,
  count(*) FILTER (true_label = 0 AND predicted_label = 1) AS FP, count(*) FILTER (true_label = 1 AND predicted_label = 0) AS FN"""
TOTALS_SQL = "TP, TN, FP, FN, TP + FN AS total_true, TN + FP AS total_false"


@query("eval_confusion", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, c AS (SELECT program, {CELLS_SQL} FROM predictions GROUP BY program) SELECT program, {rates_sql('TP', 'FP', 'FN')}, {TOTALS_SQL} FROM c")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(predictions(spark, sf_dir), ("program",))


@query("eval_folds_and_overall", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, c AS (SELECT CAST(fold AS varchar) AS fold, {CELLS_SQL} FROM predictions GROUP BY 1 UNION ALL SELECT 'overall', {CELLS_SQL} FROM predictions) SELECT fold, {rates_sql('TP', 'FP', 'FN')}, {TOTALS_SQL} FROM c")
def eval_folds_and_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.folds_and_overall(predictions(spark, sf_dir))


GT_SQL = """count(*) FILTER (true_label = -1 AND ground_truth = 1 AND predicted_label = 1) AS gt_TP, count(*) FILTER (true_label = -1 AND ground_truth = 0 AND predicted_label = 0) AS gt_TN,
  count(*) FILTER (true_label = -1 AND ground_truth = 0 AND predicted_label = 1) AS gt_FP, count(*) FILTER (true_label = -1 AND ground_truth = 1 AND predicted_label = 0) AS gt_FN"""
UNK_SQL = """count(*) FILTER (true_label = -1 AND ground_truth IS NULL AND predicted_label = 1) AS unk_labeled_true, count(*) FILTER (true_label = -1 AND ground_truth IS NULL AND predicted_label = 0) AS unk_labeled_false"""
FULL_SQL = f"TP, TN, FP, FN, gt_TP, gt_TN, gt_FP, gt_FN, unk_labeled_true, unk_labeled_false, {rates_sql('TP', 'FP', 'FN')}, {rates_sql('gt_TP', 'gt_FP', 'gt_FN', 'gt_')}"


@query("eval_full", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, c AS (SELECT program, {CELLS_SQL}, {GT_SQL}, {UNK_SQL} FROM predictions GROUP BY program) SELECT program, {FULL_SQL} FROM c")
def eval_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.full_evaluation(predictions(spark, sf_dir), ("program",))


SET_SQL = f"""kept AS (SELECT DISTINCT {K} FROM predictions WHERE predicted_label = 1),
  sides AS (SELECT {K}, max(a) AS a, max(b) AS b FROM (SELECT {K}, 1 AS a, 0 AS b FROM kept UNION ALL SELECT {K}, 0, 1 FROM true_edges) GROUP BY {K})"""
SIDE_SQL = "count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 1 AND b = 0) AS fp, count(*) FILTER (a = 0 AND b = 1) AS fn"


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).filter("predicted_label = 1")


@query("eval_set_scores", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, {SET_SQL}, c AS (SELECT program, {SIDE_SQL} FROM sides GROUP BY program) SELECT program, tp, fp, fn, {rates_sql('tp', 'fp', 'fn', digits=9)} FROM c")
def eval_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluate.set_scores(_kept(spark, sf_dir), true_edges(spark, sf_dir))
    return scores.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("eval_pooled_scores", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, {SET_SQL}, c AS (SELECT {SIDE_SQL} FROM sides) SELECT tp, fp, fn, {rates_sql('tp', 'fp', 'fn', digits=9)} FROM c")
def eval_pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluate.set_scores(_kept(spark, sf_dir), true_edges(spark, sf_dir), ())
    return scores.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


GRAPH_SQL = f"""graph_sides AS (SELECT tool, config_id, {K}, max(a) AS a, max(b) AS b FROM (
    SELECT DISTINCT tool, config_id, {K}, 1 AS a, 0 AS b FROM predictions WHERE predicted_label = 1
    UNION ALL SELECT c.tool, c.config_id, t.program, t.method, t."offset", t.target, 0, 1 FROM (SELECT DISTINCT tool, config_id, program FROM predictions) c JOIN true_edges t USING (program)) GROUP BY tool, config_id, {K}),
  graph_cells AS (SELECT tool, config_id, program, {SIDE_SQL} FROM graph_sides GROUP BY ALL),
  graph_rates AS (SELECT tool, config_id, program, {rates_sql('tp', 'fp', 'fn', digits=None)} FROM graph_cells),
  graph AS (SELECT tool, config_id, round(avg(precision), 2) AS precision, round(avg(recall), 2) AS recall, round(avg(f1), 2) AS f1 FROM graph_rates GROUP BY tool, config_id)"""


@query("eval_kept_graph", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, {GRAPH_SQL} SELECT * FROM graph")
def eval_kept_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.kept_graph_scores(predictions(spark, sf_dir), true_edges(spark, sf_dir))


@query(
    "eval_per_config",
    f"""WITH {EDGE_SQL}, {PREDICTION_SQL}, {GRAPH_SQL}, c AS (SELECT tool, config_id, {CELLS_SQL}, {GT_SQL}, {UNK_SQL} FROM predictions GROUP BY tool, config_id)
    SELECT f.*, g.precision AS graph_precision, g.recall AS graph_recall, g.f1 AS graph_f1 FROM (SELECT tool, config_id, {FULL_SQL} FROM c) f JOIN graph g USING (tool, config_id)""",
)
def eval_per_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_config_evaluation(predictions(spark, sf_dir), true_edges(spark, sf_dir))


HAND_SQL = f"hand AS (SELECT {K}, max(CASE WHEN row_order % 13 = 0 THEN 1 ELSE 0 END) AS label FROM raw_edges WHERE row_order % 13 < 2 GROUP BY {K})"


def hand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = raw_edges(spark, sf_dir).filter("row_order % 13 < 2")
    return given.groupBy("program", "method", "offset", "target").agg(F.max((F.col("row_order") % 13 == 0).cast("int")).alias("label"))


def _half_sql(name: str, found: str, truth: str) -> str:
    return f"""{name}_sides AS (SELECT tool, config_id, {K}, max(a) AS a, max(b) AS b FROM (SELECT tool, config_id, {K}, 1 AS a, 0 AS b FROM {found}
      UNION ALL SELECT c.tool, c.config_id, t.program, t.method, t."offset", t.target, 0, 1 FROM (SELECT DISTINCT tool, config_id, program FROM labelled) c JOIN {truth} t USING (program)) GROUP BY tool, config_id, {K}),
  {name}_cells AS (SELECT tool, config_id, program, {SIDE_SQL} FROM {name}_sides GROUP BY ALL),
  {name}_rates AS (SELECT tool, config_id, program, {rates_sql('tp', 'fp', 'fn', digits=None)} FROM {name}_cells),
  {name} AS (SELECT tool, config_id, round(avg(precision), 2) AS {name}_precision, round(avg(recall), 2) AS {name}_recall, round(avg(f1), 2) AS {name}_f1 FROM {name}_rates GROUP BY tool, config_id)"""


@query("eval_baseline", f"WITH {EDGE_SQL}, {HAND_SQL}, {_half_sql('auto', '(SELECT * FROM labelled WHERE is_true OR is_false)', 'true_edges')}, {_half_sql('manual', f'(SELECT * FROM labelled SEMI JOIN hand USING ({K}))', '(SELECT * FROM hand WHERE label = 1)')} SELECT * FROM auto LEFT JOIN manual USING (tool, config_id)")
def eval_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.baseline_metrics(labelled(spark, sf_dir), true_edges(spark, sf_dir), hand_labels(spark, sf_dir))


@query("eval_roll_up", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, c AS (SELECT program, {CELLS_SQL} FROM predictions GROUP BY program), m AS (SELECT {rates_sql('TP', 'FP', 'FN')}, TP, TN FROM c) SELECT round(avg(precision), 2) AS precision, round(avg(recall), 2) AS recall, sum(TP)::BIGINT AS TP, sum(TN)::BIGINT AS TN FROM m")
def eval_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roll_up_metrics(evaluate.confusion(predictions(spark, sf_dir), ("program",)), ["precision", "recall"], ["TP", "TN"])


BUCKET_SQL = "CASE WHEN true_label = 1 AND predicted_label = 0 THEN 'FN' WHEN true_label = 0 AND predicted_label = 1 THEN 'FP' WHEN true_label = 1 AND predicted_label = 1 THEN 'TP' WHEN true_label = 0 AND predicted_label = 0 THEN 'TN' END"


@query("eval_error_buckets", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, b AS (SELECT {K}, config_id, confidence, {BUCKET_SQL} AS bucket FROM predictions), s AS (SELECT {K}, config_id, bucket, CASE WHEN bucket IN ('FN', 'TN') THEN confidence ELSE -confidence END AS sort_key FROM b WHERE bucket IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY program, bucket ORDER BY sort_key, method, \"offset\", target, config_id) AS place FROM s")
def eval_error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["method", "offset", "target", "config_id"]
    return evaluate.error_buckets(predictions(spark, sf_dir), key=key).select("program", *key, "bucket", "sort_key", "place")


@query("eval_confidence_by_error", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, b AS (SELECT program, confidence, {BUCKET_SQL} AS error_type FROM predictions) SELECT program, error_type, count(*) AS n, quantile_cont(confidence, 0.25) AS q1, quantile_cont(confidence, 0.5) AS median, quantile_cont(confidence, 0.75) AS q3 FROM b WHERE error_type IN ('FN', 'FP') GROUP BY ALL")
def eval_confidence_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = evaluate.error_buckets(predictions(spark, sf_dir)).withColumnRenamed("bucket", "error_type").filter("error_type in ('FN', 'FP')")
    return evaluate.confidence_by_error(wrong, ("program",))


@query("eval_confidence_counts", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, b AS (SELECT program, confidence, {BUCKET_SQL} AS error_type FROM predictions), c AS (SELECT program, error_type, confidence, count(*) AS n FROM b WHERE error_type IN ('FN', 'FP') GROUP BY ALL) SELECT *, coalesce(sum(n) OVER (PARTITION BY program, error_type ORDER BY confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c")
def eval_confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole distribution of confidence of each kind of error: every value with its count and that of all smaller ones."""
    wrong = evaluate.error_buckets(predictions(spark, sf_dir)).withColumnRenamed("bucket", "error_type").filter("error_type in ('FN', 'FP')")
    return ranks.value_counts(wrong, "confidence", ["program", "error_type"])


@query("eval_confidence_sketched", f"WITH {EDGE_SQL}, {PREDICTION_SQL}, b AS (SELECT program, {BUCKET_SQL} AS error_type FROM predictions) SELECT program, error_type, count(*) AS n, true AS q1_near, true AS median_near, true AS q3_near FROM b WHERE error_type IN ('FN', 'FP') GROUP BY ALL")
def eval_confidence_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles from sketches of each configuration that are merged by program, and whether the exact ranks of each lie within 2 % of what was asked for."""
    wrong = durable(evaluate.error_buckets(predictions(spark, sf_dir)).withColumnRenamed("bucket", "error_type").filter("error_type in ('FN', 'FP')"), "wrong")
    shares, by = {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["program", "error_type"]
    found = ranks.sketched_quantiles(evaluate.confidence_sketches(wrong, ("program", "config_id")), shares, by)
    counts = ranks.value_counts(wrong, "confidence", by).join(found.withColumnRenamed("n", "all"), by)
    low = lambda name: F.max(F.when(F.col("confidence") == F.col(name), F.col("before"))) / F.col("all")
    high = lambda name: F.max(F.when(F.col("confidence") == F.col(name), F.col("before") + F.col("n"))) / F.col("all")
    near = [((low(name) <= share + 0.02) & (high(name) >= share - 0.02)).alias(f"{name}_near") for name, share in shares.items()]
    return counts.groupBy(*by, "all").agg(*near).withColumnRenamed("all", "n")


@query(
    "eval_leader_board",
    f"""WITH {EDGE_SQL}, {PREDICTION_SQL}, c AS (SELECT config_id || '-' || fold AS file_name, {CELLS_SQL}, {GT_SQL}, {UNK_SQL} FROM predictions GROUP BY 1), m AS (SELECT file_name, {FULL_SQL} FROM c)
    SELECT file_name, f1, gt_f1, round(0.2 * f1 + 0.6 * gt_f1 + gt_TP + 0.2 * TN + 4 * gt_TN, 6) AS score FROM m WHERE gt_f1 > 0.5 ORDER BY score DESC, file_name LIMIT 20""",
)
def eval_leader_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = predictions(spark, sf_dir).withColumn("file_name", F.concat_ws("-", "config_id", F.col("fold").cast("string")))
    board = evaluate.leader_board(evaluate.full_evaluation(named, ("file_name",)), least_gt_f1=0.5)
    return board.select("file_name", "f1", "gt_f1", F.round("score", 6).alias("score"))


@query("eval_cluster_composition", f"WITH {EDGE_SQL}, {PREDICTION_SQL} SELECT fold AS cluster_id, count(*) FILTER (true_label = 1) AS true_edges, count(*) FILTER (true_label = 0) AS false_edges, count(*) FILTER (true_label = -1) AS unknown_edges FROM predictions GROUP BY fold")
def eval_cluster_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cluster_composition(predictions(spark, sf_dir).withColumnRenamed("fold", "cluster_id"), label="true_label")


@query("eval_attach_ground_truth", f"WITH {EDGE_SQL}, {HAND_SQL} SELECT l.program, l.tool, l.config_id, l.method, l.\"offset\", l.target, CASE WHEN NOT is_true AND NOT is_false THEN h.label END AS ground_truth FROM labelled l LEFT JOIN hand h USING ({K})")
def eval_attach_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.attach_ground_truth(labelled(spark, sf_dir), hand_labels(spark, sf_dir)).select("program", "tool", "config_id", "method", "offset", "target", "ground_truth")
