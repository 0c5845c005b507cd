"""Scores of predictions and of kept edge sets: all of them conditional sums, for any grouping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.ranks import ordered_rank, quantile_sketches, quantiles
from edgeloom.operators.sets import PROGRAM_KEY, flagged_union
from edgeloom.storage import durable


def ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 where the denominator is."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return precision, recall, ratio(2 * precision * recall, precision + recall)


def set_scores(found: DataFrame, truth: DataFrame, by: Sequence[str] = ("program",), key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Precision, recall and F1 of one edge set against another, by group or (empty ``by``) pooled."""
    both = flagged_union({"found": found, "truth": truth}, [*key, *[b for b in by if b not in key]])
    counts = both.groupBy(*by).agg(F.count_if((F.col("found") == 1) & (F.col("truth") == 1)).alias("tp"), F.count_if((F.col("found") == 1) & (F.col("truth") == 0)).alias("fp"), F.count_if((F.col("found") == 0) & (F.col("truth") == 1)).alias("fn"))
    precision, recall, f1 = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*by, "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def mean_over_programs(scores: DataFrame, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Mean of the rates over programs, rounded."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(c), digits).alias(c) for c in ("precision", "recall", "f1")])


def _config_cells(rows: DataFrame, halves: dict[str, tuple[Column, str]], sides: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    """Per set and program of ``rows``, for each half ``name``: ``name_tp``, ``name_fp``, ``name_fn`` and ``name_any``, whether either side has an edge.

    A half is what of ``rows`` was found (a condition, which may use the 0/1 columns of
    ``sides``) and the side that it is held against, with all edges of the program.
    Truth edges aren't repeated for each set that must find them: those found are counted
    by a join on the whole key, those missed are the rest of the program's number. A null
    program has no truth edges; other nulls of a key are equal.
    """
    marks = flagged_union(sides, PROGRAM_KEY)
    own = [c for c in by if c != "program"]
    named = marks.select(*[F.col(c).alias(f"_of_{c}") for c in PROGRAM_KEY], *sides)
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in PROGRAM_KEY])
    joined = rows.join(named, on, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in sides})
    hit = lambda found, side: found & (F.col(side) == 1) & F.col("program").isNotNull()
    counts = joined.groupBy(*own, "program").agg(*[x for n, (found, side) in halves.items() for x in (F.count_if(found).alias(f"{n}_found"), F.count_if(hit(found, side)).alias(f"{n}_tp"))])
    sizes = marks.groupBy(F.col("program").alias("_of")).agg(*[F.sum(side).alias(f"{n}_true") for n, (_, side) in halves.items()])
    both = counts.join(sizes, F.col("program") == F.col("_of"), "left")  # a row for each set and program
    true = lambda n: F.coalesce(F.col(f"{n}_true"), F.lit(0))
    cells = [x for n in halves for x in (F.col(f"{n}_tp"), (F.col(f"{n}_found") - F.col(f"{n}_tp")).alias(f"{n}_fp"), (true(n) - F.col(f"{n}_tp")).alias(f"{n}_fn"), (F.col(f"{n}_found") + true(n) > 0).alias(f"{n}_any"))]
    return both.select(*own, "program", *cells)


def _config_rates(cells: DataFrame, names: Sequence[str], by: Sequence[str], micro: bool = False) -> DataFrame:
    """Rates of each half by set at 2 decimals: the mean over the programs that have any edge in it, or (``micro``) from sums over them."""
    if micro:
        cells = cells.groupBy(*by).agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for n in names for c, f in (("tp", F.sum), ("fp", F.sum), ("fn", F.sum), ("any", F.bool_or))])
    means = [F.round(F.avg(F.when(F.col(f"{n}_any"), x)), 2).alias(f"{n}_{c}") for n in names for c, x in zip(("precision", "recall", "f1"), rates(*[F.col(f"{n}_{c}") for c in ("tp", "fp", "fn")]), strict=True)]
    return cells.groupBy(*by).agg(*means).filter(F.col(f"{names[0]}_f1").isNotNull())


def baseline_metrics(labelled: DataFrame, truth: DataFrame, manual: DataFrame, micro: bool = False, by: Sequence[str] = ("tool", "config_id")) -> DataFrame:
    """Scores of unpruned sets: known edges against the truth set, and hand-labelled edges against those found true.

    ``labelled``: the edges of each configuration with flags. Known edges are those in
    some truth set; every configuration is held against its programs' truth edges. The
    mean is over programs unless ``micro``. A program without hand labels counts only in
    the automatic half.
    """
    known = F.coalesce(F.col("is_true") | F.col("is_false"), F.lit(False)).cast("int")
    edges = labelled.groupBy(*by, *[c for c in PROGRAM_KEY if c not in by]).agg(F.max(known).alias("_known"))
    halves = {"auto": (F.col("_known") == 1, "_truth"), "manual": (F.col("_given") == 1, "_hand")}
    cells = _config_cells(edges, halves, {"_truth": truth, "_given": manual, "_hand": manual.filter("label = 1")}, by)
    return _config_rates(cells, list(halves), by, micro)


def confusion(predictions: DataFrame, by: Sequence[str] = (), truth: str = "true_label", predicted: str = "predicted_label", prefix: str = "") -> DataFrame:
    """Precision, recall and F1 at 4 decimals, the four counts, and totals of true and false."""
    t, p = F.col(truth), F.col(predicted)
    counts = predictions.groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).alias("TP"), F.count_if((t == 0) & (p == 0)).alias("TN"), F.count_if((t == 0) & (p == 1)).alias("FP"), F.count_if((t == 1) & (p == 0)).alias("FN")
    )
    precision, recall, f1 = rates(F.col("TP"), F.col("FP"), F.col("FN"))
    named = {"precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(f1, 4), "TP": F.col("TP"), "TN": F.col("TN"), "FP": F.col("FP"), "FN": F.col("FN"), "total_true": F.col("TP") + F.col("FN"), "total_false": F.col("TN") + F.col("FP")}
    return counts.select(*by, *[c.alias(prefix + n) for n, c in named.items()])


def full_evaluation(predictions: DataFrame, by: Sequence[str] = (), count_gt_as_unknown: bool = False) -> DataFrame:
    """Scores on known rows, on hand-labelled unknown rows (``gt_``), and how unknown rows were predicted, in one pass.

    Columns read: ``true_label`` (1, 0, -1 unknown), ``ground_truth`` (1, 0 or null),
    ``predicted_label``. ``count_gt_as_unknown``: hand-labelled rows also count among the
    unknown.
    """
    t, g, p = F.col("true_label"), F.col("ground_truth"), F.col("predicted_label")
    unknown = t == -1
    plain = unknown if count_gt_as_unknown else unknown & g.isNull()
    cells = {"TP": (t == 1) & (p == 1), "TN": (t == 0) & (p == 0), "FP": (t == 0) & (p == 1), "FN": (t == 1) & (p == 0)}
    cells |= {"gt_TP": unknown & (g == 1) & (p == 1), "gt_TN": unknown & (g == 0) & (p == 0), "gt_FP": unknown & (g == 0) & (p == 1), "gt_FN": unknown & (g == 1) & (p == 0)}
    cells |= {"unk_labeled_true": plain & (p == 1), "unk_labeled_false": plain & (p == 0)}
    counts = predictions.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    for pre in ("", "gt_"):
        three = rates(F.col(pre + "TP"), F.col(pre + "FP"), F.col(pre + "FN"))
        counts = counts.withColumns({pre + n: F.round(c, 4) for n, c in zip(("precision", "recall", "f1"), three, strict=True)})
    return counts


def folds_and_overall(predictions: DataFrame, fold: str = "fold") -> DataFrame:
    """Confusion metrics per fold and over all rows ("overall")."""
    per_fold = confusion(predictions, (fold,)).withColumn(fold, F.col(fold).cast("string"))
    return per_fold.unionByName(confusion(predictions).withColumn(fold, F.lit("overall")))


def kept_graph_scores(predictions: DataFrame, truth: DataFrame, by: Sequence[str] = ("tool", "config_id")) -> DataFrame:
    """Edges predicted true against all truth edges of the programs, mean over programs."""
    kept = F.coalesce(F.col("predicted_label") == 1, F.lit(False)).cast("int")
    edges = predictions.groupBy(*by, *[c for c in PROGRAM_KEY if c not in by]).agg(F.max(kept).alias("_kept"))
    cells = _config_cells(edges, {"graph": (F.col("_kept") == 1, "_truth")}, {"_truth": truth}, by)
    return _config_rates(cells, ["graph"], by).select(*by, *[F.col(f"graph_{c}").alias(c) for c in ("precision", "recall", "f1")])


def per_config_evaluation(predictions: DataFrame, truth: DataFrame, by: Sequence[str] = ("tool", "config_id")) -> DataFrame:
    """All scores of each configuration in one row: predictions, hand-labelled rows, and the kept graph."""
    predictions = durable(predictions.select(*dict.fromkeys([*by, *PROGRAM_KEY, "true_label", "ground_truth", "predicted_label"])), "predictions")  # without vectors
    graph = kept_graph_scores(predictions, truth, by)
    return full_evaluation(predictions, by).join(graph.select(*by, *[F.col(c).alias(f"graph_{c}") for c in ("precision", "recall", "f1")]), list(by))


def roll_up_metrics(metrics: DataFrame, means: Sequence[str], sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean of rates at 2 decimals and sums of counts over metric rows."""
    return metrics.groupBy(*by).agg(*[F.round(F.avg(c), 2).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])


def error_buckets(predictions: DataFrame, by: Sequence[str] = ("program",), truth: str = "true_label", predicted: str = "predicted_label", confidence: str = "confidence", key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """``bucket``, ``sort_key`` and ``place``: FN by rising, FP by falling, TP by falling, TN by rising confidence within each group and bucket; ties by the key."""
    bucket = F.when((F.col(truth) == 1) & (F.col(predicted) == 0), "FN").when((F.col(truth) == 0) & (F.col(predicted) == 1), "FP").when((F.col(truth) == 1) & (F.col(predicted) == 1), "TP").when((F.col(truth) == 0) & (F.col(predicted) == 0), "TN")
    signed = F.when(F.col("bucket").isin("FN", "TN"), F.col(confidence)).otherwise(-F.col(confidence))
    named = predictions.withColumn("bucket", bucket).filter("bucket is not null").withColumn("sort_key", signed)
    return ordered_rank(named, [*by, "bucket"], [F.col("sort_key"), *[F.col(c) for c in key if c not in by]])


def confidence_by_error(predictions: DataFrame, by: Sequence[str], error: str = "error_type", confidence: str = "confidence") -> DataFrame:
    """Count and quartiles of the confidence of each kind of error, exact; nulls don't count."""
    return quantiles(predictions, confidence, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [*by, error])


def confidence_sketches(predictions: DataFrame, by: Sequence[str], error: str = "error_type", confidence: str = "confidence") -> DataFrame:
    """A mergeable sketch of the confidence of each kind of error, for ``ranks.sketched_quantiles``."""
    return quantile_sketches(predictions, confidence, [*by, error])


def leader_board(metrics: DataFrame, least_gt_f1: float = 0.7, n: int = 20, name: str = "file_name") -> DataFrame:
    """Best runs by weighted score: .2 f1 + .6 gt_f1 + gt_TP + .2 TN + 4 gt_TN; ties by name."""
    score = 0.2 * F.col("f1") + 0.6 * F.col("gt_f1") + F.col("gt_TP") + 0.2 * F.col("TN") + 4 * F.col("gt_TN")
    return metrics.filter(F.col("gt_f1") > least_gt_f1).withColumn("score", score).orderBy(F.desc("score"), name).limit(n)


def cluster_composition(clustered: DataFrame, cluster: str = "cluster_id", label: str = "label") -> DataFrame:
    """True, false and unknown members of each cluster."""
    return clustered.groupBy(cluster).agg(*[F.count_if(F.col(label) == v).alias(n) for n, v in (("true_edges", 1), ("false_edges", 0), ("unknown_edges", -1))])


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts each task's rows to n before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def attach_ground_truth(labelled: DataFrame, manual: DataFrame, key: Sequence[str] = PROGRAM_KEY, label: str = "label") -> DataFrame:
    """``ground_truth``: the hand label of edges that no truth set decides, null for all others."""
    given = manual.select(*key, F.col(label).alias("_hand")).dropDuplicates(list(key))
    unknown = ~F.col("is_true") & ~F.col("is_false")
    return labelled.join(given, list(key), "left").withColumn("ground_truth", F.when(unknown, F.col("_hand"))).drop("_hand")
