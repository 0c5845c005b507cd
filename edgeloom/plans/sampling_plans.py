"""Queries of samples, splits and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import sampling, sets
from edgeloom.plans.registry import query
from edgeloom.plans.set_plans import MEMBER_SQL, three_configs
from edgeloom.plans.views import EDGE_SQL, false_edges, total_edges, true_edges

K = 'program, method, "offset", target'
KEY = sets.PROGRAM_KEY


def hashed(seed: int = 42, key: str = K) -> str:
    return f"md5(concat_ws('|', {', '.join(f'CAST({c.strip()} AS varchar)' for c in key.split(','))}, '{seed}'))"


def ranked(table: str, seed: int = 42, by: str = "") -> str:
    return f"(SELECT *, row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY {hashed(seed)}) AS rank FROM {table})"


def number(seed: int = 42, key: str = K) -> str:
    return f"CAST('0x' || substr({hashed(seed, key)}, 1, 15) AS bigint)"


@query("sample_exact", f"WITH {EDGE_SQL} SELECT {K}, rank FROM {ranked('true_edges')} WHERE rank <= 350")
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_exact(true_edges(spark, sf_dir), 350)


@query("sample_batches", f"WITH {EDGE_SQL} SELECT {K}, rank, ((rank - 1) // 50 + 3)::INT AS batch FROM {ranked('true_edges')} WHERE rank <= 350")
def sample_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batches(sampling.sample_exact(true_edges(spark, sf_dir), 350), first=3)


REST_SQL = f"first AS (SELECT {K} FROM {ranked('true_edges')} WHERE rank <= 350), rest AS (SELECT {K} FROM true_edges ANTI JOIN first USING ({K}))"


@query("sample_excluding", f"WITH {EDGE_SQL}, {REST_SQL} SELECT {K}, rank, '' AS label FROM {ranked('rest')} WHERE rank <= 400")
def sample_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = true_edges(spark, sf_dir)
    return sampling.sample_excluding(edges, sampling.sample_exact(edges, 350))


STRATA_SQL = f"{MEMBER_SQL}, strata AS (SELECT {K}, CASE WHEN n = total THEN 'intersection' ELSE 'disagreement' END AS source_category FROM per JOIN tot USING (program))"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sets.membership(three_configs(spark, sf_dir))
    return found.select(*KEY, F.when(F.col("n") == F.col("of"), "intersection").otherwise("disagreement").alias("source_category"))


OLD_SQL = f"old AS (SELECT {K}, source_category FROM {ranked('strata', by='source_category')} WHERE rank <= CASE source_category WHEN 'intersection' THEN 150 ELSE 151 END)"


@query("sample_stratified", f"WITH {EDGE_SQL}, {STRATA_SQL} SELECT {K}, source_category, rank FROM {ranked('strata', by='source_category')} WHERE rank <= CASE source_category WHEN 'intersection' THEN 150 ELSE 151 END")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(strata(spark, sf_dir), 301)


LATER_SQL = "later AS (SELECT * FROM strata WHERE NOT (program = 'A' AND \"offset\" IN (1, 3)))"


@query(
    "sample_refresh",
    f"""WITH {EDGE_SQL}, {STRATA_SQL}, {OLD_SQL}, {LATER_SQL},
    gone AS (SELECT {K}, source_category FROM old ANTI JOIN later USING ({K}, source_category)),
    free AS (SELECT {K}, source_category FROM later ANTI JOIN old USING ({K})),
    g AS {ranked('gone', by='source_category')}, f AS {ranked('free', by='source_category')}
    SELECT {K}, source_category, 'kept' AS status FROM old SEMI JOIN later USING ({K}, source_category)
    UNION ALL SELECT coalesce(f.program, g.program), coalesce(f.method, g.method), coalesce(f."offset", g."offset"), coalesce(f.target, g.target), g.source_category,
      CASE WHEN f.program IS NULL THEN 'unmatched' ELSE 'replaced' END FROM g LEFT JOIN f ON f.source_category = g.source_category AND f.rank = g.rank""",
)
def sample_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = strata(spark, sf_dir)
    old = sampling.stratified_sample(now, 301).drop("rank")
    return sampling.refresh_sample(old, now.filter("not (program = 'A' and offset in (1, 3))"))


@query("sample_audit", f"WITH {EDGE_SQL}, first AS (SELECT {K} FROM {ranked('true_edges')} WHERE rank <= 350) SELECT {K} FROM first ANTI JOIN false_edges USING ({K})")
def sample_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.audit_sample(sampling.sample_exact(true_edges(spark, sf_dir), 350).drop("rank"), false_edges(spark, sf_dir))


CLASS_SQL = f"classed AS (SELECT {K}, 1 AS label FROM true_edges ANTI JOIN false_edges USING ({K}) UNION ALL SELECT {K}, 0 FROM false_edges), n AS (SELECT count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros FROM classed)"


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    true, false = true_edges(spark, sf_dir), false_edges(spark, sf_dir)
    return sets.keep_out(true, false).withColumn("label", F.lit(1)).unionByName(false.withColumn("label", F.lit(0)))


@query("balance_undersample", f"WITH {EDGE_SQL}, {CLASS_SQL} SELECT {K}, label FROM {ranked('classed', by='label')}, n WHERE label <> (CASE WHEN ones > zeros THEN 1 ELSE 0 END) OR rank <= least(floor(least(ones, zeros) / 0.9), greatest(ones, zeros))")
def balance_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(classed(spark, sf_dir), "label", 0.9, KEY)


@query(
    "balance_oversample",
    f"""WITH {EDGE_SQL}, {CLASS_SQL}, m AS (SELECT CASE WHEN ones > zeros THEN 0 ELSE 1 END AS minor, least(ones, zeros) AS size, greatest(floor(greatest(ones, zeros) * 1.0), least(ones, zeros))::BIGINT AS draws FROM n),
    d AS (SELECT range AS draw, CAST('0x' || substr(md5(concat_ws('|', CAST(range AS varchar), '42')), 1, 15) AS bigint) % (SELECT size FROM m) + 1 AS slot FROM range((SELECT draws FROM m)))
    SELECT {K}, label, draw FROM {ranked('(SELECT * FROM classed WHERE label = (SELECT minor FROM m))')} r JOIN d ON r.rank = d.slot
    UNION ALL SELECT {K}, label, NULL FROM classed WHERE label <> (SELECT minor FROM m)""",
)
def balance_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.oversample(classed(spark, sf_dir), "label", 1.0, KEY)


UNKNOWN_SQL = f"""{CLASS_SQL}, pool AS (SELECT {K}, label, false AS manual FROM classed
  UNION ALL SELECT {K}, -1, {hashed(7)} < '1' FROM (SELECT DISTINCT {K} FROM labelled WHERE NOT is_true AND NOT is_false))"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known edges with their class and unknown ones, a sixteenth of which is labelled by hand."""
    known = classed(spark, sf_dir)
    unknown = sets.keep_out(total_edges(spark, sf_dir).select(*KEY).distinct(), sets.union_edges(true_edges(spark, sf_dir), false_edges(spark, sf_dir)))
    return known.withColumn("manual", F.lit(False)).unionByName(unknown.withColumn("label", F.lit(-1)).withColumn("manual", sampling.order_hash(KEY, 7) < "1"))


@query(
    "split_k_fold",
    f"""WITH {EDGE_SQL}, {UNKNOWN_SQL}, f AS (SELECT *, {number()} % 5 AS own FROM pool), x AS (SELECT f.*, range::INT AS fold FROM f, range(5))
    SELECT {K}, label, manual, fold, CASE WHEN own = fold OR (label = -1 AND manual) THEN 'test' ELSE 'train' END AS role FROM x WHERE own = fold OR (label = -1 AND manual) OR label <> -1""",
)
def split_k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.k_fold(pool(spark, sf_dir))


@query(
    "split_by_program",
    f"""WITH {EDGE_SQL}, {UNKNOWN_SQL}, p AS (SELECT program, (row_number() OVER (ORDER BY {hashed(42, 'program')}) - 1) % 3 AS own FROM (SELECT DISTINCT program FROM pool)),
    x AS (SELECT pool.*, range::INT AS fold, own FROM pool JOIN p USING (program), range(3))
    SELECT {K}, label, manual, fold, CASE WHEN own = fold THEN 'test' ELSE 'train' END AS role FROM x WHERE own = fold OR label <> -1""",
)
def split_by_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_by_program(pool(spark, sf_dir))


@query("split_by_list", f"WITH {EDGE_SQL} SELECT {K}, CASE WHEN program = 'R' THEN 'test' ELSE 'train' END AS role FROM true_edges")
def split_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_by_list(true_edges(spark, sf_dir), ["R"])


@query("split_seed", f"WITH {EDGE_SQL}, {CLASS_SQL} SELECT {K}, label, rank > ceil(count(*) OVER (PARTITION BY label) / 2) AS is_seed FROM {ranked('classed', by='label')}")
def split_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seed_split(classed(spark, sf_dir))


@query("sample_half_hold_out", f"WITH {EDGE_SQL}, {CLASS_SQL} SELECT {K}, label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS size FROM {ranked('classed', by='label')}) WHERE label <> 1 OR rank <= ceil(size / 2)")
def sample_half_hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.half_hold_out(classed(spark, sf_dir))
