"""Mix sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import WORD_PATTERN, documents, durable, others, own_names, quoted

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = 42
#: Hex digits of the order hash that make a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key without nulls that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source_size`` and ``target``.

    ``source`` holds no nulls (see ``source_key``). Sources in code-point order get ``weights`` in turn and share
    ``budget`` times all sizes. Water-filling: a level is the words given per unit of
    weight. Sources that the level would lift over ``max_epochs`` times their size are
    clamped there and the level is taken anew from what is left, until none is above.
    The level only rises, so a source once clamped stays so, and a round is one sum
    over the table of sources; only scalars reach the driver.
    """
    per_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy("source")) - 1  # one row per source, not per document
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    filled = durable(per_source.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")), "mix-sources")
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        left = filled.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, F.col("cap"))).alias("clamped"),
            F.sum(F.when(~above, F.col("weight"))).alias("free"),
        ).first()
        if not left["free"]:
            break
        raised = (budget * left["total"] - (left["clamped"] or 0.0)) / left["free"]
        if raised <= level:
            break
        level = raised
    return filled.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(rows: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``taken`` (words that the mix takes).

    Every document is taken as often as its whole source fits into the target; the rest
    of the target goes once more through the source in the order of a seeded hash of the
    ids, and the document at which it ends is taken in part. A source's taken words are
    therefore its target rounded down, and reruns agree.

    The order is never made in one task: hash buckets of a source are summed first,
    their running sums (4,096 a source at most) place each bucket, and only the rows of
    one bucket are sorted together, so a source with a third of all rows is dealt over
    all tasks.

    Nulls: a null source is a source of its own, last in order; a null id hashes as
    empty; a null size counts as 0. Repeated rows are separate documents; rows of one id
    and size follow a hash of their other columns. An empty table gives an empty table.
    Input columns named like the added ones, in whatever case, are replaced.
    """
    added = ("source_size", "target", "taken")
    kept = others(rows.columns, added)
    n, key, own, bucket, tie, start, whole, rest, before = own_names(rows, "_mix_n", "_mix_key", "_mix_source", "_mix_bucket", "_mix_tie", "_mix_start", "_mix_whole", "_mix_rest", "_mix_before")
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    plain = [F.col(quoted(c)) for c in kept]
    keyed = rows.select(*plain, F.coalesce(F.col(size), F.lit(0)).cast("long").alias(n), hashed.alias(key), source_key(F.col(source)).alias(own), F.xxhash64(*plain).alias(tie))
    keyed = keyed.withColumn(bucket, F.substring(key, 1, BUCKET_DIGITS))
    goals = source_targets(keyed, own, n, weights, budget, max_epochs)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))

    buckets = keyed.groupBy(own, bucket).agg(F.sum(n).alias("bucket_size"))
    earlier = Window.partitionBy(own).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    placed = buckets.join(goals, F.col(own) == F.col("source")).select(own, bucket, F.col("start").alias(start), "source_size", "target", F.col("whole").alias(whole), F.col("rest").alias(rest))
    at = Window.partitionBy(own, bucket).orderBy(key, n, tie).rowsBetween(Window.unboundedPreceding, -1)
    running = keyed.withColumn(before, F.coalesce(F.sum(n).over(at), F.lit(0)))
    joined = running.join(placed, [own, bucket])
    part = F.greatest(F.lit(0), F.least(F.col(n), F.col(rest) - F.col(start) - F.col(before)))
    return joined.select(*plain, "source_size", "target", (F.col(whole) * F.col(n) + part).cast("long").alias("taken"))


def repetitions(mixed: DataFrame, size: str, columns: Sequence[str]) -> DataFrame:
    """The documents of a mix, one row for each time they are taken.

    The document at which a target ends is taken once more if at least half of it is
    wanted. Documents without words are never taken.
    """
    times = F.when(F.col(size) > 0, F.round(F.col("taken") / F.col(size))).otherwise(F.lit(0)).cast("int")
    (turn,) = own_names(mixed, "_turn")
    return mixed.withColumn(turn, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).filter(times >= 1).select(*columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the production mix takes from each document of the whole table."""
    sizes = durable(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix_sources(sizes).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('42|', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         sum(size)::DOUBLE * 2.0::DOUBLE AS cap
  FROM docs GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i FROM src),
steps AS (
  SELECT i, (1.5::DOUBLE * (SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER before, 0)) / sum(w) OVER after AS level, cap, w
  FROM o WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lev AS (SELECT level FROM steps WHERE cap >= w * level ORDER BY i LIMIT 1),
goals AS (SELECT source, source_size, least(cap, w * (SELECT level FROM lev)) AS target FROM src),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goals),
run AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, floor(g.target)::BIGINT - g.whole * g.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM docs d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - earlier)))::BIGINT AS taken FROM run
"""
