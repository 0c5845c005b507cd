"""Exact, repeatable samples, batches and splits.

All of them rest on ``hash_rank``: rows in the order of a seeded hash of their key, with
ranks that no task computes alone. Sizes are exact, no row is drawn twice unless asked
for, and the result depends on key and seed only, never on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.sets import PROGRAM_KEY, keep_in, keep_out
from edgeloom.storage import durable

SEED = 42
#: Hex digits of the hash that make a bucket.
DIGITS = 4


def order_hash(key: Sequence[str], seed: int) -> Column:
    """md5 of the key's text and the seed; null counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key], F.lit(str(seed))).cast("binary"))


def hash_rank(df: DataFrame, key: Sequence[str], seed: int = SEED, by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """``df`` with its 1-based rank in hash order, within each stratum ``by``.

    Buckets of the hash are counted, their running sums (16 ** DIGITS a stratum) place
    each bucket, and only the rows of a bucket are sorted together.
    """
    hashed = df.withColumn("_h", order_hash(key, seed)).withColumn("_b", F.substring("_h", 1, DIGITS))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *[F.col(c) for c in key]))
    counts = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    stratum = [F.col(c) for c in by] or [F.lit(0)]
    before = Window.partitionBy(*stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = placed.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(by)], F.col("_b").alias("_pb"), "_before")
    on = F.col("_b") == F.col("_pb")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return hashed.withColumn("_in", inside).join(renamed, on).select(*df.columns, (F.col("_before") + F.col("_in")).alias(rank))


def sample_exact(df: DataFrame, n: int, key: Sequence[str] = PROGRAM_KEY, seed: int = SEED) -> DataFrame:
    """n rows, or all if there are fewer, with their ``rank``."""
    return hash_rank(df, key, seed).filter(F.col("rank") <= n)


def batches(sample: DataFrame, size: int = 50, first: int = 1, rank: str = "rank") -> DataFrame:
    """``sample`` with the number of the batch that its rank falls in."""
    return sample.withColumn("batch", (F.floor((F.col(rank) - 1) / size) + first).cast("int"))


def sample_excluding(df: DataFrame, earlier: DataFrame, n: int = 400, key: Sequence[str] = PROGRAM_KEY, seed: int = SEED) -> DataFrame:
    """n rows that no earlier batch has, with a blank label."""
    return sample_exact(keep_out(df, earlier, key), n, key, seed).withColumn("label", F.lit(""))


def stratified_sample(strata: DataFrame, budget: int, stratum: str = "source_category", first: str = "intersection", key: Sequence[str] = PROGRAM_KEY, seed: int = SEED) -> DataFrame:
    """Half of the budget (rounded down) from the first stratum, the rest from the other; what one can't fill isn't moved."""
    ranked = hash_rank(strata, key, seed, (stratum,))
    share = F.when(F.col(stratum) == first, F.lit(budget // 2)).otherwise(F.lit(budget - budget // 2))
    return ranked.filter(F.col("rank") <= share)


def refresh_sample(sample: DataFrame, strata: DataFrame, stratum: str = "source_category", key: Sequence[str] = PROGRAM_KEY, seed: int = SEED) -> DataFrame:
    """The sample with each row that has left its stratum replaced by an unused row of it.

    ``status``: kept, replaced (the new row) or unmatched (nothing was left to draw: the
    old row). Outdated rows and candidates of a stratum are ranked and joined rank to
    rank, so none is drawn twice. Both tables are read several times and so kept first.
    """
    by_stratum = [*key, stratum]
    sample, strata = durable(sample.select(*by_stratum), "refresh-sample"), durable(strata.select(*by_stratum), "refresh-strata")
    kept = keep_in(sample, strata, by_stratum).select(*by_stratum).withColumn("status", F.lit("kept"))
    outdated = hash_rank(keep_out(sample, strata, by_stratum).select(*by_stratum), key, seed, (stratum,))
    free = hash_rank(keep_out(strata, sample, key).select(*by_stratum), key, seed, (stratum,))
    fresh = free.select(F.col(stratum).alias("_s"), F.col("rank").alias("_r"), *[F.col(c).alias(f"_n_{c}") for c in key])
    drawn = outdated.join(fresh, (F.col(stratum) == F.col("_s")) & (F.col("rank") == F.col("_r")), "left")
    found = F.col("_r").isNotNull()
    replaced = drawn.select(*[F.when(found, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in key], stratum, F.when(found, "replaced").otherwise("unmatched").alias("status"))
    return kept.unionByName(replaced)


def audit_sample(sample: DataFrame, population: DataFrame, key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Sampled rows that aren't in the population."""
    return keep_out(sample, population, key)


def undersample(df: DataFrame, label: str, ratio: float, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """The majority class cut to min(int(minority / ratio), majority), without replacement; on a tie label 0 is the majority."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    both = sizes.agg(F.max(F.when(F.col(label) == 1, F.col("_size"))).alias("ones"), F.max(F.when(F.col(label) == 0, F.col("_size"))).alias("zeros"))
    ranked = hash_rank(df, key, seed, (label,)).crossJoin(F.broadcast(both))  # one row
    minority, majority = F.least("ones", "zeros"), F.greatest("ones", "zeros")
    is_major = F.when(F.col("ones") > F.col("zeros"), F.col(label) == 1).otherwise(F.col(label) == 0)
    keep = F.least(F.floor(minority / F.lit(ratio)), majority)
    return ranked.filter(~is_major | (F.col("rank") <= keep)).select(*df.columns)


def oversample(df: DataFrame, label: str, ratio: float, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """The minority class drawn with replacement to max(int(majority * ratio), minority) rows.

    Draw i takes the row whose rank is a hash of i, modulo the class size plus 1: a
    bootstrap even at the original size. ``draw`` numbers the draws, null for the majority.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    minor, n, major = (0, zeros, ones) if ones > zeros else (1, ones, zeros)
    rest = df.filter(F.col(label) != minor).withColumn("draw", F.lit(None).cast("long"))
    if not n:
        return rest
    draws = df.sparkSession.range(max(int(major * ratio), n)).select(F.col("id").alias("draw"))
    slot = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long") % n + 1
    minority = hash_rank(df.filter(F.col(label) == minor), key, seed)
    return minority.join(draws.withColumn("_slot", slot), F.col("rank") == F.col("_slot")).select(*df.columns, "draw").unionByName(rest)


def fold_of(key: Sequence[str], folds: int = 5, seed: int = SEED) -> Column:
    """Fold of a row by its hash."""
    return (F.conv(F.substring(order_hash(key, seed), 1, 15), 16, 10).cast("long") % folds).cast("int")


def k_fold(df: DataFrame, label: str = "label", manual: str = "manual", folds: int = 5, train_unknown: bool = False, key: Sequence[str] = PROGRAM_KEY, seed: int = SEED) -> DataFrame:
    """One row per fold and role: ``fold``, ``role`` (train or test).

    Known rows test in their fold and train in the others. Unknown rows (label -1) test in
    their fold, and in every fold if they are labelled by hand; they train only if asked.
    """
    own = df.withColumn("_own", fold_of(key, folds, seed)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    unknown = F.col(label) == -1
    tests = (F.col("_own") == F.col("fold")) | (unknown & F.col(manual))
    role = F.when(tests, "test").when(~unknown | F.lit(train_unknown), "train")
    return own.withColumn("role", role).filter("role is not null").drop("_own")


def split_by_program(df: DataFrame, folds: int = 3, label: str = "label", train_unknown: bool = False, program: str = "program", seed: int = SEED) -> DataFrame:
    """Folds over whole programs: in fold i the programs of rank i modulo ``folds`` test, the others train without unknowns."""
    ranked = hash_rank(df.select(program).distinct(), [program], seed).select(F.col(program).alias("_p"), ((F.col("rank") - 1) % folds).cast("int").alias("_own"))
    own = df.join(ranked, F.col(program) == F.col("_p")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("_own") == F.col("fold"), "test").when((F.col(label) != -1) | F.lit(train_unknown), "train")
    return own.withColumn("role", role).filter("role is not null").drop("_own", "_p")


def split_by_list(df: DataFrame, test_programs: Sequence[str], program: str = "program") -> DataFrame:
    """``role`` test for the listed programs, train for the others."""
    return df.withColumn("role", F.when(F.col(program).isin(list(test_programs)), "test").otherwise("train"))


def seed_split(df: DataFrame, label: str = "label", key: Sequence[str] = PROGRAM_KEY, seed: int = SEED, true_only: bool = False) -> DataFrame:
    """``is_seed``: half of each class (rounded down), or of the true rows only."""
    ranked = hash_rank(df, key, seed, (label,))
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    chosen = (F.col("rank") > F.ceil(F.col("_size") / 2)) & ((F.col(label) == 1) if true_only else F.lit(True))
    return ranked.join(sizes, label).withColumn("is_seed", chosen).select(*df.columns, "is_seed")


def half_hold_out(df: DataFrame, label: str = "label", key: Sequence[str] = PROGRAM_KEY, seed: int = SEED, false_too: bool = False) -> DataFrame:
    """The rows that remain when half of the true (and, if asked, false) rows are set aside."""
    held = seed_split(df, label, key, seed)
    applies = F.col(label).isin(1, 0) if false_too else F.col(label) == 1
    return held.filter(~(applies & F.col("is_seed"))).drop("is_seed")
