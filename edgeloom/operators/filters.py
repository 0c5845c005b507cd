"""Keep or drop edges by what they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.sets import PROGRAM_KEY
from edgeloom.schema import KEY

PLATFORM = "java/"
BOOT = "<boot>"


def starting_names(edges: DataFrame, side: str, prefixes: DataFrame, program: str = "program", prefix: str = "prefix") -> DataFrame:
    """``_program`` and ``_name``: the distinct names on one side of the edges that begin with one of their program's prefixes.

    Each distinct name is cut to the lengths that prefixes have and these starts are joined
    by equality, so the work is names times lengths, however many prefixes there are.
    """
    known = prefixes.select(F.col(program).alias("_program"), F.col(prefix).alias("_start")).filter("_start is not null").distinct()
    lengths = [r["n"] for r in known.select(F.length("_start").alias("n")).distinct().orderBy("n").collect()]  # few: lengths, not prefixes
    names = edges.select(F.col(program).alias("_program"), F.col(side).alias("_name")).filter("_name is not null").distinct()
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_name"))
    starts = names.select("_program", "_name", F.explode(cut).alias("_n")).select("_program", "_name", F.expr("substring(_name, 1, _n)").alias("_start"))
    return starts.join(known, ["_program", "_start"], "left_semi").select("_program", "_name").distinct()


def flag_app_edges(edges: DataFrame, prefixes: DataFrame, out: str, program: str = "program", prefix: str = "prefix") -> DataFrame:
    """``edges`` with ``out``: whether the method or target begins with one of its program's prefixes.

    ``prefixes``: one row per program and prefix. A program without prefixes has no such
    edge. The edges are read several times.
    """
    for side in ("method", "target"):
        found = starting_names(edges, side, prefixes, program, prefix).withColumn(f"_own_{side}", F.lit(True))
        on = (F.col(program) == F.col("_program")) & (F.col(side) == F.col("_name"))
        edges = edges.join(found, on, "left").drop("_program", "_name")
    either = F.coalesce("_own_method", "_own_target", F.lit(False))
    return edges.withColumn(out, either).drop("_own_method", "_own_target")


def keep_app_edges(edges: DataFrame, prefixes: DataFrame, program: str = "program", prefix: str = "prefix") -> DataFrame:
    """Edges whose method or target begins with one of its program's prefixes; a program without prefixes keeps nothing."""
    return flag_app_edges(edges, prefixes, "_own", program, prefix).filter("_own").drop("_own")


def drop_platform_edges(edges: DataFrame, prefix: str = PLATFORM) -> DataFrame:
    """Edges whose method and target are both outside the platform."""
    return edges.filter(~F.col("method").startswith(prefix) & ~F.col("target").startswith(prefix))


def drop_library_edges(edges: DataFrame, libraries: DataFrame, prefix: str = "prefix", packages: bool = False) -> DataFrame:
    """Edges of which neither side begins with a library prefix.

    ``packages``: prefixes are top-level packages, matched as whole path heads by an
    equality join. Otherwise any prefix matches, so ``a/B`` also drops ``a/BC``; prefixes
    are cut to their distinct lengths and compared by equality, one length at a time, so
    that no nested-loop join is needed.
    """
    known = libraries.select(F.col(prefix).alias("_prefix")).filter("_prefix is not null").distinct()
    if packages:
        heads = known.select(F.regexp_replace("_prefix", "/+$", "").alias("_prefix")).distinct()
        for side in ("method", "target"):
            edges = edges.join(heads, F.substring_index(side, "/", 1) == F.col("_prefix"), "left_anti")
        return edges
    lengths = [r["n"] for r in known.select(F.length("_prefix").alias("n")).distinct().orderBy("n").collect()]  # few: lengths, not prefixes
    for n in lengths:
        of_length = known.filter(F.length("_prefix") == n)
        for side in ("method", "target"):
            edges = edges.join(of_length, F.substring(side, 1, n) == F.col("_prefix"), "left_anti")
    return edges


def drop_boot_edges(edges: DataFrame, boot: str = BOOT, exact: bool = False) -> DataFrame:
    """Edges whose caller isn't the boot method, by prefix or by equality."""
    return edges.filter(F.col("method") != boot if exact else ~F.col("method").startswith(boot))


def observed_edges(edges: DataFrame, flag: str, key: Sequence[str] = PROGRAM_KEY, platform: str = PLATFORM) -> DataFrame:
    """Distinct keys of edges that were seen at run time, outside the platform."""
    return drop_platform_edges(edges.filter(F.col(flag) == 1), platform).select(*key).dropDuplicates(list(key))


def valid_offset(edges: DataFrame, offset: str = "offset") -> Column:
    """Whether an offset given as text is numeric; 1.5 is."""
    return F.expr(f"try_cast(`{offset}` as double)").isNotNull()


def split_offsets(edges: DataFrame, offset: str = "offset") -> tuple[DataFrame, DataFrame]:
    """Rows with a numeric offset, and the distinct offsets of the others with their rows."""
    good = valid_offset(edges, offset)
    return edges.filter(good), edges.filter(~good).groupBy(offset).agg(F.count("*").alias("rows"))


def select_configs(edges: DataFrame, configs: DataFrame) -> DataFrame:
    """Edges of the chosen rows of a configuration table, matched on all columns that both have.

    Compare by (tool, version, config_id, program) or fewer: the table says which.
    """
    on = [c for c in configs.columns if c in edges.columns]
    return edges.join(configs.select(*on).distinct(), on, "left_semi")


def parse_manual_labels(labels: DataFrame, key: Sequence[str] = PROGRAM_KEY, label: str = "label", order: str | None = None) -> DataFrame:
    """Hand labels as integers: ``label`` (null if it is none) and ``label_status`` (used, blank, unreadable).

    The first label of an edge wins, by ``order`` or by the label's text.
    """
    text = F.trim(F.col(label))
    number = F.expr(f"try_cast(trim(`{label}`) as int)")
    status = F.when(text.isNull() | (text == ""), "blank").when(number.isNull(), "unreadable").otherwise("used")
    parsed = labels.withColumns({"label_status": status, "_label": number})
    first = F.min_by(F.struct("_label", "label_status"), F.struct(F.col("label_status") != "used", F.col(order or label))).alias("first")
    return parsed.groupBy(*key).agg(first).select(*key, F.col("first._label").alias(label), F.col("first.label_status").alias("label_status"))


def tag_program(edges: DataFrame, program: str) -> DataFrame:
    """Key columns with a literal program in front."""
    return edges.select(F.lit(program).alias("program"), *KEY)

