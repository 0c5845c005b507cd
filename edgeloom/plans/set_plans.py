"""Queries of filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import filters, sets, stats, subsets
from edgeloom.plans.registry import query
from edgeloom.plans.views import EDGE_SQL, RAW_SQL, false_edges, raw_edges, table, total_edges, true_edges
from edgeloom.schema import KEY

K = 'program, method, "offset", target'


def three_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges, repeated rows included, with the configurations put together to a few by their number modulo 3."""
    few = F.concat(F.lit("g"), (F.substring("config_id", 2, 9).cast("int") % 3).cast("string"))
    return raw_edges(spark, sf_dir).select("program", "tool", few.alias("config_id"), *KEY)


def app_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with sizes above 45 as prefixes of program A, suppliers of nation 3 as those of N; R has none."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    a = part.filter("p_size > 45").select(F.lit("A").alias("program"), F.concat(F.lit("b/"), "p_brand").alias("prefix"))
    n = supplier.filter("s_nationkey = 3").select(F.lit("N").alias("program"), F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("prefix"))
    return a.union(n).distinct()


PREFIX_SQL = """prefixes AS (
  SELECT DISTINCT 'A' AS program, 'b/' || p_brand AS prefix FROM part WHERE p_size > 45
  UNION SELECT 'N', 's/' || CAST(s_suppkey AS varchar) FROM supplier WHERE s_nationkey = 3)"""


@query("filter_app_edges", f"WITH {EDGE_SQL}, {PREFIX_SQL} SELECT t.* FROM total_edges t WHERE EXISTS (SELECT 1 FROM prefixes p WHERE p.program = t.program AND (starts_with(t.method, p.prefix) OR starts_with(t.target, p.prefix)))")
def filter_app_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep_app_edges(total_edges(spark, sf_dir), app_prefixes(spark, sf_dir))


@query("filter_platform_edges", f"WITH {EDGE_SQL} SELECT * FROM total_edges WHERE NOT starts_with(method, 's/1') AND NOT starts_with(target, 's/1')")
def filter_platform_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_platform_edges(total_edges(spark, sf_dir), "s/1")


LIB_SQL = "libs AS (SELECT DISTINCT 'b/' || p_brand AS prefix FROM part WHERE p_size < 3 AND p_brand LIKE '%1' UNION SELECT 's/2')"


def _libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").filter("p_size < 3 and p_brand like '%1'").select(F.concat(F.lit("b/"), "p_brand").alias("prefix"))
    return brands.union(spark.sql("select 's/2' as prefix")).distinct()


@query("filter_library_edges", f"WITH {EDGE_SQL}, {LIB_SQL} SELECT t.* FROM total_edges t WHERE NOT EXISTS (SELECT 1 FROM libs WHERE starts_with(t.method, prefix) OR starts_with(t.target, prefix))")
def filter_library_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_library_edges(total_edges(spark, sf_dir), _libraries(spark, sf_dir))


@query("filter_library_packages", f"WITH {EDGE_SQL} SELECT t.program, replace(method, 's/', 's' || substr(method, 3, 1) || '/') AS method, \"offset\", target FROM true_edges t WHERE substr(method, 3, 1) NOT IN ('2', '4')")
def filter_library_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = true_edges(spark, sf_dir).withColumn("method", F.replace("method", F.lit("s/"), F.concat(F.lit("s"), F.substring("method", 3, 1), F.lit("/"))))
    packages = table(spark, sf_dir, "nation").filter("n_nationkey in (2, 4)").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string"), F.lit("/")).alias("prefix"))
    return filters.drop_library_edges(edges, packages, packages=True)


@query("filter_boot_edges", f"WITH {EDGE_SQL} SELECT program, tool, config_id, method, \"offset\", target FROM total_edges WHERE method <> 's/1'")
def filter_boot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_boot_edges(total_edges(spark, sf_dir), "s/1", exact=True)


@query("filter_observed_edges", f"WITH {EDGE_SQL} SELECT DISTINCT {K} FROM raw_edges WHERE l_discount >= 0.05 AND NOT starts_with(method, 's/1') AND NOT starts_with(target, 's/1')")
def filter_observed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = raw_edges(spark, sf_dir).withColumn("wiretap", (F.col("l_discount") >= 0.05).cast("int"))
    return filters.observed_edges(flagged, "wiretap", platform="s/1")


TEXT_OFFSETS = "CASE WHEN l_orderkey % 7 = 0 THEN 'x' || l_linenumber WHEN l_orderkey % 7 = 1 THEN '' WHEN l_orderkey % 7 = 2 THEN l_linenumber || '.5' ELSE CAST(l_linenumber AS varchar) END"


def _text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("l_orderkey") % 7, F.col("l_linenumber").cast("string")
    text = F.when(key == 0, F.concat(F.lit("x"), n)).when(key == 1, F.lit("")).when(key == 2, F.concat(n, F.lit(".5"))).otherwise(n)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", text.alias("offset"))


@query("filter_valid_offsets", f'SELECT l_suppkey, "offset" FROM (SELECT l_suppkey, {TEXT_OFFSETS} AS "offset" FROM lineitem) WHERE try_cast("offset" AS double) IS NOT NULL')
def filter_valid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.split_offsets(_text_offsets(spark, sf_dir))[0]


@query("filter_bad_offsets", f'SELECT "offset", count(*) AS rows FROM (SELECT {TEXT_OFFSETS} AS "offset" FROM lineitem) WHERE try_cast("offset" AS double) IS NULL GROUP BY ALL')
def filter_bad_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.split_offsets(_text_offsets(spark, sf_dir))[1]


@query("filter_select_configs", f"WITH {EDGE_SQL} SELECT t.* FROM total_edges t WHERE EXISTS (SELECT 1 FROM raw_edges r WHERE r.program = t.program AND r.config_id = t.config_id AND r.l_quantity = 50 AND r.l_discount = 0 AND r.l_tax = 0)")
def filter_select_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = raw_edges(spark, sf_dir).filter("l_quantity = 50 and l_discount = 0 and l_tax = 0").select("tool", "config_id", "program")
    return filters.select_configs(total_edges(spark, sf_dir), chosen)


@query("filter_dedupe_edges", f"WITH {EDGE_SQL} SELECT {K}, min(row_order) AS row_order FROM raw_edges GROUP BY {K}")
def filter_dedupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.dedupe_edges(raw_edges(spark, sf_dir).select(*sets.PROGRAM_KEY, "row_order"), order="row_order")


@query("filter_flag_duplicates", f"WITH {EDGE_SQL} SELECT {K}, row_order FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM raw_edges) WHERE n > 1")
def filter_flag_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.duplicated(raw_edges(spark, sf_dir).select(*sets.PROGRAM_KEY, "row_order"))


LABEL_TEXT = "CASE row_order % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '1a' WHEN 3 THEN '?' WHEN 4 THEN ' 1 ' ELSE '' END"


@query(
    "filter_manual_labels",
    f"""WITH {EDGE_SQL}, given AS (SELECT {K}, row_order, {LABEL_TEXT} AS label FROM raw_edges),
    p AS (SELECT *, CASE WHEN trim(label) = '' THEN 'blank' WHEN try_cast(trim(label) AS int) IS NULL THEN 'unreadable' ELSE 'used' END AS label_status FROM given)
    SELECT {K}, try_cast(trim(label) AS int) AS label, label_status FROM p
    QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY label_status <> 'used', row_order) = 1""",
)
def filter_manual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("row_order") % 6
    text = F.when(at == 0, "1").when(at == 1, "0").when(at == 2, "1a").when(at == 3, "?").when(at == 4, " 1 ").otherwise("")
    return filters.parse_manual_labels(raw_edges(spark, sf_dir).withColumn("label", text), order="row_order")


@query("filter_tag_program", f"WITH {EDGE_SQL} SELECT 'all' AS program, method, \"offset\", target FROM true_edges")
def filter_tag_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.tag_program(true_edges(spark, sf_dir), "all")


@query("join_semi", f"WITH {EDGE_SQL} SELECT t.* FROM total_edges t SEMI JOIN true_edges USING ({K})")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.keep_in(total_edges(spark, sf_dir), true_edges(spark, sf_dir))


@query("join_anti", f"WITH {EDGE_SQL} SELECT t.* FROM total_edges t ANTI JOIN true_edges USING ({K})")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.keep_out(total_edges(spark, sf_dir), true_edges(spark, sf_dir))


@query("join_symmetric_difference", f"WITH {EDGE_SQL} SELECT {K}, max(a)::INT AS \"left\", max(b)::INT AS \"right\" FROM (SELECT {K}, 1 AS a, 0 AS b FROM true_edges UNION ALL SELECT {K}, 0, 1 FROM false_edges) GROUP BY {K} HAVING max(a) + max(b) = 1")
def join_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.symmetric_difference(true_edges(spark, sf_dir), false_edges(spark, sf_dir))


@query("set_union", f"WITH {EDGE_SQL} SELECT {K} FROM true_edges UNION SELECT {K} FROM false_edges")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_edges(true_edges(spark, sf_dir), false_edges(spark, sf_dir))


MEMBER_SQL = f"""three AS (SELECT DISTINCT {K}, tool, 'g' || (CAST(substr(config_id, 2) AS int) % 3) AS config_id FROM total_edges),
  per AS (SELECT {K}, count(DISTINCT config_id) AS n FROM three GROUP BY {K}),
  tot AS (SELECT program, count(DISTINCT config_id) AS total FROM three GROUP BY program)"""


@query("set_intersection", f"WITH {EDGE_SQL}, {MEMBER_SQL} SELECT {K} FROM per JOIN tot USING (program) WHERE n = total")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersection(three_configs(spark, sf_dir))


@query("set_difference", f"WITH {EDGE_SQL} SELECT {K} FROM true_edges EXCEPT SELECT {K} FROM false_edges")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(true_edges(spark, sf_dir), false_edges(spark, sf_dir))


@query("set_disagreement", f"WITH {EDGE_SQL}, {MEMBER_SQL} SELECT {K} FROM per JOIN tot USING (program) WHERE n < total")
def set_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.disagreement(three_configs(spark, sf_dir))


MEMBERS = [f"v{i}" for i in range(1, 8)]
MASK_SQL = f"masks AS (SELECT {K}, bit_or(CAST(1 AS bigint) << (CAST(substr(config_id, 2) AS int) - 1)) AS mask FROM total_edges GROUP BY {K})"


@query("set_exclusive_counts", f"WITH {EDGE_SQL}, {MASK_SQL} SELECT mask, count(*) AS edges FROM masks GROUP BY mask")
def set_exclusive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.exclusive_counts(total_edges(spark, sf_dir), MEMBERS)


@query("set_compare", f"WITH {EDGE_SQL} SELECT program, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 1 AND b = 0) AS only_left, count(*) FILTER (a = 0 AND b = 1) AS only_right FROM (SELECT {K}, max(a) AS a, max(b) AS b FROM (SELECT {K}, 1 AS a, 0 AS b FROM true_edges UNION ALL SELECT {K}, 0, 1 FROM false_edges) GROUP BY {K}) GROUP BY program")
def set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.compare_sets(true_edges(spark, sf_dir), false_edges(spark, sf_dir))


@query("stats_union_intersection", f"WITH {EDGE_SQL}, {MEMBER_SQL} SELECT program, count(*) AS union_size, count(*) FILTER (n = total) AS intersection_size, count(*) FILTER (n < total) AS disagreement_size FROM per JOIN tot USING (program) GROUP BY program")
def stats_union_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.union_intersection_sizes(three_configs(spark, sf_dir))


@query("stats_largest_sets", f"WITH {EDGE_SQL} SELECT * FROM (SELECT tool, config_id, count(*) AS edges, row_number() OVER (PARTITION BY tool ORDER BY count(*) DESC, config_id)::INT AS rank FROM total_edges GROUP BY tool, config_id) WHERE rank <= 3")
def stats_largest_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.largest_sets(total_edges(spark, sf_dir), 3)


SUBSET_SQL = """numbers AS (SELECT range AS s FROM range(1, 128)),
  sub AS (SELECT s, bit_count(s) AS size, list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: (s >> (x - 1)) & 1 = 1) AS ids FROM numbers WHERE bit_count(s) BETWEEN 2 AND 4),
  hist AS (SELECT mask, count(*) AS edges FROM masks GROUP BY mask),
  scored AS (SELECT s, any_value(size) AS size, any_value(ids) AS ids, sum(edges) FILTER (mask & s <> 0)::BIGINT AS union_size, coalesce(sum(edges) FILTER (mask & s = s), 0)::BIGINT AS intersection_size FROM sub, hist GROUP BY s)"""


@query("stats_best_config_subset", f"WITH {EDGE_SQL}, {MASK_SQL}, {SUBSET_SQL} SELECT array_to_string(list_transform(ids, lambda x: 'v' || x), ',') AS members, union_size, intersection_size, union_size - intersection_size AS score FROM scored WHERE intersection_size >= 5 ORDER BY score, size, ids LIMIT 1")
def stats_best_config_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subsets.best_config_subset(total_edges(spark, sf_dir), MEMBERS, min_intersection=5, max_size=4)


@query("stats_best_config_triple", f"WITH {EDGE_SQL}, {MASK_SQL}, {SUBSET_SQL} SELECT array_to_string(list_transform(ids, lambda x: 'v' || x), ',') AS members, union_size, intersection_size, union_size - intersection_size AS score FROM scored WHERE intersection_size >= 2 AND size >= 3 ORDER BY score, size, ids LIMIT 1")
def stats_best_config_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of at least three configurations, by branch and bound."""
    return subsets.best_config_subset(total_edges(spark, sf_dir), MEMBERS, min_intersection=2, max_size=4, min_size=3)


#: 200 sets: an edge lies in those of the suppliers' rows that report it, dealt by order number.
WIDE = [f"w{i}" for i in range(200)]
WIDE_SQL = "wide AS (SELECT DISTINCT program, \"offset\", target, row_order // 10 % 200 AS num FROM raw_edges)"
WIDE_KEY = ("program", "offset", "target")


def wide_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.col("row_order") / 10) % 200
    return raw_edges(spark, sf_dir).select(*WIDE_KEY, F.concat(F.lit("w"), at.cast("string")).alias("config_id")).distinct()


@query("set_exclusive_counts_wide", f"WITH {RAW_SQL}, {WIDE_SQL}, m AS (SELECT program, \"offset\", target, list(num ORDER BY num) AS sets FROM wide GROUP BY ALL) SELECT array_to_string(sets, ',') AS sets, count(*) AS edges FROM m GROUP BY ALL")
def set_exclusive_counts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges lie in exactly each subset of 200 sets."""
    counts = sets.wide_exclusive_counts(wide_sets(spark, sf_dir), WIDE, key=WIDE_KEY)
    return counts.select(F.array_join(F.col("sets").cast("array<string>"), ",").alias("sets"), "edges")


@query(
    "stats_best_config_subset_wide",
    f"""WITH {RAW_SQL}, {WIDE_SQL}, forty AS (SELECT DISTINCT program, "offset", target, num % 40 AS num FROM wide),
    sizes AS (SELECT num, count(*) AS n FROM forty GROUP BY num),
    shared AS (SELECT a.num AS l, b.num AS r, count(*) AS n FROM forty a JOIN forty b USING (program, "offset", target) WHERE a.num < b.num GROUP BY ALL)
    SELECT 'w' || l || ',w' || r AS members, x.n + y.n - shared.n AS union_size, shared.n AS intersection_size, x.n + y.n - 2 * shared.n AS score FROM shared JOIN sizes x ON x.num = l JOIN sizes y ON y.num = r
    WHERE shared.n >= 5 ORDER BY score, l, r LIMIT 1""",
)
def stats_best_config_subset_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all subsets of 2 to 8 of 40 sets; SQL looks at pairs, which are never worse than what holds them."""
    forty = wide_sets(spark, sf_dir).withColumn("config_id", F.concat(F.lit("w"), (F.substring("config_id", 2, 9).cast("int") % 40).cast("string"))).distinct()
    return subsets.best_config_subset(forty, WIDE[:40], min_intersection=5, key=WIDE_KEY)


@query("stats_class_shares", f"WITH {EDGE_SQL}, n AS (SELECT l_linestatus AS edge_class, count(*) AS edges FROM raw_edges GROUP BY ALL) SELECT edge_class, edges::BIGINT AS edges, round(100 * edges / (SELECT sum(edges) FROM n), 2) AS percent FROM n")
def stats_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_shares(raw_edges(spark, sf_dir).groupBy(F.col("l_linestatus").alias("edge_class"), "program").agg(F.count("*").alias("n")), "n")


@query(
    "stats_melt_mean_pivot",
    f"""WITH {EDGE_SQL}, r AS (SELECT program, l_linestatus, CAST(l_quantity AS double) AS quantity, CAST(l_tax AS double) AS tax FROM raw_edges),
    m AS (SELECT program, l_linestatus, 'quantity' AS metric, quantity AS value FROM r UNION ALL SELECT program, l_linestatus, 'tax', tax FROM r)
    SELECT program, metric, round(avg(value) FILTER (l_linestatus = 'F'), 6) AS "F", round(avg(value) FILTER (l_linestatus = 'O'), 6) AS "O" FROM m GROUP BY ALL""",
)
def stats_melt_mean_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_edges(spark, sf_dir).select("program", "l_linestatus", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_tax").cast("double").alias("tax"))
    means = stats.melt_mean_pivot(rows, ["program"], ["quantity", "tax"], "l_linestatus", ["F", "O"])
    return means.select("program", "metric", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))
