"""Queries of sources and text jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.functions import signatures
from edgeloom.operators import texts
from edgeloom.operators.labels import class_counts
from edgeloom.plans.labelling import labelled
from edgeloom.plans.registry import query
from edgeloom.plans.views import EDGE_SQL, raw_edges, table, total_edges, true_edges
from edgeloom.plans.set_plans import PREFIX_SQL, app_prefixes
from edgeloom.schema import EDGE
from edgeloom.sources import edges as sources
from edgeloom.sources.commits import read_sets
from edgeloom.storage import durable, shared_path

K = 'program, method, "offset", target'


@query("source_read_edges", f"WITH {EDGE_SQL} SELECT DISTINCT program, 'ship' AS tool, 'v1' AS version, substr(config_id, 2) AS config_id, method, \"offset\", target FROM total_edges")
def source_read_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write edge sets as CSV folders named by program, tool, version and configuration, all in one job, and read them all back."""
    path = shared_path(spark, "edges")
    sources.write_edges(total_edges(spark, sf_dir).select("program", "tool", F.lit("v1").alias("version"), F.substring("config_id", 2, 9).alias("config_id"), *EDGE.fieldNames()), path)
    return sources.read_edges(spark, path)


@query("source_read_or_empty", f"WITH {EDGE_SQL} SELECT method, \"offset\", target FROM true_edges")
def source_read_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "truth")
    true_edges(spark, sf_dir).select(*EDGE.fieldNames()).write.parquet(path)
    return sources.read_or_empty(spark, path).unionByName(sources.read_or_empty(spark, f"{path}-missing"))


@query("source_edge_db", f"WITH {EDGE_SQL} SELECT program, tool, config_id, method, \"offset\", target, CASE WHEN is_true AND is_false THEN 'conflict' WHEN is_true THEN 'true' WHEN is_false THEN 'false' ELSE 'unknown' END AS edge_class FROM labelled")
def source_edge_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the labelled database twice (a rerun replaces what it wrote) and read it."""
    path, key = shared_path(spark, "edge-db"), ("tool", "program", "config_id")
    found = durable(labelled(spark, sf_dir).drop("is_true", "is_false"), "labelled")  # written three times
    sources.write_edge_db(found, path, key=key)
    sources.consolidate(found, f"{path}-final", key)
    sources.consolidate(found, f"{path}-final", key)
    sources.write_edge_db(read_sets(spark, f"{path}-final", key).select(*found.columns), path, key=key)
    return sources.read_edge_db(spark, path, key=key).select(*found.columns)


CLASS_SQL = "CASE WHEN is_true AND is_false THEN 'conflict' WHEN is_true THEN 'true' WHEN is_false THEN 'false' ELSE 'unknown' END AS edge_class"
#: What is left of three writes: version 1 of early places, version 2, and version 1 of the first configurations again in full.
VERSION_SQL = """versioned AS (SELECT *, CASE WHEN "offset" <= 4 THEN 'v1' ELSE 'v2' END AS version FROM labelled),
    standing AS (SELECT * FROM versioned WHERE version = 'v2' OR "offset" <= 2 OR config_id <= 'v4')"""


def _versioned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled edges as two versions: an outdated first one, the second, and the first again for some configurations."""
    rows = durable(labelled(spark, sf_dir).withColumn("version", F.when(F.col("offset") <= 4, "v1").otherwise("v2")), "versioned")
    return rows.filter("offset <= 2"), rows.filter("version = 'v2'"), rows.filter("version = 'v1' and config_id <= 'v4'")


@query(
    "source_edge_db_two_versions",
    f"""WITH {EDGE_SQL}, {PREFIX_SQL}, {VERSION_SQL}
    SELECT program, tool, version, config_id, method, "offset", target, {CLASS_SQL},
      EXISTS (SELECT 1 FROM prefixes p WHERE p.program = s.program AND (starts_with(s.method, p.prefix) OR starts_with(s.target, p.prefix))) AS in_app FROM standing s""",
)
def source_edge_db_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writes of two versions into one database: each replaces its own sets and no others."""
    path, prefixes = shared_path(spark, "edge-db"), app_prefixes(spark, sf_dir)
    for part in _versioned(spark, sf_dir):
        sources.write_edge_db(part.drop("is_true", "is_false"), path, prefixes)
    return sources.read_edge_db(spark, path).select("program", "tool", "version", "config_id", *EDGE.fieldNames(), "edge_class", "in_app")


@query(
    "source_edge_db_app_view",
    f"""WITH {EDGE_SQL}, {PREFIX_SQL}, {VERSION_SQL}
    SELECT version, program, tool, config_id, count(*) AS total_edges, count(*) FILTER (is_true) AS true_edges, count(*) FILTER (is_false) AS false_edges, count(*) FILTER (NOT is_true AND NOT is_false) AS unknown_edges
    FROM standing s WHERE EXISTS (SELECT 1 FROM prefixes p WHERE p.program = s.program AND (starts_with(s.method, p.prefix) OR starts_with(s.target, p.prefix))) GROUP BY ALL""",
)
def source_edge_db_app_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts of the second view, without platform edges, after the same three writes."""
    path, prefixes = shared_path(spark, "edge-db"), app_prefixes(spark, sf_dir)
    for part in _versioned(spark, sf_dir):
        sources.write_edge_db(part, path, prefixes)
    return class_counts(sources.read_edge_db(spark, path, platform=False), ("version", "program", "tool", "config_id"))


@query("source_consolidated_versions", f"WITH {EDGE_SQL}, {VERSION_SQL} SELECT program, tool, version, config_id, method, \"offset\", target FROM versioned WHERE version = 'v2' OR \"offset\" <= 2")
def source_consolidated_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions and a changed first one into one table: what is there is left as it is, what isn't is added."""
    path = shared_path(spark, "final")
    early, second, again = _versioned(spark, sf_dir)
    # the first configurations come again with other rows; all of them have early ones, so none is added
    for part in (early, second, again.join(early.select("tool", "program", "config_id").distinct(), ["tool", "program", "config_id"], "left_semi")):
        sources.consolidate(part, path)
    return read_sets(spark, path).select("program", "tool", "version", "config_id", *EDGE.fieldNames())


@query(
    "source_stats_two_versions",
    f"""WITH {EDGE_SQL}, {VERSION_SQL}
    SELECT version, program, tool, config_id, count(*) AS total_edges, count(*) FILTER (is_true) AS true_edges, count(*) FILTER (is_false) AS false_edges, count(*) FILTER (NOT is_true AND NOT is_false) AS unknown_edges FROM standing GROUP BY ALL""",
)
def source_stats_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of two versions, some of them written twice."""
    path = shared_path(spark, "stats")
    for part in _versioned(spark, sf_dir):
        sources.append_stats(class_counts(part, ("version", "program", "tool", "config_id")), path)
    return sources.read_stats(spark, path)


@query("source_append_stats", f"WITH {EDGE_SQL} SELECT tool, program, count(*) AS edges FROM total_edges GROUP BY ALL")
def source_append_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, by = shared_path(spark, "stats"), ("tool", "program")
    counts = total_edges(spark, sf_dir).groupBy("tool", "program").agg(F.count("*").alias("edges"))
    sources.append_stats(counts, path, by)
    sources.append_stats(counts, path, by)
    return sources.read_stats(spark, path, by)


@query("source_metric_files", f"WITH {EDGE_SQL} SELECT program, count(*) AS edges, round(avg(l_tax), 4) AS confidence, 'means.csv' AS file_name FROM raw_edges GROUP BY program UNION ALL SELECT program, count(*), round(max(l_tax), 4), 'maxima.csv' FROM raw_edges GROUP BY program")
def source_metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write two files of metrics, one through a result table, and read both with their names."""
    path = shared_path(spark, "metrics")
    raw = raw_edges(spark, sf_dir).groupBy("program").agg(F.count("*").alias("edges"), F.avg("l_tax").cast("double").alias("confidence"), F.max("l_tax").cast("double").alias("most"))
    sources.write_results(raw.drop("most"), f"{path}-results")
    sources.write_metrics(spark.read.parquet(f"{path}-results"), path, "means.csv")
    sources.write_metrics(raw.select("program", "edges", F.round("most", 4).alias("confidence")), path, "maxima.csv")
    sources.write_metrics(raw.limit(1).drop("most"), path, "overall_evaluation.csv")
    schema = T.StructType([T.StructField("program", T.StringType()), T.StructField("edges", T.LongType()), T.StructField("confidence", T.DoubleType())])
    return sources.load_metric_files(spark, path, schema)


@query("source_instances", f"WITH {EDGE_SQL} SELECT program, method, \"offset\", target, CASE WHEN row_order % 5 = 0 THEN 'test' ELSE 'train' END AS role, row_order FROM raw_edges")
def source_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write instances by program and role twice (a rerun replaces what it wrote) and read them."""
    path = shared_path(spark, "instances")
    rows = raw_edges(spark, sf_dir).select("program", *EDGE.fieldNames(), F.when(F.col("row_order") % 5 == 0, "test").otherwise("train").alias("role"), "row_order")
    sources.write_instances(rows, path)
    sources.write_instances(rows, path)
    return spark.read.parquet(path).select(*rows.columns)


@query("source_packed_vectors", f"WITH {EDGE_SQL} SELECT {K}, [arg_max(q, row_order * 100 + q), arg_max(n, row_order * 100 + q)] AS vector FROM (SELECT {K}, row_order, l_quantity::DOUBLE AS q, \"offset\"::DOUBLE AS n FROM raw_edges WHERE (row_order // 10) % 9 <> 0) GROUP BY {K}")
def source_packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_edges(spark, sf_dir)
    bad = F.floor(F.col("row_order") / 10) % 9 == 0
    packed = F.concat_ws(",", F.col("l_quantity").cast("string"), F.when(bad, F.lit("x")).otherwise(F.col("offset").cast("string")))
    return sources.load_packed_vectors(raw.withColumns({"packed": packed, "row_order": F.struct("row_order", "l_quantity")}))


@query("source_configs", "SELECT 'n' || n_regionkey AS version, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS config_id, n_name AS analysis FROM nation")
def source_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("version"), "n_nationkey", F.col("n_name").alias("analysis"))
    return sources.number_configs(given, "n_nationkey", options=["analysis"]).select("version", "config_id", F.col("options")["analysis"].alias("analysis"))


@query("source_orders", "SELECT r_name AS option, a.n_name AS \"left\", 'MPT' AS \"order\", b.n_name AS \"right\" FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey AND b.n_nationkey > a.n_nationkey")
def source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the nations of a region, written as one JSON document and read."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a, b = nation.alias("a"), nation.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("b.n_nationkey") > F.col("a.n_nationkey")))
    per = pairs.join(region, F.col("a.n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(F.struct(F.col("a.n_name").alias("left"), F.lit("MPT").alias("order"), F.col("b.n_name").alias("right"))).alias("orders"))
    nested = per.groupBy().agg(F.collect_list(F.struct(F.col("r_name").alias("name"), "orders")).alias("options"))
    path = shared_path(spark, "orders")
    nested.coalesce(1).write.json(path)
    return sources.read_orders(spark, path)




def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, at = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 5
    caller = F.concat(F.lit("<a.b.S"), F.col("l_suppkey").cast("string"), F.lit(": int[] m(java.lang.String,long)>/x.y/"))
    target = F.concat(F.lit("<a.P"), (F.col("l_partkey") % 10).cast("string"), F.lit(": a.Q g()>"))
    made = F.when(at == 0, "short line").when(at == 1, "c\t<register-finalize <a.B: void f()>/x/1>\tc\t<a.B: void g()>").when(at == 2, F.concat_ws("\t", F.lit("c"), F.concat(caller, F.lit("n")), F.lit("c"), target)).otherwise(F.concat_ws("\t", F.lit("c"), F.concat(caller, F.col("l_linenumber").cast("string")), F.lit("c"), target))
    return line.select(made.alias("value"))


@query(
    "text_parse_edges",
    """SELECT 'a/b/S' || l_suppkey || '.m:(Ljava/lang/String;J)[I' AS method, l_linenumber::BIGINT AS "offset", 'a/P' || (l_partkey % 10) || '.g:()La/Q;' AS target FROM lineitem WHERE l_orderkey % 5 > 2""",
)
def text_parse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.parse_text_edges(_lines(spark, sf_dir))


@query("text_rejected_lines", """SELECT CASE l_orderkey % 5 WHEN 0 THEN 'short line' WHEN 1 THEN concat('c', chr(9), '<register-finalize <a.B: void f()>/x/1>', chr(9), 'c', chr(9), '<a.B: void g()>')
      ELSE concat('c', chr(9), '<a.b.S', l_suppkey, ': int[] m(java.lang.String,long)>/x.y/n', chr(9), 'c', chr(9), '<a.P', l_partkey % 10, ': a.Q g()>') END AS value,
    CASE l_orderkey % 5 WHEN 0 THEN 'fields' WHEN 1 THEN 'register-finalize' ELSE 'index' END AS reason FROM lineitem WHERE l_orderkey % 5 < 3""")
def text_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.normalize_raw(_lines(spark, sf_dir), "text")[1]


@query("text_flatten_callsites", """SELECT 'a/S' || l_suppkey || '.m:(I)V' AS method, l_linenumber::BIGINT AS "offset", 'b/P' || l_partkey || '.g:()La/Q;' AS target FROM lineitem""")
def text_flatten_callsites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reachable methods made from the line items of each order and flattened."""
    line = table(spark, sf_dir, "lineitem")
    name = lambda owner, n, args, out: F.struct(owner.alias("declaringClass"), F.lit(n).alias("name"), F.array(*[F.lit(a) for a in args]).cast("array<string>").alias("parameterTypes"), F.lit(out).alias("returnType"))
    owner, target = (F.concat(F.lit(p), F.col(c).cast("string"), F.lit(";")) for p, c in (("La/S", "l_suppkey"), ("Lb/P", "l_partkey")))
    sites = line.groupBy("l_orderkey", "l_suppkey", "l_linenumber").agg(F.collect_list(name(target, "g", [], "La/Q;")).alias("targets"))
    methods = sites.groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("pc"), "targets")).alias("callSites"))
    nested = methods.groupBy("l_orderkey").agg(F.collect_list(F.struct(name(owner, "m", ["I"], "V").alias("method"), "callSites")).alias("reachableMethods"))
    return texts.flatten_callsite_json(nested)


@query(
    "text_normalize_edges",
    f"""WITH {EDGE_SQL} SELECT program, CASE WHEN starts_with(method, 's/1') THEN '<boot>' ELSE 'a/B.<lambda/run$' || substr(method, 3, 1) || '>:()V' END AS method, CASE WHEN starts_with(method, 's/1') THEN 0 ELSE "offset" END AS "offset",
    CASE WHEN "offset" = 2 THEN 'java/lang/System.arraycopy:(Ljava/lang/Object;ILjava/lang/Object;II)V' ELSE target END AS target FROM true_edges WHERE "offset" NOT IN (5, 6)""",
)
def text_normalize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as boot callers or lambda classes, some targets as array copies, boot code or the lambda factory."""
    at = F.col("offset")
    method = F.when(F.col("method").startswith("s/1"), F.lit(texts.BOOT_CALLERS[0])).otherwise(F.concat(F.lit("wala/lambda$a$B$"), F.substring("method", 3, 1), F.lit(".run:(I)V")))
    target = F.when(at == 2, F.lit(texts.ARRAY_COPY)).when(at == 5, F.lit(texts.BOOT_TARGET)).when(at == 6, F.lit(texts.LAMBDA_FACTORY + "metafactory:()V")).otherwise(F.col("target"))
    return texts.normalize_edges(true_edges(spark, sf_dir).select("program", method.alias("method"), "offset", target.alias("target")))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between methods with signatures: suppliers call parts."""
    edges = true_edges(spark, sf_dir)
    return edges.select("program", "offset", F.concat(F.translate("method", "s", "a"), F.lit("$1C.m:([ILb/X$Y;J)V")).alias("method"), F.concat(F.translate("target", "#", "_"), F.lit(".g:()Lb/O$P;")).alias("target"))


SIGNED_SQL = """signed AS (SELECT program, "offset", replace(method, 's', 'a') || '$1C.m:([ILb/X$Y;J)V' AS method, replace(target, '#', '_') || '.g:()Lb/O$P;' AS target FROM true_edges)"""
CODE_SQL = f"""code AS (SELECT DISTINCT method AS signature, 'void  m' || chr(10) || ' ( ) {{ }} ' AS code FROM signed WHERE method LIKE 'a/2%'),
  coded AS (SELECT s.*, CASE WHEN method LIKE 'a/2%' THEN 'void m ( ) {{ }}' ELSE 'class ' || substr(method, 3, instr(method, '$') - 3) || '$C {{ void m ( int[] a0, X a1, long a2, ) {{ return void1; }}' END AS method_code,
    'class ' || substr(target, 3, instr(target, '.') - 3) || ' {{ P g ( ) {{ return P1; }}' AS target_code FROM signed s)""".replace("{{", "{").replace("}}", "}")


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _signed(spark, sf_dir)
    code = edges.select(F.col("method").alias("signature")).distinct().filter("signature like 'a/2%'").withColumn("code", F.lit("void  m\n ( ) { } "))
    return texts.edge_text(edges, code, ["program", "method", "offset", "target"])


@query("text_edge_code", f"WITH {EDGE_SQL}, {SIGNED_SQL}, {CODE_SQL} SELECT program, method, \"offset\", target, method_code, target_code FROM coded")
def text_edge_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir)


WINDOW_SQL = r"""toks AS (SELECT *, regexp_extract_all(method_code, '(\w+|[^\w\s])') AS a, regexp_extract_all(target_code, '(\w+|[^\w\s])') AS b FROM coded),
  cut AS (SELECT *, 24 - 3 AS room, len(a) AS la, len(b) AS lb FROM toks),
  keep AS (SELECT *, CASE WHEN la + lb <= room THEN la WHEN la < lb THEN la * room // (la + lb) ELSE room - lb * room // (la + lb) END AS ka,
    CASE WHEN la + lb <= room THEN lb WHEN la < lb THEN room - la * room // (la + lb) ELSE lb * room // (la + lb) END AS kb FROM cut),
  win AS (SELECT *, list_concat(list_concat(list_concat(['[CLS]'], a[1:ka]), ['[SEP]']), list_concat(b[1:kb], ['[SEP]'])) AS w FROM keep)"""


@query("text_token_windows", f"WITH {EDGE_SQL}, {SIGNED_SQL}, {CODE_SQL}, {WINDOW_SQL} SELECT program, method, \"offset\", target, list_concat(w, list_transform(range(24 - len(w)), lambda x: '[PAD]')) AS tokens, len(w) AS used FROM win")
def text_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = texts.token_windows(_coded(spark, sf_dir), ["program", "method", "offset", "target"], 24)
    return made.select("program", "method", "offset", "target", "tokens", F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("used"))


@query("text_fixed_vectors", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(range(11), lambda x: 0.0) WHEN vec_id % 3 = 1 THEN list_transform(range(11), lambda x: 0.0) ELSE CAST(embedding[1:11] AS double[]) END AS vector FROM embeddings")
def text_fixed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length 11, with null and short ones replaced by zeros."""
    given = table(spark, sf_dir, "embeddings")
    at = F.col("vec_id") % 3
    vector = F.when(at == 1, F.slice("embedding", 1, 7)).when(at == 2, F.slice("embedding", 1, 11))
    return given.select("vec_id", signatures.fixed_vector(vector, 11).alias("vector"))
