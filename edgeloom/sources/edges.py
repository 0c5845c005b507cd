"""Read and write edge tables, configurations, orders, vectors and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.functions.signatures import packed_vector
from edgeloom.operators.filters import flag_app_edges
from edgeloom.operators.sets import PROGRAM_KEY
from edgeloom.schema import EDGE
from edgeloom.sources.commits import SET, commit_sets, read_sets

#: program directory / tool _ version _ config .csv, a file or a folder of part files; a writer may put a column's name before either
EDGE_PATH = r"(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?([^/_=]+)_([^/_]+)_([^/_]+)\.csv(?:/[^/]*)?$"


def read_edges(spark: SparkSession, path: str, schema: T.StructType = EDGE) -> DataFrame:
    """All edge CSV files below a path, with program, tool, version and config_id taken from directory and file name."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    # a match has two slashes at most; above them the pattern would be tried in vain at every place, for every row
    end = F.substring_index(F.col("_metadata.file_path"), "/", -3)
    parts = [F.regexp_extract(end, EDGE_PATH, i).alias(n) for i, n in enumerate(("program", "tool", "version", "config_id"), 1)]
    return rows.select(*parts, *schema.fieldNames())


def write_edges(edges: DataFrame, path: str) -> None:
    """Write every program's and configuration's edges as CSV folders that ``read_edges`` reads, in one job."""
    name = F.concat(F.concat_ws("_", "tool", "version", "config_id"), F.lit(".csv"))
    edges.select(F.col("program"), name.alias("set"), *EDGE.fieldNames()).write.mode("append").option("header", True).partitionBy("program", "set").csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType = EDGE) -> DataFrame:
    """The table at a path, or one without rows if there is none."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """(option, left, order, right) from JSON of options with lists of orders."""
    shape = "options array<struct<name:string,orders:array<struct<left:string,order:string,right:string>>>>"
    return flatten_orders(spark.read.schema(shape).option("multiLine", True).json(path))


def flatten_orders(nested: DataFrame) -> DataFrame:
    """One row per order from ``options``."""
    option = nested.select(F.explode("options").alias("o"))
    return option.select(F.col("o.name").alias("option"), F.explode("o.orders").alias("r")).select("option", "r.left", "r.order", "r.right")


def number_configs(configs: DataFrame, order: str, version: str = "version", options: Sequence[str] = ()) -> DataFrame:
    """``config_id`` (place in the file, from 0), and the option columns as a map. ``order`` gives the rows' order in the file.

    A configuration file has a few dozen rows, so one window per version is small.
    """
    place = (F.row_number().over(Window.partitionBy(version).orderBy(order)) - 1).cast("int")
    entries = F.map_from_arrays(F.array(*[F.lit(o) for o in options]), F.array(*[F.col(o).cast("string") for o in options]))
    return configs.select(version, place.alias("config_id"), entries.alias("options"))


def consolidate(edges: DataFrame, path: str, key: Sequence[str] = SET) -> int:
    """Add edge sets to one table over all tools and versions; a set that is there already is left as it is."""
    return commit_sets(edges, path, key, replace=False)


def write_edge_db(labelled: DataFrame, path: str, prefixes: DataFrame | None = None, key: Sequence[str] = SET, sets: DataFrame | None = None) -> int:
    """Write labelled edge sets; a rerun replaces the sets that it writes and no others.

    Rows are stored once, by tool, program and class. With ``prefixes`` (program, prefix)
    ``in_app`` says whether an edge is one of the program's own, which makes the second
    view, without platform edges. ``sets`` names sets that may have no edge.
    """
    if prefixes is not None:
        labelled = flag_app_edges(labelled, prefixes, "in_app")
    return commit_sets(labelled, path, key, sets=sets, layout=("tool", "program", "edge_class"))


def read_edge_db(spark: SparkSession, path: str, platform: bool = True, key: Sequence[str] = SET, version: int | None = None, only: dict[str, str] | None = None) -> DataFrame:
    """The labelled edges with all classes; without ``platform`` only the programs' own."""
    rows = read_sets(spark, path, key, version, ("tool", "program", "edge_class"), only)
    return rows if platform else rows.filter("in_app")


def append_stats(stats: DataFrame, path: str, by: Sequence[str] = SET) -> int:
    """Add statistics; rows of the groups ``by`` that were written before are replaced, so a rerun doesn't repeat them."""
    return commit_sets(stats, path, by, layout=())


def read_stats(spark: SparkSession, path: str, by: Sequence[str] = SET, version: int | None = None) -> DataFrame:
    """The statistics as they stand."""
    return read_sets(spark, path, by, version, ())


def write_results(predictions: DataFrame, path: str) -> None:
    """Write predictions with their confidence at 4 decimals."""
    predictions.withColumn("confidence", F.round("confidence", 4)).write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str, file: str) -> None:
    """Write metric rows as the CSV file (a folder of parts) of this name, which ``load_metric_files`` reads."""
    metrics.withColumn("file", F.lit(file)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("file").csv(path)


def write_instances(rows: DataFrame, path: str, split: str = "role") -> None:
    """Write model instances by program and role (train, test); a rerun replaces what it writes again."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("program", split).parquet(path)


def load_metric_files(spark: SparkSession, path: str, schema: T.StructType, skip: Sequence[str] = ("overall_evaluation.csv",)) -> DataFrame:
    """All metric CSV files of a folder with the name of their file, or of the folder of parts that ``write_metrics`` made."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/file=([^/]+)/[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.col("_metadata.file_name"))
    return rows.select("*", name.alias("file_name")).filter(~F.col("file_name").isin(list(skip)))


def load_packed_vectors(rows: DataFrame, packed: str = "packed", order: str = "row_order", key: Sequence[str] = PROGRAM_KEY) -> DataFrame:
    """Vectors from comma-joined text, rows with a bad number dropped; the last row of a key wins."""
    good = rows.withColumn("vector", packed_vector(F.col(packed))).filter("vector is not null")
    return good.groupBy(*key).agg(F.max_by("vector", order).alias("vector"))
