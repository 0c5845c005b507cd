"""Tables of many sets, written set by set: a write is staged, then published with a new manifest.

A folder holds ``batches``, one for each write, and ``manifests``, numbered from 1: for
every set that is there now, the batch that holds its rows. A set is named by its key. What
no manifest names isn't seen, so a write that fails or is still going on changes nothing
for readers, and a manifest appears as a whole, by renaming a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.operators.sets import keep_in, keep_out

#: What names an edge set.
SET = ("tool", "program", "version", "config_id")
#: Attempts to publish while others publish too.
ATTEMPTS = 20


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    folder = _path(spark, path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the target exists already."""
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, source), _path(spark, target), options)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that were published, in order."""
    return sorted(int(n) for n in _names(spark, f"{path}/manifests") if n.isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """Key, ``rows``, ``batch`` and ``shape`` (its columns) of every set, in the last manifest or a given one; None before the first."""
    found = version or max(versions(spark, path), default=None)
    return None if found is None else spark.read.parquet(f"{path}/manifests/{found:012d}")


def commit_sets(rows: DataFrame, path: str, key: Sequence[str] = SET, replace: bool = True, sets: DataFrame | None = None, layout: Sequence[str] = ("tool", "program")) -> int:
    """Write whole sets and publish them; gives the manifest's number.

    With ``replace`` the sets that are there already are replaced, and no others; without,
    they are left as they are and their rows in ``rows`` aren't written. ``sets`` names the
    sets of this write where ``rows`` may lack some: such a set is then there, but empty.
    Values of ``layout`` name folders within a batch, so that readers who want few of them
    read no others; rows are dealt so that each folder gets files of even size, however
    large it is. Null is a value of a key like any other.

    Two writers at a time both succeed: who comes second to publish takes the other's
    manifest for its base. If both write one set with ``replace``, the second stays; without,
    the first.
    """
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    before = manifest(spark, path)
    if not replace and before is not None:
        rows = keep_out(rows, before, key)
    folder, added = f"{path}/batches/{batch}", [f"in_{c}" for c in layout]
    dealt = rows.withColumns({a: F.col(c) for a, c in zip(added, layout, strict=True)}) if layout else rows
    (dealt.hint("rebalance", *added) if added else dealt).write.partitionBy(*added).parquet(folder)
    counts = spark.read.schema(rows.schema).parquet(folder).groupBy(*key).agg(F.count("*").alias("rows"))
    if sets is not None:
        named = sets.select(*key).distinct()
        named = named if replace or before is None else keep_out(named, before, key)
        counts = counts.unionByName(keep_out(named, counts, key).withColumn("rows", F.lit(0).cast("long")))
    own = counts.withColumns({"batch": F.lit(batch), "shape": F.lit(rows.schema.json())})
    for _ in range(ATTEMPTS):
        base = max(versions(spark, path), default=0)
        now = own
        if base:
            there = manifest(spark, path, base)
            now = keep_out(there, own, key).unionByName(own) if replace else there.unionByName(keep_out(own, there, key))
        staged = f"{path}/staged/{uuid.uuid4().hex}"
        now.write.parquet(staged)
        parent = _path(spark, f"{path}/manifests")
        parent.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(parent)
        if _renamed(spark, staged, f"{path}/manifests/{base + 1:012d}"):
            return base + 1
    raise RuntimeError(f"{path}: other writers published first {ATTEMPTS} times")


def read_sets(spark: SparkSession, path: str, key: Sequence[str] = SET, version: int | None = None, layout: Sequence[str] = ("tool", "program"), only: dict[str, str] | None = None) -> DataFrame:
    """Rows of all sets of the last manifest, or of a given one.

    ``only`` keeps rows with these values in key columns; where such a column is part of
    the layout, no other folder is read.
    """
    live = manifest(spark, path, version)
    if live is None:
        raise ValueError(f"{path}: nothing was published")
    wanted = F.lit(True)
    for c, value in (only or {}).items():
        wanted = wanted & F.col(c).eqNullSafe(F.lit(value))
    found = live.filter(wanted & (F.col("rows") > 0)).select("batch", "shape").distinct().collect()  # one for each write that still counts
    if not found:
        return spark.createDataFrame([], _shape(live.first()["shape"]))
    parts = None
    for batch, shape in found:
        # folders' names are read as text: Spark would take 007 for a number
        part = spark.read.schema(_shape(shape, [f"in_{c}" for c in layout])).parquet(f"{path}/batches/{batch}").withColumn("batch", F.lit(batch))
        for c in only or {}:
            if c in layout:
                part = part.filter(_in_folder(c, only[c]))
        part = keep_in(part.filter(wanted), live.filter(F.col("batch") == batch), [*key, "batch"])
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts.drop("batch", *[f"in_{c}" for c in layout])


def _shape(found: str, folders: Sequence[str] = ()) -> T.StructType:
    """A batch's columns, and those that folders name."""
    return T.StructType([*T.StructType.fromJson(json.loads(found)), *[T.StructField(f, T.StringType()) for f in folders]])


def _in_folder(column: str, value: str) -> Column:
    """The folder of a value; null and the empty text share one."""
    folder = F.col(f"in_{column}")
    return folder.isNull() if value in (None, "") else folder == F.lit(value).cast("string")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete earlier manifests and the batches that the last one doesn't name; gives the number of batches. No writer may be at work."""
    found = versions(spark, path)
    if not found:
        return 0
    live = {r["batch"] for r in manifest(spark, path, found[-1]).select("batch").distinct().collect()}
    gone = [b for b in _names(spark, f"{path}/batches") if b not in live]
    old = [f"{path}/batches/{b}" for b in gone] + [f"{path}/manifests/{v:012d}" for v in found[:-1]] + [f"{path}/staged"]
    for name in old:
        folder = _path(spark, name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)
