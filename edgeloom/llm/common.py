"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.storage import durable as durable

#: A word of a text: a run without ASCII white space. ``bytes.split()`` splits alike.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that are turned into Python objects at once, unless one row has more.
SLICE_BYTES = 1 << 24


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_hash(doc_id: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def quoted(name: str) -> str:
    """A column's name as Spark's parsers read it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` bears, in whatever case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under column names that no operator adds, and the new name of each column."""
    plain = [f"column_{i}" for i in range(len(df.columns))]
    return df.toDF(*plain), dict(zip(df.columns, plain, strict=True))


def restored(df: DataFrame, names: dict[str, str], added: Iterable[str] = ()) -> DataFrame:
    """The columns that ``neutral`` renamed, under their own names, and those added."""
    return df.select(*[F.col(new).alias(old) for old, new in names.items()], *added)


def others(columns: Iterable[str], replaced: Iterable[str]) -> list[str]:
    """The columns but for those that bear a replaced name, in whatever case."""
    gone = {c.lower() for c in replaced}
    return [c for c in columns if c.lower() not in gone]


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, by rows and by bytes, so that long texts don't pile up as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            parts = [batch.slice(start, rows)]
            while parts:
                part = parts.pop()
                if part.num_rows > 1 and part.nbytes > most:
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
