"""Near-duplicate groups by SimHash and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, durable, own_names, quoted, slices, utf8
from edgeloom.llm.components import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
BITS = 64
#: Fingerprints that differ in so many bits at most are linked. The method below is exact for 2.
MAX_DISTANCE = 2
SEGMENTS, SEGMENT_BITS = 2, 32
#: Prints of one segment value above which the value is split by the other segment.
HEAVY = 8


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, word shingles with repeats, XXH64.

    A text of fewer words than a shingle is one shingle; a text without words gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), HASH_SEED) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        bits = np.concatenate([bits, np.zeros((-len(bits) % 255, BITS), np.uint8)])
        # eight bit counters side by side in each 64-bit number: 255 rows can't overflow one
        ones += bits.view(np.uint64).reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``print`` (the 64 bits as a signed long) of every row."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, print long")


def _segment(bits: Column, number: int | Column) -> Column:
    """The value of a segment of a print, 0 to 2 ** 32 - 1."""
    shifted = F.when(F.lit(number) == 0, bits).otherwise(F.shiftrightunsigned(bits, SEGMENT_BITS))
    return shifted.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _ball(value: Column) -> Column:
    """A segment value and all that differ from it in one bit."""
    return F.transform(F.array(*[F.lit(flip).cast("long") for flip in (0, *(1 << i for i in range(SEGMENT_BITS)))]), lambda flip: value.bitwiseXOR(flip))


def fingerprint_links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Links (``src``, ``dst``) that join all distinct ``print`` at 2 or fewer differing bits.

    Multi-index hashing: a print is cut into two segments of 32 bits, and a table holds
    every print under (segment, value). Of two prints at distance 2 or less, one segment
    differs in one bit at most. So each print looks up the ball of radius 1 around its
    value in each segment, 33 values, fetches what the table has there, and the complete
    distance of each pair is verified.

    A value that more than ``heavy`` prints share, as in a dense group of near copies,
    would meet its whole ball in pairs. Its rows are split by the other segment instead:
    those that have the value itself enumerate the ball of their other segment, those that
    came one bit off keep theirs. Two prints within distance 2 that meet under a heavy
    value always share such an entry, and all prints of an entry are within distance 2 of
    each other, so each is linked to the entry's least one: rows grow with the prints, no
    entry has more than 66 of them, and nothing is dropped.
    """
    segments = F.posexplode(F.array(*[_segment(F.col("print"), i) for i in range(SEGMENTS)])).alias("segment", "value")
    table = prints.select("print", segments)
    hot = durable(table.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("segment", "value"), "simhash-heavy")
    probes = table.select("print", "segment", F.col("value").alias("home"), F.explode(_ball(F.col("value"))).alias("value"))
    light = table.join(hot, ["segment", "value"], "left_anti").withColumnRenamed("print", "other")
    met = probes.join(light.hint("shuffle_hash"), ["segment", "value"]).filter(F.col("print") > F.col("other"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= MAX_DISTANCE
    pairs = met.filter(near).select(F.col("print").alias("src"), F.col("other").alias("dst"))

    rest = _segment(F.col("print"), 1 - F.col("segment"))
    members = probes.join(hot, ["segment", "value"], "left_semi").withColumn("rest", rest)
    entries = members.select("print", "segment", "value", F.explode(F.when(F.col("home") == F.col("value"), _ball(F.col("rest"))).otherwise(F.array("rest"))).alias("rest"))
    least = F.min("print").over(Window.partitionBy("segment", "value", "rest"))
    split = entries.withColumn("least", least).filter("print <> least")
    verified = F.bit_count(F.col("print").bitwiseXOR(F.col("least"))) <= MAX_DISTANCE
    return pairs.unionByName(split.filter(verified).select(F.col("print").alias("src"), F.col("least").alias("dst"))).distinct()


def print_components(prints: DataFrame) -> DataFrame:
    """``print``, ``component`` and ``component_id`` (least id of the component) of every distinct print.

    ``prints``: ``doc_id`` and ``print`` of all rows. Rows of one print are a class that
    enters the search once, whatever its size. Joins by component have one row per key on
    one side; the other, on which a component with most of the prints is one key, is one
    that adaptive execution splits.
    """
    classes = durable(prints.groupBy("print").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    links = durable(fingerprint_links(classes.select("print")), "simhash-links")
    found = connected_components(links).withColumnRenamed("node", "print")
    labelled = durable(classes.join(found, "print", "left"), "simhash-labelled")
    linked = labelled.filter("component is not null")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    alone = labelled.filter("component is null").select("print", F.col("print").alias("component"), F.col("rep").alias("component_id"))
    return linked.join(least, "component").select("print", "component", "component_id").unionByName(alone)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id that can be reached over links between equal
    fingerprints or such at 2 or fewer differing bits, the row's own included.

    Ids may be of any type that has an order. Nulls: a null text counts as empty
    (fingerprint zero, linked like any other); a null id never names a component unless
    all its ids are null. Repeated rows are kept. An empty table gives an empty table.
    Other columns aren't read, so their names can't clash.
    """
    prints = durable(fingerprints(docs, doc_id, text), "simhash-prints")
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0")
    return prints.join(print_components(prints), "print").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _print_of(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint((t or "").encode()) for t in text], np.uint64).view(np.int64))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id.

    Of rows that repeat this id, or of a group in which every id is null, the first in
    the order of the other columns stays. A null text counts as empty: all rows without
    words are one group. Columns may bear any name. An empty table gives an empty one.
    """
    prints = durable(fingerprints(docs, doc_id, text), "simhash-prints")
    components = durable(print_components(prints), "simhash-components")
    repeated = prints.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    kept, bits, component, least, rank = own_names(docs, "_kept", "_print", "_component", "_least", "_rank")
    if repeated.isEmpty():
        # ids name rows: the text needs neither a second hashing nor a sort
        return docs.join(components.select(F.col("component_id").alias(kept)).distinct(), F.col(doc_id) == F.col(kept), "left_semi")
    marked = docs.withColumn(bits, F.pandas_udf(_print_of, "long")(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    found = marked.join(components.select(F.col("print").alias(bits), F.col("component").alias(component), F.col("component_id").alias(least)), bits)
    found = found.filter(F.col(doc_id).eqNullSafe(F.col(least)))
    first = F.row_number().over(Window.partitionBy(component).orderBy(*[F.col(quoted(c)) for c in docs.columns]))
    return found.withColumn(rank, first).filter(F.col(rank) == 1).select(*[F.col(quoted(c)) for c in docs.columns])


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document of the whole table."""
    return near_duplicates(documents(spark, sf_dir))
