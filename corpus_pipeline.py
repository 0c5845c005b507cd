"""From raw documents to token ids: quality rules, near-duplicates, personal data, source mix, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.byte_bpe import encode_documents
from edgeloom.llm.common import documents, durable, neutral, restored
from edgeloom.llm.mixing import mix_sources, repetitions, word_count
from edgeloom.llm.pii import mask_personal_data
from edgeloom.llm.quality import quality_rules
from edgeloom.llm.simhash import one_of_each


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    plain, names = neutral(docs)
    return restored(quality_rules(plain, names["text"], names["lang"]).filter("kept"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return one_of_each(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    return mask_personal_data(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    plain, names = neutral(docs)
    sized = plain.withColumn("size", word_count(F.col(names["text"])))
    mixed = mix_sources(sized, source=names["source"], doc_id=names["doc_id"])
    return restored(repetitions(mixed, "size", list(names.values())), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", mask_private),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: Expectation-maximisation, the span classifier and byte-pair merges have no SQL form; tests/llm compares a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
