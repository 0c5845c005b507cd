"""Token counts of a document's sections by the offsets of its tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.byte_bpe import codec
from edgeloom.llm.common import documents, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Where a token that lies in several sections counts.
RULES = ("most", "first", "last", "split")


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters.

    The text is encoded once. Tokens are runs of bytes; a token that holds part of a
    character spans the whole of it, so spans of tokens that share a character overlap.
    """
    own = codec(path)
    lengths = np.array([len(own.tokens[i]) for i in np.frombuffer(own.encode(text), "<u4").tolist()], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    octets = np.frombuffer(text.encode(), np.uint8)
    leads = np.cumsum((octets & 0xC0) != 0x80)  # characters begun up to and with each byte
    if not len(ends):
        return begins, ends
    return leads[begins] - 1, leads[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str = "most") -> np.ndarray:
    """Tokens of each section: an interval join of two sorted lists.

    ``sections`` are (start, end) in order and don't overlap. A token counts for the
    section that it lies in. One that crosses a boundary counts by ``rule``: "most" for
    the section with most of its characters (of equal ones the earlier), "first" or "last"
    for the first or last one that it touches, "split" for each by its share of the
    characters in sections. A token outside all sections counts for none.
    """
    counts = np.zeros(len(sections))
    if not len(starts) or not sections:
        return counts
    edges = np.array(sections, np.int64)
    low = np.searchsorted(edges[:, 1], starts, side="right")
    high = np.searchsorted(edges[:, 0], ends, side="left") - 1
    inside = low == high
    counts += np.bincount(low[inside], minlength=len(sections))
    for token in np.flatnonzero(low < high):
        touched = np.arange(low[token], high[token] + 1)
        shared = np.minimum(edges[touched, 1], ends[token]) - np.maximum(edges[touched, 0], starts[token])
        touched, shared = touched[shared > 0], shared[shared > 0]
        if not len(touched):
            continue
        if rule == "split":
            counts[touched] += shared / shared.sum()
        else:
            counts[touched[0 if rule == "first" else -1 if rule == "last" else int(np.argmax(shared))]] += 1
    return counts


def line_sections(text: str) -> list[tuple[int, int]]:
    """The lines of a text with their line end, as sections that cover it."""
    sections, start = [], 0
    for line in text.split("\n"):
        sections.append((start, start + len(line) + 1))
        start += len(line) + 1
    sections[-1] = (sections[-1][0], len(text))
    return [s for s in sections if s[1] > s[0]]


def field_sections(fields: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Fields as one text, with a line end after each but the last, and a section for each field with its line end."""
    text, sections = "\n".join(fields), []
    start = 0
    for field in fields:
        sections.append((start, min(len(text), start + len(field) + 1)))
        start += len(field) + 1
    return text, sections


def given_sections(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Given spans in order, cut to the text; ``start`` and ``end`` in characters, end exclusive. Of two that overlap the later begins where the earlier ends."""
    found = sorted((max(0, x["start"]), min(length, x["end"])) for x in spans or [] if x and x["start"] is not None and x["end"] is not None)
    out, done = [], 0
    for start, end in found:
        if end > max(start, done):
            out.append((max(start, done), end))
            done = end
    return out


def _attributed(batches: Iterator[pa.RecordBatch], path: str, rule: str, kind: str) -> Iterator[pa.RecordBatch]:
    part = pa.struct([("section", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.float64())])
    for batch in slices(batches, 256):
        totals, found = [], []
        for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if kind == "fields":
                text, sections = field_sections([x or "" for x in row[0] or []])
            else:
                text = row[0] or ""
                sections = given_sections(row[1], len(text)) if kind == "spans" else line_sections(text)
            starts, ends = token_spans(text, path)
            counts = attribute(starts, ends, sections, rule).tolist()
            totals.append(len(starts))
            found.append([{"section": i, "start": s, "end": e, "tokens": n} for i, ((s, e), n) in enumerate(zip(sections, counts, strict=True))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(found, pa.list_(part))], names=["doc_id", "n_tokens", "sections"])


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, rule: str = "most", fields: Sequence[str] | None = None, spans: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``sections`` (section, start, end, tokens) of every whole text.

    Sections are the text's lines with their line ends; or the columns ``fields``, put
    together with a line end after each but the last; or the spans in the column ``spans``
    (array of structs with start and end in characters); a span that begins within an
    earlier one is cut to begin at its end, and one without characters is left out. Each
    document is encoded once, as a whole, and its tokens are allotted by their character
    offsets; ``n_tokens`` also counts tokens outside all sections. A null text or field
    counts as empty; a text without characters has no lines, an empty field has a section
    of its own; null spans are none. A null id is returned as null. Repeated rows give
    repeated results, an empty table an empty one. Other columns aren't read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    own = F.col(doc_id).alias("doc_id")
    if fields:
        shape, narrow = "fields", docs.select(own, F.array(*[F.col(c).cast("string") for c in fields]).alias("fields"))
    elif spans:
        shape, narrow = "spans", docs.select(own, F.col(text).cast("string").alias("text"), F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))).alias("spans"))
    else:
        shape, narrow = "lines", docs.select(own, F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return narrow.mapInArrow(lambda batches: _attributed(batches, path, rule, shape), f"doc_id {kind}, n_tokens long, sections array<struct<section:int,start:int,end:int,tokens:double>>")


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per section of every document: its place and its tokens; boundary tokens go where most of them lies."""
    rows = section_tokens(documents(spark, sf_dir))
    return rows.select("doc_id", "n_tokens", F.explode_outer("sections").alias("s")).select("doc_id", "n_tokens", "s.section", "s.start", "s.end", F.col("s.tokens").cast("long").alias("section_tokens"))
