"""Byte-level BPE encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, neutral, others, quoted, restored, slices

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The pattern for texts below U+0100, with its classes spelt out for the standard library, which splits faster.
LATIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+""".replace("{L}", "A-Za-zªµºÀ-ÖØ-öø-ÿ").replace("{N}", "0-9²³¹¼-¾").replace("{S}", r" \t-\r\x85\xa0")
#: Pieces of so many characters at most are kept with their ids, and so many of them per Python worker.
MEMO_CHARS, MEMO_PIECES = 48, 1_000_000
#: Adjacent-token verdicts kept per Python worker.
MEMO_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairCodec:
    """Encode and decode by the ranks of one vocabulary.

    A sequence of tokens is what the merges would give exactly if each two neighbours may
    stand side by side (see ``fits``). So a piece is covered from the left by the longest
    token that begins there, found in an automaton over the bytes as Latin-1; where a
    neighbour doesn't fit, the next shorter token that is a prefix is tried, then the
    token before is taken back. A position that led nowhere is never tried again, so the
    work is linear in the piece.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.split_latin = re.compile(LATIN_PATTERN).findall if pattern == public_tokenizers.PATTERN else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        # the last merge that makes a token; entries that merges can't reach count only as whole pieces
        self.parts: dict[int, tuple[int, int] | None] = {}
        for token, rank in ranks.items():
            parts = self._merge(token)
            if len(token) == 1 or len(parts) == 2 and ranks.get(parts[0] + parts[1]) == rank:
                self.parts[rank] = None if len(token) == 1 else (ranks[parts[0]], ranks[parts[1]])
        self.matcher = ahocorasick.Automaton()
        known = {self.tokens[rank]: rank for rank in self.parts}
        for token, rank in known.items():
            self.matcher.add_word(token.decode("latin-1"), rank)
        self.known, self.widest = known, max(map(len, known))
        # the longest proper prefix that is a token itself
        self.shorter = {rank: next((known[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in known), None) for token, rank in known.items()}

    def _merge(self, token: bytes) -> list[bytes]:
        """The merges as defined, up to the last two parts: lowest rank first, leftmost of equals."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            if (least := min(joined)) == 1 << 60:
                break
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, latest first, and look whether one across their border would have come first.

        The parts at the border last until the next merge of their own side; a merge
        across the border wins below the rank of that on the left and up to that on the
        right, since of equal ranks the leftmost goes first.
        """
        left_ends = right_ends = 1 << 60
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < left_ends and across <= right_ends:
                return False
            left_parts, right_parts = self.parts[left], self.parts[right]
            if left_parts and (not right_parts or left > right):
                left_ends, left = left, left_parts[1]
            elif right_parts:
                right_ends, right = right, right_parts[0]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives the same two tokens."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._fits(left, right)
        return found

    def longest(self, piece: bytes, at: int) -> int:
        """The longest token that begins at a place."""
        ahead = piece[at : at + self.widest]
        size = self.matcher.longest_prefix(ahead.decode("latin-1"))
        while (found := self.known.get(ahead[:size])) is None:
            size -= 1
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ids: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, self.longest(piece, 0)
        while True:
            end = at + len(self.tokens[token])
            if not dead[end] and (not ids or self.fits(ids[-1], token)):
                ids.append(token)
                if (at := end) == len(piece):
                    return ids
                token = self.longest(piece, at)
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                dead[at] = 1
                token = ids.pop()
                at -= len(self.tokens[token])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        split = self.split_latin if self.split_latin and (text.isascii() or max(text) < "\u0100") else self.split
        pieces, known = split(text), self.pieces
        found = list(map(known.get, pieces))
        if None in found:
            if len(known) >= MEMO_PIECES:
                known.clear()
            for i, piece in enumerate(pieces):
                if found[i] is None:
                    ids = known.get(piece) or array("I", self.encode_piece(piece.encode())).tobytes()
                    found[i] = ids
                    if len(piece) <= MEMO_CHARS:
                        known[piece] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec per Python worker and vocabulary."""
    return BytePairCodec(read_ranks(path))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches, 256):
        ids = [own.encode(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
        flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32, copy=False))
        ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
        decoded = [own.decode(x) for x in ids]
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in data]) for data in (ids, decoded)]
        counts = pa.array([len(x) // 4 for x in ids], pa.int64())
        arrays = [*batch.columns[:-1], counts, pa.ListArray.from_arrays(ends, flat), *digests]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in _encoded(batches, path):
        yield batch.drop_columns(["ids"])


def encode_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None, ids: bool = True) -> DataFrame:
    """The other columns of ``docs`` with ``n_tokens``, ``ids`` (if asked for), ``ids_sha256`` and ``decoded_sha256``.

    ``vocabulary``: path of a rank file that every executor can read. A null text counts
    as empty; a text of any length is encoded whole, piece by piece. Repeated rows are
    kept and an empty table gives an empty table. Columns named like the added ones, in
    whatever case, are replaced; others may bear any name.
    """
    path = vocabulary or public_tokenizers.path(RANKS)
    kept = others(docs.columns, (text, "n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    plain, _ = neutral(docs.select(*[F.col(quoted(c)) for c in kept], F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("_text")))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema[:-1]]
    added = ["n_tokens long", *["ids array<int>"] * ids, "ids_sha256 string", "decoded_sha256 string"]
    found = plain.mapInArrow(lambda batches: (_encoded if ids else _digests)(batches, path), ", ".join([*kinds, *added]))
    return restored(found, dict(zip(kept, plain.columns, strict=False)), [a.split()[0] for a in added])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches, 256):
        found = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.decode("utf-8", "replace") for x in found])], names=[*batch.schema.names[:-1], "text"])


def decode_documents(encoded: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The other columns of ``encoded`` with ``text``, what the token ids stand for.

    Ids that no text has, cut within a character, decode to replacement characters there.
    Null ids count as none. A column ``text`` is replaced; others may bear any name. An
    empty table gives an empty one.
    """
    path = vocabulary or public_tokenizers.path(RANKS)
    kept = others(encoded.columns, (ids, "text"))
    plain, _ = neutral(encoded.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(ids)).alias("_ids")))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema[:-1]]
    found = plain.mapInArrow(lambda batches: _decoded(batches, path), ", ".join([*kinds, "text string"]))
    return restored(found, dict(zip(kept, plain.columns, strict=False)), ["text"])


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document, as digests, and the digest of what they decode to."""
    return encode_documents(documents(spark, sf_dir).select("doc_id", "text"), ids=False)
