"""Personal data: base patterns, and further spans learned by weak supervision."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, durable, neutral, quoted, restored, slices, texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the learned classifier adds.
ADDED_KINDS = ("secret", "account", "name")
KINDS = BASE_KINDS + ADDED_KINDS

# ---- base patterns: linear forms of the patterns in the docstring of find_personal_data

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: the name can't hold an @, so it is the run of its characters before one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the base patterns' matches, in order."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# ---- candidates and labelers

#: First names and forms of address: fixed values of the gazetteer labelers.
FIRST_NAMES = frozenset("Alice Andrea Anna Antonio Barbara Carlos Carmen Charles Christine Daniel David Elena Elizabeth Emma Francisco François George Hans Isabelle James Jean Jennifer John José Juan Julia Karl Klaus Laura Linda Louis Lucas Luis Manuel Maria María Marie Martin Mary Michael Michel Miguel Monika Nathalie Nicolas Patricia Paul Peter Petra Philippe Pierre Robert Sabine Sarah Sofia Sophie Stefan Susan Thomas Ursula William Wolfgang".split())
TITLES = ("mr.", "mrs.", "ms.", "dr.", "prof.", "herr", "frau", "monsieur", "madame", "señor", "señora", "don", "doña")
CUES = {
    "secret": re.compile(r"(?i)(?:token|password|passwd|passwort|contraseña|secret|api[_ -]?key|access[_ -]?key|credential)\W{0,6}\Z"),
    "account": re.compile(r"(?i)(?:account|konto|kontonummer|compte|cuenta|iban|card|karte|carte|tarjeta|passport|ssn|número|nummer|numéro)\W{0,6}\Z"),
    "name": re.compile(r"(?i)(?:name is|my name|called|contact|signed|regards|author|heiße|je m'appelle|me llamo|mr\.|mrs\.|ms\.|dr\.|prof\.|herr|frau|monsieur|madame|señora?|don|doña)\W{0,3}\Z"),
}
_ASSIGNED = re.compile(r"[=:]\s*[\"']?\Z")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_VALUE = re.compile(r"(?i)(?:token|password|passwd|passwort|secret|key)\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{6,})")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){8,18}(?![0-9A-Za-z])")
_CAPITALS = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]+(?: [A-ZÀ-Þ][a-zà-ÿ]+)*")
LABELERS = ("pattern", "context", "assignment", "gazetteer", "variety", "form")
#: Slots of the classifier's hashed features, and candidates that it is fitted on at most.
FEATURES, MAX_FITTED = 1 << 12, 50_000
CONTEXT_CHARS = 24


def _candidate_places(text: str) -> Iterator[tuple[str, int, int]]:
    has_digit = _DIGIT.search(text) is not None
    if has_digit:
        for m in _OPAQUE.finditer(text):
            if _DIGIT.search(m[0]) and not m[0].isdigit():
                yield "secret", m.start(), m.end()
        for m in _NUMBER.finditer(text):
            yield "account", m.start(), m.end()
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            yield "secret", m.start(1), m.end(1)
    for m in _CAPITALS.finditer(text):
        words = m[0].split(" ")
        known = next((i for i, w in enumerate(words) if w in FIRST_NAMES), None)
        if known is not None:
            yield "name", m.start() + sum(len(w) + 1 for w in words[:known]), m.end()
        elif text[max(0, m.start() - 9) : m.start()].lower().rstrip().endswith(TITLES):
            yield "name", m.start(), m.end()


def _entropy(value: str) -> float:
    counts = np.unique(list(value), return_counts=True)[1] / len(value)
    return float(-(counts * np.log2(counts)).sum())


def _votes(kind: str, value: str, before: str, variety: float) -> tuple[int, ...]:
    """A vote for each of LABELERS: 1 personal, -1 not, 0 no opinion."""
    digits = sum(c.isdigit() for c in value)
    if kind == "secret":
        pattern = 1 if re.fullmatch(r"[0-9a-fA-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/]{20,}", value) else 0
        form = -1 if re.fullmatch(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}|[A-Za-z/_-]+", value) else 1 if digits >= 4 and digits < len(value) else 0
        gazetteer, spread = 0, 1 if variety >= 3 else -1 if variety < 2 else 0
    elif kind == "account":
        plain = value.replace(" ", "").replace("-", "")
        pattern = 1 if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", value) else 0
        groups = re.split("[ -]", value)
        # few different digits are a filler; groups of one length, the last aside, are how such numbers are written
        form = -1 if len(set(plain)) <= 2 else 1 if len(groups) > 2 and len({len(g) for g in groups[:-1]}) == 1 else 0
        gazetteer, spread = 0, 0 if variety >= 1.5 else -1
    else:
        words = value.split(" ")
        pattern = 1 if 2 <= len(words) <= 3 else 0
        form = -1 if len(words) > 4 else 0
        gazetteer, spread = 1 if words[0] in FIRST_NAMES else -1, 0
    return pattern, 1 if CUES[kind].search(before) else -1 if kind == "account" else 0, 1 if _ASSIGNED.search(before) else 0, gazetteer, spread, form


def _shape(value: str) -> str:
    """The kinds of its runs of letters, digits and signs in order; of many runs the first and last, and how many about."""
    runs = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x", value)
    shape = re.sub(r"[0-9]+", "9", runs)
    return shape if len(shape) <= 16 else f"{shape[:6]}~{len(shape).bit_length()}~{shape[-6:]}"


def _features(kind: str, value: str, before: str, after: str, variety: float) -> list[int]:
    """Hashed features of a span and its surroundings, independent of the labelers' verdicts."""
    words = re.findall(r"\w+|[^\w\s]", before.lower())[-2:]
    named = [f"shape={_shape(value)}", f"length={min(40, len(value)) // 4}", f"variety={int(variety * 2)}", f"digits={4 * sum(c.isdigit() for c in value) // len(value)}", f"after={after[:1]}", f"first={value[0].isupper()}{value[0].isdigit()}", *[f"word{i}={w}" for i, w in enumerate(reversed(words))], "bias"]
    return sorted({xxhash.xxh32_intdigest(f"{kind}|{x}") % FEATURES for x in named})


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, place in KINDS, end, votes as base-3 digits, features) of spans outside the base spans."""
    found, seen, at = [], set(), 0
    for start, kind, end in sorted({(s, k, e) for k, s, e in _candidate_places(text)}):
        while at < len(base) and base[at][2] <= start and base[at][0] < start:
            at += 1
        if any(s < end and start < e for s, _, e in base[max(0, at - 2) : at + 8]) or (start, kind) in seen:
            continue
        seen.add((start, kind))
        value, before, after = text[start:end], text[max(0, start - CONTEXT_CHARS) : start], text[end : end + 1]
        variety = _entropy(value)
        code = sum((v + 1) * 3**i for i, v in enumerate(_votes(kind, value, before, variety)))
        found.append((start, KINDS.index(kind), end, code, _features(kind, value, before, after, variety)))
    return found


# ---- the model

@dataclass(frozen=True)
class SpanModel:
    """Weights of the final span classifier, and what expectation-maximisation made of the labelers."""

    weights: np.ndarray
    reliability: dict[str, dict[str, float]]
    prior: dict[str, float]

    def accepts(self, features: list[int]) -> bool:
        return float(self.weights[features].sum()) > 0


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, P(vote | class) by labeler, and the share of personal spans.

    Expectation-maximisation of a two-class model in which labelers vote independently
    given the class. It begins with the balance of votes, so that classes keep their
    meaning, and counts two votes of each labeler in that sense beforehand.
    """
    posterior = 1 / (1 + np.exp(-votes.sum(axis=1)))
    values = np.arange(-1, 2)
    is_vote = votes[:, :, None] == values
    start = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])[:, None, :]
    for _ in range(rounds):
        of = np.stack([counts * (1 - posterior), counts * posterior])
        tables = np.einsum("cp,plv->clv", of, is_vote) + start
        tables /= tables.sum(axis=2, keepdims=True)
        prior = (of[1].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("plv,clv->cp", is_vote, np.log(tables)) + np.log([1 - prior, prior])[:, None]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, tables, float(prior)


def fit_classifier(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on hashed features and probabilistic labels."""
    weights = np.zeros(FEATURES)
    if not rows:
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slots = np.concatenate([np.array(r, np.int64) for r in rows])
    memory = np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[slots], len(rows)), -30, 30)))
        slope = np.bincount(slots, (weight * (p - target))[owner], FEATURES) / weight.sum() + decay * weights
        memory += slope**2
        weights -= rate * slope / np.sqrt(memory)
    return weights


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    found = pa.struct([*span, ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])
    for batch in slices(batches):
        own = [(b, candidates(t, b)) for t in texts(batch.column(1)) for b in (base_spans(t),)]
        base = pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in b] for b, _ in own], pa.list_(span))
        more = pa.array([[dict(zip(("start", "kind", "end", "votes", "features"), s, strict=True)) for s in c] for _, c in own], pa.list_(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), base, more], names=["doc_id", "base", "candidates"])


def label_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``base`` spans and ``candidates`` with votes and features, of every row."""
    narrow = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return narrow.mapInArrow(_labelled, f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,kind:int,end:int,votes:int,features:array<int>>>")


def fit_span_model(labelled: DataFrame, max_fitted: int = MAX_FITTED) -> SpanModel:
    """Reliabilities from the vote patterns of all candidates, then the span classifier.

    Patterns are counted by Spark over all candidates: 3 ** 6 of them a kind at most reach
    the driver. The classifier is fitted on about ``max_fitted`` candidates, chosen by a
    hash of their id and place.
    """
    spans = labelled.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    share = min(1.0, max_fitted / max(1, sum(r["n"] for r in patterns)))
    chosen = F.pmod(F.xxhash64("doc_id", "start", "end"), F.lit(1_000_003)) < math.ceil(share * 1_000_003)
    sample = spans.filter(chosen).groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).orderBy("kind", "votes", "features").collect()
    posterior, reliability, prior = {}, {}, {}
    for kind in sorted({r["kind"] for r in patterns}):
        own = [r for r in patterns if r["kind"] == kind]
        votes = np.array([[r["votes"] // 3**i % 3 - 1 for i in range(len(LABELERS))] for r in own])
        found, tables, prior[KINDS[kind]] = label_model(votes, np.array([float(r["n"]) for r in own]))
        posterior |= {(kind, r["votes"]): p for r, p in zip(own, found.tolist(), strict=True)}
        reliability[KINDS[kind]] = {name: float(tables[1, i, 2] / (tables[1, i, 2] + tables[0, i, 2])) for i, name in enumerate(LABELERS)}
    target = np.array([posterior[r["kind"], r["votes"]] for r in sample])
    weights = fit_classifier([r["features"] for r in sample], target, np.array([float(r["n"]) for r in sample]))
    return SpanModel(weights, reliability, prior)


def all_spans(base: list[tuple[int, int, int]], found: list[tuple], model: SpanModel) -> list[tuple[int, int, int]]:
    """Base spans and the candidates that the classifier accepts, by start, then kind."""
    return sorted([*base, *((s, k, e) for s, k, e, _, features in found if model.accepts(features))])


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _answers(batches: Iterator[pa.RecordBatch], model: SpanModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [([(x["start"], x["kind"], x["end"]) for x in base], [tuple(x.values()) for x in more]) for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in rows], pa.int64()) for k in range(len(BASE_KINDS))]
        digests = pa.array([hashlib.sha256(_text_of(base).encode()).hexdigest() for base, _ in rows])
        spans = pa.array([_text_of(all_spans(base, more, model)) for base, more in rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts (``n_email`` ...), ``base_sha256`` and all ``spans`` of every row.

    Base spans are the leftmost matches of a kind that don't overlap: email
    ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ip four dotted numbers up to
    255, card 12 to 19 digits that pass Luhn, phone a plus and 9 to 15 digits. Weak
    supervision adds secrets, account numbers and names: regex, gazetteer and context
    labelers vote on candidates outside the base spans, expectation-maximisation
    estimates how far each can be trusted, and a span classifier fitted on the resulting
    probabilities decides. Added kinds bear names of their own, so the counts are those
    of the base.

    Nulls: a null text counts as empty (no spans); a null id is returned as null.
    Repeated rows give repeated results, an empty table an empty one. Other columns
    aren't read. Texts of any length are searched whole in linear time.
    """
    labelled = durable(label_spans(docs, doc_id, text), "pii-labelled")
    model = fit_span_model(labelled)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"n_{k} long" for k in BASE_KINDS), "base_sha256 string", "spans string"])
    return labelled.mapInArrow(lambda batches: _answers(batches, model), schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _masked(batches: Iterator[pa.RecordBatch], model: SpanModel) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        clean = [t if t is None else mask(t, all_spans(b, candidates(t, b), model)) for t in batch.column(batch.num_columns - 1).to_pylist() for b in (base_spans(t or ""),)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(clean, pa.string())], names=batch.schema.names)


def mask_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans masked in ``text``, and ``length`` (if there is such a column) set anew. Null texts stay null. Other columns may bear any name."""
    model = fit_span_model(durable(label_spans(docs, doc_id, text), "pii-labelled"))
    plain, names = neutral(docs)
    own = names[text]
    moved = plain.select(*[c for c in plain.columns if c != own], F.col(own).cast("string").alias(own))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moved.schema)
    masked = moved.mapInArrow(lambda batches: _masked(batches, model), kinds)
    if length in names:
        masked = masked.withColumn(names[length], F.length(own).cast(docs.schema[length].dataType))
    return restored(masked, names)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document of the table."""
    return find_personal_data(documents(spark, sf_dir))
