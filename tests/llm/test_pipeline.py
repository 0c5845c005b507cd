import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline
from edgeloom.llm import pii

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rng = random.Random(6)
    words = ["the", "of", "and", *("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(60, 150)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(200, "short", "en", "s0"), (201, None, None, None), (202, "#$%& " * 200, "en", "s1"), (203, text(80) + " mail me: joe@example.org or +1 (555) 123-4567", None, "s2")]
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOC)


def test_stages_one_by_one(spark):
    docs = corpus(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    good = stages["quality rules"](spark, docs, "")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert good.columns == docs.columns and ids(good) == [*range(60), *range(100, 110), 203]
    single = stages["SimHash near-dedup"](spark, good, "")
    assert single.columns == docs.columns and ids(single) == [*range(60), 203]
    masked = stages["PII"](spark, single, "")
    text = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert text[203].endswith("mail me: [EMAIL] or [PHONE]") and all(text[r["doc_id"]] == r["text"] for r in single.collect() if r["doc_id"] != 203)
    mixed = stages["mixing sources to target weights"](spark, masked, "")
    times, size = Counter(ids(mixed)), {i: len(t.split()) for i, t in text.items()}
    assert mixed.columns == docs.columns and max(times.values()) <= 2
    total = sum(n * size[i] for i, n in times.items())
    assert abs(total - 1.5 * sum(size.values())) < 3 * max(size.values())
    tokens = stages["byte-level BPE encoding and decoding"](spark, mixed, "")
    for r in tokens.collect():
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"]


def test_run_and_empty_table(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "full" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).count() > 60
    corpus(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def plain_quality(rows):
    """Kept rows, by counting everything in plain dictionaries."""
    kinds = {c: k for k, cs in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\n\x0b\x0c\r"), ("punctuation", ".,;:!?'\"()-"), ("symbol", "#*$%&|<>@^_~`+=/\\{}[]")) for c in cs}
    letters = lambda w: w.lower().strip(".,;:!?'\"()-#*$%&|<>")
    classes, words = {}, {}
    for _, text, lang, *_ in rows:
        for of in {lang, "*"} - {None}:
            classes.setdefault(of, Counter()).update(kinds.get(c, "other") for c in text or "")
            words.setdefault(of, Counter()).update(map(letters, (text or "").split()))

    def distance(a, b):
        a_sum, b_sum, total = sum(a.values()), sum(b.values()), 0.0
        if not a_sum or not b_sum:
            return 0.0
        for k in {*a, *b}:
            p, q = a.get(k, 0) / a_sum, b.get(k, 0) / b_sum
            total += sum(x * math.log2(2 * x / (p + q)) for x in (p, q) if x) / 2
        return math.sqrt(max(0.0, total))

    kept = []
    for row in rows:
        text, of = row[1] or "", row[2] if row[2] else "*"
        own = text.split()
        fives = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        repeated = {i + k for i, w in enumerate(fives) if fives.count(w) > 1 for k in range(5)}
        if len(own) < 10 or 100 * len(repeated) > 20 * len(own):
            continue
        if len(text) >= 200 and distance(Counter(kinds.get(c, "other") for c in text), classes[of]) > 0.3:
            continue
        common = dict(sorted(words[of].items(), key=lambda x: (-x[1], x[0].encode()))[:100])
        fold = lambda counts: Counter({w: counts[w] for w in common} | {None: sum(counts.values()) - sum(counts[w] for w in common)})  # noqa: B023, E731
        if len(own) >= 40 and distance(fold(Counter(map(letters, own))), fold(words[of])) > 0.52:
            continue
        kept.append(row)
    return kept


def plain_print(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_dedup(rows):
    prints = [plain_print(r[1] or "") for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min((r for r, h in zip(rows, group, strict=True) if h == g), key=lambda r: r[0]) for g in set(group)]


def plain_masked(rows):
    found = {r[0]: pii.candidates(r[1], pii.base_spans(r[1])) for r in rows}
    patterns, posterior = Counter((k, votes) for spans in found.values() for _, k, _, votes, _ in spans), {}
    for kind in sorted({k for k, _ in patterns}):
        own = sorted(v for k, v in patterns if k == kind)
        votes = np.array([[v // 3**i % 3 - 1 for i in range(len(pii.LABELERS))] for v in own])
        chance, _, _ = pii.label_model(votes, np.array([float(patterns[kind, v]) for v in own]))
        posterior |= {(kind, v): p for v, p in zip(own, chance.tolist(), strict=True)}
    sample = sorted(Counter((k, v, tuple(f)) for spans in found.values() for _, k, _, v, f in spans).items())
    model = pii.SpanModel(pii.fit_classifier([list(f) for (_, _, f), _ in sample], np.array([posterior[k, v] for (k, v, _), _ in sample]), np.array([float(n) for _, n in sample])), {}, {})
    return [(r[0], pii.mask(r[1], pii.all_spans(pii.base_spans(r[1]), found[r[0]], model)), *r[2:]) for r in rows]


def plain_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    clamped = set()
    while True:
        free = [s for s in order if s not in clamped]
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in clamped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            break
        clamped |= above
    out = []
    for s in order:
        target = 2 * sizes[s] if s in clamped else level * weight[s]
        whole = int(target // sizes[s])
        rest = int(target) - whole * sizes[s]
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest()):
            size = len(r[1].split())
            part = max(0, min(size, rest))
            rest -= size
            out += [r] * int((whole * size + part) / size + 0.5)
    return out


def test_run_equals_a_plain_version(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = plain_mix(plain_masked(plain_dedup(plain_quality([tuple(r) for r in docs.collect()]))))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, text, lang, source, _ in rows:
        ids = coder.encode_ordinary(text)
        wanted.append((i, lang, source, len(text), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = [(r["doc_id"], r["lang"], r["source"], r["n_chars"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))
