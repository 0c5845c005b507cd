import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import attribution as at

PATH = public_tokenizers.path(at.VOCABULARY)


def encoding():
    from edgeloom.llm.byte_bpe import codec

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec(PATH).ranks, special_tokens={})


def plain(text, sections, rule):
    """Bytes of each token located one by one, and each section asked about each token."""
    enc, counts, done = encoding(), [0.0] * len(sections), 0
    owner = [i for i, ch in enumerate(text) for _ in ch.encode()]
    for token in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(token))
        chars = sorted(set(owner[done : done + size]))
        done += size
        shared = [sum(s <= c < e for c in chars) for s, e in sections]
        hit = [i for i, n in enumerate(shared) if n]
        if not hit:
            continue
        if rule == "split":
            for i in hit:
                counts[i] += shared[i] / sum(shared)
        else:
            counts[{"first": hit[0], "last": hit[-1], "most": max(hit, key=lambda i: (shared[i], -i))}[rule]] += 1
    return counts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "\n", "\n\n", "é", "日本", "😀", "123", " the", "."]), max_size=40).map("".join), st.sampled_from(at.RULES))
def test_counts_equal_brute_force(text, rule):
    sections = at.line_sections(text)
    starts, ends = at.token_spans(text, PATH)
    assert np.allclose(at.attribute(starts, ends, sections, rule), plain(text, sections, rule))
    if rule != "split" and text:
        assert at.attribute(starts, ends, sections, rule).sum() == len(encoding().encode_ordinary(text))


def test_gaps_between_sections():
    text = "alpha beta gamma delta"
    sections = [(2, 8), (14, 19)]
    starts, ends = at.token_spans(text, PATH)
    for rule in at.RULES:
        assert np.allclose(at.attribute(starts, ends, sections, rule), plain(text, sections, rule))


def test_operator_edge_cases(spark):
    df = spark.createDataFrame([(1, "one two\nthree", 5), (None, None, 5), (2, "", 5), (1, "one two\nthree", 5)], "doc_id long, text string, sections int")
    found = at.section_tokens(df).collect()
    assert len(found) == 4
    one = next(r for r in found if r["doc_id"] == 1)
    assert one["n_tokens"] == sum(s["tokens"] for s in one["sections"]) and [(s["start"], s["end"]) for s in one["sections"]] == [(0, 8), (8, 13)]
    assert all(r["sections"] == [] and r["n_tokens"] == 0 for r in found if r["doc_id"] in (None, 2))
    assert at.section_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        at.section_tokens(df, rule="none")


def test_fields_and_given_spans(spark):
    rows = [(1, "The river", "stone hills walk", [(4, 9), (0, 3)]), (2, None, "x", None), (3, "", "", [(0, 5)]), (None, "a", None, [(None, 1)])]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string, marks array<struct<start:int,end:int>>")
    found = {r["doc_id"]: r for r in at.section_tokens(df, fields=["title", "body"]).collect()}
    assert [(x["start"], x["end"]) for x in found[1]["sections"]] == [(0, 10), (10, 26)] and [(x["start"], x["end"]) for x in found[2]["sections"]] == [(0, 1), (1, 2)]
    for r in found.values():
        assert sum(x["tokens"] for x in r["sections"]) == r["n_tokens"]
    marked = {r["doc_id"]: r for r in at.section_tokens(df, text="title", spans="marks").collect()}
    assert [(x["section"], x["start"], x["end"], x["tokens"]) for x in marked[1]["sections"]] == [(0, 0, 3, 1.0), (1, 4, 9, 1.0)]
    assert all(marked[i]["sections"] == [] for i in (2, 3, None))
    over = spark.createDataFrame([(1, "The river stone", [(10, 15), (0, 9), (3, 5), (4, 12)])], "doc_id long, text string, marks array<struct<start:int,end:int>>")
    cut = at.section_tokens(over, spans="marks").first()
    assert [(x["start"], x["end"]) for x in cut["sections"]] == [(0, 9), (9, 12), (12, 15)] and cut["n_tokens"] == 3
