import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0 if digits else False
            good = [True, kind != 1 or all(int(p) <= 255 for p in m[0].split(".")), kind != 2 or (12 <= len(digits) <= 19 and luhn), kind != 3 or 9 <= len(digits) <= 15]
            if all(good):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "b.c", "1", "25", "255", "256", "+", "-", " ", "(", ")", "4111111111111111", "x@y.z", "1.2.3.4", "+1 (555) 123-4567", "é", "%", "0"]), max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_texts_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" + "(" * 200_000):
        assert pii.base_spans(text) == pii.base_spans(text)


TEXTS = {
    1: 'Write to bob@example.com or call +1 (555) 123-4567. token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" end',
    2: "clean words only, version 2.0 of 2024 and 12 items",
    3: "",
    4: None,
    5: 'password="b44e15e09fd311c3cf3163b66d5a9875b883d8ce" at 10.0.0.1, card 4111 1111 1111 1111',
    6: "Number 9807915762804490 is no card",
}


def frame(spark):
    rows = [(i, t, "x", 1) for i, t in TEXTS.items()] + [(None, TEXTS[1], "x", 1), (2, TEXTS[2], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long")


def test_query_columns(spark):
    found = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark)).collect()}
    for i, text in TEXTS.items():
        base = plain(text or "")
        r = found[i]
        wanted = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(wanted.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(filter(None, wanted.split(","))) <= set(r["spans"].split(","))
    assert "secret:" in found[1]["spans"] and "secret:" in found[5]["spans"]
    assert found[2]["spans"] == found[3]["spans"] == found[4]["spans"] == found[6]["spans"] == ""
    assert pii.find_personal_data(frame(spark).limit(0)).count() == 0


def test_masking_keeps_clean_texts_and_columns(spark):
    df = frame(spark)
    found = pii.mask_personal_data(df)
    assert found.columns == df.columns and found.count() == df.count()
    by = {r["doc_id"]: r for r in found.collect()}
    assert by[1]["text"] == 'Write to [EMAIL] or call [PHONE]. token = "[SECRET]" end'
    assert by[2]["text"] == TEXTS[2] and by[4]["text"] is None and by[6]["text"] == TEXTS[6]
    assert by[5]["n_chars"] == len(by[5]["text"])


def test_label_model_ranks_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    noisy = lambda p: np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1
    votes = np.stack([noisy(0.95), noisy(0.8), noisy(0.75), noisy(0.55)], axis=1)
    posterior, tables, prior = pii.label_model(votes, np.ones(4000))
    assert abs(prior - 0.3) < 0.05 and ((posterior > 0.5) == truth).mean() > 0.94
    assert tables[1, 0, 2] > tables[1, 1, 2] > tables[1, 3, 2]


def test_form_labeler_has_opinions_on_accounts():
    form = pii.LABELERS.index("form")
    vote = lambda value: pii._votes("account", value, "", pii._entropy(value))[form]
    assert (vote("000000000000"), vote("4409 1283 5501 7"), vote("440912835501")) == (-1, 1, 0)


def test_long_values_of_other_shape_look_different():
    a, b = "ab12-" * 20 + "9", "ab12-" * 20 + "zz"
    assert pii._shape("ab12-" * 3) != pii._shape("ab12-" * 40) and pii._shape(a) != pii._shape(b) and len(pii._shape(a)) <= 16


def test_numbers_of_any_length(spark):
    zeros = "0" * 5_000
    rows = [(1, f"{zeros}.0.0.0"), (2, f"{zeros}255.1.2.{zeros}3"), (3, f"{zeros}256.1.2.3"), (4, "9" * 6_000 + ".1.1.1"), (5, "1" * 5_000), (6, "+" + "1 " * 5_000), (7, f"a@b.{zeros}")]
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i]["n_ip"] for i in range(1, 8)] == [1, 1, 0, 0, 0, 0, 0]
    assert f"ip:0:{5_006}" in found[1]["spans"] and found[7]["n_email"] == 1
    assert sum(found[i]["n_card"] + found[i]["n_phone"] for i in range(1, 8)) == 0
