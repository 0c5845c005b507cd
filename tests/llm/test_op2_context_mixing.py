import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import context_mixing as cm


def corpus():
    rng = random.Random(2)
    words = ["the", "of", "And", "tion", "ing", "er", "é", "river", "stone"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    return [*rows, (300, ""), (301, None), (None, "the river"), (7, rows[7][1]), (302, "zzz \tunseen\nwords " * 30)]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in corpus()], "doc_id long, text string, score double")
    return cm.score_texts(df).collect()


def test_base_figures_equal_the_definition(found):
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in corpus() if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(corpus())
    assert len(found) == len(corpus())
    for r in found:
        own = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(own), n)
        assert r["n_known"] == sum(w in counts for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)


def test_model_beats_single_tokens_and_uniform_bytes(found):
    held = [r for r in found if r["held_out"] and r["doc_id"] != 302]
    assert sum(r["bits_per_byte"] for r in held) / len(held) < 4
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def key(past, byte):
    return int.from_bytes((b"\xff" * 6 + past)[-6:] + bytes([byte]), "big")


def plain_windows(text):
    stream = text.lower() + b"\xff"
    return [key(stream[:i], c) for i, c in enumerate(stream)]


def test_windows_hold_the_six_bytes_before():
    assert [int(k).to_bytes(7, "big") for k in cm.windows(b"Ab")] == [b"\xff" * 6 + b"a", b"\xff" * 5 + b"ab", b"\xff" * 4 + b"ab\xff"]
    assert cm.windows(b"x" * 100).tolist() == plain_windows(b"x" * 100)


def small_model(words=b"the river and the stone", seed=1):
    """Counts of some windows, weights and a map: what the operator would learn, but at random."""
    rng = np.random.default_rng(seed)
    keys = np.unique(np.array([key(p, c) for p in (b"", b"the ", b"a river", b"o") for c in range(256)] + plain_windows(words) + plain_windows(b"the ring"), np.uint64))
    own = cm.Windows(keys, rng.integers(0, 4, (3, len(keys))).astype(float))
    pairs, at = np.unique(keys & np.uint64(0xFFFFFF), return_inverse=True)
    short = cm.ShortContexts(pairs, np.stack([np.bincount(at, own.counts[r]) for r in (0, 1)]))
    weights = [rng.normal(0.3, 0.2, (cm.INPUTS, n)).astype(np.float32) for n in cm.GATES]
    return own, short, weights, rng.uniform(0.05, 0.95, (256, cm.REFINED)).astype(np.float32)


def context_of(window, order):
    past = int(window).to_bytes(7, "big")[:6]
    if order == "word":
        blank = max((i for i, c in enumerate(past) if c in b" \n\xff"), default=0)
        return past[min(blank, 3) :]
    return past[-order:]


def plain_inputs(own, counts, window, k):
    """The predictors' log odds of bit k of a window's byte, and which were seen, by counting through all windows."""
    odds, met = [], []
    byte = int(window) & 255
    for order in (*cm.ORDERS, "word"):
        ones = zeros = 0
        for other, n in zip(own.keys, counts, strict=True):
            b = int(other) & 255
            if context_of(other, order) == context_of(window, order) and b >> (8 - k) == byte >> (8 - k):
                ones, zeros = ones + n * (b >> (7 - k) & 1), zeros + n * (1 - (b >> (7 - k) & 1))
        odds.append(math.log((ones + cm.SOFT) / (zeros + cm.SOFT)))
        met.append(ones + zeros > 0)
    return odds, met


def test_predictors_and_mixers_equal_a_plain_version():
    own, short, weights, refinement = small_model()
    counts = own.counts[cm.FILL] + own.counts[cm.MIX]
    steps, values = cm.Steps(own, counts, short, short.all_odds), cm.window_values(own, short, weights, refinement)
    for i in range(0, len(own.keys), 97):
        byte, last = int(own.keys[i]) & 255, int(own.keys[i]) >> 8 & 255
        for k in range(8):
            odds, met = plain_inputs(own, counts, own.keys[i], k)
            rows, (first, second), bit = steps(k, np.array([i]))
            assert np.allclose(rows[:-1, 0], odds, atol=1e-5) and bit[0] == byte >> (7 - k) & 1
            assert first[0] == sum(met[j] for j in cm.LONGEST) * 256 + ((1 << k) | byte >> (8 - k)) and second[0] == last * 8 + k
            total = sum(w * x for w, x in zip(weights[0][:, first[0]], [*odds, 0.3], strict=True))
            place = (min(max(total, -7.999), 7.999) + 8) * 2
            low = int(place)
            cell = refinement[last]
            p = 0.5 / (1 + math.exp(-total)) + 0.5 * (cell[low] * (1 - place + low) + cell[low + 1] * (place - low))
            other = sum(w * x for w, x in zip(weights[1][:, second[0]], [*odds, 0.3], strict=True))
            for m, exact in enumerate((math.log(p / (1 - p)), other)):
                assert abs(values[m, i, k] * (1 if bit[0] else -1) - min(max(exact * cm.STEPS, -127), 127)) < 0.51


def test_probabilities_of_the_next_byte_sum_to_one():
    own, short, weights, refinement = small_model()
    values = cm.window_values(own, short, weights, refinement)
    for past in (b"", b"the ", b"a river"):
        at = np.searchsorted(own.keys, np.array([key(past, c) for c in range(256)], np.uint64))
        for w in ((0.5, 0.5), (0.9, 0.05)):
            bits = cm.rest_bits(own.keys[at], np.tile(np.array(w, np.float32), (256, 1)), own.keys, tuple(values))
            assert abs((2.0**-bits).sum() - 1) < 1e-9


def plain_coded(text, keys, values, held):
    """Bit by bit: nats of the held windows, and the others with the weights at their place."""
    place = {int(k): i for i, k in enumerate(keys)}
    weights, nats, rest, slope = [cm.START, cm.START], 0.0, [], [0.0, 0.0]
    for n, window in enumerate(plain_windows(text)):
        if n and n % cm.BLOCK == 0:
            weights = [min(1.0, max(0.0, w + cm.PACE * s / (8 * cm.BLOCK))) for w, s in zip(weights, slope, strict=True)]
            slope = [0.0, 0.0]
        if window not in held:
            rest.append((window, *weights))
            continue
        for k in range(8):
            z = [float(values[m][place[window]][k]) / cm.STEPS for m in (0, 1)]
            p = 1 / (1 + math.exp(-weights[0] * z[0] - weights[1] * z[1]))
            nats -= math.log(p)
            slope = [s + (1 - p) * x for s, x in zip(slope, z, strict=True)]
    return nats, rest


def test_coding_equals_a_plain_bit_by_bit_version():
    texts = [b"the river and the stone " * 60, b"", b"the", b"The River and " * 100, b"the ring", "\u00e9t\u00e9".encode()]
    own, short, weights, refinement = small_model(b"".join(texts))
    keys = np.unique(np.concatenate([own.keys, *(np.array(plain_windows(t), np.uint64) for t in texts)]))
    rng = np.random.default_rng(3)
    values = rng.integers(-60, 90, (2, len(keys), 8)).astype(np.int8)
    some = rng.random(len(keys)) < 0.8
    table = cm.HeldWindows(keys[some], tuple(np.ascontiguousarray(v[some]).view(np.uint64).ravel() for v in values))
    nats, owner, missed, at = cm.coded(texts, table)
    for i, text in enumerate(texts):
        wanted, rest = plain_coded(text, keys, values, set(keys[some].tolist()))
        assert abs(nats[i] - wanted) < 1e-3 * max(1, wanted)
        assert missed[owner == i].tolist() == [r[0] for r in rest]
        assert np.allclose(at[owner == i], np.array([r[1:] for r in rest]).reshape(-1, 2), atol=1e-4)
    alone = [cm.coded([t], table)[0][0] for t in texts]
    assert nats.tolist() == alone  # texts that are coded side by side don't touch each other


def test_window_table_counts_every_window_by_role(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").select(cm._role(F.col("doc_id")).alias("role"), "text")
    wanted = [Counter(), Counter(), Counter()]
    for r in df.collect():
        wanted[r["role"]].update(plain_windows((r["text"] or "").encode()))
    for learners in (1, 5):
        found = [Counter(), Counter(), Counter()]
        for r in cm.window_table(df.repartition(3), learners).collect():
            own = cm.Windows.of(r["windows"], r["counts"])
            assert (cm.learner_of(own.keys, learners) == r["learner"]).all()
            for role in range(3):
                found[role].update({int(k): int(n) for k, n in zip(own.keys, own.counts[role], strict=True) if n})
        assert found == wanted


def test_learning_follows_the_coding_error_twice_a_batch():
    own, short, _, _ = small_model()
    one = cm.Windows(own.keys, np.where(np.arange(len(own.keys)) == 40, 1.0, 0.0) * np.array([[0], [1], [0]]))
    weights, use = cm.learn(one, cm.ShortContexts(short.pairs, np.zeros((2, len(short.pairs)))))
    byte = int(own.keys[40]) & 255
    for k in range(8):  # nothing was counted, so only the bias speaks
        bit, weight, memory = byte >> (7 - k) & 1, 0.3, 1e-3
        for _ in range(2):
            slope = 0.3 * (bit - 1 / (1 + math.exp(-0.3 * weight)))
            memory += slope**2
            weight += cm.RATE * slope / math.sqrt(memory)
        gate = (1 << k) | byte >> (8 - k)
        assert use[0][gate] == 1 and abs(weights[0][-1, gate] - weight) < 1e-6


def test_scores_depend_neither_on_partitions_nor_on_repeats(spark, found):
    df = spark.createDataFrame([(i, t) for i, t in corpus()], "doc_id long, text string")
    rows = lambda r: sorted((x["doc_id"] or -1, x["n_tokens"], x["base_score"], x["score"]) for x in r)
    for n in (1, 7):
        assert rows(cm.score_texts(df.repartition(n)).collect()) == rows(found)


def test_windows_that_tasks_do_not_hold_are_joined(spark, found):
    df = spark.createDataFrame([(i, t) for i, t in corpus()], "doc_id long, text string")
    few = {(r["doc_id"], r["n_tokens"]): r["score"] for r in cm.score_texts(df, most=40).collect()}
    none = {(r["doc_id"], r["n_tokens"]): r["score"] for r in cm.score_texts(df, most=0).collect()}
    for r in found:
        if r["n_tokens"] < 20:  # within the first block no weight has moved
            assert abs(few[r["doc_id"], r["n_tokens"]] - r["score"]) < 1e-4 and abs(none[r["doc_id"], r["n_tokens"]] - r["score"]) < 1e-4
        assert abs(none[r["doc_id"], r["n_tokens"]] - r["score"]) < 0.1 * abs(r["score"]) + 1


def test_hot_tokens_are_bounded_and_the_commonest(spark):
    counts = spark.createDataFrame([(bytes([i]), 2**i) for i in range(20)], "token binary, n long")
    hot = cm.hot_tokens(counts, 5)
    assert sorted(hot.values()) == [2**i for i in range(15, 20)]
    assert cm.hot_tokens(counts.limit(0), 5) == {}


def test_empty_table(spark):
    assert cm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_texts_change_no_other_score(spark):
    rows = [(i, f"the river {i % 7} and the stone walk under green hills {i % 3} often " * 3) for i in range(60)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    extra = [i for i in range(60, 400) if zlib.crc32(str(i).encode()) % 10 == 0][:30]
    # held-out texts that would make other windows the commonest
    more = rows + [(i, "zebra quartz vixen jumps over and over " * 40) for i in extra]
    shape = "doc_id long, text string"
    for most in (0, 300, cm.MAX_HELD):
        few = {r["doc_id"]: r["score"] for r in cm.score_texts(spark.createDataFrame(rows, shape), most=most).collect()}
        many = {r["doc_id"]: r["score"] for r in cm.score_texts(spark.createDataFrame(more, shape), most=most).collect()}
        assert held and all(many[i] == s for i, s in few.items())
