import random
import time

from edgeloom.llm import licences
from edgeloom.llm.licences import LEAST_DICE, TEMPLATES, LicenceIndex, bigrams, normalised


def plain_dice(words, form):
    own, grams = bigrams(words), bigrams(normalised(form))
    return 2 * len(own & grams) / (len(own) + len(grams))


def plain_names(words):
    """Every licence that some passage of the words matches, by comparing all passages with all templates."""
    found = set()
    for name, forms in TEMPLATES.items():
        for form in forms:
            long = 3 * len(normalised(form))
            if any(plain_dice(words[i:j], form) >= LEAST_DICE for i in range(len(words)) for j in range(i + 2, min(len(words), i + long) + 1)):
                found.add(name)
    return found


def noisy(rng, form):
    words = normalised(form)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(words) + 1)
        words[at : at + rng.randrange(2)] = rng.choice([[], ["x"], ["of", "the"]])
    return words


def test_passages_equal_comparing_everything():
    index, rng = LicenceIndex(), random.Random(1)
    short = [f for forms in TEMPLATES.values() for f in forms if len(normalised(f)) < 14]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [rng.choice(["word", "the", "license", "under"]) for _ in range(rng.randrange(6))] + (noisy(rng, rng.choice(short)) if rng.random() < 0.7 else [])
        found = index.passages(words)
        names = plain_names(words)
        assert {n for _, _, n, _ in found} <= names and bool(found) == bool(names)
        for first, last, name, dice in found:
            assert dice >= LEAST_DICE - 1e-9
            assert max(plain_dice(words[first : last + 1], f) for f in TEMPLATES[name]) > dice - 1e-9
        assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_every_template_is_found_in_the_middle_of_a_line():
    index = LicenceIndex()
    for name, forms in TEMPLATES.items():
        for form in forms:
            found = index.scan(f"first line\nCopyright 2020 Acme Inc. {form} int main() {{ return 0; }}")
            assert [(line, n) for line, n, _ in found][:1] == [(1, name)] or name in {n for _, n, _ in found}, (name, form[:60], found)


def test_lines_wrapped_notices_and_edge_cases(spark):
    wrapped = TEMPLATES["MIT"][1].replace(" to deal", "\nto deal").replace(" the Software,", "\nthe Software,", 1)
    rows = [
        (1, "Some words.\nReleased under the MIT Licence!\nmore"), (2, f"Title\n\n{wrapped}\nint x;\n\nbody"), (3, "nothing about it"), (4, None), (5, ""),
        (None, "All rights reserved."), (6, "word " * 50_000 + "\nAll rights reserved."), (7, "Code is licensed under the Apache License, Version 2.0, see file LICENSE."),
        (8, "The river is long. Rights of way are reserved for all who walk under the stone hills."),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, licences int")
    found = {r["doc_id"]: [(x["line"], x["licence"]) for x in r["licences"]] for r in licences.scan_licences(df).collect()}
    assert found[1] == [(1, "MIT")] and found[2] == [(2, "MIT")] and found[6] == [(1, "All-Rights-Reserved")] and found[7] == [(0, "Apache-2.0")]
    assert found[3] == found[4] == found[5] == found[8] == [] and found[None] == [(0, "All-Rights-Reserved")]
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_time_follows_the_text():
    index, seconds = LicenceIndex(), []
    for n in (4_000, 16_000):
        text = "Copyright 2020 Acme\nReleased under the MIT License.\n\n" * n
        began = time.process_time()
        assert len(index.scan(text)) == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * max(seconds[0], 0.05)
