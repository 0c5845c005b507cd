"""Licence scan: normalised passages against templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, slices, texts
from edgeloom.llm.licence_texts import TEMPLATES

LEAST_DICE = 0.8
#: Words of a passage for each distinct bigram that it may hold.
MOST_REPEATS = 4
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> list[str]:
    """Words in lower case: runs of letters and digits, all else is between words; licence is spelt license."""
    return _WORD.findall(text.lower().replace("licence", "license"))


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbours."""
    return frozenset(zip(words, words[1:], strict=False))


class LicenceIndex:
    """Templates by the bigrams that they hold, with the sizes that a passage can have to match one.

    Dice, 2c / (a + b) for c common bigrams among a and b distinct ones, can reach t only
    if a lies between b t / (2 - t) and b (2 - t) / t, and then c is b t / (2 - t) or
    more: these bounds prune a template before any comparison.
    """

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST_DICE):
        self.least = least
        self.forms = [(name, grams) for name, forms in sorted(templates.items()) for t in forms if (grams := bigrams(normalised(t)))]
        self.holding: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, grams) in enumerate(self.forms):
            for g in grams:
                self.holding[g].append(i)
        self.fewest = [math.ceil(len(g) * least / (2 - least) - 1e-9) for _, g in self.forms]
        self.most = [math.floor(len(g) * (2 - least) / least + 1e-9) for _, g in self.forms]

    def _best_end(self, pairs: list[tuple[str, str]], start: int, hits: set[int], form: int) -> tuple[float, int]:
        """The best Dice of the passages that begin at a place, and the last bigram of the first such; (0, start) if none is large enough."""
        grams, most = self.forms[form][1], self.most[form]
        seen: set[tuple[str, str]] = set()
        common, best, end = 0, 0.0, start
        for at in range(start, len(pairs)):
            pair = pairs[at]
            if pair not in seen:
                seen.add(pair)
                if len(seen) > most:
                    break
                common += pair in grams
            elif at - start > MOST_REPEATS * most:
                break
            if at in hits and (dice := 2 * common / (len(seen) + len(grams))) > best + 1e-12:
                best, end = dice, at
        return best, end

    def passages(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, name, Dice) of the passages of a text that match a template, none of which overlap.

        A passage begins and ends with a bigram of the template. From the left, the first
        place from which one matches is taken, moved on to the best place within it; the
        next begins after its end. Of overlapping passages of several templates the one
        with most common bigrams stays, then that of higher Dice, then by name.
        """
        pairs = list(zip(words, words[1:], strict=False))
        placed: dict[int, list[int]] = defaultdict(list)
        for at, forms in enumerate(map(self.holding.get, pairs)):
            if forms:
                for i in forms:
                    placed[i].append(at)
        found = []
        for form, places in placed.items():
            need, most, hits, grams = self.fewest[form], MOST_REPEATS * self.most[form], set(places), self.forms[form][1]
            if len(places) < need:
                continue
            k = 0
            while k + need <= len(places):
                start = places[k]
                if places[k + need - 1] - start > most:
                    k += 1
                    continue
                dice, end = self._best_end(pairs, start, hits, form)
                if dice < self.least - 1e-12:
                    k += 1
                    continue
                for later in places[k + 1 : bisect_right(places, start + max(2, len(grams) // 4))]:
                    other, at = self._best_end(pairs, later, hits, form)
                    if other > dice + 1e-12:
                        start, dice, end = later, other, at
                common = round(dice * (len(set(pairs[start : end + 1])) + len(grams)) / 2)
                found.append((-common, -dice, self.forms[form][0], start, end + 1))
                k = bisect_right(places, end)
        # of overlapping passages the best stay: later ones can only be hidden by words that are taken
        taken: set[int] = set()
        kept = []
        for _, dice, name, first, last in sorted(found):
            if taken.isdisjoint(range(first, last + 1)):
                taken.update(range(first, last + 1))
                kept.append((first, last, name, -dice))
        return sorted(kept)

    def scan(self, text: str) -> list[tuple[int, str, float]]:
        """(line, name, Dice) of the licence passages in a text, whose first word stands on that line."""
        found = self.passages(normalised(text))
        if not found:
            return []
        lines, line, done, at = [], 0, 0, 0
        for i, word in enumerate(_WORD.finditer(text.lower().replace("licence", "license"))):
            if at < len(found) and found[at][0] == i:
                line += word.string.count("\n", done, word.start())
                done = word.start()
                lines.append((line, found[at][2], found[at][3]))
                at += 1
        return lines


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = LicenceIndex()
    kind = pa.list_(pa.struct([("line", pa.int32()), ("licence", pa.string()), ("dice", pa.float64())]))
    for batch in slices(batches):
        found = [[{"line": p, "licence": n, "dice": d} for p, n, d in index.scan(t)] for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "licences"])


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``licences`` (line, licence, dice) of every whole text.

    Passages of any place are found, whether they fill lines or not; those of equal
    evidence go by Dice, then by licence name. Dice counts distinct bigrams, so a passage
    may repeat itself: one is followed for up to ``MOST_REPEATS`` times as many words as it
    may have distinct bigrams. A licence that is stretched by repetition to more isn't found
    as a whole; the bound keeps the work linear in the text. A null text counts as empty and, like
    it, has none; a null id is returned as null. Repeated rows give repeated results, an
    empty table an empty one. Other columns aren't read.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return narrow.mapInArrow(_scanned, f"doc_id {kind}, licences array<struct<line:int,licence:string,dice:double>>")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of licence passages, their names, the best Dice and the places."""
    found = scan_licences(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct("licences.licence")), ",").alias("names"),
        F.round(F.array_max("licences.dice"), 9).alias("best_dice"),
        F.array_join(F.transform("licences", lambda x: F.concat(x["licence"], F.lit(":"), x["line"].cast("string"))), ",").alias("places"),
    )
