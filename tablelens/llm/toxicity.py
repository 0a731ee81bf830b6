"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded texts.

Folding lower-cases, takes letters that look alike, accented letters and digits or signs put for letters
to plain letters, and all else to single blanks. Terms are words or beginnings of words with the
difference in log odds between toxic and other texts as weight; exception phrases are terms with a
neighbouring word that occur in clean texts, and what lies in one does not count. The weight found, as a
whole and normalised by the number of words, is turned into a probability by a fitted curve.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like plain ones, and digits and signs put for letters. Fixed values.
ALIKE = dict(zip("аеорсухіјѕкмтнвԁгαεορτυνικβ", "aeopcyxijskmthbdraeoptuvikb", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Letters of the beginnings of words that may become terms.
STEMS = range(4, 9)
#: Bounds of the model: rows learned from, terms, exception phrases; and support and odds that a term needs.
ROWS, TERMS, PHRASES, SUPPORT, ODDS = 20_000, 1_000, 1_000, 0.01, 2.5
#: Characters of a text folded and searched at a time (cut at a blank), and words added to short texts.
WINDOW, PADDING = 1 << 20, 20


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = SUBSTITUTES.get(c, ALIKE.get(c, c))
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if "a" <= x <= "z")
        self[code] = plain or " "
        return self[code]


_FOLD = _Fold()


def folded(text: str | None) -> list[str]:
    """Words of the folded text."""
    return (text or "").translate(_FOLD).split()


def _pieces(text: str | None) -> Iterator[str]:
    """The text in pieces of bounded length, cut where words end if they do."""
    text, start = text or "", 0
    while start < len(text):
        end = start + WINDOW
        if end < len(text):
            end = max(text.rfind(" ", start, end) + 1, text.rfind("\n", start, end) + 1) or end
            end = end if end > start else start + WINDOW
        yield text[start:end]
        start = end


def candidates(text: str | None) -> set[str]:
    """Terms that a text could give: its words, and beginnings of them."""
    found: set[str] = set()
    for piece in _pieces(text):
        for word in set(folded(piece)):
            if len(word) >= 3:
                found.add(f" {word} ")
                found.update(f" {word[:n]}" for n in STEMS if n < len(word))
    return found


@dataclass(frozen=True)
class Lexicon:
    """Terms (a word between blanks, or a beginning after a blank) and phrases, folded; curve: of normalised weight, weight, 1."""

    terms: tuple[tuple[str, float], ...]
    phrases: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


@lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in lexicon.terms:
        automaton.add_word(term, (len(term), weight))
    for phrase in lexicon.phrases:
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
    automaton.make_automaton()
    return automaton


def hits(words: list[str], lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """(start, end, weight) in the blank-joined words: one a word, of its best term, not inside a phrase."""
    if not lexicon.terms:
        return []
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for last, (size, weight) in _automaton(lexicon).iter(f" {' '.join(words)} "):
        start = last - size + 1
        if weight is None:
            spared.append((start, last + 1))
        elif start not in best or weight > best[start][1]:
            best[start] = (last + 1, weight)
    found, i, reach = [], 0, 0
    spared.sort()
    for start in sorted(best):
        while i < len(spared) and spared[i][0] <= start:
            reach, i = max(reach, spared[i][1]), i + 1
        if best[start][0] > reach:
            found.append((start, *best[start]))
    return found


def weights(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """Logs of the weight found for each hundred words, and of the weight found."""
    weight, n = 0.0, 0
    for piece in _pieces(text):
        words = folded(piece)
        n += len(words)
        weight += sum(w for *_, w in hits(words, lexicon))
    return math.log1p(100 * weight / (n + PADDING)), math.log1p(weight)


def score_of(text: str | None, lexicon: Lexicon) -> float:
    z = sum(c * x for c, x in zip(lexicon.curve, (*weights(text, lexicon), 1.0), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve, by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.01 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return w


def _covering(terms: list[str], held: list[set[str]], least: int, sure: int) -> list[str]:
    """Terms by falling number of toxic texts they explain that no term before does, while those are many.

    A rare word of a toxic text, or of its copies, explains nothing that the toxic words do not. Terms in
    at least `sure` toxic texts stay anyway.
    """
    where: dict[str, set[int]] = {t: set() for t in terms}
    for i, own in enumerate(held):
        for t in own:
            where[t].add(i)
    chosen, open_ = [], set(range(len(held)))
    while where:
        best = max(where, key=lambda t: (len(where[t] & open_), len(where[t]), t))
        if len(where[best] & open_) < least:
            break
        open_ -= where[best]
        chosen.append(best)
        del where[best]
    return chosen + [t for t in where if len(where[t]) >= sure]


def _count(rows: DataFrame, features, least: int) -> pd.DataFrame:
    """feature, toxic, clean: rows with the feature, for features in at least `least` toxic or clean rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part, counts = batch.iloc[start : start + 1000], (Counter(), Counter())
                for text, label in zip(part["text"], part["label"], strict=True):
                    counts[label > 0].update(features(text))
                both = list(counts[0].keys() | counts[1].keys())
                if not both:  # a slice in which no text has a feature
                    continue
                yield pd.DataFrame({"feature": both, "toxic": [counts[1][f] for f in both], "clean": [counts[0][f] for f in both]})

    counted = rows.mapInPandas(run, "feature string, toxic long, clean long").groupBy("feature")
    counted = counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return counted.filter(F.greatest("toxic", "clean") >= least)


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from (text, label) of a bounded sample; equal texts count once.

    Terms need to occur in a hundredth of the toxic texts, and in five, with log odds of 2.5 more than in
    others; the 1,000 in most toxic texts are looked at, and those stay that explain toxic texts which no
    other explains (see `_covering`). Without toxic or without other rows the lexicon is empty and every
    score the share of toxic rows.
    """
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), "label").groupBy("text").agg(F.max("label").alias("label")).persist()
    try:
        sizes = rows.agg(F.sum((F.col("label") > 0).cast("int")), F.count("*")).first()
        toxic, clean = sizes[0] or 0, sizes[1] - (sizes[0] or 0)
        if not toxic or not clean:
            share = (toxic + 0.5) / (toxic + clean + 1)
            return Lexicon((), (), (0.0, 0.0, math.log(share / (1 - share))))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        counted = _count(rows, candidates, max(5, int(SUPPORT * toxic))).withColumn("weight", odds)
        good = counted.filter(F.col("weight") >= ODDS).orderBy(F.desc("toxic"), "feature").limit(TERMS).collect()
        # of terms in the same texts the shortest speaks for all
        seen: dict[str, tuple[int, float]] = {}
        for row in sorted(good, key=lambda r: (len(r["feature"]), r["feature"])):
            term = row["feature"]
            if not any(seen.get(term[:n], (0, 0.0)) >= (row["toxic"], row["weight"]) for n in range(3, len(term))):
                seen[term] = (row["toxic"], row["weight"])
        held = [set(own) for own in _held(rows.filter("label > 0"), sorted(seen))]
        terms = _covering(sorted(seen), held, max(4, toxic // 250), max(5, toxic // 20))
        lexicon = Lexicon(tuple(sorted((t, seen[t][1]) for t in terms)))
        found = _count(rows, lambda text: _neighbours(text, lexicon), 5)
        harmless = found.filter((F.col("clean") >= 5) & (F.col("clean") >= 4 * F.col("toxic")))
        phrases = [r["feature"] for r in harmless.orderBy(F.desc("clean"), "feature").limit(PHRASES).collect()]
        lexicon = Lexicon(lexicon.terms, tuple(sorted(phrases)))
        points = rows.select(_weights(F.col("text"), lexicon).alias("x"), "label").toPandas()  # bounded by the sample
        x = np.array([[*v, 1.0] for v in points["x"]])
        curve = tuple(float(c) for c in _fit(x, (points["label"] > 0).to_numpy(float)))
        return Lexicon(lexicon.terms, lexicon.phrases, curve)
    finally:
        rows.unpersist()


def _held(rows: DataFrame, terms: list[str]) -> list[list[str]]:
    """For each of the toxic texts of the sample, which of the terms it holds."""
    wanted = frozenset(terms)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(candidates(t) & wanted) for t in texts], index=texts.index, dtype=object)

    found = rows.select(F.pandas_udf(run, "array<string>")("text").alias("held"))
    return [list(r["held"]) for r in found.collect()]


def _neighbours(text: str | None, lexicon: Lexicon) -> set[str]:
    """Two-word phrases around the terms of a text."""
    phrases: set[str] = set()
    for piece in _pieces(text):
        words = folded(piece)
        starts = {start for start, *_ in hits(words, lexicon)}
        at = 0
        for i, word in enumerate(words):
            if at in starts:
                phrases.update(" ".join(words[max(0, j) : j + 2]) for j in (i - 1, i) if j >= 0 and j + 2 <= len(words))
            at += len(word) + 1
    return phrases


def _weights(text: Column, lexicon: Lexicon) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(weights(t, lexicon)) for t in texts], index=texts.index, dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """Probability that a whole text is toxic; null and empty texts get that of a text without terms."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score_of(t, lexicon) for t in texts], index=texts.index, dtype="float64")

    return F.pandas_udf(run, "double")(text)
