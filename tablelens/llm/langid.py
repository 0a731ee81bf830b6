"""Language of a text by Bayesian fusion of what the text, its markup, its address and its host say.

Text: byte trigrams of the lower-cased text, hashed into a table of log probabilities for each language;
the mean over all trigrams counts as `EVIDENCE` trigrams at most, as neighbours are not independent.
Declared language: how often each declaration goes with each language. Address suffix: likewise. Host:
the shares of the languages at the host, smoothed towards those at its domain, and those towards the
shares overall. These three are counted over all rows, by what the text alone says, in one grouped
aggregation. The posterior is the normalised product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import quoted
from tablelens.session import cut_lineage

BUCKETS = 1 << 13
#: Bytes of a text taken at a time; trigrams that a text counts as at most; rows learned from per language.
WINDOW, EVIDENCE, LEARNED = 1 << 20, 60, 1000
#: Weight of the level above when shares are smoothed, and of a single unseen count.
ABOVE, UNSEEN = 20.0, 0.5
#: The language of a text without letters.
UNKNOWN = "und"


def grams(text: str | None) -> np.ndarray:
    """How often each bucket of byte trigrams occurs in the whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    if not text or not any(map(str.isalpha, text)):
        return counts
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    for start in range(0, max(1, len(raw) - 2), WINDOW):
        part = raw[start : start + WINDOW + 2].astype(np.uint32)
        if len(part) >= 3:
            mixed = part[:-2] * np.uint32(0x9E3779B1) ^ part[1:-1] * np.uint32(0x85EBCA77) ^ part[2:] * np.uint32(0xC2B2AE3D)
            counts += np.bincount(mixed >> np.uint32(19), minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # languages x buckets, log probabilities

    def score(self, text: str | None) -> np.ndarray | None:
        counts = grams(text)
        n = counts.sum()
        return None if n == 0 else self.table @ counts * (min(n, EVIDENCE) / n)


def learn(docs: DataFrame, text: str, declared: str, rows: int = LEARNED) -> TextModel:
    """Trigram counts of about `rows` rows (by a hash of the text) of each declared language.

    Languages with fewer than five rows are not learned.
    """
    named = docs.select(F.lower(F.trim(declared)).alias("language"), F.col(text).alias("text"))
    named = named.filter((F.col("language") != "") & F.col("text").isNotNull())
    sizes = {r["language"]: r["n"] for r in named.groupBy("language").agg(F.count("*").alias("n")).filter("n >= 5").collect()}
    if not sizes:
        return TextModel((), np.zeros((0, BUCKETS)))
    shares = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))))
    number = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = named.filter(F.col("language").isin(list(sizes))).filter(number < F.element_at(shares, F.col("language")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, body in zip(batch["language"], batch["text"], strict=True):
                sums[language] = sums.get(language, 0) + grams(body)
        for language, counts in sums.items():
            at = np.nonzero(counts)[0]
            yield pd.DataFrame({"language": language, "gram": at, "n": counts[at]})

    counted = drawn.mapInPandas(count, "language string, gram int, n long")
    found = counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    languages = tuple(sorted(sizes))
    table = np.full((len(languages), BUCKETS), UNSEEN)
    table[[languages.index(x) for x in found["language"]], found["gram"]] += found["n"]
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def text_evidence(text: Column, model: TextModel) -> Column:
    """Log likelihood for each language, as array<double>; null for a text without letters."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], index=texts.index, dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


def _address(address: Column) -> dict[str, Column]:
    host = F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(address, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]*)", 1), r"\.$", "")
    labels = F.split(host, r"\.")
    return {
        "host": host,
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "suffix": F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(""),
    }


def _tables(counted: DataFrame, n: int) -> dict[str, DataFrame]:
    """Log shares of the n languages by host, and log likelihoods of declarations and suffixes."""
    sums = [F.sum(F.when(F.col("guess") == i, F.col("rows")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(n)]
    total = counted.agg(*sums).first()
    total = [x or 0.0 for x in total]
    overall = [(x + 1.0) / (sum(total) + n) for x in total]

    def likelihood(key: str) -> DataFrame:
        known = counted.groupBy(key).agg(*sums)
        kinds = max(1, known.count())
        logs = [F.log((F.col(f"n{i}") + UNSEEN) / F.lit(total[i] + UNSEEN * (kinds + 1))) for i in range(n)]
        return cut_lineage(known.select(F.col(key).alias(f"{key}_of"), F.array(*logs).alias(f"{key}_says")))

    def shares(has: list[Column], above: list[Column]) -> list[Column]:
        rows = sum(has[1:], has[0])
        return [(x + ABOVE * up) / (rows + ABOVE) for x, up in zip(has, above, strict=True)]

    columns = [F.col(f"n{i}") for i in range(n)]
    hosts = counted.groupBy("host", "domain").agg(*sums)
    domains = hosts.groupBy("domain").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(n)))
    domains = domains.select("domain", F.array(*shares(columns, [F.lit(x) for x in overall])).alias("above"))
    smoothed = hosts.join(domains, "domain")
    at_host = shares(columns, [F.col("above")[i] for i in range(n)])
    prior = F.array(*(F.log(x) for x in at_host))
    return {
        "host": cut_lineage(smoothed.select(F.col("host").alias("host_of"), prior.alias("host_says"))),
        "declared": likelihood("declared"),
        "suffix": likelihood("suffix"),
    }


def identify(
    docs: DataFrame, text: str = "text", declared: str = "lang", address: str = "source", least: float = 0.5
) -> DataFrame:
    """All columns of docs with `language`, `probability` and `accepted`, which replace columns of these names.

    `declared` is the language that markup or metadata state, `address` a URL or host name; either may be
    null. A text without letters (null and empty ones too) has language `und`, probability 0, and is not
    accepted; others are if the posterior of the best language is `least` or more. Of equal languages the
    first by name is taken. Repeated rows get equal results; no rows give no rows, and if no row declares
    a language nothing is accepted. Evidence that is small as a table is sent to all tasks by Spark's own
    choice by size; otherwise it is joined by host, and AQE splits the hot ones.
    """
    model = learn(docs, text, declared)
    n, names = len(model.languages), [c for c in docs.columns if c.lower() not in ("language", "probability", "accepted")]
    if n == 0:
        empty = {"language": F.lit(UNKNOWN), "probability": F.lit(0.0), "accepted": F.lit(False)}
        return docs.select(*map(quoted, names), *(c.alias(k) for k, c in empty.items()))
    marks = {"declared": F.lower(F.trim(F.coalesce(F.col(declared), F.lit("")))), **_address(F.col(address))}
    # The given columns go by number meanwhile, so that none of them meets a name used here.
    given = [quoted(c).alias(f"given{i}") for i, c in enumerate(names)]
    seen = docs.select(*given, *(c.alias(f"_{k}") for k, c in marks.items()), text_evidence(F.col(text), model).alias("_says"))
    guess = F.array_position("_says", F.array_max("_says")) - 1
    keys = ["host", "domain", "suffix", "declared"]
    counted = seen.filter(F.col("_says").isNotNull()).select(*(F.col(f"_{k}").alias(k) for k in keys), guess.alias("guess"))
    counted = cut_lineage(counted.groupBy(*keys, "guess").agg(F.count("*").alias("rows")))
    for key, says in _tables(counted, n).items():
        seen = seen.join(says.withColumnsRenamed({f"{key}_of": f"_{key}_of", f"{key}_says": f"_{key}_says"}), F.col(f"_{key}") == F.col(f"_{key}_of"), "left")

    def said(key: str, i: int) -> Column:
        return F.coalesce(F.col(f"_{key}_says")[i], F.lit(0.0))

    sums = F.array(*(F.col("_says")[i] + said("host", i) + said("declared", i) + said("suffix", i) for i in range(n)))
    seen = seen.withColumn("_sums", sums).withColumn("_best", F.array_max("_sums"))
    mass = F.aggregate("_sums", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_best")))
    place = F.array_position("_sums", F.col("_best")).cast("int")
    language = F.element_at(F.array(*(F.lit(x) for x in model.languages)), place)
    heard = F.col("_says").isNotNull()
    probability = F.when(heard, 1.0 / mass).otherwise(0.0)
    return seen.select(
        *(F.col(f"given{i}").alias(c) for i, c in enumerate(names)),
        F.when(heard, language).otherwise(UNKNOWN).alias("language"),
        probability.alias("probability"),
        (heard & (probability >= least)).alias("accepted"),
    )
