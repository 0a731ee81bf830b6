import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare, connect

from tablelens.llm import phrases as P
from tablelens.llm.queries import QUERIES, SQL

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least=10, inside=50, first=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in frequent.items():
            longer = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    words = ["The", "the", "a", "é𝄞", "c\x00", "Ä", "x" * 300, *(f"w{i}" for i in range(40))]
    made = []
    for i in range(120):
        text = "".join(draw.choice(words[: 5 + i % 40]) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\r\n", " "]) for _ in range(draw.randint(0, 120)))
        made.append((draw.choice(["en", "de", None, ""]), text))
    return made + [("en", None), (None, None), ("en", ""), ("fr", " \t\n"), ("en", "the the the " * 3000), ("es", "one two")]


@pytest.mark.parametrize("budget", [P.BUDGET, 60, 3])
def test_equals_brute_force(spark, rows, budget):
    df = spark.createDataFrame([(lang, text, 7, "p") for lang, text in rows], "lang string, text string, n int, phrase string")
    assert found(P.collocations(df, budget=budget)) == brute(rows)


def test_first_and_inside(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(P.collocations(df, least=4, inside=80, first=15)) == brute(rows, 4, 80, 15)


def test_slices_and_flushes(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 7)
    monkeypatch.setattr(P, "MERGED", 50)
    texts = rows[:40]
    whole = [P.Suffixes(), P.Suffixes()]
    for _, text in texts:
        whole[0].add(text)
    monkeypatch.setattr(P, "SLICE", 10**6)
    for _, text in texts:
        whole[1].add(text)
    for one, other in zip(whole[0].merged(), whole[1].merged(), strict=True):
        assert (one == other).all()


def test_groups_keep_to_their_capacity():
    counts = np.array([[50, 3, 4, 0], [10, 20, 2, 25], [30, 1, 1, 1]])
    groups, n = P.groups_of(counts, 20)
    assert groups[0].tolist()[0] == -1 and groups[1].tolist()[3] == -1 and (groups[2] >= 0).all()
    for g in range(n):
        held = counts[groups == g]
        assert held.sum() <= 20 or held.tolist() == [30]
    assert P.groups_of(np.array([[5, 6], [5, 6], [5, 6]]), 20)[0].tolist() == [[0, 0], [-1, -1], [-1, -1]]


def test_many_words_are_ordered_without_packing():
    rows = np.array([[3, 1, 3, 1], [2, 2, 2, 0], [1, 1, 1, 0]])
    for size in (4, 1 << 22):
        leaves, totals = P.leaves_of(rows, np.array([1, 2, 3, 4]), size)
        assert leaves.T.tolist() == [[1, 0, 0], [1, 2, 1], [3, 2, 1]] and totals.tolist() == [4, 2, 4]


def test_exact_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3_000_000_019, 3_000_000_077, 4_000_000_007
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(P._score(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 10**6 * a * a // (left * right)


def test_odd_tables(spark, odd, documents):
    assert found(P.collocations(odd)) == brute([(r["lang"], r["text"]) for r in odd.collect()])
    assert P.collocations(documents([])).collect() == []


def test_query_equals_sql(spark, folder):
    assert compare(QUERIES["op13_phrases"](spark, folder), connect(folder), SQL["op13_phrases"]) == []
