import random
import re

import numpy as np
import pytest
from oracle import compare, connect
from plain import groups_of

from tablelens.llm import components as C
from tablelens.llm import tensored as T
from tablelens.llm.queries import QUERIES, SQL


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent=85, k=3):
    sets = [shingles(t, k) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    group = groups_of(links, range(len(rows)))
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(rows[i][0], least.get(g, rows[i][0]))
    out = [(d, len(s), d if not s else least.get(group[i])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted([(*r, r[0] is not None and r[0] == r[2]) for r in out], key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=str)


def near_copies(n, seed, words=60, most=9):
    """Copies of one text with up to `most` words changed: a dense group with pairs on both sides of the threshold."""
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 500)}" for _ in range(words)]
    made = []
    for _ in range(n):
        own = base[:]
        for at in draw.sample(range(words), draw.randint(0, most)):
            own[at] = f"x{draw.randint(0, 10**6)}"
        made.append(" ".join(own))
    return made


def test_equals_brute_force(spark, documents):
    texts = near_copies(40, 1) + near_copies(60, 2, 200, 8) + near_copies(30, 3, 12, 2) + ["The END", "the  end", "the end of"]
    draw = random.Random(5)
    texts += [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 30))) for _ in range(60)] + [texts[0]] * 20
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    assert found(T.near_duplicates(documents(rows))) == brute(rows)


@pytest.mark.parametrize("few, meeting", [(1, 16), (3, 2048)])
def test_dense_groups(spark, documents, monkeypatch, few, meeting):
    monkeypatch.setattr(T, "FEW", few)
    monkeypatch.setattr(T, "MEETING", meeting)
    rows = list(enumerate(near_copies(150, 4) + near_copies(120, 6, 100, 14)))
    assert found(T.near_duplicates(documents(rows))) == brute(rows)


def test_other_thresholds(spark, documents):
    rows = list(enumerate(near_copies(50, 8)))
    assert found(T.near_duplicates(documents(rows), shingle=2, percent=90)) == brute(rows, 90, 2)


def test_misses_are_rare():
    share = 0.85**T.WIDTH
    assert 2 * (1 - share) ** T.SIDE < 6e-6
    draw = np.random.default_rng(0)
    met = agreed = 0
    for _ in range(300):
        pool = draw.integers(-(1 << 62), 1 << 62, 1150)
        a, b = np.unique(pool[:1075]), np.unique(np.append(pool[:1000], pool[1075:]))  # similarity 1000 / 1150
        x, y = T.min_values(a), T.min_values(b)
        same = T.half_bands(x) == T.half_bands(y)
        met += same[: T.SIDE].any() and same[T.SIDE :].any()
        agreed += (x.astype(np.uint8) == y.astype(np.uint8)).sum()
    assert met == 300 and 0.84 < agreed / 300 / T.VALUES < 0.9
    assert T.least_agreement(85) < 25


def test_a_meeting_skips_pairs_of_other_half_bands():
    import pandas as pd

    halves, words = np.arange(2 * T.SIDE), np.arange(50)
    row = {"half": 0, "x": 0, "y": 0, "n": 50, "halves": halves, "signs": bytes(T.VALUES), "words": words}
    group = pd.DataFrame([row | {"node": 1, "component": 1, "stray": True}, row | {"node": 2, "component": 2, "stray": False}])
    assert T._meet(group, 85).values.tolist() == [[1, 2]]
    assert T._meet(group.assign(half=1), 85).empty and T._meet(group.assign(component=1), 85).empty


def test_odd_rows(spark, odd, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(T.near_duplicates(odd)) == brute(rows)
    assert T.near_duplicates(documents([])).collect() == []
    assert found(T.near_duplicates(documents([(None, "a b c"), (None, "A B C"), (None, None)]))) == [(None, 0, None, False), (None, 1, None, False), (None, 1, None, False)]


def test_query_equals_sql(spark, folder):
    assert compare(QUERIES["op11_tensored_minhash"](spark, folder), connect(folder), SQL["op11_tensored_minhash"]) == []


def test_links_are_walked_once(spark, documents, monkeypatch):
    walked = []

    def counted(edges, run=C.components):
        walked.append(edges.filter("u != v").count())
        return run(edges)

    monkeypatch.setattr(C, "components", counted)
    monkeypatch.setattr(T, "components", counted)
    rows = list(enumerate(near_copies(150, 9, 200, 14)))
    assert found(T.near_duplicates(documents(rows))) == brute(rows)
    assert len(walked) == 2 and walked[0] > 100 and walked[1] < walked[0] / 2, walked


def test_joined_components_equal_those_of_all_links(spark):
    draw = random.Random(11)
    first, more = ([(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(n)] for n in (40, 25))
    frames = [spark.createDataFrame(x, "u long, v long") for x in (first, more)]
    whole = {r["node"]: r["component"] for r in C.components(frames[0].union(frames[1])).collect()}
    rows = C.joined(C.components(frames[0]), frames[1]).collect()
    assert {r["node"]: r["component"] for r in rows} == whole and len(rows) == len(whole)
    nothing = frames[1].limit(0)
    assert {tuple(r) for r in C.joined(C.components(frames[0]), nothing).collect()} == {tuple(r) for r in C.components(frames[0]).collect()}
