import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablelens.llm import lines as L
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, edits, least):
    """doc_id -> (kept, copies, near) for documents in order."""
    first, out = {}, {}
    for doc_id, text in docs:
        for i, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (doc_id, i))
    long = [x for x in first if len(x) >= least]
    late = {
        first[a] for a in long for b in long if first[b] < first[a] and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits
    }
    for doc_id, text in docs:
        rows = list(enumerate(text.split("\n")))
        full = [(i, x) for i, x in rows if x.strip(" ")]
        copies = sum(first[x] != (doc_id, i) for i, x in full)
        near = sum((doc_id, i) in late for i, _ in full)
        kept = [x for i, x in rows if not x.strip(" ") or (first[x] == (doc_id, i) and (doc_id, i) not in late)]
        out[doc_id] = ("\n".join(kept), copies, near)
    return out


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_band_equals_plain_distance(spark, edits):
    rng, rows = random.Random(edits), []
    for _ in range(400):
        a = "".join(rng.choice("abé𝄞") for _ in range(rng.randint(8, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "c", "a"])
        if len(b) > 7 and abs(len(a) - len(b)) <= edits:
            rows.append((a, "".join(b), distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int").withColumn("x", L.banded_distance(F.col("a"), F.col("b"), edits))
    for r in df.collect():
        assert r["x"] == r["d"] if r["d"] <= edits else r["x"] > edits


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_every_near_line_is_found(documents, edits):
    rng, docs = random.Random(9), []
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(14, 40))) for _ in range(12)]
    for doc_id in range(25):
        own = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            own.append("".join(line))
        docs.append((doc_id, "\n".join(own)))
    found = {r["doc_id"]: (r["kept"], r["n_copies"], r["n_near"]) for r in L.dedup_lines(documents(docs), edits=edits, least=10).collect()}
    assert found == brute(docs, edits, 10)


def test_documents_equal_brute_force(spark, folder):
    docs = table(spark, folder, "documents").filter("doc_id < 60")
    plain = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = {r["doc_id"]: (r["kept"], r["n_copies"], r["n_near"]) for r in L.dedup_lines(docs).collect()}
    assert found == brute(plain, 2, 24)


def test_odd_rows(odd):
    done = L.dedup_lines(odd)
    assert set(done.columns) == {*odd.columns, "n_lines", "n_copies", "n_near"}
    rows = done.collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert by[(0, None)]["kept"] == "" and by[(3, "\n\n")]["kept"] == "\n\n"
    assert by[(4, "a")]["kept"] == "a" and by[(5, "a")]["kept"] == "" and by[(5, "a")]["n_copies"] == 1
    assert by[(9, "# head\n\nline one.\nline one.")]["kept"] == "# head\n\nline one."
    assert L.dedup_lines(odd.limit(0)).count() == 0


def test_short_limit_is_an_error(odd):
    with pytest.raises(ValueError):
        L.dedup_lines(odd, edits=5, least=10)


def test_no_python_on_the_way(spark, folder):
    plan = QUERIES["op2_line_dedup"](spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_lines_that_differ_by_a_word_meet_in_few_rows(spark, documents, monkeypatch):
    rng, rows = random.Random(4), []
    letters = "abcdefghijklmnop"
    base = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(20)]
    lines = set()
    while len(lines) < 240:
        own = base[:]
        own[rng.randrange(20)] = "".join(rng.choice(letters) for _ in range(rng.randint(4, 8)))
        lines.add(" ".join(own))
    for line in sorted(lines)[:30]:  # and some that are near one of them, in two places or one
        for edits in (1, 2):
            near = list(line)
            for _ in range(edits):
                at = rng.randrange(len(near))
                near[at : at + rng.randint(0, 1)] = rng.choice("xyz")
            lines.add("".join(near))
    docs = list(enumerate(sorted(lines, key=lambda x: x[::-1])))

    def counted(df, cut=L.cut_lineage):
        done = cut(df)
        if {"owners", "x"} <= set(done.columns):
            rows.append(done.count())
        return done

    monkeypatch.setattr(L, "cut_lineage", counted)
    found = {r["doc_id"]: r["n_near"] for r in L.dedup_lines(documents(docs)).collect()}

    def near(a, b):
        apart = Counter(a), Counter(b)
        return (apart[0] - apart[1]).total() + (apart[1] - apart[0]).total() <= 4 and distance(a, b) <= 2

    assert found == {i: int(any(near(x, y) for _, y in docs[:i])) for i, x in docs}
    assert sum(rows) < 60 * len(docs)
