import hashlib

from pyspark.sql import functions as F

from tablelens.llm import merkle as M
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(text):
    """The fingerprint of a text, step by step."""
    sections, own, before = [], [], None
    for line in text.split("\n"):
        here = (sha(line), line.startswith("#"), line.strip(" ") == "")
        if before and (here[1] or before[2] or before[0].startswith("0")):
            sections.append(own)
            own = []
        own.append(here[0])
        before = here
    sections.append(own)
    return sha(",".join(sha(",".join(s)) for s in sections))


def test_query_equals_brute_force(spark, folder):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect())
    found = {r["doc_id"]: r for r in QUERIES["op3_merkle"](spark, folder).collect()}
    assert len(found) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        after, half, row = docs[(i + 1) % len(docs)][1], len(text) // 2, found[doc_id]
        edited = text[: len(text) - half] + after[:half]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == sha(edited)
        assert row["fingerprint"] == root(text) and row["edited_fingerprint"] == root(edited)
        assert 0 <= row["near_edited"] <= 1 and (row["near_next"] == 1) == (text == after)


def test_next_crosses_gaps_and_wraps(documents, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "FAN", 8)
    ids = [-7, -6, 0, 3, 5, 40, 41, 42, 43, 44, 1000, 5000]
    rows = documents([(i, f"t{i}") for i in ids] + [(None, "n")]).select("doc_id", "text")
    found = {r["text"]: r["next_text"] for r in M.with_next(rows).collect()}
    order = ["n", *(f"t{i}" for i in ids)]
    assert found == dict(zip(order, order[1:] + order[:1], strict=True))


def test_edits_are_located(spark):
    a = "# one\nfirst line.\nsecond line.\n# two\nthird line."
    rows = [(a, a), (a, a.replace("second", "other")), ("", a), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    trees = df.select(M.merkle_tree(F.col("a")).alias("a"), M.merkle_tree(F.col("b")).alias("b"))
    shown = trees.select(M.likeness(F.col("a"), F.col("b")).alias("like"), M.edits(F.col("a"), F.col("b")).alias("edits")).collect()
    assert [r["like"] for r in shown] == [1.0, 0.8, 0.0, 1.0]
    assert shown[0]["edits"] == [] and len(shown[1]["edits"]) == 1 and shown[3]["edits"] == []


def test_odd_rows(odd):
    rows = M.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert all(len(r["text"]) // 2 <= len(r["edited"]) <= len(r["text"]) for r in rows)
    assert M.fingerprints(odd.limit(0)).count() == 0
    assert [r["next_text"] for r in M.with_next(odd.limit(1).select("doc_id", F.lit("x").alias("text"))).collect()] == ["x"]


def test_no_python_on_the_way(spark, folder):
    plan = QUERIES["op3_merkle"](spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
