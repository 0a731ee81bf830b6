import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tablelens.llm import boosting
from tablelens.llm import pii as P
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain(text):
    """Base spans by the patterns as the contract writes them."""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(n)))
        if 13 <= len(n) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    found += [
        ("phone", *m.span())
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15
    ]
    return found


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "x-y", "1.2.3.4", "256", "12", "0", "+1", " ", "-", "(", ")", "4111111111111111", "é", "%", "007.1", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert P.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "+1" * 100_000, "1." * 100_000, "a@" * 50_000):
        P.base_spans(text)
        P.candidates(text)


def test_trees_fit_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 2] < 0.5)).astype(float)
    trees = boosting.fit(x, y)
    assert ((trees.predict(x) > 0.5) == (y > 0)).mean() > 0.97
    assert boosting.fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]


def test_model_adds_rewritten_ones_and_leaves_numbers(spark):
    rng, rows = random.Random(2), []
    for i in range(900):
        number = "".join(rng.choice("0123456789") for _ in range(10))
        rows.append((f"word order {rng.randint(1, 10**9)} then mail user{i}@host{i % 9}.example.com or phone +1 ({number[:3]}) {number[3:6]}-{number[6:]} end, version {i}.{i % 7} of year 19{i % 90 + 10}",))
    docs = spark.createDataFrame(rows, "text string")
    model = P.learn(docs)
    texts = ["write to user5 [at] host [dot] example [dot] org now", "in the year 1999 and 2001 there were 12345 of them"]
    (base, added), (none, nothing) = P.all_spans(texts, model)
    assert base == [] and [texts[0][s:e] for _, s, e in added] == ["user5 [at] host [dot] example [dot] org"]
    assert none == [] and nothing == []


def shown(text):
    return {(k, text[s:e]) for k, s, e in P.candidates(text)}


def test_numbers_in_one_run_are_candidates_each():
    card = "4465758382889437"
    assert [(k, s) for k, s, e in P.candidates(f"{card} {card}") if e - s == 16] == [("card", 0), ("card", 17)]
    assert {("phone", "555-123-4567"), ("phone", "555-987-6543")} <= shown("555-123-4567 / 555-987-6543")
    assert ("phone", "555-123-4567") in shown("2024-01-05 555-123-4567")
    assert ("ip", "10.20.30.400") in shown("at 10.20.30.400 5")
    spans = [("card", 0, 16)]
    assert ("phone", 17, 29) in list(P._free(P.candidates(f"{card} 555-123-4567"), spans))
    assert not any(s < 16 for _, s, _ in P._free(P.candidates(f"{card} 555-123-4567"), spans))


def test_model_adds_cards_and_phones_side_by_side(spark):
    rng, rows = random.Random(6), []
    for i in range(900):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(body + c for c in "0123456789" if P.luhn(body + c))
        number = "".join(rng.choice("0123456789") for _ in range(10))
        rows.append((f"order {rng.randint(1, 10**9)} paid by card {card} or call +1 ({number[:3]}) {number[3:6]}-{number[6:]} on 20{i % 90 + 10}-01-05 end",))
    model = P.learn(spark.createDataFrame(rows, "text string"))
    card = "4465758382889437"
    texts = [f"paid by card {card} {card} here", "please call 1555-123-4567 / 1555-987-6543 now"]
    told = [[t[s:e] for _, s, e in sorted(added, key=lambda x: x[1])] for t, (_, added) in zip(texts, P.all_spans(texts, model), strict=True)]
    assert told == [[card, card], ["1555-123-4567", "1555-987-6543"]]


def test_common_loose_forms_are_not_learned_as_negatives(spark):
    rng, rows = random.Random(7), []
    for i in range(1500):
        number = "".join(rng.choice("123456789") for _ in range(10))
        base = f"mail user{i}@host{i % 9}.example.com or phone +1 ({number[:3]}) {number[3:6]}-{number[6:]}"
        loose = f"mail user{i} [at] host{i % 9} [dot] example [dot] com or phone ({number[:3]}) {number[3:6]}-{number[6:]}"
        made = base if i % 5 == 0 else loose  # four in five are loose
        rows.append((f"word order {rng.randint(1, 10**9)} then {made} end, version {i}.{i % 7} of 20{i % 90 + 10}-01-05",))
    model = P.learn(spark.createDataFrame(rows, "text string"))
    assert model.thresholds["email"] <= 1 and model.thresholds["phone"] <= 1
    texts = ["word then mail ann [at] host3 [dot] example [dot] com or phone (555) 123-4567 end", "order 20231 of 2024-01-05, version 12.3"]
    (_, added), (_, nothing) = P.all_spans(texts, model)
    assert {texts[0][s:e] for _, s, e in added} == {"ann [at] host3 [dot] example [dot] com", "(555) 123-4567"}
    assert nothing == []


def test_redaction(spark):
    df = spark.createDataFrame([("ab é@c xyz", [("email", 3, 6), ("ip", 5, 6), ("phone", 7, 9)]), ("", [])], f"t string, s array<{P.SPAN}>")
    assert [r["r"] for r in df.select(P.redacted(F.col("t"), F.col("s")).alias("r")).collect()] == ["ab [EMAIL] [PHONE]z", ""]


def test_odd_rows(odd):
    made = P.find_documents(odd)
    assert made.count() == odd.count() and made.filter("size(spans) > 0").count() == 0
    assert P.find_documents(odd.limit(0)).count() == 0


def test_query_equals_the_patterns(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    for r in QUERIES["op9_pii"](spark, folder).collect():
        base = plain(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(b[0] == k for b in base) for k in P.KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_given_columns_keep_their_values(documents):
    taken = ["_found", "found", "given0", "a.b", "spans", "Base"]
    docs = documents([(1, "write to a.b@example.org or 10.0.0.1"), (2, None)]).withColumns({c: F.lit(i) for i, c in enumerate(taken)})
    made = P.find_documents(docs)
    assert made.columns == [*docs.columns[:-2], "base", "spans"]
    rows = {r["doc_id"]: r.asDict() for r in made.collect()}
    assert all(r[c] == i for r in rows.values() for i, c in enumerate(taken[:-2]))
    assert [s["kind"] for s in rows[1]["base"]] == ["email", "ip"] and rows[2]["base"] == []


def test_all_documents_are_learned_from(spark):
    """Phones stand only in texts that a draw of 5,000 of the 6,000 by hash would leave out."""
    rng, texts = random.Random(8), []
    for i in range(6_000):
        number = "".join(rng.choice("123456789") for _ in range(10))
        texts.append((f"order {i} of 20{i % 90 + 10}-01-05 ", f"phone +1 ({number[:3]}) {number[3:6]}-{number[6:]} end"))
    docs = spark.createDataFrame(texts, "a string, b string").withColumn("text", F.concat("a", "b"))
    left_out = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) >= int(0.84 * (1 << 30))
    docs = docs.select(F.when(left_out, F.col("text")).otherwise(F.col("a")).alias("text"))
    model = P.learn(docs)
    assert model.thresholds["phone"] <= 1 and len(model.trees["phone"].splits)


def test_trees_of_spread_cells_equal_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(3 * rng.normal(size=(600, P.FEATURES)))
    y = ((x[:, 0] > 1) & (x[:, 2] < 2) ^ (rng.random(600) < 0.1)).astype(int)
    kinds = ["card", "phone"]
    rows = [(kinds[i % 2], int(y[i]), x[i].tolist()) for i in range(600)]
    trees = P._trees(spark.createDataFrame(rows, "kind string, label int, x array<double>").repartition(5))
    for i, kind in enumerate(kinds):
        whole = boosting.fit(x[i::2], y[i::2])
        assert np.array_equal(trees[kind].splits, whole.splits) and np.allclose(trees[kind].leaves, whole.leaves)
    assert trees["email"].predict(x[:2]).tolist() == [0.5, 0.5]


def test_threshold_is_that_of_all_in_order(spark):
    told = [("ip", p, i < ones) for p, n, ones in ((0.9, 60, 60), (0.8, 40, 36), (0.79999, 3, 0), (0.1, 100, 0)) for i in range(n)]
    judged = spark.createDataFrame(told, "kind string, p double, label boolean").withColumn("label", F.col("label").cast("int"))
    assert P._thresholds(judged) == {"email": 1.1, "ip": 0.8, "card": 1.1, "phone": 1.1}
    assert P._thresholds(judged.limit(0))["ip"] == 1.1
