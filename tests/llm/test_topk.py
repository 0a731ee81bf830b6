import math
import random

import numpy as np
from oracle import compare, connect
from pyspark.sql import functions as F

from tablelens.llm import topk as K
from tablelens.llm.queries import QUERIES, SQL


def brute(queries, rows, k):
    out = []
    for q, x in queries:
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_query_equals_sql(spark, folder):
    assert compare(QUERIES["op7_topk"](spark, folder), connect(folder), SQL["op7_topk"]) == []


def test_blocks_ties_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 40)
    monkeypatch.setattr(K, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(K, "STEP", 4)
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) * (1 + i % 3) for _ in range(4 if i % 5 else 3)]) for i in range(150)]
    rows += [(150 + i, rows[7][1]) for i in range(20)] + [(200, [0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    found = K.search(df.filter("vec_id % 10 = 0"), df, 10).collect()
    assert sorted(map(tuple, found)) == brute([r for r in rows if r[0] % 10 == 0], rows, 10)


def test_elimination_skips_rows(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(-900, 900, (10, 16))
    rows = (centres[rng.integers(0, 10, 4000)] + rng.integers(-20, 20, (4000, 16))).astype(np.int64)
    longest = int((rows * rows).sum(axis=1).max())
    seen = []
    order = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(1) or order(keys))
    for _, ids, scores in K.best_of_block(rows[:5], np.arange(5), rows, np.arange(4000), rows[::125], longest, 10):
        assert len(ids) == 10 and (np.diff(scores) <= 0).all()
    assert len(seen) < 5 * 4000 / K.STEP / 2


def test_odd_vectors(spark):
    rows = [(0, [1.0, -0.5]), (1, [0.25, None]), (2, None), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", K.scaled(F.col("embedding")).alias("vector"))
    assert {r["vec_id"] for r in df.filter("vector is not null").collect()} == {None, 0, 5, 6}
    found = K.search(df, df, 10).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 6, 1024 * 512 - 512 * 512), (6, 1, 0, 1024 * 512 - 512 * 512)]
    assert K.search(df.limit(0), df, 3).count() == 0 and K.search(df, df.limit(0), 3).count() == 0
