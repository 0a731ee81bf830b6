import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import whitening as M
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame([(i, list(map(int, v))) for i, v in rows], "vec_id long, vector array<long>")


def held(df):
    """component -> vec_id -> row"""
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], {})[r["vec_id"]] = r
    return out


def against_numpy(rows, found, most=32):
    x = np.array([v for _, v in rows], float)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert sorted(found) == list(range(1, k + 1))
    whitened = np.array([[found[c][i]["whitened"] for c in range(1, k + 1)] for i, _ in rows])
    assert np.abs(whitened.T @ whitened / len(x) - np.eye(k)).max() < 1e-9
    for c in range(1, k + 1):
        one = next(iter(found[c].values()))
        assert one["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert one["identity_error"] < 1e-9 and one["n"] == len(rows)
        want = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        gap = min([abs(values[c - 1] - v) for i, v in enumerate(values) if i != c - 1], default=1)
        if gap > 1e-4 * values[0]:
            assert min(np.abs(whitened[:, c - 1] - want).max(), np.abs(whitened[:, c - 1] + want).max()) < 1e-7
    total = [sum(int(v[j]) for _, v in rows) for j in range(x.shape[1])]
    for i, v in rows:
        assert int(found[1][i]["deviation"]) == sum((len(rows) * int(a) - s) ** 2 for a, s in zip(v, total, strict=True))


def drawn(n, size, seed=0, scale=40):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, size)) @ rng.normal(size=(size, size))
    return [(i, np.floor(scale * v).astype(int) + 10**6) for i, v in enumerate(mixed)]


@pytest.mark.parametrize("n, size, most", [(200, 12, 5), (60, 7, 32), (5, 9, 32), (40, 1, 3), (30, 2, 2)])
def test_equals_numpy(spark, n, size, most):
    rows = drawn(n, size)
    against_numpy(rows, held(M.whiten(frame(spark, rows), most)), most)


def test_equal_eigenvalues(spark):
    rows = [(2 * i + s, [7 * (1 - 2 * s) * (j == i) for j in range(6)]) for i in range(6) for s in (0, 1)]
    found = held(M.whiten(frame(spark, rows)))
    against_numpy(rows, found)
    rows += [(100 + s, [300 * (1 - 2 * s), 0, 0, 0, 0, 0]) for s in (0, 1)]
    against_numpy(rows, held(M.whiten(frame(spark, rows))))


def test_eigenvalues_that_doubles_cannot_tell_apart(spark):
    a = 10**9
    rows = [(0, [a, 0]), (1, [-a, 0]), (2, [0, a + 1]), (3, [0, -a - 1])]
    found = held(M.whiten(frame(spark, rows)))
    assert abs(found[1][2]["whitened"]) == pytest.approx(math.sqrt(2), rel=1e-14)
    assert abs(found[1][0]["whitened"]) < 1e-14 and abs(found[2][2]["whitened"]) < 1e-14


def test_sums_beyond_64_bits(spark):
    rows = [(i, [(-1) ** i * (1 << 59) + i, i * (1 << 50), 5]) for i in range(6)]
    found = M.sums(frame(spark, rows).withColumn("size", F.lit(3)).select("size", "vector"))[3]
    assert found.products[0][0] == sum(int(v[0]) ** 2 for _, v in rows)
    assert found.products[0][1] == sum(v[0] * v[1] for _, v in rows)
    assert len(held(M.whiten(frame(spark, rows)))) == 2


def test_characteristic_polynomial(spark):
    matrix = M.Sums(9, [3, -1, 4], [[50, 7, 1], [7, 60, -20], [1, -20, 90]]).scatter()
    found, _ = M.characteristic(spark, matrix)
    for at in (0, 5, -3, 10**6):
        (a, b, c), (d, e, f), (g, h, i) = [[Fraction(at * (j == k) - matrix[j, k]) for k in range(3)] for j in range(3)]
        assert sum(x * at**k for k, x in enumerate(found)) == a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def test_hessenberg_with_zero_pivots():
    matrix = np.array([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]], object)
    # (x - 1) (x - 3)^3
    assert M.characteristic_modulo(matrix, 2147483647) == [27, 2147483647 - 54, 36, 2147483647 - 10, 1]
    factors = M.square_free([27, -54, 36, -10, 1], [2147483647, 2147483629])
    assert factors == [([-1, 1], 1), ([-3, 1], 3)]
    bits, found = M.isolate([3, -4, 1], 5)
    assert [M.refined([3, -4, 1], bits + 10, low << 10, high << 10, n) / 2 ** (bits + 10) for low, high, n in found] == [3, 1]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [0.25, 0.0]), (5, [0.25, 0.0]),
            (5, [0.25, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [3e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("size", F.lit("mine")).withColumn("n", F.lit(-1))
    df = df.withColumn("vector", M.whole_vector(F.col("embedding")))
    found = M.whiten(df).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in found) == sorted((i, c, 5) for i in ("0", "None", "5", "5", "9") for c in (1, 2))
    assert M.whiten(df.limit(0)).collect() == [] and M.whiten(df.filter("vec_id = 7")).collect() == []


def test_query(spark, folder):
    rows = [(r[0], [math.floor(64 * float(c)) + 10**6 for c in r[1]]) for r in table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    against_numpy(rows, held(QUERIES["op12_whitening"](spark, folder)))
