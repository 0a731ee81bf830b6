"""Whitening of integer vectors by the exact characteristic polynomial of their scatter.

Counts, sums and products of whole numbers are added up exactly in one pass, so n^2 times the covariance is
an integer matrix M. Its characteristic polynomial is computed modulo many primes, each by reduction to
Hessenberg form, and put together by the Chinese remainder theorem; primes are rows that Spark spreads over
tasks. The polynomial has real roots only, so the signs of its coefficients after a shift count the roots
beyond a point, which isolates them; they are then bisected to many digits. Components are null vectors of M
less a root, by inverse iteration in fixed point, so they are right to double precision however close
two roots are. All this depends on the length of the vectors alone; rows are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb, isqrt, prod, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import cut_lineage

#: Primes are just under this, so that products of residues fit 62 bits.
HIGHEST_PRIME = 1 << 31
#: Bits to which roots and components are computed.
DIGITS, FIXED = 128, 256
_LIMB = 40


def whole_vector(embedding: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of each entry as array<long>; null if the vector or an entry is null or not finite.

    Entries beyond 2^60 / scale count as that.
    """
    sound = F.forall(embedding, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    most = float(1 << 60)

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(most)), F.lit(-most))).cast("long") + F.lit(shift)

    return F.when(F.coalesce(sound, F.lit(False)), F.transform(embedding, whole))


def _rows_of(part: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in part])


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as it is if numbers up to `most` fit 62 bits, else as whole numbers of any size."""
    return x if most < 1 << 62 else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


@dataclass
class Sums:
    """Exact sums over the vectors of one length."""

    n: int
    total: list[int]
    products: list[list[int]]

    def scatter(self) -> np.ndarray:
        """n^2 times the covariance (divisor n), as whole numbers."""
        x = np.array(self.total, object)
        return self.n * np.array(self.products, object).reshape(len(x), len(x)) - np.outer(x, x)


def sums(vectors: DataFrame) -> dict[int, Sums]:
    """By length: number, sums and sums of products of (size, vector), each task's own sums added up by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for size, part in batch.groupby("size"):
                x = _rows_of(part["vector"])
                x = _exact(x, _largest(x) ** 2 * len(x))
                own = held.setdefault(int(size), [0, 0, 0])
                own[0] += len(x)
                own[1] = own[1] + x.sum(axis=0).astype(object)
                own[2] = own[2] + (x.T @ x).astype(object)
        for size, (n, total, products) in held.items():
            places, values = [(-1, -1)], [n]
            places += [(-1, j) for j in range(size)]
            values += [int(v) for v in total]
            upper = np.triu_indices(size)
            places += list(zip(*upper, strict=True))
            values += [int(v) for v in products[upper]]
            i, j = zip(*places, strict=True)
            high, low = [Decimal(v >> _LIMB) for v in values], [v & (1 << _LIMB) - 1 for v in values]
            yield pd.DataFrame({"size": size, "i": i, "j": j, "high": high, "low": low})

    parts = vectors.mapInPandas(run, "size int, i int, j int, high decimal(38,0), low long")
    found: dict[int, Sums] = {}
    # one row for each pair of components of a length
    added = parts.groupBy("size", "i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    for r in sorted(added.collect(), key=lambda r: (r["size"], r["i"], r["j"])):
        value, size = (int(r["high"]) << _LIMB) + int(r["low"]), r["size"]
        own = found.setdefault(size, Sums(0, [0] * size, [[0] * size for _ in range(size)]))
        if r["j"] < 0:
            own.n = value
        elif r["i"] < 0:
            own.total[r["j"]] = value
        else:
            own.products[r["i"]][r["j"]] = own.products[r["j"]][r["i"]] = value
    return found


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide all numbers under 2^32."""
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd = n - 1
    turns = (odd & -odd).bit_length() - 1
    odd >>= turns
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(turns - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes from HIGHEST_PRIME down whose product is more than `bound`."""
    found, product, n = [], 1, HIGHEST_PRIME - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(trace: int, size: int) -> int:
    """No coefficient of a polynomial with `size` roots of 0 or more and that sum is larger."""
    return max(comb(size, k) * (trace // max(size, 1) + 1) ** k for k in range(size + 1))


def characteristic_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo a prime, from the constant on, by way of Hessenberg form."""
    h = (matrix % p).astype(np.int64)
    size = len(h)
    for k in range(size - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + below[0]
        h[[k + 1, at]] = h[[at, k + 1]]
        h[:, [k + 1, at]] = h[:, [at, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((size + 1, size + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, size + 1):
        new = np.roll(polys[m - 1], 1) - h[m - 1, m - 1] * polys[m - 1] % p
        weight, weights = 1, []
        for i in range(m - 1, 0, -1):
            weight = weight * int(h[i, i - 1]) % p
            weights.append(weight * int(h[i - 1, m - 1]) % p)
        if weights:
            new = new - (np.array(weights[::-1], np.int64)[:, None] * polys[: m - 1] % p).sum(axis=0)
        polys[m] = new % p
    return polys[size].tolist()


def _remainders(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The whole numbers nearest to zero with those residues."""
    values, product = [0] * len(residues[0][1]), 1
    for p, own in residues:
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, own, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> tuple[list[int], list[int]]:
    """Coefficients of the characteristic polynomial from the constant on, and the primes that gave them."""
    trace = sum(int(x) for x in np.diag(matrix))
    primes = primes_beyond(2 * coefficient_bound(trace, len(matrix)))
    parts = min(len(primes), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [characteristic_modulo(matrix, int(p)) for p in batch["p"]]
            yield pd.DataFrame({"p": batch["p"], "residues": found})

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(parts)
    residues = rows.mapInPandas(run, "p long, residues array<long>").collect()
    return _remainders([(r["p"], r["residues"]) for r in residues]), primes


def _trimmed(f: np.ndarray) -> np.ndarray:
    used = np.flatnonzero(f)
    return f[: used[-1] + 1] if len(used) else f[:0]


def _divided(f: np.ndarray, g: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder modulo p; polynomials from the constant on, without leading zeros."""
    f, g = f.copy(), g * pow(int(g[-1]), -1, p) % p
    lead, quotient = 1, np.zeros(max(len(f) - len(g) + 1, 0), np.int64)
    for k in range(len(quotient) - 1, -1, -1):
        quotient[k] = f[k + len(g) - 1] * lead % p
        f[k : k + len(g)] = (f[k : k + len(g)] - quotient[k] * g % p) % p
    return quotient, _trimmed(f)


def _common(f: np.ndarray, g: np.ndarray, p: int) -> np.ndarray:
    while len(g):
        f, g = g, _divided(f, g, p)[1]
    return f * pow(int(f[-1]), -1, p) % p


def _slope(f: np.ndarray, p: int) -> np.ndarray:
    return _trimmed(f[1:] * np.arange(1, len(f)) % p)


def square_free_modulo(coefficients: list[int], p: int) -> list[list[int]]:
    """Factors of single roots, of double roots and so on, modulo a prime (Yun); their leading ones are 1."""
    f = np.array([c % p for c in coefficients], np.int64)
    slope = _slope(f, p)
    common = _common(f, slope, p)
    b, c, factors = _divided(f, common, p)[0], _divided(slope, common, p)[0], []
    while len(b) > 1:
        own = _slope(b, p)
        width = max(len(c), len(own))
        d = _trimmed((np.pad(c, (0, width - len(c))) - np.pad(own, (0, width - len(own)))) % p)
        a = _common(b, d, p)
        factors.append(a.tolist())
        b, c = _divided(b, a, p)[0], _divided(d, a, p)[0] if len(d) else d
    return factors


def _times(f: list[int], g: list[int]) -> list[int]:
    out = [0] * (len(f) + len(g) - 1)
    for i, a in enumerate(f):
        for j, b in enumerate(g):
            out[i + j] += a * b
    return out


def square_free(coefficients: list[int], primes: list[int]) -> list[tuple[list[int], int]]:
    """(factor, multiplicity) of a monic polynomial with whole coefficients: no factor has a root twice.

    A prime for which there is no common root with the slope proves that there is none at all.
    """
    if len(coefficients) == 1:
        return []
    found = []
    for p in primes:
        factors = square_free_modulo(coefficients, p)
        if len(factors) == 1:
            return [(coefficients, 1)]
        found.append((p, factors))
    # a prime that divides a discriminant sees more repeated roots than there are
    shape = max(found, key=lambda x: [len(f) for f in x[1]])[1]
    shape = [len(f) for f in shape]
    whole = [
        _remainders([(p, factors[i]) for p, factors in found if [len(f) for f in factors] == shape]) for i in range(len(shape))
    ]
    back = [1]
    for i, f in enumerate(whole):
        for _ in range(i + 1):
            back = _times(back, f)
    if back != coefficients:
        raise ArithmeticError("too few primes tell the factors of the characteristic polynomial apart")
    return [(f, i + 1) for i, f in enumerate(whole) if len(f) > 1]


def _stretched(f: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    return [c << bits * (len(f) - 1 - k) for k, c in enumerate(f)]


def roots_beyond(f: list[int], at: int) -> int:
    """Number of roots over `at`, for a polynomial with real simple roots: signs of f(x + at) that change."""
    f = f[:]
    for i in range(len(f) - 1):
        for j in range(len(f) - 2, i - 1, -1):
            f[j] += at * f[j + 1]
    signs = [c > 0 for c in f if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolate(f: list[int], most: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(bits, intervals): the `most` largest positive roots, each alone in (low, high] / 2^bits, with the roots beyond."""
    bits = 0
    while True:
        g = _stretched(f, bits)
        high = 1 << max(abs(c).bit_length() // (len(g) - 1 - k) + 2 for k, c in enumerate(g[:-1]))
        stack, found = [(0, high, roots_beyond(g, 0), 0)], []
        while stack:
            low, high, n_low, n_high = stack.pop()
            if n_low == n_high or len(found) >= most:
                continue
            if n_low == n_high + 1:
                found.append((low, high, n_high))
            elif high - low == 1:
                break
            else:
                mid = (low + high) // 2
                n_mid = roots_beyond(g, mid)
                stack += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
        else:
            return bits, found
        bits += 64


def refined(f: list[int], bits: int, low: int, high: int, beyond: int) -> int:
    """The root in (low, high] / 2^bits as a whole number of 2^-bits, when `high - low` is 1 or it is met."""
    g = _stretched(f, bits)
    while high - low > 1:
        mid = (low + high) // 2
        value = 0
        for c in reversed(g):
            value = value * mid + c
        if not value:
            return mid
        if (value > 0) == (beyond % 2 == 0):
            high = mid
        else:
            low = mid
    return high


def null_vectors(matrix: np.ndarray, root: int, bits: int, many: int) -> np.ndarray:
    """(many, size) orthonormal vectors that matrix - root / 2^bits brings nearest to zero, as doubles."""
    size, up = len(matrix), bits + FIXED
    a = np.array([[int(x) << up for x in row] for row in matrix], object).reshape(size, size)
    a[np.diag_indices(size)] -= root << FIXED
    unit, turns, factors = 1 << FIXED, [], []
    for k in range(size):
        at = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
        turns.append(at)
        a[k, k] = a[k, k] or 1
        u = (a[k + 1 :, k] << FIXED) // a[k, k]
        a[k + 1 :, k:] -= np.outer(u, a[k, k:]) >> FIXED
        factors.append(u)
    found: list[np.ndarray] = []
    for m in range(many):
        x = np.array([unit + ((k * 7919 + m * 104729 + k * k * 31) % 1009 << FIXED - 11) for k in range(size)], object)
        for _ in range(3):
            for k in range(size):
                x[[k, turns[k]]] = x[[turns[k], k]]
                x[k + 1 :] -= factors[k] * x[k] >> FIXED
            for k in range(size - 1, -1, -1):
                x[k] = ((x[k] << up) - sum(a[k, k + 1 :] * x[k + 1 :])) // a[k, k]
            for own in found:
                x = x - (own * (sum(own * x) >> FIXED) >> FIXED)
            x = (x << FIXED) // max(1, isqrt(sum(x * x)))
        found.append(x)
    return np.array([[int(v) / unit for v in x] for x in found], float).reshape(many, size)


@dataclass
class Basis:
    """Components of the vectors of one length, by falling eigenvalue."""

    n: int
    total: list[int]
    components: np.ndarray
    roots: list[float]
    explained: list[float]


def basis(spark: SparkSession, fitted: Sums, most: int) -> Basis:
    """Up to `most` components whose eigenvalue is over zero; equal eigenvalues count each."""
    matrix = fitted.scatter()
    trace = sum(int(x) for x in np.diag(matrix)) if len(matrix) else 0
    empty = Basis(fitted.n, fitted.total, np.zeros((0, len(matrix))), [], [])
    if not trace:
        return empty
    coefficients, primes = characteristic(spark, matrix)
    zeros = next(k for k, c in enumerate(coefficients) if c)
    jobs = []
    for factor, times in square_free(coefficients[zeros:], primes):
        bits, intervals = isolate(factor, most)
        jobs += [(times, bits, str(low), str(high), beyond, [str(c) for c in factor]) for low, high, beyond in intervals]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                low, high = int(r.low), int(r.high)
                more = max(0, DIGITS - high.bit_length()) + (high - low).bit_length()
                root = refined([int(c) for c in r.factor], r.bits + more, low << more, high << more, r.beyond)
                found = null_vectors(matrix, root, r.bits + more, r.times)
                yield pd.DataFrame({"root": [str(root)], "bits": [r.bits + more], "vectors": [found.ravel()], "times": [r.times]})

    rows = spark.createDataFrame(jobs, "times int, bits int, low string, high string, beyond int, factor array<string>")
    rows = rows.repartition(min(len(jobs), spark.sparkContext.defaultParallelism))
    done = rows.mapInPandas(run, "root string, bits int, vectors array<double>, times int").collect()
    depth = max(r["bits"] for r in done)
    done.sort(key=lambda r: -(int(r["root"]) << depth - r["bits"]))
    vectors = np.concatenate([np.array(r["vectors"]).reshape(r["times"], -1) for r in done])[:most]
    roots = [int(r["root"]) / (1 << r["bits"]) for r in done for _ in range(r["times"])][:most]
    shares = [int(r["root"]) / (trace << r["bits"]) for r in done for _ in range(r["times"])][:most]
    return Basis(fitted.n, fitted.total, vectors, roots, shares)


def _projected(vectors: DataFrame, bases: dict[int, Basis]) -> DataFrame:
    """vec_id, size, n, deviation, whitened: an array over the components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                own, x = bases[int(size)], _rows_of(part["vector"])
                total = np.array(own.total, object)
                most = own.n * _largest(x) + max((abs(t) for t in own.total), default=0)
                apart = own.n * _exact(x, most) - (total.astype(np.int64) if most < 1 << 62 else total)
                squares = _exact(apart, _largest(apart) ** 2 * int(size))
                deviation = (squares * squares).sum(axis=1)
                whitened = apart.astype(float) @ own.components.T / np.sqrt(np.array(own.roots))
                yield pd.DataFrame(
                    {"vec_id": part["vec_id"].astype("Int64"), "size": part["size"], "n": own.n, "deviation": [Decimal(int(v)) for v in deviation], "whitened": list(whitened)}
                )

    return vectors.mapInPandas(run, "vec_id long, size int, n long, deviation decimal(38,0), whitened array<double>")


def _identity_errors(projected: DataFrame) -> dict[int, float]:
    """By length: the largest entry of the covariance of the whitened rows less the identity, to 12 digits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for size, part in batch.groupby("size"):
                w = np.stack(part["whitened"])
                own = held.setdefault(int(size), [0, 0.0, 0.0])
                held[int(size)] = [own[0] + len(w), own[1] + w.sum(axis=0), own[2] + w.T @ w]
        for size, (n, total, products) in held.items():
            flat = np.concatenate([[n], total, products.ravel()])
            yield pd.DataFrame({"size": size, "place": np.arange(len(flat)), "value": flat})

    parts = projected.mapInPandas(run, "size int, place int, value double")
    # one row for each pair of components of a length
    added = parts.groupBy("size", "place").agg(F.sum("value").alias("value")).toPandas()
    found = {}
    for size, part in added.groupby("size"):
        flat = part.sort_values("place")["value"].to_numpy()
        k = isqrt(len(flat) - 1)
        mean = flat[1 : k + 1] / flat[0]
        apart = flat[k + 1 :].reshape(k, k) / flat[0] - np.outer(mean, mean) - np.eye(k)
        found[int(size)] = round(float(np.abs(apart).max(initial=0.0)), 12)
    return found


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, vector of longs) -> vec_id, component, n, deviation, whitened, explained, identity_error.

    One row for each vector and each of the first `most` components of the vectors of its length, which
    are a fit of their own (lengths are few). Components are numbered from 1 by falling eigenvalue; those of
    eigenvalue zero are left out, so single vectors, equal vectors and empty ones give no rows. Null vectors
    take no part; null and repeated ids are kept as rows of their own; other columns are ignored. deviation is
    the sum of (n x - S)^2 over the entries, exact, as decimal(38,0).
    """
    spark = vectors.sparkSession
    vectors = vectors.filter("vector is not null").select("vec_id", F.size("vector").alias("size"), "vector")
    bases = {size: basis(spark, fitted, most) for size, fitted in sums(vectors.select("size", "vector")).items()}
    bases = {size: own for size, own in bases.items() if own.roots}
    kept = vectors.filter(F.col("size").isin(list(bases))) if bases else vectors.filter(F.lit(False))
    projected = cut_lineage(_projected(kept, bases))
    errors = _identity_errors(projected)
    rows = projected.select("vec_id", "size", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained, error = F.lit(None).cast("double"), F.lit(None).cast("double")
    for size, own in bases.items():
        shares = F.array(*map(F.lit, own.explained))
        explained = F.when(F.col("size") == size, shares[F.col("place")]).otherwise(explained)
        error = F.when(F.col("size") == size, F.lit(errors.get(size))).otherwise(error)
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
        explained.alias("explained"), error.alias("identity_error"),
    )
