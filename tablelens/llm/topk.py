"""Exact top-k inner products by pivot-table elimination.

Vectors are stretched to one length by an added component, which turns the largest inner product into
the smallest distance. The distances of all rows to some pivots are kept; for a query, the greatest
difference between its own distance to a pivot and a row's is a lower bound of their distance, so an
upper bound of the score. Rows are evaluated by falling bound until the bound is under the k-th score.
Queries and rows meet in blocks: each pair of blocks is one group of a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIVOTS = 32
#: Rows and queries of a block on average, and rows evaluated at a time.
BLOCK_ROWS, BLOCK_QUERIES, STEP = 8192, 1024, 64


def scaled(embedding: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as array<long>; null if the vector or a component is null or not finite."""
    sound = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return F.when(F.coalesce(sound, F.lit(False)), whole)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in rows])


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, PIVOTS of them, taken by a hash of their ids."""
    place = W.partitionBy("size").orderBy(F.xxhash64("vec_id"), "vec_id")
    drawn = vectors.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= PIVOTS)
    found = drawn.select("size", "vector").toPandas()
    return {int(size): _matrix(part["vector"]) for size, part in found.groupby("size")}


def _stretch(x: np.ndarray, longest: int) -> np.ndarray:
    """The added component that makes each row as long as the longest."""
    return np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0).astype(float))


def _distances(x: np.ndarray, added: np.ndarray, pivots: np.ndarray, pivots_added: np.ndarray) -> np.ndarray:
    """(rows, pivots): from rows with an added component to pivots with theirs."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square + (added[:, None] - pivots_added[None, :]) ** 2, 0))


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray, longest: int, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best rows of a block for each query, without the query's own id."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    pivots_added = _stretch(pivots, longest)
    table = _distances(rows, _stretch(rows, longest), pivots, pivots_added)
    asked = _distances(queries, np.zeros(len(queries)), pivots, pivots_added)
    for query, own, near in zip(queries, query_ids, asked, strict=True):
        least = np.abs(table - near[None, :]).max(axis=1)
        # the slack is more than what rounding can do to the distances
        size = float((query * query).sum()) + longest
        bound = (size - least * least) / 2 + 1 + 1e-9 * size
        by_bound = np.argsort(-bound, kind="stable")
        kept_ids, kept = np.empty(0, np.int64), np.empty(0, np.int64)
        for start in range(0, len(by_bound), STEP):
            part = by_bound[start : start + STEP]
            if len(kept) == k and bound[part[0]] < kept[-1]:
                break
            part = part[ids[part] != own]
            kept_ids, kept = np.append(kept_ids, ids[part]), np.append(kept, rows[part] @ query)
            best = np.lexsort((kept_ids, -kept))[:k]
            kept_ids, kept = kept_ids[best], kept[best]
        yield own, kept_ids, kept


def search(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(vec_id, vector of longs) of queries and rows -> query_id, rank, vec_id, score: the k best rows a query.

    Scores are inner products with the rows of the same length but the query's own id; ties go to the
    smaller vec_id. Rows with a null vec_id or vector take no part; of rows or queries with the same
    vec_id each takes part. No rows or no queries give no rows; fewer than k rows give all. Products must
    fit in 63 bits.
    """
    schema = "query_id long, vec_id long, score long"
    rows = rows.filter("vec_id is not null and vector is not null").withColumn("size", F.size("vector"))
    queries = queries.filter("vec_id is not null and vector is not null").withColumn("size", F.size("vector"))
    pivots = _pivots(rows)
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    counted = rows.groupBy("size").agg(F.max(square).alias("longest"), F.count("*").alias("n")).collect()
    longest = {r["size"]: r["longest"] for r in counted}
    row_blocks = max(1, -(-sum(r["n"] for r in counted) // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def spread(blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    held = rows.select("size", spread(row_blocks).alias("rb"), every(query_blocks).alias("qb"), "vec_id", "vector")
    asked = queries.select("size", every(row_blocks).alias("rb"), spread(query_blocks).alias("qb"), "vec_id", "vector")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        size = int(left["size"].iloc[0])
        found = best_of_block(
            _matrix(left["vector"]), left["vec_id"].to_numpy(), _matrix(right["vector"]), right["vec_id"].to_numpy(),
            pivots[size], longest[size], k,
        )
        parts = [pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores}) for q, ids, scores in found]
        return pd.concat(parts)

    keys = ["size", "rb", "qb"]
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
