"""Mixing sources by temperature, in DataFrame functions only.

Each source's share of tokens is raised to an exponent between 1 (as it is) and 0 (all alike), found by
section search on sums over all sources. The weights, normalised, are realised by permutations in
blocks: a source is dealt into hash blocks, its order is block by block and by hash within a block, and
its token budget takes whole passes over that order and then the rows before one cut. So what a document
gets follows from two small values of its source, and texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablelens.session import cut_lineage

#: Documents in a block on average; exponents tried in one pass; passes of the search.
BLOCK_ROWS, TRIED, PASSES = 256, 64, 6
#: Most blocks that the first eight hexadecimal digits can tell apart.
SPREAD = 1 << 32


def words(text: Column) -> Column:
    """Tokens of a text, counted as runs between blanks, tabs and line breaks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \n\t\r]+")).cast("long")


def place(seed: int) -> Column:
    """The hash that orders documents: MD5 of seed and doc_id as text (null: empty)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _search(sources: DataFrame, repeats: float | None, entropy: float | None) -> float:
    """The exponent, in [0, 1], that the target allows: the smallest for repeats, the largest for entropy.

    Each pass sums the powers of all sources' shares for a row of exponents and keeps the interval in
    which the target is crossed; the driver sees those sums only.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * i / TRIED for i in range(TRIED + 1)]
        sums = [F.sum(F.pow("share", F.lit(a))).alias(f"z{i}") for i, a in enumerate(tried)]
        logs = [F.sum(F.pow("share", F.lit(a)) * F.log("share")).alias(f"l{i}") for i, a in enumerate(tried)]
        row = sources.agg(F.min("share").alias("least"), F.max("share").alias("most"), *sums, *logs).first()

        def met(i: int, row=row, tried=tried) -> bool:
            a, z = tried[i], row[f"z{i}"]
            if repeats is not None:
                return (row["least"] / row["most"]) ** (a - 1) <= repeats
            return math.log(z) - a * row[f"l{i}"] / z <= entropy

        # repeats and entropy both fall as the exponent rises
        i = next((i for i in range(TRIED + 1) if met(i)), None)
        if i is None:
            return 1.0
        if i == 0:
            return tried[0]
        low, high = tried[i - 1], tried[i]
    return high


def source_budgets(counted: DataFrame, repeats: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """(source, tokens) -> source, docs, tokens, weight, passes: how often its budget holds its tokens."""
    totals = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = cut_lineage(totals)
    whole = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    if not whole["all"]:  # no rows, or no tokens: nothing to weigh
        return totals.select("source", "docs", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("passes"))
    shares = totals.filter("tokens > 0").withColumn("share", F.col("tokens") / float(whole["all"]))
    exponent = _search(shares, repeats, entropy)
    z = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    most = whole["most"] / whole["all"]
    spent = float(budget) if budget is not None else whole["most"] * z / most**exponent
    weight = F.pow(F.col("tokens") / float(whole["all"]), F.lit(exponent)) / z
    weight = F.when(F.col("tokens") > 0, weight).otherwise(0.0)
    passes = F.when(F.col("tokens") > 0, F.round(weight * spent / F.col("tokens"), 9)).otherwise(1.0)
    return totals.select("source", "docs", "tokens", weight.alias("weight"), passes.alias("passes"))


def plan(docs: DataFrame, repeats: float | None, entropy: float | None, budget: int | None, seed: int) -> DataFrame:
    """One row a source: source (null as such), weight, whole passes, cut_block and cut_place of the last one."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("tokens"), place(seed).alias("place"))
    budgets = cut_lineage(source_budgets(rows.select("source", "tokens"), repeats, entropy, budget))
    dealt = _blocked(rows, budgets)
    blocks = dealt.groupBy("source", "block").agg(
        F.sum("tokens").alias("tokens"), F.min("passes").alias("passes"), F.min("total").alias("total")
    )
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    left = (F.col("passes") - F.floor("passes")) * F.col("total")
    cut = blocks.select("source", "block", ahead.alias("ahead"), left.alias("left"), "tokens")
    cut = cut_lineage(cut.filter("ahead < left and left <= ahead + tokens").select("source", "block", "ahead", "left"))
    # rows of the cut blocks alone: one block a source
    hit = dealt.select("source", "block", "place", "tokens").join(
        cut.withColumnRenamed("source", "of").withColumnRenamed("block", "at"),
        F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")),
    )
    inside = W.partitionBy("source", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    sofar = F.col("ahead") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    taken = hit.withColumn("sofar", sofar).filter("sofar < left")
    cuts = taken.groupBy("source").agg(F.min("block").alias("cut_block"), F.max("place").alias("cut_place"))
    return (
        budgets.alias("b")
        .join(cuts.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")), "left")
        .select("b.source", "docs", "weight", F.floor("passes").cast("int").alias("whole"), "cut_block", "cut_place")
    )


def _blocked(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    joined = rows.alias("r").join(budgets.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")))
    return joined.select("r.source", "r.tokens", "place", _block(F.col("b.docs")).alias("block"), "passes", F.col("b.tokens").alias("total"))


def _block(docs: Column) -> Column:
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    return F.floor(number / F.lit(SPREAD) * F.ceil(docs / BLOCK_ROWS)).cast("long")


def mix(
    docs: DataFrame,
    repeats: float | None = 1.5,
    entropy: float | None = None,
    budget: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Each row of docs with `weight` (of its source) and `copies`: how often the mixture takes it.

    Columns of docs of these names are replaced.

    docs holds doc_id, source and text. The exponent is the largest change towards equal shares that
    repeats no source more than `repeats` times as often as the largest one, or, if `entropy` is given,
    the smallest that reaches that entropy (in nats). `budget` is the number of tokens of the mixture; by
    default it is so large that the largest source is taken exactly once, and then no document is left
    out. Rows with the same doc_id stand at the same place and are taken or left together; a null source
    is a source; sources without any tokens are kept as they are, at weight 0. No rows give no rows.
    """
    if (repeats is None) == (entropy is None):
        if repeats is None:
            raise ValueError("give repeats or entropy")
        repeats = None
    sources = cut_lineage(plan(docs, repeats, entropy, budget, seed)).withColumnsRenamed({"source": "of", "docs": "docs_of"})
    others = F.struct(*(c for c in docs.columns if c not in ("weight", "copies")), F.lit(0).alias("_")).alias("row")
    placed = docs.select("source", others, place(seed).alias("place"))
    joined = placed.join(sources, F.col("source").eqNullSafe(F.col("of")))
    block = _block(F.col("docs_of"))
    in_cut = (block < F.col("cut_block")) | ((block == F.col("cut_block")) & (F.col("place") <= F.col("cut_place")))
    copies = F.col("whole") + F.when(F.coalesce(in_cut, F.lit(False)), 1).otherwise(0)
    return joined.select("row.*", "weight", copies.cast("int").alias("copies")).drop("_")


def mixture(docs: DataFrame, **target) -> DataFrame:
    """The mixture itself: each row of docs as often as `mix` says, with the columns of docs."""
    return mix(docs, **target).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)
