"""MinHash near-duplicates by tensored banding.

Two small collections of SIDE half-bands are computed, WIDTH MinHash values each. A table key is a pair of
half-bands, one of each collection: SIDE * SIDE tables of 2 * WIDTH values come from 2 * SIDE * WIDTH MinHash
values, about the square root of what so many tables of their own would take. Two sets meet if they share a
half-band of both collections; at a similarity of 0.85 five pairs in a million do not. Half-bands that one
set alone has are dropped before keys are made, so most documents make none.

Sets that meet are compared by size and by the low bits of their MinHash values, and then as whole sets of
shingles. Keys of few sets give all their pairs. In fuller ones each set is compared with a drawn centre,
another one in each key, so that large groups of copies are linked in linear work; what then lies in another
component than the most of its half-band meets the others there in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.components import components, joined
from tablelens.llm.simhash import shingle_set_of
from tablelens.session import cut_lineage

#: Half-bands of each collection, and MinHash values in each.
SIDE, WIDTH = 10, 2
VALUES = 2 * SIDE * WIDTH
#: Sets under a key beyond which not all pairs are made; members and shingles of a block of a full half-band.
FEW, MEETING, WEIGHT = 8, 2048, 1 << 20
#: How likely a pair at the least similarity may be taken for less by its MinHash values.
MISSED = 1e-9

_FACTORS, _ADDED, _MIXED = np.random.default_rng(11).integers(0, 1 << 64, (3, VALUES), dtype=np.uint64)
_ODD = np.uint64(1)


def min_values(held: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set of hashed shingles that is not empty."""
    least = np.full(VALUES, (1 << 64) - 1, np.uint64)
    for start in range(0, len(held), 1024):
        part = held[start : start + 1024].view(np.uint64)
        mixed = (_FACTORS | _ODD)[:, None] * part + _ADDED[:, None]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1), out=least)
    return least


def half_bands(least: np.ndarray) -> np.ndarray:
    """2 * SIDE longs: those of the first collection, then those of the second."""
    joined = (least * (_MIXED | _ODD)).reshape(2 * SIDE, WIDTH).sum(axis=1, dtype=np.uint64)
    return (joined ^ (joined >> np.uint64(31))).view(np.int64)


def least_agreement(percent: int) -> int:
    """MinHash values that a pair of that similarity shares, but for a chance of MISSED at most."""
    share, below = percent / 100, 0.0
    for n in range(VALUES + 1):
        below += comb(VALUES, n) * share**n * (1 - share) ** (VALUES - n)
        if below > MISSED:
            return n
    return VALUES


def _marks(text: Column, shingle: int) -> Column:
    """struct<n, one, two, halves, signs>: size of the set, two hashes of it, half-bands, low bytes of values."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for texts in batches:
            rows = []
            for text in texts:
                held = shingle_set_of(text, shingle)
                if not len(held):
                    rows.append((0, 0, 0, [], b""))
                    continue
                least, raw = min_values(held), held.tobytes()
                hashes = np.array([xxh64_intdigest(raw, 1), xxh64_intdigest(raw, 2)], np.uint64).view(np.int64)
                rows.append((len(held), *hashes, half_bands(least), least.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "one", "two", "halves", "signs"])

    return F.pandas_udf(run, "n long, one long, two long, halves array<long>, signs binary")(text)


def _sets(docs: DataFrame, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(node, words) of the wanted nodes (node, rep, one, two), from the texts of their documents alone."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for texts in batches:
            sets = [shingle_set_of(t, shingle) for t in texts]
            hashes = np.array([[xxh64_intdigest(x.tobytes(), seed) for seed in (1, 2)] for x in sets], np.uint64).view(np.int64).reshape(-1, 2)
            yield pd.DataFrame({"words": sets, "one": hashes[:, 0], "two": hashes[:, 1]})

    made = F.pandas_udf(run, "words array<long>, one long, two long")(F.col(text).cast("string"))
    reps = wanted.select("rep").distinct()
    own = docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep"]), "left_semi").select(made.alias("made")).select("made.*")
    found = own.join(wanted.select("node", "one", "two"), ["one", "two"])
    return found.groupBy("node").agg(F.first("words").alias("words"))


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, half, node): all pairs of half-bands of a node that other nodes have too; half is that of the first collection."""
    spread = nodes.select("node", F.posexplode("halves").alias("place", "half"))
    shared = spread.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    held = spread.join(shared, "half", "left_semi").groupBy("node").agg(F.collect_list(F.struct("place", "half")).alias("held"))
    first, second = (F.transform(F.filter("held", test), lambda x: x["half"]) for test in (lambda x: x["place"] < SIDE, lambda x: x["place"] >= SIDE))
    paired = held.select("node", first.alias("first"), second.alias("second")).filter("size(first) > 0 and size(second) > 0")
    paired = paired.select("node", "second", F.explode("first").alias("half"))
    return paired.select("node", "half", F.explode("second").alias("other")).select(F.xxhash64("half", "other").alias("key"), "half", "node")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and MinHash values allow the similarity."""
    facts = nodes.select("node", "n", F.transform(F.sequence(F.lit(1), F.lit(VALUES)), lambda i: F.substring("signs", i, F.lit(1))).alias("signs"))
    for x in "ab":
        pairs = pairs.join(facts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signs").alias(f"signs_{x}")), x)
    pairs = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    same = F.size(F.filter(F.zip_with("signs_a", "signs_b", lambda p, q: p == q), lambda x: x))
    return pairs.filter(same >= least_agreement(percent)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets have the similarity."""
    for x in "ba":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("words").alias(f"words_{x}")), x)
    common = F.size(F.array_intersect("words_a", "words_b"))
    pairs = pairs.select("a", "b", common.alias("i"), (F.size("words_a") + F.size("words_b") - common).alias("u"))
    return pairs.filter(100 * F.col("i") >= percent * F.col("u")).select("a", "b")


def _meet(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links from the strays of a block to members of a block of the same half-band, a spanning forest of them.

    A pair is looked at under the first half-band that it shares in the first collection.
    """
    strays, others = group[group["stray"]], group[~group["stray"]]
    if strays.empty or others.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    halves, signs = np.stack(others["halves"]), np.stack([np.frombuffer(x, np.uint8) for x in others["signs"]])
    sizes, nodes, words = others["n"].to_numpy(), others["node"].to_numpy(), others["words"].to_list()
    component, least, found = others["component"].to_numpy().copy(), least_agreement(percent), []
    merged: dict[int, int] = {}
    for row in strays.itertuples():
        own = row.component
        while own in merged:
            own = merged[own]
        shared = halves == row.halves
        first = np.argmax(shared[:, :SIDE], axis=1)
        hit = (row.halves[first] == row.half) & shared[:, :SIDE].any(axis=1) & shared[:, SIDE:].any(axis=1)
        hit &= (component != own) & (100 * np.minimum(sizes, row.n) >= percent * np.maximum(sizes, row.n))
        hit &= (signs == np.frombuffer(row.signs, np.uint8)).sum(axis=1) >= least
        for at in np.flatnonzero(hit):
            if component[at] == own:
                continue
            place = np.searchsorted(row.words, words[at])
            common = int((row.words[np.minimum(place, row.n - 1)] == words[at]).sum())
            if 100 * common >= percent * (row.n + sizes[at] - common):
                found.append((row.node, nodes[at]))
                merged[component[at]] = own
                component[component == component[at]] = own
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _strays(crowds: DataFrame, parts: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links under crowded keys that still hold several components; parts: (node, component) of the links so far.

    Under each half-band of such keys the members outside its most common component meet all others, in
    blocks; a meeting gives no more links than it has components.
    """
    named = crowds.join(parts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    open_ = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    members = named.join(open_.select("key"), "key", "left_semi").select("half", "node", "component").distinct()
    members = cut_lineage(members.join(nodes.select("node", "n"), "node"))
    common = members.groupBy("half", "component").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
    main = F.max_by("component", F.struct("m", "component")).alias("main")
    totals = common.groupBy("half").agg(main, F.sum("m").alias("m"), F.sum("weight").alias("weight"), F.max_by(F.struct("m", "weight"), F.struct("m", "component")).alias("most"))

    def blocks(m: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(m / MEETING), F.ceil(weight / WEIGHT), F.lit(1)).cast("int")

    totals = totals.select(
        "half", "main", blocks(F.col("m"), F.col("weight")).alias("wide"),
        blocks(F.col("m") - F.col("most.m"), F.col("weight") - F.col("most.weight")).alias("high"),
    )
    placed = members.join(totals, "half")
    spread = F.xxhash64("node", F.lit("block"))

    def dealt(rows: DataFrame, own: str, other: str, stray: bool) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(spread, F.col("high" if stray else "wide")).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("wide" if stray else "high") - 1)))
        return rows.select("half", "x", "y", "node", "component", F.lit(stray).alias("stray"))

    met = dealt(placed.filter("component != main"), "x", "y", True).union(dealt(placed, "y", "x", False))
    met = met.join(nodes.select("node", "n", "halves", "signs"), "node").join(sets, "node")
    links = met.groupBy("half", "x", "y").applyInPandas(lambda group: _meet(group, percent), "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents with 100 * intersection >= percent * union are linked.

    One row for each row of docs; the sets are word shingles, A-Z in lower case; fewer words are one shingle.
    component_id is the smallest doc_id that links lead to. Null, empty and blank texts have no shingles, are
    linked with nothing and keep their own doc_id. A null doc_id gets the component of its text, null if no
    row there has a doc_id, and is not kept. Equal sets are one node, so copies make no pairs however many there
    are. An empty table gives an empty one; other columns are ignored.
    """
    docs = docs.select("doc_id", text)
    made = docs.select("doc_id", _marks(F.col(text).cast("string"), shingle).alias("made")).select("doc_id", "made.*")
    marked = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))
    one = F.min_by(F.struct("doc_id", "n", "halves", "signs"), "row").alias("own")
    nodes = marked.filter("n > 0").groupBy("one", "two").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), one)
    nodes = cut_lineage(nodes.select("one", "two", "node", "first", F.col("own.doc_id").alias("rep"), "own.n", "own.halves", "own.signs"))

    keys = cut_lineage(_keys(nodes))
    centre = F.min(F.struct(F.xxhash64("key", "node").alias("draw"), "node"))["node"].alias("centre")
    sizes = keys.groupBy("key").agg(F.count("*").alias("m"), centre).filter("m > 1")
    members = cut_lineage(keys.join(sizes, "key"))
    small, crowds = members.filter(F.col("m") <= FEW), members.filter(F.col("m") > FEW)
    left, right = (small.select("key", F.col("node").alias(x)) for x in "ab")
    pairs = left.join(right, "key").filter("a < b").select("a", "b")
    stars = crowds.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).filter("a < b")
    pairs = cut_lineage(_near(pairs.union(stars).distinct(), nodes, percent))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowds.select("node")).distinct()
    sets = cut_lineage(_sets(docs, text, shingle, nodes.join(wanted, "node", "left_semi")))
    links = cut_lineage(_verified(pairs, sets, percent))
    parts = cut_lineage(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    more = cut_lineage(_strays(crowds.select("key", "half", "node"), parts, nodes, sets, percent))
    linked = joined(parts, more.select(F.col("a").alias("u"), F.col("b").alias("v")))

    grouped = nodes.select("one", "two", "node", "first").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = grouped.join(smallest, "component").select("one", "two", "component_id")
    found = marked.select("doc_id", "n", "one", "two").join(labels, ["one", "two"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
