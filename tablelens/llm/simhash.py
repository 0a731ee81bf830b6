"""SimHash near-duplicates with keys from the Golay code.

A fingerprint is cut into three segments. If two fingerprints differ in `bits` bits at most, those
errors are spread over the segments, and the pigeonhole principle says what the best segments look like:

* 2 bits or fewer: one segment is equal, and the next one differs in two bits at most, so it shares a
  Golay key. Key: the equal segment with a Golay index of the next.
* 3 to 5 bits: the two best segments have three errors together at most, two each, so both share Golay
  keys. Key: the two Golay indexes, for each pair of segments.

Fingerprints that share a key are joined and their bits compared. A key with many fingerprints makes no
pairs: its members are written out with all words at one bit, and those that have such a word in common
are linked to the least of them, which gives the same components for 2 bits in linear work.

Where similarity is given as the Jaccard similarity of shingle sets rather than in bits, fingerprints that
are linked propose pairs, which the sets themselves confirm. At 0.8 some ten bits differ, so bits tell too
little there: sets that share a band of MinHash values are compared too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablelens.llm import golay
from tablelens.llm.components import components
from tablelens.session import cut_lineage

#: Widths of the three segments, from the highest bit on.
SEGMENTS = (22, 21, 21)
#: Shingles of one text hashed at a time.
WINDOW = 1 << 18
#: Fingerprints under one key beyond which no pairs of them are made, and members of a block of such a key.
CROWD, MEETING = 32, 2048
#: Bands of MinHash values, and values in each: of pairs at similarity 0.8 three in a million share no band.
BANDS, VALUES = 32, 5
#: Shingle sets under one band beyond which not all pairs are made, and shingles in a block of such a band.
FEW, WEIGHT = 8, 1 << 21

_DRAWN = np.random.default_rng(8).integers(0, 1 << 64, (3, BANDS * VALUES), dtype=np.uint64)


def _shingles(text: str | None, shingle: int) -> Iterator[list[bytes]]:
    """The word shingles in lists of limited length; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    n = max(1, len(words) - shingle + 1)
    for start in range(0, n if words else 0, WINDOW):
        part = words[start : min(start + WINDOW, n) + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)), strict=False) if len(part) >= shingle else [part]
        yield list(map(b" ".join, rows))


def fingerprint_of(text: str | None, shingle: int, parts: int = 1) -> list[int]:
    """For each part the majority of each bit over XXH64 (seed 42, 43, ...) of the word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    n, ones = 0, np.zeros((parts, 64), np.int64)
    for joined in _shingles(text, shingle):
        n += len(joined)
        for p in range(parts):
            hashes = np.fromiter((xxh64_intdigest(x, 42 + p) for x in joined), ">u8", len(joined))
            ones[p] += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1).view(">i8")[:, 0].tolist()


def fingerprint(text: Column, shingle: int = 3, parts: int = 1) -> Column:
    """Fingerprint as an array of `parts` longs of 64 bits, from whole texts of any length."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = [np.array(fingerprint_of(t, shingle, parts), np.int64) for t in texts]
            yield pd.Series(made, index=texts.index, dtype=object)

    return F.pandas_udf(run, "array<long>")(text)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _split(fps: np.ndarray) -> list[np.ndarray]:
    words, shift = [], 64
    for width in SEGMENTS:
        shift -= width
        words.append(fps.view(np.uint64) >> np.uint64(shift) & np.uint64((1 << width) - 1))
    return [w.astype(np.int64) for w in words]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in six columns, as a word never has more, and which of them count."""
    keys = np.sort(keys, axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, column = np.nonzero(fresh)
    at = np.cumsum(fresh, axis=1)[row, column] - 1
    out, held = np.zeros((len(keys), 6), np.int64), np.zeros((len(keys), 6), bool)
    out[row, at], held[row, at] = keys[fresh], True
    return out, held


def _keys_of(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): key = number of the segment, then the equal segment or its Golay index, then a Golay index."""
    words = _split(fps)
    balls = [_distinct(golay.ball_indexes(w, width)) for w, width in zip(words, SEGMENTS, strict=True)]
    rows, keys = [], []
    for i in range(3):
        second, counts = balls[(i + 1) % 3]
        if bits <= 2:
            both, held = words[i][:, None] << 12 | second, counts
        else:
            both = (balls[i][0][:, :, None] << 12 | second[:, None, :]).reshape(len(fps), -1)
            held = (balls[i][1][:, :, None] & counts[:, None, :]).reshape(len(fps), -1)
        rows.append(np.nonzero(held)[0])
        keys.append(both[held] | i << 40)
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """(node, words) -> (key, node): keys of each word of a fingerprint, about 13 for 2 bits and 80 for 5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start : start + 2048]
                own, words = part["node"].to_numpy(np.int64), np.stack(part["words"]).astype(np.int64)
                for p in range(words.shape[1]):
                    row, key = _keys_of(np.ascontiguousarray(words[:, p]), bits)
                    yield pd.DataFrame({"key": key | p << 44, "node": own[row]})

    return nodes.select("node", "words").mapInPandas(run, "key long, node long")


def _shared(nodes: DataFrame, bits: int) -> DataFrame:
    """(key, node, n) of keys with n > 1 nodes, written out; keys move once."""
    counted = golay_keys(nodes, bits).withColumn("n", F.count("*").over(W.partitionBy("key")))
    return cut_lineage(counted.filter("n > 1"))


def _pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs of nodes (a, b), a < b, that share a key."""
    left, right = shared.select("key", F.col("node").alias("a")), shared.select("key", F.col("node").alias("b"))
    return left.join(right, "key").filter("a < b").select("a", "b").distinct()


def fingerprint_links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints (node = the fingerprint, words = it alone) -> links (a, b) at two bits or fewer.

    The links have the components of "differ in two bits at most". Under keys with up to `crowd` members
    all such pairs are given; under fuller keys each member is linked to the least one that shares a word
    at one bit from both.
    """
    shared = _shared(nodes, 2)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = _pairs(shared.filter(F.col("n") <= crowd)).filter(near)
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    many = shared.filter(F.col("n") > crowd).select("node").distinct()
    words = many.select("node", F.explode(F.transform(flips, lambda x: F.col("node").bitwiseXOR(x))).alias("word"))
    least = words.groupBy("word").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    stars = words.join(least.select("word", "least"), "word").filter("node > least")
    return pairs.union(stars.select(F.col("least").alias("a"), F.col("node").alias("b")).filter(near)).distinct()


def similar_links(nodes: DataFrame, most: int, crowd: int = CROWD) -> DataFrame:
    """(node, words) -> links (a, b) of nodes whose words differ in `most` bits at most and share a key.

    Nodes with a word that differs in five bits or fewer always share a key. Under keys with more than
    `crowd` members, members meet in blocks, all pairs of blocks, and each meeting gives a spanning forest
    of its links: the components stay whole, and no meeting gives more links than it has members.
    """
    shared = _shared(nodes, 5)
    held = nodes.select("node", "words")
    pairs = _pairs(shared.filter(F.col("n") <= crowd))
    for x in "ab":
        pairs = pairs.join(held.select(F.col("node").alias(x), F.col("words").alias(f"words_{x}")), x)
    parts = F.zip_with("words_a", "words_b", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    near = pairs.filter(F.aggregate(parts, F.lit(0), lambda s, n: s + n) <= most).select("a", "b")
    blocks = F.ceil(F.col("n") / MEETING).cast("int")
    many = shared.filter(F.col("n") > crowd).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = many.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node")

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        own, words = group["node"].to_numpy(), np.stack(group["words"]).astype(np.int64).view(np.uint64)
        left, found = np.arange(len(own)), []
        while len(left):  # grow a tree from the least member that is left
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                apart = np.bitwise_count(words[left] ^ words[front[0]]).sum(axis=1, dtype=np.int64)
                hit = left[apart <= most]
                found += [(own[front[0]], own[i]) for i in hit]
                left, front = left[apart > most], np.append(front[1:], hit)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    trees = met.join(held, "node").groupBy("key", "x", "y").applyInPandas(forest, "a long, b long")
    return near.union(trees).distinct()


def _grouped(marked: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, node, component_id: the smallest doc_id of the nodes that links lead to."""
    linked = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    grouped = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = grouped.join(smallest, "component").select("node", "component_id")
    return marked.join(labels, "node").select("doc_id", "node", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of two bits or fewer lead to.

    One row for each row of docs. Texts without words have fingerprint 0 and are linked like any other;
    a null doc_id gets the component of its text, null if no row there has a doc_id. Rows that share a
    fingerprint are one node, so copies make no pairs however many there are. An empty table gives an
    empty one; other columns are ignored.
    """
    words = docs.select("doc_id", fingerprint(F.col(text).cast("string"), shingle).alias("words"))
    marked = cut_lineage(words.select("doc_id", F.col("words")[0].alias("node")))
    nodes = cut_lineage(marked.groupBy("node").agg(F.min("doc_id").alias("first")))
    links = fingerprint_links(nodes.select("node", F.array("node").alias("words")))
    return _grouped(marked, nodes, links).withColumnRenamed("node", "fp")


def shingle_set_of(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, each once, sorted as longs."""
    from xxhash import xxh64_intdigest

    parts = [np.zeros(0, np.uint64)]
    for joined in _shingles(text, shingle):
        parts.append(np.unique(np.fromiter((xxh64_intdigest(x, 42) for x in joined), np.uint64, len(joined))))
    return np.unique(np.concatenate(parts).view(np.int64))


def majority_of(held: np.ndarray) -> int:
    """Fingerprint of a set of hashed shingles, each counted once; 0 of an empty one."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(held), WINDOW):
        ones += np.unpackbits(held[start : start + WINDOW].astype(">i8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(held)).view(">i8")[0])


def bands_of(held: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its MinHash values. An empty set has none."""
    if not len(held):
        return held
    factors, added, mixed = _DRAWN
    least = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for start in range(0, len(held), 1024):
        part = held[start : start + 1024].view(np.uint64)
        np.minimum(least, ((factors | np.uint64(1))[:, None] * part + added[:, None]).min(axis=1), out=least)
    return (least * (mixed | np.uint64(1))).reshape(BANDS, VALUES).sum(axis=1, dtype=np.uint64).view(np.int64)


def shingle_sets(text: Column, shingle: int) -> Column:
    """struct<words, keys, fp>: the set of hashed shingles of the whole text, its bands, and its fingerprint."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set_of(t, shingle) for t in texts]
            yield pd.DataFrame({"words": sets, "keys": [bands_of(x) for x in sets], "fp": [majority_of(x) for x in sets]})

    return F.pandas_udf(run, "words array<long>, keys array<long>, fp long")(text)


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(node, size, fp) -> pairs (a, size_a, b, size_b), a < b, whose fingerprints differ in two bits at most.

    The least node of a fingerprint stands for it, and meets the others that have it too.
    """
    least = cut_lineage(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("one"), F.count("*").alias("n")))
    same = nodes.join(least.filter("n > 1").select("fp", "one"), "fp").select(F.col("one").alias("x"), F.struct("node", "size").alias("y"))
    pairs = fingerprint_links(least.select(F.col("fp").alias("node"), F.array("fp").alias("words")))
    for fp, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(least.select(F.col("fp").alias(fp), F.col("one").alias(name)), fp)
    found = same.union(pairs.select("x", "y")).filter("x.node != y.node").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    ends = {"a": "x.node", "size_a": "x.size", "b": "y.node", "size_b": "y.size"}
    return found.select(*(F.col(c).alias(name) for name, c in ends.items()))


def _jaccard(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sets have that similarity, by their sets."""
    for x in "ba":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("words").alias(f"words_{x}")), x)
    common = F.size(F.array_intersect("words_a", "words_b"))
    pairs = pairs.select("a", "b", common.alias("i"), (F.size("words_a") + F.size("words_b")).alias("n"))
    return pairs.filter(F.col("i") / (F.col("n") - F.col("i")) >= similarity).select("a", "b")


def _meetings(crowds: DataFrame, linked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members of a crowded band whom the links so far leave in different components.

    Members meet in blocks, all pairs of blocks; a meeting gives no more links than it has members.
    """
    of_key = W.partitionBy("key")
    named = crowds.join(components(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    parted = named.withColumns({"low": F.min("component").over(of_key), "high": F.max("component").over(of_key)})
    parted = parted.filter("low != high").withColumn("weight", F.sum("size").over(of_key))
    blocks = F.greatest(F.ceil(F.col("n") / MEETING), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    many = parted.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = many.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "component")

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        own, component, sizes = group["node"].to_numpy(), group["component"].to_numpy(), group["words"].map(len).to_numpy()
        values, codes = np.unique(np.concatenate(group["words"].tolist()), return_inverse=True)
        ends = np.cumsum(sizes)
        alive, found = np.ones(len(own), bool), []
        while alive.any():  # grow a tree from the component of the least member that is left
            front = np.nonzero(alive & (component == component[alive][0]))[0].tolist()
            alive[front] = False
            while front and alive.any():
                at = front.pop()
                marks = np.zeros(len(values), np.int64)
                marks[codes[ends[at] - sizes[at] : ends[at]]] = 1
                common = np.add.reduceat(marks[codes], ends - sizes)
                hit = alive & (common / (sizes + sizes[at] - common) >= similarity)
                found += [(own[at], own[i]) for i in np.nonzero(hit)[0]]
                joined = alive & np.isin(component, component[hit])
                alive &= ~joined
                front += np.nonzero(joined)[0].tolist()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.join(sets, "node").groupBy("key", "x", "y").applyInPandas(forest, "a long, b long")


def jaccard_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, few: int = FEW) -> DataFrame:
    """Links (a, b) with the components of "sets have that Jaccard similarity", among pairs whose fingerprints are linked or that share a band.

    nodes: (node, size, keys, fp), one for each set; sets: distinct (node) -> (node, words), asked for the sets under
    shared bands and of linked fingerprints only. Each link is verified by the sets themselves. Under bands with up to `few` members all pairs are; under fuller ones the least member and
    each other, and then those in different components meet.
    """
    of_key = W.partitionBy("key")
    spread = nodes.select("node", "size", F.explode("keys").alias("key"))
    counted = spread.withColumns(
        {"n": F.count("*").over(of_key), "least": F.min(F.struct("node", "size")).over(of_key)}
    )
    shared = cut_lineage(counted.filter("n > 1"))
    alike = cut_lineage(fingerprint_pairs(nodes.select("node", "size", "fp")))
    asked = shared.select("node").union(alike.select("a")).union(alike.select("b")).distinct()
    held = cut_lineage(sets(asked).select("node", "words"))
    small, crowds = shared.filter(F.col("n") <= few), shared.filter(F.col("n") > few)
    left = small.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"))
    right = small.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"))
    pairs = left.join(right, "key").filter("a < b").select("a", "size_a", "b", "size_b")
    stars = crowds.select(F.col("least.node").alias("a"), F.col("least.size").alias("size_a"), F.col("node").alias("b"), F.col("size").alias("size_b"))
    pairs = pairs.union(stars.filter("a < b")).union(alike.select("a", "size_a", "b", "size_b"))
    # sets of too different sizes cannot be that similar
    pairs = pairs.filter(F.least("size_a", "size_b") / F.greatest("size_a", "size_b") >= similarity)
    links = cut_lineage(_jaccard(pairs.select("a", "b").distinct(), held, similarity))
    if crowds.isEmpty():
        return links
    return links.union(_meetings(crowds, links, held, similarity)).distinct()


def similar_documents(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, node, component_id: the smallest doc_id that links of similar shingle sets lead to.

    Documents are linked if the Jaccard similarity of their sets of word shingles is `similarity` or more and
    the fingerprints of the sets differ in two bits at most or they share a band of MinHash values, as nearly all
    pairs at 0.8 do. Rows, nulls and empty tables are
    treated as by `near_duplicates`. `node` is a hash of the set.
    """
    value = F.col(text).cast("string")
    named = docs.select("doc_id", F.xxhash64(value).alias("digest"), value.alias("text"))
    made = named.select("doc_id", "digest", shingle_sets(F.col("text"), shingle).alias("made"))
    made = made.select("doc_id", "digest", F.xxhash64("made.words").alias("node"), F.size("made.words").alias("size"), "made.keys", "made.fp")
    marked = cut_lineage(made)  # sets themselves are not written: those under shared bands are made again from their texts
    one = F.min(F.struct("doc_id", "digest", "size", "keys", "fp")).alias("one")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first"), one)
    nodes = cut_lineage(nodes.select("node", "first", F.col("one.doc_id").alias("of"), "one.digest", "one.size", "one.keys", "one.fp"))

    def sets(wanted: DataFrame) -> DataFrame:
        at = cut_lineage(nodes.join(wanted, "node").select("node", "of", F.col("digest").alias("digest_of")))
        texts = named.join(at, (F.col("digest") == F.col("digest_of")) & F.col("doc_id").eqNullSafe(F.col("of")))
        texts = texts.select("node", "text").dropDuplicates(["node"])
        return texts.select("node", shingle_sets(F.col("text"), shingle)["words"].alias("words"))

    links = jaccard_links(nodes, sets, similarity)
    return _grouped(marked.select("doc_id", "node"), nodes.select("node", "first"), links)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of similar documents.

    Rows with the same doc_id are one document and stay or go together; so are rows without one if their
    texts have the same fingerprint, and they go if a document with a doc_id is in their group.
    """
    found = similar_documents(docs.select("doc_id", "text"), **how)
    later = found.filter("component_id < doc_id or (doc_id is null and component_id is not null)")
    gone = later.select(F.col("doc_id").alias("_gone")).filter("_gone is not null").distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    if later.filter("doc_id is null").isEmpty():
        return kept
    nameless = cut_lineage(later.filter("doc_id is null").select(F.col("node").alias("_nameless")).distinct())
    words = shingle_sets(F.col("text").cast("string"), how.get("shingle", 5))["words"]
    of = docs.filter("doc_id is null").withColumn("_node", F.xxhash64(words))
    stays = of.join(nameless, F.col("_node") == F.col("_nameless"), "left_anti").select(*docs.columns)
    return kept.filter("doc_id is not null").union(stays)
