"""Phrase collocations from depth-truncated suffix subtrees, partitioned vertically by word prefix.

A suffix is a word with the words after it in its piece of text, cut to the longest phrase. All suffixes
together make a suffix tree of that depth. It is partitioned by prefix: suffixes are counted by hashed
prefix of one, two and three words; a prefix with more suffixes than a task may hold is extended by a
word, and prefixes are packed into groups that hold no more than that. Each task that reads texts merges
its suffixes into partial subtrees, one a group, before they are shuffled; each group is one task's subtree,
and the counts of phrases are sums of leaf totals. Nodes above an extended prefix lie in several groups
and are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablelens.session import cut_lineage

#: Words of the longest phrase.
DEPTH = 3
#: Suffixes that one subtree may hold, and suffixes that a task merges before it hands them on.
BUDGET, MERGED = 1_000_000, 1_500_000
#: Words of one text taken at a time, and slots told in one row.
SLICE, TOLD = 500_000, 64

_BREAKS = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" " + b"\n" * 9)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of each piece of a text, A-Z in lower case; empty pieces are left out."""
    for piece in (text or "").encode().lower().translate(_BREAKS).split(b"\n"):
        words = piece.split()
        if words:
            yield words


class Suffixes:
    """Suffixes of one language, as ids of their words; id 0 is no word."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, text: str | None) -> None:
        """All suffixes of a text, in slices that share their last words with the next."""
        ids, run = self.ids, []
        for words in pieces_of(text):
            run += [ids.setdefault(w, len(ids) + 1) for w in words]
            run += [0] * (DEPTH - 1)
            while len(run) > SLICE:
                self._take(run[: SLICE + DEPTH - 1])
                run = run[SLICE:]
        self._take(run)

    def _take(self, run: list[int]) -> None:
        own = np.array(run, np.int64)
        if len(own) < DEPTH:
            return
        rows = np.stack([own[i : len(own) - DEPTH + 1 + i] for i in range(DEPTH)])
        rows = rows[:, rows[0] > 0]
        for i in range(1, DEPTH):  # nothing follows the end of a piece
            rows[i, rows[i - 1] == 0] = 0
        self.parts.append(rows)
        self.n += rows.shape[1]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """(depth, leaves) in order of ids, and the total of each leaf."""
        rows = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((DEPTH, 0), np.int64)
        return leaves_of(rows, np.ones(rows.shape[1], np.int64), len(self.ids) + 1)

    def hashes(self) -> np.ndarray:
        return hashes_of(self.ids)


def hashes_of(words) -> np.ndarray:
    """A hash of each word by its id; of no word, 0."""
    from xxhash import xxh64_intdigest

    return np.fromiter((0, *map(xxh64_intdigest, words)), np.uint64, len(words) + 1)


def leaves_of(rows: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal suffixes as one leaf with their sum; ids are under `size`. Sums are exact integers."""
    if not rows.shape[1]:
        return rows, counts
    if size**DEPTH < 1 << 63:
        key = rows[0]
        for r in rows[1:]:
            key = key * size + r
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(rows[::-1])
    rows, counts = rows[:, order], counts[order]
    starts = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)))
    return rows[:, starts], np.add.reduceat(counts, starts)


def slots_of(rows: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """(depth, leaves): the slot of the prefix of each length, by its highest hash bits."""
    found, state = [], np.zeros(rows.shape[1], np.uint64)
    for r in rows:
        state = (state ^ hashes[r]) * _MIX
        state = state ^ (state >> np.uint64(29))
        found.append(((state * _MIX) >> np.uint64(64 - bits)).astype(np.int64))
    return np.stack(found)


def _language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def _flushes(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Suffixes]]:
    """(language, suffixes) of the texts of a task, whenever there are MERGED of them, and at the end."""
    held: dict[str, Suffixes] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            held.setdefault(lang, Suffixes()).add(text)
            if sum(s.n for s in held.values()) >= MERGED:
                yield from held.items()
                held = {}
    yield from held.items()


def prefix_counts(texts: DataFrame, bits: int) -> DataFrame:
    """(level, block, lang, counts): suffixes of TOLD slots of prefixes side by side; at level 0 the words of each language.

    Counts of slots are added up as arrays, as each task has nearly all slots.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((DEPTH, 1 << bits), np.int64)
        words: dict[str, int] = {}
        for lang, own in _flushes(batches):
            words[lang] = words.get(lang, 0) + own.n
            rows, counts = own.merged()
            for level, slot in enumerate(slots_of(rows, own.hashes(), bits)):
                np.add.at(total[level], slot, counts)
        made = [(level + 1, block, None, part) for level, own in enumerate(total) for block, part in enumerate(own.reshape(-1, TOLD)) if part.any()]
        made += [(0, 0, lang, np.array([n] + [0] * (TOLD - 1))) for lang, n in words.items()]
        if made:
            yield pd.DataFrame(made, columns=["level", "block", "lang", "counts"])

    counted = texts.mapInPandas(run, "level int, block int, lang string, counts array<long>")
    added = F.array(*(F.sum(F.col("counts")[i]) for i in range(TOLD)))
    return counted.groupBy("level", "block", "lang").agg(added.alias("counts"))


def groups_of(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(depth, slots) suffixes by prefix length -> the group of each slot, -1 where prefixes are extended.

    Slots are packed by falling size into groups of `capacity` suffixes. One of more is extended by a word;
    at full depth it is a group of its own, as there are no more words to tell its suffixes apart.
    """
    groups = np.full(counts.shape, -1, np.int32)
    level, slot = np.nonzero(counts)
    n = counts[level, slot]
    fits = (n <= capacity) | (level == len(counts) - 1)
    level, slot, n = level[fits], slot[fits], n[fits]
    if not (counts[0] > capacity).any():  # nothing is extended
        level, slot, n = level[level == 0], slot[level == 0], n[level == 0]
    group, room = -1, 0
    for i in np.argsort(-n, kind="stable"):
        if group < 0 or n[i] > room:
            group, room = group + 1, capacity
        room -= n[i]
        groups[level[i], slot[i]] = group
    return groups, group + 1


def _route(groups: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The group of the shortest prefix that has one."""
    found = groups[0][slots[0]]
    for own, slot in zip(groups[1:], slots[1:], strict=True):
        found = np.where(found < 0, own[slot], found)
    return found


def partial_subtrees(texts: DataFrame, groups: np.ndarray, bits: int) -> DataFrame:
    """(group, lang, words, leaves, n): for each group the part of its subtree that a task has seen.

    words: the words, joined by spaces; leaves: ids of the words of each leaf and its total, by columns, as
    unsigned integers of four bytes, the first column as differences; n: the number of leaves.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, own in _flushes(batches):
            rows, counts = own.merged()
            if not len(counts):
                continue
            words = np.array([b"", *own.ids], object)
            group = _route(groups, slots_of(rows, own.hashes(), bits))
            order = np.argsort(group, kind="stable")
            rows, counts, group = rows[:, order], counts[order], group[order]
            ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
            made, start = [], 0
            for end in ends:
                used, ids = np.unique(rows[:, start:end], return_inverse=True)
                ids = ids.reshape(DEPTH, -1) + (0 if used[0] == 0 else 1)
                ids[0] = np.diff(ids[0], prepend=0)
                table = np.vstack([ids, counts[start:end]]).astype(np.uint32)
                own_words = words[used[used > 0]]
                made.append((int(group[start]), lang, b" ".join(own_words), table.tobytes(), end - start))
                start = end
                if len(made) == 256:
                    yield pd.DataFrame(made, columns=["group", "lang", "words", "leaves", "n"]).astype({"group": np.int32, "n": np.int32})
                    made = []
            if made:
                yield pd.DataFrame(made, columns=["group", "lang", "words", "leaves", "n"]).astype({"group": np.int32, "n": np.int32})

    return texts.mapInPandas(run, "group int, lang string, words binary, leaves binary, n int")


def _subtree(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Leaves, their totals and the words by id - 1 of all parts of a group in one language."""
    ids: dict[bytes, int] = {}
    rows, counts = [], []
    for words, leaves in zip(part["words"], part["leaves"], strict=True):
        known = np.fromiter((0, *(ids.setdefault(w, len(ids) + 1) for w in words.split(b" "))), np.int64)
        table = np.frombuffer(leaves, np.uint32).reshape(DEPTH + 1, -1).astype(np.int64)
        table[0] = np.cumsum(table[0])
        rows.append(known[table[:-1]])
        counts.append(table[-1])
    leaves, totals = leaves_of(np.concatenate(rows, axis=1), np.concatenate(counts), len(ids) + 1)
    return leaves, totals, list(ids)


def subtree_counts(partial: DataFrame, groups: np.ndarray, bits: int, least: int) -> DataFrame:
    """(lang, size, phrase, f): how often phrases of up to DEPTH words occur, for those that do `least` times.

    Each group is read as one subtree. Nodes above an extended prefix are given whatever their count, as
    other groups hold the rest.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = []
        for lang, part in group.groupby("lang", sort=False):
            leaves, totals, words = _subtree(part)
            hashes = hashes_of(words)
            for size in range(1, DEPTH + 1):
                held = leaves[:, leaves[size - 1] > 0]
                if not held.shape[1]:
                    break
                new = np.append(True, (held[:size, 1:] != held[:size, :-1]).any(axis=0))
                starts = np.flatnonzero(new)
                f = np.add.reduceat(totals[leaves[size - 1] > 0], starts)
                nodes = held[:, starts].copy()
                nodes[size:] = 0
                slots = slots_of(nodes, hashes, bits)[:size]
                open_ = (np.stack([g[s] for g, s in zip(groups[:size], slots, strict=True)]) < 0).all(axis=0)
                at = np.flatnonzero((f >= least) | open_)
                phrases = [b" ".join(words[i - 1] for i in nodes[:size, j]).decode() for j in at]
                made.append(pd.DataFrame({"lang": lang, "size": np.int32(size), "phrase": phrases, "f": f[at]}).astype({"lang": object, "phrase": object}))
        return pd.concat(made, ignore_index=True)

    found = partial.groupBy("group").applyInPandas(run, "lang string, size int, phrase string, f long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of phrases that occur `least` times or more, and (lang, n) words of each language."""
    spark = docs.sparkSession
    texts = docs.select(_language(F.col(lang)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # six bytes a word or so: only how finely prefixes are told apart depends on it
    expected = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(10, (16 * max(parts, expected // budget)).bit_length())
    counted = cut_lineage(prefix_counts(texts, bits))
    table = np.zeros((DEPTH, 1 << bits), np.int64)
    for r in counted.filter("level > 0").select("level", "block", "counts").toLocalIterator():
        table[r["level"] - 1, r["block"] * TOLD : (r["block"] + 1) * TOLD] = r["counts"]
    words = counted.filter("level = 0").select("lang", F.col("counts")[0].alias("n"))
    capacity = max(1, min(budget, int(table[0].sum()) // parts))
    groups, _ = groups_of(table, capacity)
    found = subtree_counts(partial_subtrees(texts, groups, bits), groups, bits, least)
    return cut_lineage(found), words


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) in whole numbers of 38 digits."""
    whole = [x.cast("decimal(19,0)") for x in (a, left, right)]
    top = (F.lit(1_000_000).cast("decimal(7,0)") * whole[0].cast("decimal(15,0)")).cast("decimal(22,0)") * whole[0].cast("decimal(15,0)")
    bottom = (whole[1] * whole[2]).cast("decimal(38,0)")
    # the remainder is exact, and without it so is the quotient
    return ((top - top % bottom) / bottom).cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, inside: int = 50, first: int = 2000, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of two or three words of each language.

    A phrase counts if it occurs `least` times in pieces between punctuation and line ends. Its score is that
    of its worst cut into two parts, floor(10^6 a^2 / (l r)), the earliest of equal ones; l and r are how often
    the parts occur. Phrases inside a longer one that occurs at least `inside` percent as often are dropped.
    Null languages are "und", null texts empty; repeated rows count each; other columns are ignored. Tables
    without words or without frequent phrases give no rows. Counts may reach 10^15.
    """
    counts, words = phrase_counts(docs, text, lang, least, budget)
    parts = F.split("phrase", " ")
    cuts = F.when(F.col("size") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    cut = counts.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("k"))
    left = F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")
    right = F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " ")
    cut = cut.withColumns({"left": left, "right": right})
    for side, name in (("left", "l"), ("right", "r")):
        known = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f").alias(name))
        cut = cut.join(known, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part")
    scored = cut.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("worst")
    scored = scored.groupBy("lang", "size", "phrase", "a").agg(worst).select("lang", "size", "phrase", "a", "worst.l", "worst.r", "worst.score")

    longer = counts.filter("size = 3").select("lang", "f", F.explode(F.array(F.array_join(F.slice(parts, 1, 2), " "), F.array_join(F.slice(parts, 2, 2), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    # sizes differ, so a phrase of three words is never dropped
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("size") == 3) | (100 * F.col("longer") < inside * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
