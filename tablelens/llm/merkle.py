"""Merkle trees over sections, paragraphs and sentences of a text, in SQL functions only.

A paragraph is a line; its hash is the SHA-256 of its text. A section ends before a heading (a line that
starts with #), after an empty line, and after a paragraph whose hash starts with 0 (one in sixteen), so
that an edit moves no border but those next to it. A section's hash is that of its paragraphs' hashes,
and the root, which is the fingerprint, that of its sections' hashes: texts are equal if and only if
their roots are. Below a paragraph are the 64-bit hashes of its sentences, for likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablelens.llm.common import let, whole_text

#: Rows of neighbouring doc_ids that are dealt out together, and blocks under one node of the block tree.
BLOCK, FAN = 256, 4096


def _sha(parts: Column) -> Column:
    return F.sha2(F.concat_ws(",", parts).cast("binary"), 256)


def _paragraphs(text: Column) -> Column:
    """hash, sentence hashes and kind (0 plain, 1 heading, 2 empty) of each line."""

    def paragraph(line: Column) -> Column:
        sentences = F.filter(F.split(line, r"(?<=[.!?])\s+"), lambda s: s != "")
        return F.struct(
            F.sha2(line.cast("binary"), 256).alias("hash"),
            F.transform(sentences, lambda s: F.xxhash64(s)).alias("sentences"),
            F.when(line.startswith("#"), 1).when(F.trim(line) == "", 2).otherwise(0).alias("kind"),
        )

    return F.transform(F.split(text, "\n"), paragraph)


def _sections(paragraphs: Column) -> Column:
    """Sections as (hash, paragraphs), cut at the places the module describes."""

    def begins(i: Column) -> Column:
        here, before = F.element_at(paragraphs, i), F.element_at(paragraphs, i - 1)
        return (here["kind"] == 1) | (before["kind"] == 2) | before["hash"].startswith("0")

    n = F.size(paragraphs)
    places = F.sequence(F.lit(1), n)
    starts = F.concat(F.filter(places, lambda i: F.when(i == 1, True).otherwise(begins(i))), F.array(n + 1))

    def section(starts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(starts) - 1),
            lambda k: let(
                F.slice(paragraphs, F.element_at(starts, k), F.element_at(starts, k + 1) - F.element_at(starts, k)),
                lambda own: F.struct(
                    _sha(F.transform(own, lambda p: p["hash"])).alias("hash"),
                    F.transform(own, lambda p: F.struct(p["hash"], p["sentences"])).alias("paragraphs"),
                ),
            ),
        )

    return let(starts, section)


def merkle_tree(text: Column) -> Column:
    """struct<root, sections: array<struct<hash, paragraphs: array<struct<hash, sentences>>>>>.

    Null counts as empty; an empty text is one section of one empty paragraph without sentences.
    """
    return let(
        _paragraphs(F.coalesce(text, F.lit(""))),
        lambda paragraphs: let(
            _sections(paragraphs),
            lambda sections: F.struct(
                _sha(F.transform(sections, lambda s: s["hash"])).alias("root"), sections.alias("sections")
            ),
        ),
    )


def _below(sections: Column) -> Column:
    """The sentence hashes below sections; a paragraph without sentences stands for itself."""
    paragraphs = F.flatten(F.transform(sections, lambda s: s["paragraphs"]))
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: p["sentences"])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 if the roots are equal, else the share of sentences that both trees hold (Dice).

    Texts without sentences are like each other only if their roots are equal.
    """

    def shared(x: Column, y: Column) -> Column:
        both, either = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
        return F.when(either == 0, 0.0).otherwise(2.0 * both / either)

    def differing(a: Column, b: Column) -> Column:
        return let(_below(a["sections"]), lambda x: let(_below(b["sections"]), lambda y: shared(x, y)))

    return F.when(a["root"] == b["root"], 1.0).otherwise(differing(a, b))


def edits(a: Column, b: Column) -> Column:
    """Where a differs from b: array<struct<section, paragraph>> from 0, of a's paragraphs that b lacks.

    Equal roots end the search at once, and sections whose hash b has too are not entered.
    """

    def entered(has: Column, held: Column) -> Column:
        return F.flatten(
            F.transform(
                a["sections"],
                lambda s, i: F.when(F.array_contains(has, s["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
                    F.filter(
                        F.transform(
                            s["paragraphs"],
                            lambda p, j: F.when(
                                ~F.array_contains(held, p["hash"]),
                                F.struct(i.alias("section"), j.alias("paragraph")),
                            ),
                        ),
                        lambda x: x.isNotNull(),
                    )
                ),
            )
        )

    hashes = F.transform(b["sections"], lambda s: s["hash"])
    paragraphs = F.transform(F.flatten(F.transform(b["sections"], lambda s: s["paragraphs"])), lambda p: p["hash"])
    nothing = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.when(a["root"] == b["root"], nothing).otherwise(
        let(hashes, lambda has: let(paragraphs, lambda held: entered(has, held)))
    )


def _successors(blocks: DataFrame, span: int) -> DataFrame:
    """(block) distinct -> (block, next): the next block in order, through a tree of FAN blocks a node."""
    if span <= FAN:
        whole = W.partitionBy(F.lit(0)).orderBy("block")
        return blocks.withColumn("next", F.lead("block").over(whole))
    parents = blocks.withColumn("parent", F.floor(F.col("block") / FAN))
    inside = parents.withColumn("next", F.lead("block").over(W.partitionBy("parent").orderBy("block")))
    heads = parents.groupBy("parent").agg(F.min("block").alias("head"))
    above = _successors(heads.select(F.col("parent").alias("block")), span // FAN + 2)
    after = above.join(heads.withColumnRenamed("parent", "next"), "next").select(F.col("block").alias("parent"), "head")
    joined = inside.join(after, "parent", "left")
    return joined.select("block", F.coalesce("next", "head").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the same rows with `next_text`, of the next row by doc_id; the first after the last.

    Rows without doc_id come first, rows with the same doc_id in the order of their texts. Texts move
    once, to the block of 256 doc_ids they are in; only the first row of each block moves again, to the
    block before.
    """
    low, high, dated, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count("*")).first()
    low, span = (low, (high - low) // BLOCK + 3) if dated else (0, 1)
    first = 1 if dated == rows else 0  # block 0 holds the rows without doc_id
    block = F.coalesce(F.floor((F.col("doc_id") - low) / BLOCK) + 1, F.lit(0))
    dealt = docs.select("doc_id", "text", block.cast("long").alias("block"))
    order = W.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    inside = dealt.withColumn("following", F.lead("text").over(order))
    heads = dealt.withColumn("n", F.row_number().over(order)).filter("n = 1").select("block", "text")
    ring = _successors(dealt.select("block").distinct(), span)
    ring = ring.select("block", F.coalesce("next", F.lit(first)).alias("next"))
    after = ring.join(heads.select(F.col("block").alias("next"), F.col("text").alias("head")), "next")
    after = after.select(F.col("block").alias("of"), "head")
    last = (F.col("block") == F.col("of")) & F.col("following").isNull()
    joined = inside.join(after, last, "left")
    return joined.select("doc_id", "text", F.coalesce("following", "head").alias("next_text"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text, edited, and the trees of the text, of its edited form and of the next text.

    The edited form has the last half of the characters replaced by as many from the start of the next
    document. A null text counts as empty; an empty one stays so. A single document is its own next.
    Other columns are ignored.
    """
    rows = with_next(docs.select("doc_id", whole_text(text).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    return rows.select(
        "doc_id",
        "text",
        "edited",
        merkle_tree(F.col("text")).alias("tree"),
        merkle_tree(F.col("edited")).alias("edited_tree"),
        merkle_tree(F.col("next_text")).alias("next_tree"),
    )
