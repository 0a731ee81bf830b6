"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.bpe import encode_documents
from tablelens.llm.common import importable
from tablelens.llm.langid import identify
from tablelens.llm.lines import dedup_lines
from tablelens.llm.mixing import mixture
from tablelens.llm.queries import public_tokenizer
from tablelens.llm.simhash import one_of_each
from tablelens.session import cut_folders, discard, work_dir

#: Folders that stages wrote on their way, needed until what they return is written.
_LEFT: list[str] = []


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; before it begins, the folders of stages before go, unless the documents given are still read from them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = discard(spark, _LEFT, but=docs)
        with cut_folders() as made:
            done = stage(spark, docs, sf_dir)
        _LEFT.extend(made)
        return done

    return run



@_tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose language the evidence agrees; those without letters or with a weak posterior go."""
    importable(spark)
    return identify(docs).filter("accepted").select(*docs.columns)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand earlier in the corpus, equal or within two edits."""
    done = dedup_lines(docs)
    text = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.withColumns(text).select(*docs.columns)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is similar in its five-word shingles (0.8 or more)."""
    importable(spark)
    return one_of_each(docs)


@_tidy
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: all once, those of small sources up to 1.5 times on average."""
    return mixture(docs)


@_tidy
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and whether they decode to the same bytes."""
    importable(spark)
    encoded = encode_documents(docs, public_tokenizer(), decoded=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decodes", same).drop("decoded")


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The stages hold a learned model, an edit distance and byte-level encoding, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written to the shared folder, and goes when the next is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = []
    for name, stage in STAGES:
        folder = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        discard(spark, done)
        done = [folder]
    _LEFT[:] = discard(spark, _LEFT, but=docs)
    return docs
