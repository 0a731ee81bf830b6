import corpus_pipeline as C
from pyspark.sql import functions as F

from tablelens.llm.bpe import Codec
from tablelens.llm.queries import public_tokenizer
from tablelens.session import cut_lineage


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = held[name] = spark.read.parquet(f"{tmp_path}/{name}")
    for name, _ in C.STAGES[:-1]:
        assert held[name].columns == columns
    assert held["line_dedup"].count() == held["language"].count()
    lines = held["line_dedup"].select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) != ''")
    assert lines.count() == lines.distinct().count()
    kept = held["near_dedup"]
    assert 0 < kept.count() == kept.select("doc_id").distinct().count() < held["line_dedup"].count()
    mixed = held["mixing"].groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    assert sum(r["d"] for r in mixed) == kept.count() and any(r["n"] > r["d"] for r in mixed)
    codec = Codec(*public_tokenizer())
    for r in held["byte_bpe"].limit(40).collect():
        assert r["decodes"] and codec.encode(r["text"]).tolist() == list(r["ids"]) and r["n_tokens"] == len(r["ids"])


def test_odd_rows_pass_all_stages(spark, odd, folder):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in C.STAGES:
        docs = cut_lineage(stage(spark, docs, folder))
    assert docs.filter("not decodes").count() == 0
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
