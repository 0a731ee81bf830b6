"""The operators over the given tables: one query for each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import held_out, importable, learning_labels, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def ready(spark: SparkSession, folder: str) -> DataFrame:
        importable(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = ready
    return ready


def public_tokenizer() -> tuple[bytes, str]:
    import public_tokenizers

    from tablelens.llm.bpe import tokenizer

    return tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.bpe import encode_documents

    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = encode_documents(docs, public_tokenizer(), decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.simhash import hex_of, near_duplicates

    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_merkle(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.merkle import fingerprints, likeness

    rows = fingerprints(table(spark, folder, "documents").select("doc_id", "text"))
    tree, edited, after = F.col("tree"), F.col("edited_tree"), F.col("next_tree")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        tree["root"].alias("fingerprint"),
        edited["root"].alias("edited_fingerprint"),
        likeness(tree, edited).alias("near_edited"),
        likeness(tree, after).alias("near_next"),
    )


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.lines import dedup_lines

    done = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_copies", "n_near", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.mixing import mix

    mixed = mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.round("weight", 6).alias("weight"), "copies")


SQL["op10_mixing"] = r"""
WITH RECURSIVE counted AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \n\t\r]+')) AS tokens,
           md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
    FROM documents
),
totals AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM counted GROUP BY source),
shares AS (SELECT tokens / (SELECT sum(tokens) FROM totals) AS share FROM totals WHERE tokens > 0),
ends AS (SELECT min(share) AS least, max(share) AS most FROM shares),
search(n, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT n + 1,
           CASE WHEN pow(least / most, (low + high) / 2 - 1) <= 1.5 THEN low ELSE (low + high) / 2 END,
           CASE WHEN pow(least / most, (low + high) / 2 - 1) <= 1.5 THEN (low + high) / 2 ELSE high END
    FROM search, ends WHERE n < 45
),
exponent AS (SELECT high AS a FROM search WHERE n = 45),
norm AS (SELECT sum(pow(share, a)) AS z FROM shares, exponent),
budgets AS (
    SELECT source, docs, tokens,
           CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM totals), a) / z ELSE 0.0 END AS weight,
           CASE WHEN tokens > 0 THEN round(pow(tokens / (SELECT sum(tokens) FROM totals), a) / z
                * ((SELECT max(tokens) FROM totals) * z / pow(most, a)) / tokens, 9) ELSE 1.0 END AS passes
    FROM totals, exponent, norm, ends
),
dealt AS (
    SELECT c.*, b.passes, b.tokens AS total, b.weight,
           floor(('0x' || substr(place, 1, 8))::BIGINT / 4294967296.0 * ceil(b.docs / 256.0)) AS block
    FROM counted c JOIN budgets b ON c.source IS NOT DISTINCT FROM b.source
),
sums AS (
    SELECT source, block, place, sum(tokens) AS tokens FROM dealt GROUP BY source, block, place
),
run AS (
    SELECT source, place,
           sum(tokens) OVER (PARTITION BY source ORDER BY block, place) - tokens AS ahead
    FROM sums
)
SELECT d.doc_id, d.source, round(d.weight, 6) AS weight,
       CAST(floor(d.passes) + CASE WHEN r.ahead < (d.passes - floor(d.passes)) * d.total THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM dealt d JOIN run r ON d.source IS NOT DISTINCT FROM r.source AND d.place = r.place
"""


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.langid import identify

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs).select("doc_id", "language", F.round("probability", 6).alias("probability"), "accepted")


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm import toxicity as T

    docs = table(spark, folder, "documents").select("doc_id", "text")
    drawn = learning_labels(table(spark, folder, "labels"), "toxic", 5, 0, T.ROWS)
    lexicon = T.learn(docs.join(F.broadcast(drawn), "doc_id"))  # T.ROWS rows, about
    scored = docs.withColumn("score", T.toxicity(F.col("text"), lexicon))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm import quality as Q

    docs = table(spark, folder, "documents").select("doc_id", "text")
    drawn = learning_labels(table(spark, folder, "labels"), "quality", 4, 2, Q.ROWS)
    net = Q.learn(docs.join(F.broadcast(drawn), "doc_id"))  # Q.ROWS rows, about
    scored = docs.withColumn("score", Q.quality(F.col("text"), net))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.topk import scaled, search

    vectors = table(spark, folder, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("vector"))
    return search(vectors.filter("vec_id % 100 = 0"), vectors, 10)


SQL["op7_topk"] = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (SELECT vec_id, len(v) AS size, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM parts q JOIN parts c ON q.i = c.i AND q.size = c.size AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
    GROUP BY q.vec_id, c.vec_id
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.pii import KINDS, find_documents

    found = find_documents(table(spark, folder, "documents").select("doc_id", "text"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


@query
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.phrases import collocations

    return collocations(table(spark, folder, "documents").select("lang", "text"))


SQL["op13_phrases"] = r"""
WITH pieces AS (
    SELECT doc_id, lang, unnest(parts) AS piece, generate_subscripts(parts, 1) AS place
    FROM (
        SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]') AS parts
        FROM documents
    )
),
words AS (
    SELECT doc_id, lang, place, unnest(own) AS w, generate_subscripts(own, 1) AS i
    FROM (SELECT doc_id, lang, place, regexp_extract_all(piece, '[^\x20\x09]+') AS own FROM pieces)
),
suffixes AS (
    SELECT lang, w AS x, lead(w) OVER following AS y, lead(w, 2) OVER following AS z
    FROM words WINDOW following AS (PARTITION BY doc_id, place ORDER BY i)
),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
ones AS (SELECT lang, x, count(*) AS f FROM suffixes GROUP BY ALL),
twos AS (SELECT lang, x, y, count(*) AS f FROM suffixes WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
threes AS (SELECT lang, x, y, z, count(*) AS f FROM suffixes WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
    SELECT t.lang, 2 AS size, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r
    FROM twos t JOIN ones l ON t.lang = l.lang AND t.x = l.x JOIN ones r ON t.lang = r.lang AND t.y = r.x
    UNION ALL
    SELECT t.lang, 3, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, l.f, r.f
    FROM threes t JOIN ones l ON t.lang = l.lang AND t.x = l.x
    JOIN twos r ON t.lang = r.lang AND t.y = r.x AND t.z = r.y
    UNION ALL
    SELECT t.lang, 3, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f
    FROM threes t JOIN twos l ON t.lang = l.lang AND t.x = l.x AND t.y = l.y
    JOIN ones r ON t.lang = r.lang AND t.z = r.x
),
scored AS (
    SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
),
worst AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
longer AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, x || ' ' || y AS phrase, f FROM threes UNION ALL SELECT lang, y || ' ' || z, f FROM threes
    ) GROUP BY ALL
),
kept AS (
    SELECT w.* FROM worst w LEFT JOIN longer g ON w.size = 2 AND w.lang = g.lang AND w.phrase = g.phrase
    WHERE g.f IS NULL OR 100 * g.f < 50 * w.a
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.whitening import whiten, whole_vector

    vectors = table(spark, folder, "embeddings").select("vec_id", whole_vector(F.col("embedding")).alias("vector"))
    return whiten(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op11_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.llm.tensored import near_duplicates

    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


SQL["op11_tensored_minhash"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_of USING (doc_id)
"""
