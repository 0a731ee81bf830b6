"""Source and sink queries (S1, S3-S6) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.catalog.fixtures import GAPPY_SQL, orders_gappy, rounded, table
from tablelens.operators.clean import impute_mean, impute_mode
from tablelens.session import work_dir
from tablelens.sources import images, tables

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _through_csv(df, name, schema=None):
    folder = work_dir(df.sparkSession, name)
    tables.save_csv(df, folder)
    return tables.scan_csv(df.sparkSession, folder, schema)


def _dated(df):
    """The date as text, the same in both engines."""
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def _scan(s, d):
    df = table(s, d, "orders").select(*ORDER_COLUMNS)
    return _dated(_through_csv(df, "scan-csv", df.schema))


def _scan_inferred(s, d):
    found = _through_csv(table(s, d, "orders").select(*ORDER_COLUMNS), "scan-csv")
    return _dated(found.select(*[F.col(c).cast("bigint").alias(c) if c.endswith("key") else F.col(c) for c in found.columns]))


def _odd_texts(s, d):
    """Whole documents, with blanks, quotes, backslashes, empty and missing texts where the key says so."""
    key = F.col("doc_id") % 6
    odd = (
        F.when(key == 0, F.lit(""))
        .when(key == 1, F.lit(None).cast("string"))
        .when(key == 2, F.concat(F.lit('  "a\\b",\r\n'), F.col("text"), F.lit(" \\ ")))
    )
    return table(s, d, "documents").withColumn("odd", odd.otherwise(F.col("text")))


def _scan_text(s, d):
    df = _odd_texts(s, d)
    return _digests(_through_csv(df, "scan-text", df.schema))


def _digests(df):
    """Texts as digests, missing ones as such, so that the comparison stays readable."""
    return df.select(*[F.md5(c).alias(c) if c in ("text", "odd", "html") else F.col(c) for c in df.columns])


def _save_text(s, d):
    pages = table(s, d, "pages")
    return _digests(_through_csv(impute_mode(pages), "save-text", pages.schema))


def _land_text(s, d):
    df = _odd_texts(s, d)
    return _digests(tables.land_table(_through_csv(df, "upload-text", df.schema), work_dir(s, "land-text")))


def _land(s, d):
    customers = table(s, d, "customer")
    raw = _through_csv(customers, "upload", customers.schema)
    return tables.land_table(raw, work_dir(s, "land-table"))


def _save(s, d):
    cleaned = impute_mode(impute_mean(orders_gappy(s, d).drop("empty_col")))
    return rounded(_through_csv(cleaned, "save-cleaned", cleaned.schema), {"o_totalprice": 4})


def _files(s, d):
    """A table of files as the binary source gives it, one per page, with several endings."""
    endings = F.array(*[F.lit(e) for e in (".png", ".PNG", ".Jpeg", ".jpg.txt", ".svg")])
    ending = F.get(endings, F.pmod("page_id", F.lit(5)).cast("int"))
    path = F.concat(F.lit("file:/plots/"), F.col("page_id").cast("string"), F.lit("_bar"), ending)
    return table(s, d, "pages").select(path.alias("path"), F.encode("html", "utf-8").alias("content"))


QUERIES = {
    "scan_csv": _scan,
    "scan_csv_inferred": _scan_inferred,
    "land_table": _land,
    "save_cleaned": _save,
    "scan_csv_text": _scan_text,
    "save_cleaned_text": _save_text,
    "land_table_text": _land_text,
    "image_scan": lambda s, d: images.image_rows(_files(s, d)).select(
        "name", F.length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("digest")
    ),
    "image_data_uri": lambda s, d: images.image_data_uris(images.image_rows(_files(s, d))).select(
        "name", F.md5("data_uri").alias("digest")
    ),
}

_DATED = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""
_ODD = r"""SELECT doc_id, md5(text) AS text, lang, source, n_chars, md5(CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN NULL
  WHEN 2 THEN '  "a\b",' || chr(13) || chr(10) || text || ' \ ' ELSE text END) AS odd FROM documents"""
_PRICE = "round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM known)), 4)"
_NAMES = """f AS (SELECT page_id || '_bar' || ['.png', '.PNG', '.Jpeg', '.jpg.txt', '.svg'][page_id % 5 + 1] AS name,
  encode(html) AS content FROM pages)"""

SQL = {
    "scan_csv": _DATED,
    "scan_csv_inferred": _DATED,
    "land_table": "SELECT * FROM customer",
    "save_cleaned": f"""WITH {GAPPY_SQL} SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  o_orderstatus, {_PRICE} AS o_totalprice, coalesce(o_orderpriority, (SELECT o_orderpriority FROM known
    WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM known""",
    "scan_csv_text": _ODD,
    "land_table_text": _ODD,
    "save_cleaned_text": "SELECT page_id, url, md5(html) AS html FROM pages",
    "image_scan": f"WITH {_NAMES} SELECT name, octet_length(content) AS n_bytes, md5(content) AS digest FROM f "
    "WHERE lower(name) SIMILAR TO '.*[.](png|jpg|jpeg)'",
    "image_data_uri": f"WITH {_NAMES} SELECT name, md5('data:image/png;base64,' || to_base64(content)) AS digest FROM f "
    "WHERE name LIKE '%.png'",
}
