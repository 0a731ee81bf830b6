"""Reading, landing and saving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import quoted

#: Quoted as spreadsheets do it: quotes doubled, backslashes and blanks as they are, line breaks kept.
FORMAT = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "lineSep": "\n",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}
#: What the reader gives for a quoted empty text, to tell it from a missing value.
EMPTY = "\x01empty\x01"


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Read CSV with a header row. Without a schema the types are inferred, at the price of one more scan.

    Quoted values may hold delimiters, doubled quotes and line breaks; nothing between delimiters is a
    missing value, a pair of quotes an empty text. With line breaks allowed a file is read by one task, so
    many moderate files read faster than one large one; `multi_line=False` splits files, for tables
    without line breaks in values.
    """
    options = FORMAT | {"multiLine": multi_line}
    if schema is None:
        schema = spark.read.options(**options, inferSchema=True).csv(path).schema
    read = spark.read.options(**options, emptyValue=EMPTY).schema(schema).csv(path)
    texts = {f.name for f in read.schema.fields if isinstance(f.dataType, T.StringType)}
    return read.select(
        *[F.when(quoted(c) == EMPTY, "").otherwise(quoted(c)).alias(c) if c in texts else quoted(c) for c in read.columns]
    )


def land_table(df: DataFrame, folder: str) -> DataFrame:
    """Write a table to the lake as Parquet, replacing what was there, and read it back.

    Later scans then read single columns and push filters down, which CSV cannot do.
    """
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def save_csv(df: DataFrame | None, folder: str, single_file: bool = False) -> None:
    """Write CSV with a header, one file per partition; `single_file` writes it in one task.

    `scan_csv` with the schema gives every value back; only in a table of one column a missing value is an
    empty line, which readers leave out. No table is no work.
    """
    if df is None:
        return
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**FORMAT).csv(folder)
