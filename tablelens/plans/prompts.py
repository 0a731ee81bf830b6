"""The profile of a table as one text, for an advisor to read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import quoted
from tablelens.operators import profile as P

# The section headings.
HEADINGS = ["Data Types:", "Missing Values:", "Unique Values:", "Sample Data:"]
PROBLEM_HEADING = "problem_type:"

# What the parsers of the replies can read.
INSTRUCTION_FORMAT = (
    "Answer with these five lists and nothing else:\n"
    "drop_columns = ['...']\n"
    "problem_type = ['classification'] or ['regression']\n"
    "label_encoding = ['...'] (text columns only)\n"
    "standard_scalar = ['yes'] or ['no']\n"
    "target_column = ['...']"
)


def _section(number: int, rows: DataFrame, place: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(number).alias("section"), place.cast("bigint").alias("place"), line.alias("line"))


def profile_prompt(
    df: DataFrame,
    order_by: list[str],
    sample: int = 5,
    approx: bool = False,
    problem_type: str | None = None,
    answer_format: str | None = INSTRUCTION_FORMAT,
) -> DataFrame:
    """One row (prompt): types, missing counts, distinct counts and the first rows in a stated order.

    What is gathered is three lines per column and `sample` rows.
    """
    named = F.concat(F.col("column_name"), F.lit(": "), F.col("shown").cast("string"))

    def lines(number: int, table: DataFrame, shown: str) -> DataFrame:
        return _section(number, table.withColumn("shown", F.col(shown)), F.col("position"), named)

    unique = P.approx_distinct(df) if approx else P.distinct_counts(df)
    cells = F.concat_ws(", ", *[F.coalesce(quoted(c).cast("string"), F.lit("NaN")) for c in df.columns])
    first = P.sample_rows(df, order_by, sample)
    numbered = first.select(F.struct(*[quoted(c) for c in order_by], cells.alias("line")).alias("row")).agg(
        F.sort_array(F.collect_list("row")).alias("rows")
    ).select(F.posexplode("rows").alias("place", "row"))
    header = df.sparkSession.range(1).select(F.lit(-1).alias("place"), F.lit(", ".join(df.columns)).alias("line"))
    schema = P.schema_info(df)
    gathered = reduce(
        DataFrame.unionByName,
        [
            lines(0, schema, "data_type"),
            lines(1, P.missing_counts(df), "n_missing"),
            lines(2, unique, "n_distinct"),
            _section(3, header, F.col("place"), F.col("line")),
            _section(3, numbered, F.col("place"), F.col("row.line")),
        ],
    )
    texts = gathered.agg(F.sort_array(F.collect_list(F.struct("section", "place", "line"))).alias("all"))

    def section_text(number: int) -> Column:
        own = F.filter("all", lambda e: e["section"] == number)
        return F.concat(F.lit(HEADINGS[number] + "\n"), F.array_join(F.transform(own, lambda e: e["line"]), "\n"))

    parts = [section_text(i) for i in range(len(HEADINGS))]
    if problem_type is not None:
        parts.append(F.lit(f"{PROBLEM_HEADING}\n{problem_type}"))
    if answer_format is not None:
        parts.append(F.lit(answer_format))
    return texts.select(F.concat_ws("\n\n", *parts).alias("prompt"))
