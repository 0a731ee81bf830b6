"""All charts of a reply from shared scans: one of ranges, one of cells, one of boxes, one of levels.

A chart becomes one or more parts. A part names the columns of its cells, by number or by level, and what is
measured in them; a row gives one cell to each part, and one aggregate counts the cells of all parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import FIELDS_PER_AGGREGATE, is_numeric, number, present
from tablelens.operators.charts import CONFIDENCE_Z, DENSITY_BINS, DENSITY_POINTS, HISTOGRAM_BINS, PIE_LEVELS, bin_of

CELLS = "part int, x_level string, x_bin bigint, y_level string, y_bin bigint"


@dataclass(frozen=True)
class Part:
    """What one chart, or one panel of it, takes from the rows.

    `kind`: `mean` (of `measured` per level of x), `bins` (of the number x, empty ones too), `density` (of the number x),
    `grid` (cells of x, or of x and y) or `panel` (the same with both names in the label, and turned if x is not y).
    """

    chart: int
    kind: str
    x: str
    y: str | None = None
    measured: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in (self.x, self.y, self.measured) if c is not None]


@dataclass(frozen=True)
class Range:
    low: float | None
    high: float | None
    std: float | None
    n: int


def _complete(df: DataFrame, columns: tuple[str, ...]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & present(df, c).isNotNull()
    return known


def _levels(df: DataFrame, part: Part, column: str | None) -> bool:
    """Whether cells go by the column's levels: always for means, else for all that is no number."""
    return column is not None and (part.kind == "mean" or not is_numeric(df, column))


def ranges_of(df: DataFrame, parts: list[Part]) -> dict[tuple[str, tuple[str, ...]], Range]:
    """Range of each number that is binned, over the rows complete in the part's columns; one row, one scan."""
    wanted = sorted(
        {(c, _span_rows(p)) for p in parts for c in (p.x, p.y) if c is not None and not _levels(df, p, c)}
    )
    found = {}
    per_row = FIELDS_PER_AGGREGATE // 8
    for at in range(0, len(wanted), per_row):
        group = wanted[at : at + per_row]
        stats = []
        for i, (column, rows) in enumerate(group):
            value = F.when(_complete(df, rows), number(df, column))
            stats += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"), F.stddev_samp(value).alias(f"std{i}"), F.count(value).alias(f"n{i}")]
        row = df.agg(*stats).first()
        found |= {key: Range(row[f"lo{i}"], row[f"hi{i}"], row[f"std{i}"], row[f"n{i}"]) for i, key in enumerate(group)}
    return found


def _span_rows(part: Part) -> tuple[str, ...]:
    """Columns in which rows must be complete to count for a range: a panel's columns keep ranges of their own."""
    return () if part.kind == "panel" else tuple(sorted({c for c in (part.x, part.y) if c is not None}))


def cells_of(df: DataFrame, parts: list[Part], ranges: dict) -> DataFrame:
    """(part, x_level, x_bin, y_level, y_bin, n, mean, std): the cells of all parts, counted before the one shuffle.

    Empty bins come as rows of weight zero.
    """
    text, whole, real = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def place(part: Part, column: str | None) -> tuple[Column, Column]:
        if column is None:
            return text, whole
        if _levels(df, part, column):
            return present(df, column).cast("string"), whole
        span = ranges[(column, _span_rows(part))]
        bins = DENSITY_BINS if part.kind == "density" else HISTOGRAM_BINS
        return text, whole if span.low is None else bin_of(number(df, column), (span.low, span.high), bins)

    cells, empty = [], []
    for i, part in enumerate(parts):
        (x_level, x_bin), (y_level, y_bin) = place(part, part.x), place(part, part.y)
        value = number(df, part.measured) if part.measured else real
        cell = F.struct(
            F.lit(i).alias("part"), x_level.alias("x_level"), x_bin.alias("x_bin"), y_level.alias("y_level"),
            y_bin.alias("y_bin"), value.alias("value"), F.lit(1).cast("bigint").alias("weight"),
        )
        cells.append(F.when(_complete(df, tuple(part.columns)), cell))
        if part.kind == "bins" and ranges[(part.x, _span_rows(part))].low is not None:
            empty.append((i, _used_bins(ranges[(part.x, _span_rows(part))])))
    rows = df.select(F.inline(F.array_compact(F.array(*cells))))
    if empty:
        no_rows = F.explode(F.concat(*[_bins(i, n) for i, n in empty]))
        zeros = df.sparkSession.range(1).select(no_rows.alias("z")).select(
            "z.part", text.alias("x_level"), F.col("z.bin").alias("x_bin"), text.alias("y_level"), whole.alias("y_bin"),
            real.alias("value"), F.lit(0).cast("bigint").alias("weight"),
        )
        rows = rows.unionByName(zeros)
    return rows.groupBy("part", "x_level", "x_bin", "y_level", "y_bin").agg(
        F.sum("weight").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def _bins(part: int, n: int) -> Column:
    """An array of the bins of one part."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.struct(F.lit(part).alias("part"), b.cast("bigint").alias("bin")))


def _used_bins(span: Range) -> int:
    return HISTOGRAM_BINS if span.high > span.low else 1


def _measure(label: Column, name: str, value: Column) -> Column:
    return F.struct(label.alias("label"), F.lit(name).alias("measure"), value.cast("double").alias("value"))


def _measures(part: Part, span: Range | None) -> Column:
    """The rows (label, measure, value) of one cell."""
    x = F.coalesce("x_level", F.col("x_bin").cast("string"))
    y = F.coalesce("y_level", F.col("y_bin").cast("string"))
    if part.kind == "mean":
        half = F.lit(CONFIDENCE_Z) * F.col("std") / F.sqrt("n")
        named = {"n": F.col("n"), "mean": F.col("mean"), "low": F.col("mean") - half, "high": F.col("mean") + half}
        return F.array(*[_measure(x, m, v) for m, v in named.items()])
    if part.kind == "grid":
        return F.array(_measure(F.concat_ws(",", x, y), "n", F.col("n")))
    if part.kind == "panel":
        if part.y is None:
            return F.array(_measure(F.concat_ws(",", F.lit(part.x), F.lit(part.x), x, x), "n", F.col("n")))
        ways = [(part.x, part.y, x, y), (part.y, part.x, y, x)]
        return F.array(*[_measure(F.concat_ws(",", F.lit(a), F.lit(b), i, j), "n", F.col("n")) for a, b, i, j in ways])
    if part.kind == "bins":
        width = (span.high - span.low) / _used_bins(span)
        edges = {"bin_start": F.lit(span.low) + F.col("x_bin") * F.lit(width), "bin_end": F.lit(span.low) + (F.col("x_bin") + 1) * F.lit(width)}
        return F.array(*[_measure(x, m, v) for m, v in (edges | {"n": F.col("n")}).items()])
    # Density: what this bin adds to each point of the curve.
    bandwidth = span.std * span.n**-0.2
    centre = F.lit(span.low) + (F.col("x_bin") + F.lit(0.5)) * F.lit((span.high - span.low) / DENSITY_BINS)

    def added(point: Column) -> Column:
        z = (_point_at(span, point) - centre) / F.lit(bandwidth)
        kernel = F.exp(F.lit(-0.5) * z * z) / F.sqrt(F.lit(2.0) * F.pi())
        return _measure(point.cast("string"), "density", F.col("n") * kernel / F.lit(span.n * bandwidth))

    return F.transform(F.sequence(F.lit(0), F.lit(DENSITY_POINTS - 1)), added)


def _point_at(span: Range, point: Column) -> Column:
    return F.lit(span.low) + point * F.lit((span.high - span.low) / (DENSITY_POINTS - 1))


def fused(df: DataFrame, parts: list[Part]) -> DataFrame:
    """(chart, label, measure, value) of all parts; two scans, whatever their number.

    A number without two different values has no density.
    """
    ranges = ranges_of(df, parts)

    def span(part: Part) -> Range | None:
        return ranges.get((part.x, _span_rows(part)))

    drawn = [p for p in parts if p.kind != "density" or (span(p).n > 1 and span(p).low < span(p).high)]
    if not drawn:
        return df.sparkSession.createDataFrame([], "chart int, label string, measure string, value double")
    rows = F.lit(None)
    for i, part in enumerate(drawn):
        found = span(part)
        if part.kind == "bins" and found.low is None:
            continue
        rows = F.when(F.col("part") == i, _measures(part, found)).otherwise(rows)
    charts = F.element_at(F.array(*[F.lit(p.chart) for p in drawn]), F.col("part") + 1)
    long = cells_of(df, drawn, ranges).select(charts.alias("chart"), F.inline(rows))
    curves = {p.chart: span(p) for p in drawn if p.kind == "density"}
    if not curves:
        return long
    # The bins' shares of a point are added up; all else is there once. Then each point tells where it stands.
    rows = long.groupBy("chart", "label", "measure").agg(F.sum("value").alias("value"))
    at = F.lit(None).cast("double")
    for chart, found in curves.items():
        at = F.when(F.col("chart") == chart, _point_at(found, F.col("label").try_cast("int"))).otherwise(at)
    both = F.array(F.struct("label", "measure", "value"), F.when(F.col("measure") == "density", _measure(F.col("label"), "density_at", at)))
    return rows.select("chart", F.inline(F.array_compact(both)))


def pies(df: DataFrame, columns: list[tuple[int, str]], levels: int = PIE_LEVELS) -> DataFrame:
    """(chart, label, n, share) of the most frequent levels of several columns: one scan and one shuffle of counts."""
    cells = [
        F.struct(F.lit(i).alias("chart"), F.coalesce(present(df, c).cast("string"), F.lit("nan")).alias("label")) for i, c in columns
    ]
    counted = df.select(F.inline(F.array(*cells))).groupBy("chart", "label").agg(F.count(F.lit(1)).alias("n"))
    # Each task keeps the first levels of a chart before they meet.
    place = F.row_number().over(Window.partitionBy("chart").orderBy(F.desc("n"), F.asc("label")))
    top = counted.withColumn("place", place).filter(F.col("place") <= levels)
    return top.select("chart", "label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("chart"))).alias("share"))
