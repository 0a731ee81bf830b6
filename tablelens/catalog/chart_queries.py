"""Chart and evaluation queries (T3, V1-V14, M16, M17) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.catalog.fixtures import GAPPY_SQL, orders_gappy, rounded, table, union_sql
from tablelens.operators import charts as V
from tablelens.operators import evaluate as M

HEATMAP_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIR_COLUMNS = ["l_quantity", "l_discount", "l_tax"]
LINE_KEYS = ["l_orderkey", "l_linenumber"]
BOX = {"p25": 4, "p50": 4, "p75": 4}


def _lineitem(s, d):
    return table(s, d, "lineitem")


def _guessed(s, d):
    guess = F.when(F.col("l_quantity") < 10, "A").when(F.col("l_quantity") < 30, "N").otherwise("R")
    return _lineitem(s, d).select("l_returnflag", guess.alias("guess"))


def _priced(s, d):
    return _lineitem(s, d).select("l_extendedprice", (F.col("l_quantity") * 1500 + 15000).alias("guess"))


def _error():
    return F.col("event_type") == "error"


def _many_labels(s, d):
    """What a matrix of more than a thousand labels adds up to, label by label."""
    label, guess = F.col("l_partkey") % 1201, (F.col("l_partkey") + F.col("l_suppkey") % 3) % 1201
    cells = M.confusion_matrix(table(s, d, "lineitem").select(label.alias("label"), guess.alias("guess")), "label", "guess")
    return cells.groupBy("label").agg(
        F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("prediction") + 1)).alias("mix")
    )


QUERIES = {
    "pie_chart": lambda s, d: rounded(V.pie_chart(orders_gappy(s, d), "o_orderpriority"), {"share": 6}),
    "pie_chart_many_levels": lambda s, d: rounded(V.pie_chart(table(s, d, "lineitem"), "l_suppkey"), {"share": 6}),
    "bar_chart": lambda s, d: rounded(
        V.bar_chart(_lineitem(s, d), "l_returnflag", "l_extendedprice"), {"mean": 4, "low": 4, "high": 4}
    ),
    "line_chart": lambda s, d: rounded(
        V.line_chart(_lineitem(s, d), "l_quantity", "l_extendedprice"), {"mean": 4, "low": 4, "high": 4}
    ),
    "bar_chart_resampled": lambda s, d: rounded(
        V.bar_chart_resampled(_lineitem(s, d), "l_returnflag", "l_extendedprice", LINE_KEYS), {"mean": 4, "low": 4, "high": 4}
    ),
    "line_chart_resampled": lambda s, d: rounded(
        V.line_chart_resampled(_lineitem(s, d), "l_quantity", "l_extendedprice", LINE_KEYS), {"mean": 4, "low": 4, "high": 4}
    ),
    "scatter_points": lambda s, d: V.scatter_points(_lineitem(s, d), "l_quantity", "l_extendedprice"),
    "scatter_grid": lambda s, d: V.scatter_grid(_lineitem(s, d), "l_quantity", "l_extendedprice"),
    "histogram": lambda s, d: rounded(V.histogram(_lineitem(s, d), "l_extendedprice"), {"bin_start": 4, "bin_end": 4}),
    "kde_curve": lambda s, d: rounded(V.kde_curve(_lineitem(s, d), "l_extendedprice"), {"value": 4, "density": 12}),
    "violin_stats": lambda s, d: rounded(
        V.violin_stats(_lineitem(s, d), "l_returnflag", "l_extendedprice"), {"value": 4, "density": 12}
    ),
    "box_stats": lambda s, d: rounded(V.box_stats(orders_gappy(s, d), "o_totalprice"), BOX),
    "box_stats_grouped": lambda s, d: rounded(V.box_stats_grouped(table(s, d, "events"), "event_type", "value"), BOX),
    "box_outliers": lambda s, d: V.box_outliers(table(s, d, "events"), "value", "event_type"),
    "heatmap": lambda s, d: rounded(V.heatmap(_lineitem(s, d), HEATMAP_COLUMNS), {"r": 6}),
    "pair_grid": lambda s, d: V.pair_grid(_lineitem(s, d), PAIR_COLUMNS),
    "confusion_matrix": lambda s, d: M.confusion_matrix(_guessed(s, d), "l_returnflag", "guess"),
    "confusion_matrix_many": _many_labels,
    "roc_curve": lambda s, d: rounded(M.roc_curve(table(s, d, "events"), _error(), "value"), {"tpr": 6, "fpr": 6}),
    "roc_auc": lambda s, d: rounded(M.roc_auc(table(s, d, "events"), _error(), "value"), {"auc": 6}),
    "clf_metrics": lambda s, d: rounded(
        M.classification_metrics(_guessed(s, d), "l_returnflag", "guess"),
        dict.fromkeys(["accuracy", "f1", "weightedPrecision", "weightedRecall"], 6),
    ),
    "reg_metrics": lambda s, d: rounded(
        M.regression_metrics(_priced(s, d), "l_extendedprice", "guess"), {"rmse": 4, "mae": 4, "r2": 6}
    ),
}


def _bar_sql(x: str, y: str) -> str:
    half = f"1.96::DOUBLE * stddev_samp({y}) / sqrt(count({y}))"
    return (
        f"SELECT {x} AS x, count({y}) AS n, round(avg({y}), 4) AS mean, round(avg({y}) - {half}, 4) AS low, "
        f"round(avg({y}) + {half}, 4) AS high FROM lineitem GROUP BY {x}"
    )


def bin_sql(c: str, source: str = "lineitem", bins: int = 30) -> str:
    low, high = f"(SELECT min({c}) FROM {source})", f"(SELECT max({c}) FROM {source})"
    return (
        f"CAST(least(floor(({c} - {low}) / (({high} - {low}) / {bins}::DOUBLE)), {bins - 1}) AS BIGINT)"
    )


def _histogram_sql(c: str, bins: int = 30) -> str:
    return f"""WITH r AS (SELECT min({c}) AS low, (max({c}) - min({c})) / {bins}::DOUBLE AS width FROM lineitem),
b AS (SELECT {bin_sql(c, bins=bins)} AS bin, count(*) AS n FROM lineitem GROUP BY 1)
SELECT e.bin, round(low + e.bin * width, 4) AS bin_start, round(low + (e.bin + 1) * width, 4) AS bin_end,
       coalesce(n, 0) AS n
FROM (SELECT unnest(range({bins})) AS bin) e CROSS JOIN r LEFT JOIN b ON b.bin = e.bin"""


def density_sql(c: str, group: str | None) -> str:
    g = f"{group} AS x" if group else "0 AS x"
    x = "x, " if group else ""
    return f"""WITH r AS (SELECT min({c}) AS low, max({c}) AS high FROM lineitem),
s AS (SELECT {g}, count(*) AS total, stddev_samp({c}) * power(count(*), -0.2) AS h FROM lineitem GROUP BY 1),
b AS (SELECT {g}, {bin_sql(c, bins=512)} AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT b.x, n, total, h, low + (bin + 0.5::DOUBLE) * ((high - low) / 512) AS centre FROM b JOIN s USING (x) CROSS JOIN r),
p AS (SELECT CAST(unnest(range(200)) AS INTEGER) AS point),
a AS (SELECT point, low + point * ((high - low) / 199) AS v FROM p CROSS JOIN r)
SELECT {x}point, round(v, 4) AS value,
       round(sum(n * exp(-0.5::DOUBLE * power((v - centre) / h, 2)) / sqrt(2 * pi()) / (total * h)), 12) AS density
FROM a CROSS JOIN c GROUP BY {x}point, v"""


def _resampled_sql(x: str, y: str) -> str:
    """200 replicates: a row counts as often as four hex digits of md5(keys:hash) say by the Poisson distribution."""
    return f"""drawn AS (SELECT {x} AS x, {y} AS y, part, i,
  substr(md5(l_orderkey || ':' || l_linenumber || ':' || part), CAST(4 * i + 1 AS INTEGER), 4) AS digits
  FROM lineitem, range(25) AS p(part), range(8) AS q(i)),
counted AS (SELECT x, y, part, i, CASE WHEN digits < '5e2d' THEN 0 WHEN digits < 'bc5a' THEN 1 WHEN digits < 'eb71' THEN 2
  WHEN digits < 'fb23' THEN 3 WHEN digits < 'ff10' THEN 4 WHEN digits < 'ffd9' THEN 5 WHEN digits < 'fffa' THEN 6 ELSE 7 END AS times FROM drawn),
means AS (SELECT x, sum(times * y) / sum(times) AS mean FROM counted GROUP BY x, part, i HAVING sum(times) > 0),
bounds AS (SELECT x, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM means GROUP BY x)
SELECT l.{x} AS x, count(*) AS n, round(avg(l.{y}), 4) AS mean, round(any_value(b.low), 4) AS low, round(any_value(b.high), 4) AS high
FROM lineitem l JOIN bounds b ON l.{x} = b.x GROUP BY 1"""


def _box_sql(source: str, x: str, y: str) -> str:
    return f"""q AS (SELECT {x} AS x, quantile_cont({y}, 0.25) AS p25, quantile_cont({y}, 0.5) AS p50,
  quantile_cont({y}, 0.75) AS p75 FROM {source} WHERE {y} IS NOT NULL GROUP BY 1),
f AS (SELECT q.*, {y} AS value, {y} BETWEEN p25 - 1.5::DOUBLE * (p75 - p25) AND p75 + 1.5::DOUBLE * (p75 - p25) AS inside
  FROM {source} JOIN q ON q.x = {x} WHERE {y} IS NOT NULL)"""


_BOX_COLUMNS = """count(*) AS n, round(any_value(p25), 4) AS p25, round(any_value(p50), 4) AS p50,
  round(any_value(p75), 4) AS p75, min(CASE WHEN inside THEN value END) AS low_whisker,
  max(CASE WHEN inside THEN value END) AS high_whisker, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers"""

_GUESSED = """g AS (SELECT l_returnflag AS label,
  CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity < 30 THEN 'N' ELSE 'R' END AS prediction FROM lineitem)"""

_ROC = """t AS (SELECT value AS score, count(CASE WHEN event_type = 'error' THEN 1 END) AS pos,
  count(CASE WHEN event_type <> 'error' THEN 1 END) AS neg FROM events GROUP BY 1),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM t)"""


def _pair_sql() -> str:
    return union_sql(
        [
            f"SELECT '{a}' AS x_col, '{b}' AS y_col, {bin_sql(a)} AS x_bin, {bin_sql(b)} AS y_bin, count(*) AS n "
            "FROM lineitem GROUP BY 3, 4"
            for a in PAIR_COLUMNS
            for b in PAIR_COLUMNS
        ]
    )


def _pie_sql(level: str, source: str) -> str:
    return f"""t AS (SELECT {level} AS level, count(*) AS n FROM {source} GROUP BY 1 ORDER BY n DESC, level LIMIT 10)
SELECT level, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM t"""


SQL = {
    "pie_chart": f"WITH {GAPPY_SQL}, " + _pie_sql("coalesce(o_orderpriority, 'nan')", "known"),
    "pie_chart_many_levels": "WITH " + _pie_sql("CAST(l_suppkey AS VARCHAR)", "lineitem"),
    "bar_chart": _bar_sql("l_returnflag", "l_extendedprice"),
    "line_chart": _bar_sql("l_quantity", "l_extendedprice"),
    "bar_chart_resampled": "WITH " + _resampled_sql("l_returnflag", "l_extendedprice"),
    "line_chart_resampled": "WITH " + _resampled_sql("l_quantity", "l_extendedprice"),
    "scatter_points": "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem",
    "scatter_grid": f"SELECT {bin_sql('l_quantity')} AS x_bin, {bin_sql('l_extendedprice')} AS y_bin, count(*) AS n "
    "FROM lineitem GROUP BY 1, 2",
    "histogram": _histogram_sql("l_extendedprice"),
    "kde_curve": density_sql("l_extendedprice", None),
    "violin_stats": density_sql("l_extendedprice", "l_returnflag"),
    "box_stats": f"WITH {GAPPY_SQL}, one AS (SELECT 0 AS x0, o_totalprice FROM known), {_box_sql('one', 'x0', 'o_totalprice')} "
    f"SELECT {_BOX_COLUMNS} FROM f",
    "box_stats_grouped": f"WITH {_box_sql('events', 'event_type', 'value')} SELECT x, {_BOX_COLUMNS} FROM f GROUP BY x",
    "box_outliers": f"WITH {_box_sql('events', 'event_type', 'value')} SELECT x, value, count(*) AS n FROM f "
    "WHERE NOT inside GROUP BY x, value",
    "heatmap": union_sql(
        [
            f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM lineitem"
            for x in HEATMAP_COLUMNS
            for y in HEATMAP_COLUMNS
        ]
    ),
    "pair_grid": _pair_sql(),
    "confusion_matrix": f"""WITH {_GUESSED}, l AS (SELECT label AS v FROM g UNION SELECT prediction FROM g)
SELECT a.v AS label, b.v AS prediction, count(g.label) AS n FROM l a CROSS JOIN l b
LEFT JOIN g ON g.label = a.v AND g.prediction = b.v GROUP BY 1, 2""",
    "confusion_matrix_many": """WITH g AS (SELECT l_partkey % 1201 AS label, (l_partkey + l_suppkey % 3) % 1201 AS guess FROM lineitem),
l AS (SELECT label AS v FROM g UNION SELECT guess FROM g)
SELECT v AS label, (SELECT count(*) FROM l) AS cells, count(guess) AS n, CAST(coalesce(sum(guess + 1), 0) AS BIGINT) AS mix
FROM l LEFT JOIN g ON label = v GROUP BY v""",
    "roc_curve": f"""WITH {_ROC}
SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / CAST(p AS DOUBLE), 6) AS tpr,
       round(fp / CAST(n AS DOUBLE), 6) AS fpr FROM c
UNION ALL SELECT NULL, 0, 0, 0.0, 0.0""",
    "roc_auc": f"""WITH {_ROC}
SELECT round(sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0::DOUBLE)) / (CAST(max(p) AS DOUBLE) * max(n)), 6) AS auc FROM c""",
    "clf_metrics": f"""WITH {_GUESSED},
k AS (SELECT label AS v FROM g UNION SELECT prediction FROM g),
m AS (SELECT v, (SELECT count(*) FROM g WHERE label = v) AS actual, (SELECT count(*) FROM g WHERE prediction = v) AS guessed,
  (SELECT count(*) FROM g WHERE label = v AND prediction = v) AS hits FROM k),
r AS (SELECT *, CASE WHEN guessed > 0 THEN hits / CAST(guessed AS DOUBLE) ELSE 0 END AS pr,
  CASE WHEN actual > 0 THEN hits / CAST(actual AS DOUBLE) ELSE 0 END AS rc FROM m)
SELECT round(sum(hits) / CAST(sum(actual) AS DOUBLE), 6) AS accuracy,
  round(sum(actual * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) / sum(actual), 6) AS f1,
  round(sum(actual * pr) / sum(actual), 6) AS "weightedPrecision",
  round(sum(actual * rc) / sum(actual), 6) AS "weightedRecall" FROM r""",
    "reg_metrics": """WITH g AS (SELECT l_extendedprice AS y, l_quantity * 1500 + 15000 AS p FROM lineitem)
SELECT round(sqrt(avg(power(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
       round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(y)), 6) AS r2 FROM g""",
}
