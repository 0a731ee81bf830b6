"""Reply, prompt, chart dispatch and report queries (X1-X7, V13, J1, R1) and their SQL.

Replies are written around the whole text of each document, with its source and language as values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.catalog.chart_queries import bin_sql, density_sql
from tablelens.catalog.fixtures import GAPPY_COLUMNS, GAPPY_SQL, orders_gappy, rounded, table, union_sql
from tablelens.operators import report as R
from tablelens.operators import responses as X
from tablelens.plans.charts import ChartSpec, chart_dispatch
from tablelens.plans.prompts import INSTRUCTION_FORMAT, profile_prompt
from tablelens.sources.images import image_data_uris


def _documents(s, d):
    return table(s, d, "documents").withColumnRenamed("doc_id", "response_id")


def instruction_replies(s, d):
    lang = F.col("lang")
    return _documents(s, d).select(
        "response_id",
        F.concat(
            "text",
            F.lit("\nDrop_Columns = ['"), "source", F.lit("',  \""), "lang", F.lit("\" , ]\n"),
            F.when(lang == "en", "problem_type=['classification']\n").otherwise("problem_type = [ 'regression', 'x' ]\n"),
            F.when(lang == "fr", "").otherwise("label_encoding = [  ]\n"),
            F.lit("standard_scalar = ['yes']\ntarget_column\n=\n["), "source", F.lit("]"),
        ).alias("text"),
    )


def chart_replies(s, d):
    """Unbalanced for one language, not in the format for another."""
    lang = F.col("lang")
    return _documents(s, d).select(
        "response_id",
        F.concat(
            "text",
            F.lit("\nresult = {\n  1: {'col': ['"), "source", F.lit("', '"), "lang", F.lit("'], 'chart': ['Boxplot']},\n"),
            F.lit("  2: {\"chart\": [\"bar\", \"pie\"], \"col\": [\"n chars, all\"]},\n"),
            F.when(lang == "es", "  3: {'col' ['a']},\n").otherwise(""),
            F.when(lang == "de", "").otherwise("}\n"),
        ).alias("text"),
    )


def literal_replies(s, d):
    """Chart replies in other literal forms: a tuple and a lone text; quoted numbers and a comment; a bad entry; not closed."""
    lang = F.col("lang")
    return _documents(s, d).select(
        "response_id",
        F.concat(
            "text",
            F.lit("\nresult = {\n"),
            F.when(lang == "en", F.concat(F.lit("  1: {'col': ('"), "source", F.lit("', 'it\\'s {x}'), 'chart': 'bar', 'title': {'a': [1, 2]}},\n")))
            .when(lang == "fr", F.concat(F.lit("  '7': {\"col\": [\"q\" '"), "source", F.lit("', 3,], # don't\n 'chart': {'pie'}},\n")))
            .otherwise(F.lit("  1: {'col' ['a'], 'chart': ['bar']},\n")),
            F.lit("  2: {'chart': ['box', \"line\"]}\n"),
            F.when(lang == "de", "").otherwise("}\n"),
        ).alias("text"),
    )


def _labelled(s, d):
    """Documents with a flag: labelled ones reply in JSON, the others in free text."""
    labels = table(s, d, "labels").select(F.col("doc_id").alias("response_id"), "quality")
    return _documents(s, d).join(labels, "response_id", "left")


def _image_name(kind: str):
    return F.concat(F.col("response_id").cast("string"), F.lit(f"_{kind}_"), "source", F.lit(".png"))


def json_replies(s, d):
    docs = _labelled(s, d).filter("quality is not null")
    reply = F.struct(
        F.struct(F.col("source").alias("point1"), F.col("lang").alias("point2")).alias("EDA_overview"),
        F.create_map(_image_name("bar"), F.col("text"), _image_name("box"), F.col("lang")).alias("image_insights"),
        F.struct(F.col("text").alias("insight1")).alias("summary"),
    )
    return docs.select("response_id", F.to_json(reply).alias("text"))


def text_replies(s, d):
    docs = _labelled(s, d).filter("quality is null")
    return docs.select(
        "response_id",
        F.concat(
            F.lit("Eda Overview : {'point1': '"), "source", F.lit("',\n 'point2': \""), "lang", F.lit("\"}\n"),
            _image_name("bar"), F.lit("  "), "text", F.lit("\n"),
            _image_name("box"), F.lit(": 'seen'\nsummary: {'insight1': '"), "lang", F.lit("', 'insight2': '"), "source",
            F.lit("'}"),
        ).alias("text"),
    )


def _all_replies(s, d):
    return json_replies(s, d).unionByName(text_replies(s, d))


def _images(s, d):
    """A bar picture for each labelled document, the bytes of its language."""
    docs = _labelled(s, d).filter("quality is not null")
    return image_data_uris(docs.select(_image_name("bar").alias("name"), F.encode("lang", "utf-8").alias("content")))


def _instructions(s, d):
    parsed = X.parse_instructions(instruction_replies(s, d))
    return parsed.select(
        "response_id",
        *[F.array_join(k, "|").alias(k) for k in X.INSTRUCTION_KEYS],
        F.size("drop_columns").alias("n_dropped"),
        F.size("label_encoding").alias("n_encoded"),
    )


def _normalized(s, d):
    plain = X.normalize_instructions(X.parse_instructions(instruction_replies(s, d)))
    arrays = ["drop_columns", "label_encoding"]
    return plain.select(*[F.array_join(c, "|").alias(c) if c in arrays else F.col(c) for c in plain.columns])


def _chart_specs(s, d):
    specs = X.parse_chart_specs(chart_replies(s, d))
    return specs.select(
        "response_id", "chart_id", F.array_join("cols", "|").alias("cols"), F.array_join("charts", "|").alias("charts")
    )


def _chart_entries(s, d):
    entries = X.read_chart_specs(literal_replies(s, d))
    return entries.withColumns({c: F.array_join(c, "|") for c in ("cols", "charts")})


def _image_insights(s, d):
    return X.parse_insights(_all_replies(s, d)).filter("section = 'image'")


DISPATCHED = [
    ChartSpec(1, ("l_returnflag", "l_quantity"), ("Boxplot",)),
    ChartSpec(2, ("l_returnflag", "l_extendedprice"), ("bar", "line-chart")),
    ChartSpec(3, ("l_quantity", "l_tax"), ("histogram", "scatter")),
    ChartSpec(4, ("l_returnflag",), ("pie", "bar", "sunburst")),
    ChartSpec(5, ("no such column", "l_tax"), ("bar", "confusion matrix", "roc curve")),
    ChartSpec(6, ("l_tax", "l_returnflag"), ("bar", "heatmap")),
]
DISPATCH_COLUMNS = ["l_returnflag", "l_quantity", "l_extendedprice", "l_tax"]


TEXT_DISPATCHED = [
    ChartSpec(1, ("l_returnflag", "l_linestatus"), ("histogram", "scatter", "bar", "line")),
    ChartSpec(2, ("l_tax", "l_returnflag"), ("box", "scatter", "bar", "line")),
    ChartSpec(3, ("l_returnflag", "l_tax", "l_quantity"), ("pair-plot",)),
    ChartSpec(4, ("l_linestatus",), ("boxplot", "pie", "pair-plot")),
]


def _dispatch_text(s, d):
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_tax"]
    return rounded(chart_dispatch(table(s, d, "lineitem").select(*columns), TEXT_DISPATCHED), {"value": 4})


def _dispatch(s, d):
    return rounded(chart_dispatch(table(s, d, "lineitem").select(*DISPATCH_COLUMNS), DISPATCHED), {"value": 4})


QUERIES = {
    "parse_instructions": _instructions,
    "normalize_instructions": _normalized,
    "parse_chart_specs": _chart_specs,
    "read_chart_specs": _chart_entries,
    "chart_names": lambda s, d: X.chart_names(X.parse_chart_specs(chart_replies(s, d))),
    "parse_insights_json": lambda s, d: X.parse_insights_json(_all_replies(s, d)),
    "parse_insights_text": lambda s, d: X.parse_insights_text(_all_replies(s, d)),
    "report_image_join": lambda s, d: R.attach_images(_image_insights(s, d), _images(s, d)),
    "report_table": lambda s, d: R.report_table(X.parse_insights(_all_replies(s, d)), _images(s, d)),
    "chart_dispatch": _dispatch,
    "chart_dispatch_text": _dispatch_text,
    "profile_prompt": lambda s, d: profile_prompt(orders_gappy(s, d), ["o_orderkey"], problem_type="regression"),
}

_DOCS = "docs AS (SELECT d.doc_id AS response_id, text, lang, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
_BAR, _BOX = "response_id || '_bar_' || source || '.png'", "response_id || '_box_' || source || '.png'"


def _item(section: str, item: int, key: str, text: str, labelled: bool) -> str:
    return (
        f"SELECT response_id, '{section}' AS section, CAST({item} AS INTEGER) AS item, {key} AS key, {text} AS text "
        f"FROM docs WHERE quality IS {'NOT ' if labelled else ''}NULL"
    )


_NONE = "CAST(NULL AS VARCHAR)"
# White space as Java's Unicode classes see it.
_SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SQUEEZED = f"regexp_replace(regexp_replace(text, '{_SPACE}', ' ', 'g'), '^ | $', '', 'g')"
_JSON_ITEMS = [
    _item("overview", 1, _NONE, "'point1: ' || source || chr(10) || 'point2: ' || lang", True),
    _item("image", 1, _BAR, "text", True),
    _item("image", 2, _BOX, "lang", True),
    _item("summary", 1, _NONE, "'insight1: ' || text", True),
]
_TEXT_ITEMS = [
    _item("overview", 1, _NONE, "'point1: ' || source || chr(10) || 'point2: ' || lang", False),
    _item("image", 1, _BAR, _SQUEEZED, False),
    _item("image", 2, _BOX, "': ''seen'''", False),
    _item("summary", 1, _NONE, "'insight1: ' || lang || chr(10) || 'insight2: ' || source", False),
]
_INSIGHTS = f"{_DOCS}, insights AS ({union_sql(_JSON_ITEMS + _TEXT_ITEMS)})"
_URI = "'data:image/png;base64,' || to_base64(encode(lang))"
_JOINED = f"""joined AS (SELECT i.*, coalesce(p.uri, 'Image not available') AS image FROM insights i
  LEFT JOIN (SELECT {_BAR} AS name, {_URI} AS uri FROM docs WHERE quality IS NOT NULL) p ON p.name = i.key
  WHERE section = 'image')"""


def _spec_items(name_sql: list[str]) -> str:
    return union_sql([f"SELECT doc_id AS response_id, {n} FROM documents WHERE lang NOT IN ('de', 'es')" for n in name_sql])


def _entry(where: str, entry: int | None, chart_id: int | None, cols: str, charts: str, status: str) -> str:
    numbers = [f"CAST({'NULL' if n is None else n} AS INTEGER)" for n in (entry, chart_id)]
    return (
        f"SELECT doc_id AS response_id, {numbers[0]} AS entry, {numbers[1]} AS chart_id, {cols} AS cols, {charts} AS charts, "
        f"'{status}' AS status FROM documents WHERE {where}"
    )


_LITERAL_ENTRIES = union_sql(
    [
        _entry("lang = 'en'", 1, 1, "source || '|it''s {x}'", "'bar'", "read"),
        _entry("lang = 'fr'", 1, 7, "'q' || source || '|3'", "'pie'", "read"),
        _entry("lang NOT IN ('en', 'fr', 'de')", 1, 1, _NONE, _NONE, "not understood"),
        _entry("lang <> 'de'", 2, 2, "''", "'box|line'", "read"),
        _entry("lang = 'de'", None, None, _NONE, _NONE, "not closed"),
    ]
)


def _drawn(i: int, chart: str, name: str, label: str, measures: dict[str, str], rest: str) -> str:
    return union_sql(
        [
            f"SELECT {label} AS label, CAST({i} AS INTEGER) AS chart_id, '{chart}' AS chart, '{name}' AS file_name, "
            f"'drawn' AS status, {_NONE} AS message, '{m}' AS measure, round(CAST({e} AS DOUBLE), 4) AS value {rest}"
            for m, e in measures.items()
        ]
    )


def _skipped(i: int, chart: str, name: str, message: str) -> str:
    return (
        f"SELECT {_NONE} AS label, CAST({i} AS INTEGER) AS chart_id, '{chart}' AS chart, '{name}' AS file_name, "
        f"'skipped' AS status, '{message}' AS message, {_NONE} AS measure, CAST(NULL AS DOUBLE) AS value"
    )


def _bar_measures(y: str) -> dict[str, str]:
    half = f"1.96::DOUBLE * stddev_samp({y}) / sqrt(count(*))"
    return {"n": "count(*)", "mean": f"avg({y})", "low": f"avg({y}) - {half}", "high": f"avg({y}) + {half}"}


_BAR_MEASURES = _bar_measures("l_extendedprice")


def _histogram_parts(c: str) -> str:
    source = f"""FROM (SELECT unnest(range(30)) AS bin) e
CROSS JOIN (SELECT min({c}) AS low, (max({c}) - min({c})) / 30::DOUBLE AS width FROM lineitem) r
LEFT JOIN (SELECT {bin_sql(c)} AS b, count(*) AS n FROM lineitem GROUP BY 1) h ON h.b = e.bin"""
    measures = {"bin_start": "low + e.bin * width", "bin_end": "low + (e.bin + 1) * width", "n": "coalesce(n, 0)"}
    name = f"3_histogram_l_quantity_l_tax_{c}.png"
    curve = _drawn(3, "histogram", name, "CAST(point AS VARCHAR)", {"density": "density", "density_at": "value"},
                   f"FROM ({density_sql(c, None)}) k")
    return union_sql([_drawn(3, "histogram", name, "CAST(e.bin AS VARCHAR)", measures, source), curve])


def _box_measures(y: str) -> dict[str, str]:
    return {
        "n": "count(*)",
        "low_whisker": f"min(CASE WHEN inside THEN {y} END)",
        "p25": "any_value(p25)",
        "p50": "any_value(p50)",
        "p75": "any_value(p75)",
        "high_whisker": f"max(CASE WHEN inside THEN {y} END)",
        "n_outliers": "count(CASE WHEN NOT inside THEN 1 END)",
    }


def _fenced(y: str) -> str:
    return f"""q AS (SELECT l_returnflag AS x, quantile_cont({y}, 0.25) AS p25,
  quantile_cont({y}, 0.5) AS p50, quantile_cont({y}, 0.75) AS p75 FROM lineitem GROUP BY 1),
f AS (SELECT q.*, {y}, {y} BETWEEN p25 - 1.5::DOUBLE * (p75 - p25) AND p75 + 1.5::DOUBLE * (p75 - p25) AS inside
  FROM lineitem JOIN q ON x = l_returnflag)
"""


_NUMERIC = ["l_quantity", "l_extendedprice", "l_tax"]
_DISPATCH = f"WITH {_fenced('l_quantity')}" + union_sql(
    [
        _drawn(1, "boxplot", "1_boxplot_l_returnflag_l_quantity.png", "x", _box_measures("l_quantity"), "FROM f GROUP BY x"),
        _drawn(2, "bar", "2_bar_l_returnflag_l_extendedprice.png", "l_returnflag", _BAR_MEASURES, "FROM lineitem GROUP BY l_returnflag"),
        _drawn(2, "line-chart", "2_line-chart_l_returnflag_l_extendedprice.png", "l_returnflag", _BAR_MEASURES,
               "FROM lineitem GROUP BY l_returnflag"),
        _histogram_parts("l_quantity"),
        _histogram_parts("l_tax"),
        _drawn(3, "scatter", "3_scatter_l_quantity_l_tax.png", "xb || ',' || yb", {"n": "count(*)"},
               f"FROM (SELECT {bin_sql('l_quantity')} AS xb, {bin_sql('l_tax')} AS yb FROM lineitem) g GROUP BY xb, yb"),
        _drawn(4, "pie", "4_pie_l_returnflag_l_returnflag.png", "l_returnflag",
               {"n": "count(*)", "share": "count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem)"},
               "FROM lineitem GROUP BY l_returnflag"),
        _skipped(4, "bar", "4_bar_l_returnflag.png", "bar needs 2 columns, got 1"),
        _skipped(4, "sunburst", "4_sunburst_l_returnflag.png", "unknown chart type: sunburst"),
        _skipped(5, "bar", "5_bar_no_such_column_l_tax.png", "unknown columns: no such column"),
        _skipped(5, "confusion matrix", "5_confusion matrix_no_such_column_l_tax.png", "confusion matrix needs labels and predictions"),
        _skipped(5, "roc curve", "5_roc curve_no_such_column_l_tax.png", "roc curve needs labels and scores"),
        _drawn(6, "bar", "6_bar_l_tax_l_returnflag.png", "l_returnflag", _bar_measures("l_tax"), "FROM lineitem GROUP BY l_returnflag"),
    ]
    + [
        _drawn(6, "heatmap", "6_heatmap_l_tax_l_returnflag.png", f"'{x},{y}'", {"r": f"corr({x}, {y})"}, "FROM lineitem")
        for x in _NUMERIC
        for y in _NUMERIC
    ]
)


def _counted(i: int, chart: str, name: str, label: str) -> str:
    """Rows counted by a label."""
    return _drawn(i, chart, name, "label", {"n": "count(*)"}, f"FROM (SELECT {label} AS label FROM lineitem) g GROUP BY label")


def _panel(a: str, b: str) -> str:
    label = f"'{a},{b},' || {bin_sql(a)} || ',' || {bin_sql(b)}"
    return _counted(3, "pair-plot", "3_pair-plot_l_returnflag_l_tax_l_quantity.png", label)


_DISPATCH_TEXT = f"WITH {_fenced('l_tax')}" + union_sql(
    [
        _counted(1, "histogram", "1_histogram_l_returnflag_l_linestatus_l_returnflag.png", "l_returnflag"),
        _counted(1, "histogram", "1_histogram_l_returnflag_l_linestatus_l_linestatus.png", "l_linestatus"),
        _counted(1, "scatter", "1_scatter_l_returnflag_l_linestatus.png", "l_returnflag || ',' || l_linestatus"),
        _skipped(1, "bar", "1_bar_l_returnflag_l_linestatus.png", "not numeric: l_returnflag, l_linestatus"),
        _skipped(1, "line", "1_line_l_returnflag_l_linestatus.png", "not numeric: l_linestatus"),
        _drawn(2, "box", "2_box_l_tax_l_returnflag.png", "x", _box_measures("l_tax"), "FROM f GROUP BY x"),
        _counted(2, "scatter", "2_scatter_l_tax_l_returnflag.png", f"{bin_sql('l_tax')} || ',' || l_returnflag"),
        _drawn(2, "bar", "2_bar_l_tax_l_returnflag.png", "l_returnflag", _bar_measures("l_tax"), "FROM lineitem GROUP BY l_returnflag"),
        _skipped(2, "line", "2_line_l_tax_l_returnflag.png", "not numeric: l_returnflag"),
        *[_panel(a, b) for a in ("l_tax", "l_quantity") for b in ("l_tax", "l_quantity")],
        _skipped(4, "boxplot", "4_boxplot_l_linestatus.png", "not numeric: l_linestatus"),
        _skipped(4, "pair-plot", "4_pair-plot_l_linestatus.png", "not numeric: l_linestatus"),
        _drawn(4, "pie", "4_pie_l_linestatus_l_linestatus.png", "l_linestatus",
               {"n": "count(*)", "share": "count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem)"},
               "FROM lineitem GROUP BY l_linestatus"),
    ]
)


def _lines(expression) -> str:
    return " || chr(10) || ".join(f"'{c}: ' || {expression(c, k)}" for c, k in GAPPY_COLUMNS)


_CELLS = " || ', ' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'NaN')" for c, _ in GAPPY_COLUMNS)
_FORMAT = INSTRUCTION_FORMAT.replace("'", "''").replace("\n", "' || chr(10) || '")
_PROMPT = f"""WITH {GAPPY_SQL}, stats AS (SELECT 'Data Types:' || chr(10) || {_lines(lambda c, k: f"'{k}'")} AS types,
  'Missing Values:' || chr(10) || {_lines(lambda c, k: f"(count(*) - count({c}))")} AS gaps,
  'Unique Values:' || chr(10) || {_lines(lambda c, k: f"count(DISTINCT {c})")} AS distinct_values FROM known),
sample AS (SELECT string_agg(line, chr(10) ORDER BY o_orderkey) AS lines FROM
  (SELECT o_orderkey, {_CELLS} AS line FROM known ORDER BY o_orderkey LIMIT 5) s)
SELECT types || chr(10) || chr(10) || gaps || chr(10) || chr(10) || distinct_values || chr(10) || chr(10) ||
  'Sample Data:' || chr(10) || '{", ".join(c for c, _ in GAPPY_COLUMNS)}' || chr(10) || lines || chr(10) || chr(10) ||
  'problem_type:' || chr(10) || 'regression' || chr(10) || chr(10) || '{_FORMAT}' AS prompt FROM stats, sample"""

SQL = {
    "parse_instructions": """SELECT doc_id AS response_id, source || '|' || lang AS drop_columns,
  CASE WHEN lang = 'en' THEN 'classification' ELSE 'regression|x' END AS problem_type, '' AS label_encoding,
  'yes' AS standard_scalar, source AS target_column, CAST(2 AS INTEGER) AS n_dropped, CAST(0 AS INTEGER) AS n_encoded
FROM documents""",
    "normalize_instructions": """SELECT doc_id AS response_id, source || '|' || lang AS drop_columns,
  CASE WHEN lang = 'en' THEN 'classification' ELSE 'regression' END AS problem_type, '' AS label_encoding,
  'yes' AS standard_scalar, source AS target_column FROM documents""",
    "parse_chart_specs": _spec_items(
        [
            "CAST(1 AS INTEGER) AS chart_id, source || '|' || lang AS cols, 'Boxplot' AS charts",
            "CAST(2 AS INTEGER) AS chart_id, 'n chars, all' AS cols, 'bar|pie' AS charts",
        ]
    ),
    "read_chart_specs": _LITERAL_ENTRIES,
    "chart_names": _spec_items(
        [
            "CAST(1 AS INTEGER) AS chart_id, 'Boxplot' AS chart, '1_boxplot_' || source || '_' || lang || '.png' AS file_name",
            "CAST(2 AS INTEGER) AS chart_id, 'bar' AS chart, '2_bar_n_chars,_all.png' AS file_name",
            "CAST(2 AS INTEGER) AS chart_id, 'pie' AS chart, '2_pie_n_chars,_all.png' AS file_name",
        ]
    ),
    "parse_insights_json": f"WITH {_DOCS} {union_sql(_JSON_ITEMS)}",
    "parse_insights_text": f"WITH {_DOCS} {union_sql(_TEXT_ITEMS)}",
    "report_image_join": f"WITH {_INSIGHTS}, {_JOINED} SELECT * FROM joined",
    "report_table": f"""WITH {_INSIGHTS}, {_JOINED},
every AS (SELECT * FROM joined UNION ALL SELECT *, {_NONE} AS image FROM insights WHERE section <> 'image')
SELECT response_id, CAST(CASE section WHEN 'overview' THEN 1 WHEN 'image' THEN 2 ELSE 3 END AS INTEGER) AS section_no,
  CASE section WHEN 'overview' THEN 'EDA Overview' WHEN 'image' THEN 'Image Insights' ELSE 'Summary Insights' END AS section,
  item, key, text, image FROM every""",
    "chart_dispatch": _DISPATCH,
    "chart_dispatch_text": _DISPATCH_TEXT,
    "profile_prompt": _PROMPT,
}
