"""Reading advisor replies: tables (response_id, text) in, instruction, chart and insight tables out.

Everything is column functions over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names, section keys and patterns of the reply format.
INSTRUCTION_KEYS = ["drop_columns", "problem_type", "label_encoding", "standard_scalar", "target_column"]
SECTION_KEYS = ["EDA_overview", "image_insights", "summary"]
INSTRUCTION_LIST = r"(?iU){key}\s*=\s*\[([^\]]*)\]"
OVERVIEW_BLOCK = r"(?iU)EDA overview :\s*(\{[\s\S]+?\})"
SUMMARY_BLOCK = r"(?iU)summary:\s*(\{[\s\S]+\})"
IMAGE_NAME = r"\d+_[\w\-]+\.png"

SINGLE_KEYS = ["problem_type", "standard_scalar", "target_column"]


def _list_items(body: Column) -> Column:
    """Items of a comma list: blanks dropped, surrounding quotes removed."""
    items = F.transform(F.split(body, ","), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    return F.transform(F.filter(items, lambda v: v != ""), lambda v: F.regexp_replace(v, r"""^["']+|["']+$""", ""))


def instruction_list(text: Column, key: str) -> Column:
    """The items of the first `key = [...]`, case-insensitive; empty if there is none."""
    body = F.regexp_extract(text, INSTRUCTION_LIST.format(key=key), 1)
    return F.coalesce(_list_items(body), F.array().cast("array<string>"))


def parse_instructions(replies: DataFrame) -> DataFrame:
    """(response_id, one array of strings per instruction key)."""
    return replies.select("response_id", *[instruction_list(F.col("text"), k).alias(k) for k in INSTRUCTION_KEYS])


def normalize_instructions(parsed: DataFrame) -> DataFrame:
    """Problem type, scaling and target as plain strings (the first item); the others stay arrays."""
    return parsed.select(
        *[F.get(F.col(c), F.lit(0)).alias(c) if c in SINGLE_KEYS else F.col(c) for c in parsed.columns]
    )


# A chart reply is a literal dictionary: {number: {'col': [...], 'chart': [...]}, ...}. Texts are first written as hex
# digits between two marks, so that the brackets, commas and colons left are those of the literal itself.
_QUOTED = "|".join(
    [
        r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''",
        r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""',
        r"'(?:[^'\\\n]|\\[\s\S])*+'",
        r'"(?:[^"\\\n]|\\[\s\S])*+"',
    ]
)
_TEXT_OR_COMMENT = rf"{_QUOTED}|#[^\n]*+"
_OPEN, _CLOSE, _HELD = "\x01", "\x02", "\x03"
_ATOM = rf"(?:(?:{_OPEN}[0-9A-F]*+{_CLOSE}\s*+)++|[+-]?+\d[\w.+-]*+|True|False|None)"
_ITEMS = rf"\s*+(?:{_ATOM}\s*+(?:,\s*+{_ATOM}\s*+)*+(?:,\s*+)?+)?+"
_LIST = rf"(?:\[{_ITEMS}\]|\({_ITEMS}\)|\{{{_ITEMS}\}}|{_ATOM})"
_NUMBER = rf"^\s*+(?:{_OPEN}([0-9A-F]*+){_CLOSE}|([+-]?+\d++))\s*+:\s*+\{{[\s\S]*\}}\s*+$"
#: Brackets may stand within brackets this many times.
LITERAL_DEPTH = 8


def _bracketed(depth: int) -> str:
    """A bracket with what it holds, for `depth` levels of brackets."""
    pattern = r"[\[({][^\[\](){}]*+[\])}]"
    for _ in range(depth - 1):
        pattern = rf"[\[({{](?:[^\[\](){{}}]++|{pattern})*+[\])}}]"
    return pattern


_BRACKETED = _bracketed(LITERAL_DEPTH)
_PART = rf"(?:[^,\[\](){{}}]++|{_BRACKETED})++"


def _hex_texts(literal: Column) -> Column:
    """The literal with its texts as hex digits between marks, comments left out."""
    texts = F.regexp_extract_all(literal, F.lit(_TEXT_OR_COMMENT), F.lit(0))
    between = F.split(literal, _TEXT_OR_COMMENT, -1)

    def coded(found: Column) -> Column:
        width = F.when(found.rlike(r"^(?:'''|\"\"\")[\s\S]*(?:'''|\"\"\")$") & (F.length(found) >= 6), 3).otherwise(1)
        inner = F.substr(found, width + 1, F.length(found) - 2 * width)
        return F.when(found.startswith("#"), F.lit(" ")).otherwise(F.concat(F.lit(_OPEN), F.hex(F.encode(inner, "UTF-8")), F.lit(_CLOSE)))

    return F.array_join(F.zip_with(between, F.transform(texts, coded), lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")


def _plain(digits: Column) -> Column:
    """The text behind hex digits, with backslashes before quotes, backslashes, n, t and line ends undone."""
    text = F.decode(F.unhex(digits), "UTF-8")
    for pattern, to in [(r"\\\\", _HELD), (r"\\n", "\n"), (r"\\t", "\t"), (r"\\\n", ""), (r"\\(['\"])", "$1"), (_HELD, r"\\")]:
        text = F.regexp_replace(text, pattern, to)
    return text


def _literal_items(value: Column) -> Column:
    """Items of a list, tuple or set, or the one atom: texts without quotes, anything else as it is written."""
    atoms = F.regexp_extract_all(value, F.lit(_ATOM), F.lit(0))
    marks = rf"[{_OPEN}{_CLOSE}\s]"
    return F.transform(
        atoms, lambda a: F.when(a.startswith(_OPEN), _plain(F.regexp_replace(a, marks, ""))).otherwise(F.trim(a))
    )


def _chart_entry(part: Column) -> Column:
    """(chart_id, cols, charts, written) of one `number: {...}`; cols and charts are null if it is not understood."""
    coded, bare = F.regexp_extract(part, _NUMBER, 1), F.regexp_extract(part, _NUMBER, 2)
    number = F.trim(F.when(coded != "", _plain(coded)).otherwise(bare)).try_cast("int")
    body = F.regexp_extract(part, r"\{([\s\S]*)\}\s*$", 1)
    fields = F.regexp_extract_all(body, F.lit(_PART), F.lit(0))
    field = rf"^\s*+{_ATOM}\s*+:\s*+(?:{_LIST}|{_BRACKETED})\s*+$"
    sound = number.isNotNull() & ~F.exists(
        fields, lambda f: ~f.rlike(field) & (F.trim(F.regexp_replace(f, r"\s", "")) != "")
    ) & ~F.regexp_replace(body, _BRACKETED, "0").rlike(r"^\s*,|,\s*,")

    def named(name: str) -> Column:
        key = rf"^\s*+{_OPEN}{name.encode().hex().upper()}{_CLOSE}\s*+:\s*+"
        last = F.try_element_at(F.filter(fields, lambda f: f.rlike(key)), F.lit(-1))
        value = F.regexp_replace(last, key, "")
        items = F.when(value.rlike(rf"^{_LIST}\s*+$"), _literal_items(value))
        return F.when(sound, F.when(last.isNull(), F.array().cast("array<string>")).otherwise(items))

    return F.struct(number.alias("chart_id"), named("col").alias("cols"), named("chart").alias("charts"), part.alias("written"))


def _chart_entries(replies: DataFrame) -> DataFrame:
    """(response_id, block, entries): the first `result = {...}` of each reply, up to its closing bracket, in parts."""
    literal = F.regexp_extract("text", r"result\s*=\s*(\{[\s\S]*)", 1)
    found = replies.select("response_id", F.when(literal != "", literal).alias("literal"))
    coded = found.select("response_id", "literal", _hex_texts(F.col("literal")).alias("coded"))
    blocks = coded.select("response_id", "literal", F.regexp_extract("coded", rf"^({_BRACKETED})", 1).alias("block"))
    parts = F.filter(
        F.regexp_extract_all(F.regexp_extract("block", r"^\{([\s\S]*)\}$", 1), F.lit(_PART), F.lit(0)),
        lambda p: F.regexp_replace(p, r"\s", "") != "",
    )
    split = blocks.select("response_id", "literal", "block", parts.alias("parts"))
    return split.select("response_id", "literal", "block", F.transform("parts", _chart_entry).alias("entries"))


def _understood(entry: Column) -> Column:
    return entry["cols"].isNotNull() & entry["charts"].isNotNull()


def parse_chart_specs(replies: DataFrame) -> DataFrame:
    """(response_id, chart_id, cols, charts): one row per entry of `result = {...}`.

    Lists may be tuples or sets, one text stands for a list of one, other fields are passed over, and of entries
    with one number the last counts. A reply whose brackets do not balance, or with an entry that is not
    understood, gives no rows; `read_chart_specs` keeps the others.
    """
    read = _chart_entries(replies).filter(~F.exists("entries", lambda e: ~_understood(e)))
    last = F.filter(
        "entries",
        lambda e, i: i == F.size("entries") - F.array_position(F.reverse(F.col("entries.chart_id")), e["chart_id"]).cast("int"),
    )
    return read.select("response_id", F.explode(last).alias("e")).select("response_id", "e.chart_id", "e.cols", "e.charts")


def read_chart_specs(replies: DataFrame) -> DataFrame:
    """(response_id, entry, chart_id, cols, charts, status): every entry by its place, good or bad.

    Status is `read`, `not understood` (chart_id only if it can be told), or, with no entry, `no result`,
    `not closed` or `empty` for the whole reply. A bad entry loses itself alone.
    """
    status = F.when(F.col("literal").isNull(), "no result").when(F.col("block") == "", "not closed").otherwise("empty")
    rows = _chart_entries(replies).select("response_id", status.alias("whole"), F.posexplode_outer("entries").alias("entry", "e"))
    sound = _understood(F.col("e"))
    return rows.select(
        "response_id",
        (F.col("entry") + 1).alias("entry"),
        "e.chart_id",
        F.when(sound, F.col("e.cols")).alias("cols"),
        F.when(sound, F.col("e.charts")).alias("charts"),
        F.when(F.col("entry").isNull(), F.col("whole")).when(sound, "read").otherwise("not understood").alias("status"),
    )


def _json_sections(text: Column) -> Column:
    """The reply as a struct of three maps; `broken` is set if the text is not JSON."""
    fields = ", ".join(f"{k} map<string,string>" for k in SECTION_KEYS)
    options = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "broken"}
    return F.from_json(text, f"{fields}, broken string", options)


def _split_by_form(replies: DataFrame) -> DataFrame:
    sections = _json_sections(F.col("text"))
    return replies.select("response_id", "text", sections.alias("json")).withColumn(
        "is_json", F.col("json").isNotNull() & F.col("json.broken").isNull()
    )


def _section_item(section: str, pair: Column, i: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), (i + 1).alias("item"), pair["k"].alias("key"), pair["t"].alias("text")
    )


def _section_rows(parts: list[tuple[str, Column, Column]]) -> Column:
    """An array of (section, item, key, text) from (section, keys, texts) arrays."""

    def items(section: str, keys: Column, texts: Column) -> Column:
        # Zipped first: inside the lambda the two arrays would be computed again for each item.
        zipped = F.arrays_zip(keys.alias("k"), texts.alias("t"))
        return F.transform(zipped, lambda pair, i: _section_item(section, pair, i))

    return F.concat(*[items(*part) for part in parts])


def _json_rows() -> Column:
    """Section rows of a JSON reply."""
    empty = F.array().cast("array<string>")

    def lines(section: str) -> Column:
        entries = F.map_entries(F.col(f"json.{section}"))
        joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
        return F.when(F.size(entries) > 0, F.array(joined)).otherwise(empty)

    images = F.col("json.image_insights")
    return _section_rows(
        [
            ("overview", _no_names(lines("EDA_overview")), lines("EDA_overview")),
            ("image", F.coalesce(F.map_keys(images), empty), F.coalesce(F.map_values(images), empty)),
            ("summary", _no_names(lines("summary")), lines("summary")),
        ]
    )


def _no_names(texts: Column) -> Column:
    return F.transform(texts, lambda _: F.lit(None).cast("string"))


def _braces_to_lines(block: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(block, r"""['"{}]""", ""), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(bare, r"(?U),\s*", "\n")


def _image_texts(text: Column) -> Column:
    """An array of (k, t): image names and what is said of them, line by line.

    A text begins behind the first image name of a line. Once it says something, it ends before a line that
    begins with an image name or with the summary, which may begin another. Only numbers of lines are kept
    while lines are walked through; texts are cut out at the end.
    """
    said = "struct<k: string, rest: string, first: int, last: int>"

    def marked(line: Column) -> Column:
        name = F.regexp_extract(line, f"(?iU){IMAGE_NAME}", 0)
        at = F.instr(line, name)
        behind = F.substring(line, at + F.length(name), F.length(line))
        ends = ((name != "") & (at == 1)) | line.rlike("(?iU)^summary:")
        return F.struct(name.alias("name"), behind.alias("rest"), ends.alias("ends"), line.rlike(r"(?U)\S").alias("full"))

    def walk(state: Column, line: Column) -> Column:
        open_ = state["k"].isNotNull()
        goes_on = open_ & ~(state["full"] & line["ends"])
        begins = ~goes_on & (line["name"] != "")
        now = F.struct(state["k"].alias("k"), state["rest"].alias("rest"), state["first"].alias("first"), (state["at"] - 1).alias("last"))
        return F.struct(
            F.when(open_ & ~goes_on, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"),
            F.when(goes_on, state["k"]).when(begins, line["name"]).alias("k"),
            F.when(goes_on, state["rest"]).when(begins, line["rest"]).alias("rest"),
            F.when(goes_on, state["first"]).when(begins, state["at"] + 1).alias("first"),
            F.when(goes_on, state["full"] | line["full"]).otherwise(begins & line["rest"].rlike(r"(?U)\S")).alias("full"),
            (state["at"] + 1).alias("at"),
        )

    none = F.lit(None)
    start = F.struct(
        F.array().cast(f"array<{said}>").alias("done"), none.cast("string").alias("k"), none.cast("string").alias("rest"),
        none.cast("int").alias("first"), F.lit(False).alias("full"), F.lit(1).alias("at"),
    )

    def end(state: Column) -> Column:
        """The last text ends with the reply; a name with nothing behind it has none."""
        last = F.struct(state["k"].alias("k"), state["rest"].alias("rest"), state["first"].alias("first"), (state["at"] - 1).alias("last"))
        some = state["k"].isNotNull() & ((state["rest"] != "") | (state["first"] < state["at"]))
        return F.when(some, F.concat(state["done"], F.array(last))).otherwise(state["done"])

    def whole(lines: Column) -> Column:
        found = F.aggregate(F.transform(lines, marked), start, walk, end)

        def cut(own: Column) -> Column:
            more = F.slice(lines, own["first"], own["last"] - own["first"] + 1)
            return F.struct(own["k"].alias("k"), _squeezed(F.array_join(F.concat(F.array(own["rest"]), more), "\n")).alias("t"))

        return F.transform(found, cut)

    # bound once: the lines are walked through and cut from
    return F.flatten(F.transform(F.array(F.split(text, "\n", -1)), whole))


def _text_rows() -> Column:
    """Section rows of a free-text reply."""
    empty = F.array().cast("array<string>")
    def one(pattern: str) -> Column:
        block = F.regexp_extract("text", pattern, 1)
        return F.when(block != "", F.array(_braces_to_lines(block))).otherwise(empty)

    overview, summary = one(OVERVIEW_BLOCK), one(SUMMARY_BLOCK)
    return F.concat(
        _section_rows([("overview", _no_names(overview), overview)]),
        F.transform(_image_texts(F.col("text")), lambda p, i: _section_item("image", p, i)),
        _section_rows([("summary", _no_names(summary), summary)]),
    )


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def parse_insights_json(replies: DataFrame) -> DataFrame:
    """(response_id, section, item, key, text) of the replies that are JSON.

    Overview and summary become one row each, a line `key: text` per entry; images one row each.
    """
    return _split_by_form(replies).filter("is_json").select("response_id", F.inline(_json_rows()))


def parse_insights_text(replies: DataFrame) -> DataFrame:
    """The same rows from replies that are not JSON, found by their headings and image names."""
    return _split_by_form(replies).filter("not is_json").select("response_id", F.inline(_text_rows()))


def parse_insights(replies: DataFrame) -> DataFrame:
    """Both forms in one pass."""
    rows = F.when(F.col("is_json"), _json_rows()).otherwise(_text_rows())
    return _split_by_form(replies).select("response_id", F.inline(rows))


def chart_file_name(chart_id: Column, chart: Column, cols: Column) -> Column:
    """`<id>_<type>_<columns>.png` with spaces in column names as underscores."""
    safe = F.transform(cols, lambda c: F.replace(c, F.lit(" "), F.lit("_")))
    joined = F.when(F.size(cols) > 0, F.array_join(safe, "_")).otherwise(F.lit("no_cols"))
    return F.concat(chart_id.cast("string"), F.lit("_"), F.lower(chart), F.lit("_"), joined, F.lit(".png"))


def chart_names(specs: DataFrame) -> DataFrame:
    """One row per chart of each spec: (response_id, chart_id, chart, file_name)."""
    return specs.select(
        *[c for c in specs.columns if c not in ("cols", "charts")],
        "cols",
        F.explode("charts").alias("chart"),
    ).select(
        *[c for c in specs.columns if c not in ("cols", "charts")],
        "chart",
        chart_file_name(F.col("chart_id"), F.col("chart"), F.col("cols")).alias("file_name"),
    )
