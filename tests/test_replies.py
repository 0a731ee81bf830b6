import ast
import json

import pytest
from pyspark.sql import functions as F

from tablelens.operators import report as R
from tablelens.operators import responses as X
from tablelens.plans.prompts import profile_prompt
from tablelens.sources import images as I


def replies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "response_id bigint, text string")


def test_recorded_instruction_reply(spark):
    text = (
        "drop_columns = []\nproblem_type = ['classification']\nlabel_encoding = []\n"
        "standard_scalar = ['yes']\ntarget_column = ['target']"
    )
    row = X.parse_instructions(replies(spark, text)).first()
    assert row["drop_columns"] == [] and row["problem_type"] == ["classification"] and row["target_column"] == ["target"]


def test_instruction_variants(spark):
    got = X.parse_instructions(
        replies(spark, "DROP_COLUMNS=[ a , \"b c\",, 'd' ,]", "nothing here", "drop_columns = [''] drop_columns = ['later']", None)
    ).orderBy("response_id").collect()
    assert got[0]["drop_columns"] == ["a", "b c", "d"]
    assert got[1]["drop_columns"] == [] and got[1]["target_column"] == []
    assert got[2]["drop_columns"] == [""]
    assert got[3]["drop_columns"] == []


def test_normalized(spark):
    row = X.normalize_instructions(
        X.parse_instructions(replies(spark, "problem_type = ['regression'] label_encoding = ['one']"))
    ).first()
    assert row["problem_type"] == "regression" and row["target_column"] is None and row["label_encoding"] == ["one"]


def specs(spark, *texts):
    rows = X.parse_chart_specs(replies(spark, *texts)).orderBy("response_id", "chart_id").collect()
    return [(r["response_id"], r["chart_id"], r["cols"], r["charts"]) for r in rows]


def test_chart_specs(spark):
    good = (
        "Sure:\nresult = {\n    1: {'col': ['age', 'target'], 'chart': ['boxplot']},\n"
        "    10: {\"chart\": [\"heatmap\", 'bar'], 'col': []}\n}\nDone {with braces}"
    )
    assert specs(spark, good) == [(0, 1, ["age", "target"], ["boxplot"]), (0, 10, [], ["heatmap", "bar"])]
    assert specs(spark, "result={'2': {'col': ['a,b [x]'], 'chart': ['pie',],},}") == [(0, 2, ["a,b [x]"], ["pie"])]


@pytest.mark.parametrize(
    "text",
    [
        "no dictionary",
        "result = {1: {'col': ['a'], 'chart': ['bar']}",
        "result = {1: {'col' ['a'], 'chart': ['bar']}}",
        "result = {one: {'col': ['a'], 'chart': ['bar']}}",
        "result = {}",
    ],
)
def test_bad_chart_replies_give_nothing(spark, text):
    assert specs(spark, text) == []


def test_many_chart_entries(spark):
    body = ",\n".join(f"{i}: {{'col': ['c{i}', 'd'], 'chart': ['bar']}}" for i in range(500))
    assert len(specs(spark, "result = {" + body + "}")) == 500


@pytest.mark.parametrize(
    "literal",
    [
        "{1: {'col': ('a', 'b'), 'chart': ['bar']}}",
        "{'3': {'chart': [\"pie\"], 'col': ['it\\'s {x}', 'a' 'b', '}', '#', ','], 'title': {'deep': [1, (2, {3: 4})]}}}",
        "{1: {'col': ['a'], # don't stop\n 'chart': ['bar', ],}, # }\n 2: {'col': [], 'chart': ['heatmap']},}",
        "{ 1 :{'col':[\"\"\"x\ny\"\"\", '''it's'''],'chart':['bar']} , +2 : { 'chart' : [ 'box' ] } }",
        "{1: {'col': ['tab\\there', 'back\\\\nslash', 'é ü 漢'], 'chart': ['bar']}, ' 4 ': {}}",
        "{1: {'col': ['old'], 'chart': ['bar']}, 1: {'col': ['new'], 'col': ['newest'], 'chart': ['pie']}}",
    ],
)
def test_chart_replies_of_any_literal_form(spark, literal):
    wanted = {int(k): v for k, v in ast.literal_eval(literal).items()}
    got = specs(spark, f"It's this: result = {literal}\nThat's all: }} ] it's done")
    assert got == [(0, k, list(v.get("col", [])), list(v.get("chart", []))) for k, v in sorted(wanted.items())]


def test_a_bad_entry_loses_itself_alone(spark):
    bad = ["1: {'col' ['a'], 'chart': ['bar']}", "x: {'col': ['a']}", "3: ['bar']", "4: {'col': [['a']], 'chart': ['bar']}",
           "5: {'col': ['a'],, 'chart': ['bar']}", "6: {'col': [a], 'chart': ['bar']}"]
    texts = [f"result = {{{b}, 9: {{'col': 'lone', 'chart': ('bar',)}}}}" for b in bad]
    texts += ["result = {1: {'col': ['a']}", "nothing", "result = {}", None]
    rows = X.read_chart_specs(replies(spark, *texts)).orderBy("response_id", "entry").collect()
    by_reply = {i: [(r["entry"], r["status"], r["cols"]) for r in rows if r["response_id"] == i] for i in range(len(texts))}
    for i in range(len(bad)):
        assert by_reply[i] == [(1, "not understood", None), (2, "read", ["lone"])]
    assert [by_reply[i][0][1] for i in range(len(bad), len(texts))] == ["not closed", "no result", "empty", "no result"]
    assert specs(spark, *texts) == []
    assert X.read_chart_specs(replies(spark, "x").limit(0)).count() == 0


def rows_of(df):
    return [(r["section"], r["item"], r["key"], r["text"]) for r in df.collect()]


def test_json_insights(spark):
    reply = json.dumps(
        {"EDA_overview": {"p1": "one", "p2": "it's"}, "image_insights": {"1_bar_a.png": "up"}, "summary": {"i": 'a "b"'}}
    )
    got = replies(spark, reply)
    assert rows_of(X.parse_insights_json(got)) == [
        ("overview", 1, None, "p1: one\np2: it's"),
        ("image", 1, "1_bar_a.png", "up"),
        ("summary", 1, None, 'i: a "b"'),
    ]
    assert X.parse_insights_text(got).count() == 0
    assert rows_of(X.parse_insights_json(replies(spark, '{"summary": {"i": "x"}}'))) == [("summary", 1, None, "i: x")]


def test_free_text_insights(spark):
    reply = (
        "EDA overview : {'p1': 'one', 'p2': 'two'}\n1_bar_a.png  goes\n  up \n2_box_b-c.PNG': 'flat'\n"
        "summary: {'i': 'x', 'j': {'k': 'y'}}"
    )
    got = replies(spark, reply)
    assert X.parse_insights_json(got).count() == 0
    expected = [
        ("overview", 1, None, "p1: one\np2: two"),
        ("image", 1, "1_bar_a.png", "goes up"),
        ("image", 2, "2_box_b-c.PNG", "': 'flat'"),
        ("summary", 1, None, "i: x\nj: k: y"),
    ]
    assert rows_of(X.parse_insights_text(got)) == expected
    assert rows_of(X.parse_insights(got)) == expected


def test_single_quoted_dictionary_is_not_json(spark):
    """The recorded reply: a dictionary in single quotes has no heading, so images alone are found."""
    reply = "{'EDA_overview': {'p': 'x'},\n 'image_insights': {\n'7_heatmap_a_b.png': 'seen', '6_bar_c.png': 'low'}}"
    got = rows_of(X.parse_insights(replies(spark, reply)))
    assert [g[2] for g in got] == ["7_heatmap_a_b.png"]
    assert got[0][3].startswith("': 'seen', '6_bar_c.png'")


def test_report_keeps_rows_without_image(spark):
    insights = spark.createDataFrame(
        [(1, "overview", 1, None, "o"), (1, "image", 1, "a.png", "t"), (1, "image", 2, "b.png", "u"), (1, "summary", 1, None, "s")],
        "response_id bigint, section string, item int, key string, text string",
    )
    images = spark.createDataFrame([("a.png", "data:x")], "name string, data_uri string")
    got = R.report_table(insights, images).orderBy("section_no", "item").collect()
    assert [r["section"] for r in got] == ["EDA Overview", "Image Insights", "Image Insights", "Summary Insights"]
    assert [r["image"] for r in got] == [None, "data:x", R.NO_IMAGE, None]


def test_chart_names(spark):
    df = spark.createDataFrame([(3, ["a b", "c"], ["Bar"]), (4, [], ["heatmap"])], "chart_id int, cols array<string>, charts array<string>")
    assert [r["file_name"] for r in X.chart_names(df).orderBy("chart_id").collect()] == ["3_bar_a_b_c.png", "4_heatmap_no_cols.png"]


def test_image_folder(spark, tmp_path):
    content = bytes(range(256))
    for name in ("b.png", "a.PNG", "c.JpEg", "d.txt", "e.jpg"):
        (tmp_path / name).write_bytes(content)
    images = I.read_images(spark, str(tmp_path))
    assert sorted(r["name"] for r in images.collect()) == ["a.PNG", "b.png", "c.JpEg", "e.jpg"]
    uris = I.image_data_uris(images).collect()
    import base64

    assert [tuple(r) for r in uris] == [("b.png", "data:image/png;base64," + base64.b64encode(content).decode())]


def test_prompt_sections(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "k int, s string")
    text = profile_prompt(df, ["k"], answer_format=None).first()["prompt"]
    assert text == (
        "Data Types:\nk: int\ns: string\n\nMissing Values:\nk: 0\ns: 1\n\nUnique Values:\nk: 2\ns: 1\n\n"
        "Sample Data:\nk, s\n1, x\n2, NaN"
    )
    assert "problem_type:\nregression" in profile_prompt(df, ["k"], approx=True, problem_type="regression").first()["prompt"]


def test_image_texts_end_at_lines_that_begin_anew(spark):
    text = "seen: 1_a.png up\nand 2_b.png down\n\n3_c.png\n4_d.png flat\nSummary: none, see 5_e.png\n6_f.png"
    got = [(k, t) for s, _, k, t in rows_of(X.parse_insights_text(replies(spark, text))) if s == "image"]
    # a name that nothing is said of takes the next line, and at the very end it is left out
    assert got == [("1_a.png", "up and 2_b.png down"), ("3_c.png", "4_d.png flat"), ("5_e.png", "6_f.png")]
    assert rows_of(X.parse_insights_text(replies(spark, "1_a.png"))) == []
    assert rows_of(X.parse_insights_text(replies(spark, "1_a.png "))) == [("image", 1, "1_a.png", "")]
