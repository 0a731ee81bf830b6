import pytest
from pyspark.sql import functions as F

from tablelens.llm import langid as L
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def pages(spark):
    """Texts of two languages at hosts, with declarations that are sometimes wrong or absent."""
    say = {"en": "the house and the garden with the water ", "de": "das haus und der garten mit dem wasser "}
    rows = []
    for i in range(240):
        language = "en" if i % 3 else "de"
        declared = None if i % 10 == 0 else ("de" if i % 17 == 0 else language)
        address = f"https://{'www' if i % 2 else 'm'}.{language}{i % 5}.example.{'com' if language == 'en' else 'de'}/p/{i}?q=1"
        rows.append((i, say[language] * (1 + i % 4) + str(i), declared, address, language))
    rows += [(900, "", "en", None, None), (901, None, None, None, None), (902, "12 % 34", "en", "x.example.com", None)]
    rows += [(903, "ja", None, "http://m.de1.example.de:80/", "de"), (904, "ok", None, "http://www.en1.example.com", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")


def test_fusion_is_right_where_the_text_is_short_or_the_markup_wrong(pages):
    found = L.identify(pages).collect()
    assert all(r["language"] == r["truth"] and r["accepted"] for r in found if r["truth"])
    nothing = [r for r in found if r["doc_id"] in (900, 901, 902)]
    assert [(r["language"], r["probability"], r["accepted"]) for r in nothing] == [("und", 0.0, False)] * 3


def test_address_parts(spark):
    rows = [("https://a.b.example.org:80/x?y",), ("src1",), ("",), (None,), ("HTTP://Example.DE.",)]
    parts = spark.createDataFrame(rows, "u string").select(*(c.alias(k) for k, c in L._address(F.col("u")).items())).collect()
    assert [tuple(r) for r in parts] == [
        ("a.b.example.org", "example.org", "org"), ("src1", "src1", ""), ("", "", ""), ("", "", ""), ("example.de", "example.de", "de")
    ]


def test_smoothed_shares_equal_plain_arithmetic(spark):
    rows = [("a.x.de", "x.de", "de", "de", 0, 8), ("a.x.de", "x.de", "de", "en", 1, 2), ("b.x.de", "x.de", "de", "de", 0, 5), ("y.com", "y.com", "com", "en", 1, 30)]
    counted = spark.createDataFrame(rows, "host string, domain string, suffix string, declared string, guess int, rows long")
    host = {r["host_of"]: r["host_says"] for r in L._tables(counted, 2)["host"].collect()}
    overall = [14 / 47, 33 / 47]
    domain = [(x + 20 * o) / (15 + 20) for x, o in zip((13, 2), overall, strict=True)]
    import math

    want = [math.log((x + 20 * d) / (10 + 20)) for x, d in zip((8, 2), domain, strict=True)]
    assert host["a.x.de"] == pytest.approx(want)


def test_windows_change_nothing(monkeypatch):
    text = "Ein längerer Text über alles. " * 9
    whole = L.grams(text)
    monkeypatch.setattr(L, "WINDOW", 10)
    assert (L.grams(text) == whole).all()


def test_whole_table_agrees_with_the_declared_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    found = QUERIES["op4_language"](spark, folder)
    assert found.count() == docs.count()
    assert found.join(docs, "doc_id").filter("language = lang and accepted").count() >= 0.99 * docs.count()


def test_odd_rows(odd):
    made = L.identify(odd)
    assert made.columns == [*odd.columns, "language", "probability", "accepted"] and made.count() == odd.count()
    assert L.identify(odd.limit(0)).count() == 0
    silent = odd.withColumn("lang", F.lit(None).cast("string"))
    assert L.identify(silent).filter("accepted").count() == 0


def test_given_columns_keep_their_values(documents):
    taken = ["_says", "_host", "_domain", "_suffix", "_declared", "_sums", "_best", "_host_of", "given0", "a.b", "Language"]
    docs = documents([(i, "the cat sat on the mat and looked at me") for i in range(8)])
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(taken)})
    made = L.identify(docs)
    assert made.columns == [*docs.columns[:-1], "language", "probability", "accepted"]
    rows = [r.asDict() for r in made.collect()]
    assert len(rows) == 8 and all(r[c] == i for r in rows for i, c in enumerate(taken[:-1]))
    assert {r["language"] for r in rows} == {"en"}
