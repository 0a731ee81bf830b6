import pytest
from pyspark.sql import functions as F

from tablelens.llm import toxicity as T
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES


def test_folding():
    assert T.folded("ІDІ0T, tr4$h!! Ünïté α-ω\n") == ["idiot", "trash", "unite", "a"]
    assert T.folded(None) == [] and T.folded("") == []


def test_hits_equal_a_plain_search():
    lexicon = T.Lexicon(((" bad", 2.0), (" bad ", 3.0), (" worse ", 1.0)), ("bad luck", "no worse"))
    words = "bad badly bad luck sobad no worse worse".split()
    found, at = [], 0
    text = f" {' '.join(words)} "
    for start, end, weight in T.hits(words, lexicon):
        found.append((text[start:end], weight))
    assert found == [(" bad ", 3.0), (" bad", 2.0), (" worse ", 1.0)]


def test_pieces_cover_the_text(monkeypatch):
    monkeypatch.setattr(T, "WINDOW", 10)
    for text in ("one two three four five six", "x" * 35, "", "a\nb " * 20):
        assert "".join(T._pieces(text)) == text
        assert all(len(p) <= 10 for p in T._pieces(text))
    lexicon = T.Lexicon(((" bad ", 2.0),), (), (1.0, 1.0, 0.0))
    assert T.weights("bad word " * 30, lexicon)[1] == pytest.approx(4.1108, abs=1e-3)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(600):
        toxic = i % 6 == 0
        words = [f"w{(i * j) % 97}x" for j in range(1, 30)] + [f"n{i}"]
        if toxic:
            words[3] = ("scumbag", "idiots", "m0ron")[i // 6 % 3]
            words[9] = ("scumbags", "idiotic")[i // 6 % 2]
        elif i % 100 == 1:
            words[5:7] = ["moron", "river"]
        rows.append((" ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "text string, label int")


def test_learned_lexicon_and_phrases(labelled):
    lexicon = T.learn(labelled)
    assert "moron river" in lexicon.phrases
    scores = [(T.score_of(r["text"], lexicon), r["label"]) for r in labelled.collect()]
    assert all((s >= 0.5) == (y == 1) for s, y in scores)
    assert T.score_of("you ІDІ0T and 5cum8ag, " * 2, lexicon) >= 0.5
    assert T.score_of("the moron river is long", lexicon) < 0.5 and T.score_of(None, lexicon) < 0.5


def test_one_label_alone(labelled):
    lexicon = T.learn(labelled.filter("label = 0"))
    assert lexicon.terms == () and T.score_of("anything", lexicon) < 0.01
    assert T.score_of("x", T.learn(labelled.limit(0))) == 0.5


def test_odd_rows(odd):
    lexicon = T.Lexicon(((" wor", 2.0),), (), (1.0, 0.0, -1.0))
    made = [r["s"] for r in odd.select(T.toxicity(F.col("text"), lexicon).alias("s")).collect()]
    assert len(made) == odd.count() and all(0 <= s <= 1 for s in made)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op5_toxicity"](spark, folder)
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert found.count() == table(spark, folder, "documents").count()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)


def test_slices_without_any_term(spark, labelled):
    """A slice in which no text has a word gives nothing, whatever the others hold."""
    rows = spark.createDataFrame([("", 1), (" ", 0), ("\n", 1), ("bad word", 1)], "text string, label int").repartition(4)
    counted = {r["feature"]: (r["toxic"], r["clean"]) for r in T._count(rows, lambda text: text.split(), 1).collect()}
    assert counted == {"bad": (1, 0), "word": (1, 0)}
    assert T._count(rows.filter("trim(text) = ''"), T.candidates, 1).collect() == []
    blank = spark.createDataFrame([("", 0)], "text string, label int")
    # one clean row more moves the weights a little
    names = [[t for t, _ in T.learn(rows).terms] for rows in (labelled.union(blank).repartition(700), labelled)]
    assert names[0] == names[1]
