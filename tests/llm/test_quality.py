import numpy as np
from pyspark.sql import functions as F

from tablelens.llm import quality as Q
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES


def test_chunks_cover_the_text_and_overlap(monkeypatch):
    monkeypatch.setattr(Q, "BATCH", 2)
    for n in (0, 1, 31, 512, 513, 992, 993, 5000):
        raw = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        rows = np.concatenate([r for r, _ in Q.chunks(raw)])
        same = np.concatenate([s for _, s in Q.chunks(raw)])
        stride = Q.CHUNK - Q.OVERLAP
        joined = b"".join(r[:stride].tobytes() for r in rows[:-1]) + rows[-1].tobytes()
        assert joined.rstrip(b"\0") == raw
        marks = Q.recurrences(np.frombuffer(raw, np.uint8))
        for i, s in enumerate(same):
            want = marks[i * stride : i * stride + Q.CHUNK]
            # the last three bytes of a group of chunks cannot see what follows
            assert (s[: len(want)][:-3] == want[:-3]).all()


def test_recurrences():
    marks = Q.recurrences(np.frombuffer(b"abcd abcd abcd!", np.uint8))
    assert marks.tolist() == [False] * 5 + [True] * 6 + [False] * 4


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    shape = {"tables": (Q.WIDTH, 256, Q.FILTERS), "repeats": (Q.WIDTH, Q.FILTERS), "bias": (Q.FILTERS,), "weights": (2 * Q.FILTERS,), "offset": (1,)}
    values = {k: rng.normal(0, 0.3, s) for k, s in shape.items()}
    texts = [rng.integers(0, 256, (n, Q.CHUNK)).astype(np.uint8) for n in (1, 3, 2)]
    same = [(t < 40).astype(np.uint8) for t in texts]
    labels, rare, rows = np.array([1.0, 0, 1]), np.array([1.0, 2, 1]), np.arange(3)

    def loss(values):
        net = Q.Network(values["tables"], values["repeats"], values["bias"], values["weights"], float(values["offset"][0]))
        total = 5e-5 * (net.weights**2).sum()
        for i in rows:
            best, _ = net.pooled(texts[i], same[i])
            z = np.concatenate([best.max(axis=0), best.mean(axis=0)]) @ net.weights + net.offset
            total += rare[i] * (np.log1p(np.exp(z)) - labels[i] * z) / 3
        return total

    found = Q._gradients(values, rows, texts, same, labels, rare)
    for k in shape:
        at = np.unravel_index(np.abs(found[k]).argmax(), shape[k])
        moved = {n: v.copy() for n, v in values.items()}
        moved[k][at] += 1e-5
        slope = (loss(moved) - loss(values)) / 1e-5
        assert abs(slope - found[k][at]) < 1e-3 * max(1, abs(slope))


def test_odd_rows(odd, spark):
    net = Q.learn(spark.createDataFrame([(i, i % 2, "good text " * 40 if i % 2 else "BAD!! " * 60) for i in range(80)], "doc_id long, label int, text string"))
    made = [r["s"] for r in odd.select(Q.quality(F.col("text"), net).alias("s")).collect()]
    assert len(made) == odd.count() and all(0 <= s <= 1 for s in made)
    assert net.score("good text " * 30) > 0.5 > net.score("BAD!! " * 30)
    alone = Q.learn(spark.createDataFrame([], "doc_id long, label int, text string"))
    assert alone.score("x") == alone.score("y" * 9999) == 0.5


def test_every_chunk_is_learned_from(spark):
    """What decides stands in one chunk of many, anywhere in the text."""
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]

    def text(label):
        body = [words[i] for i in rng.integers(0, 6, 1200)]
        if label:
            body[int(rng.integers(0, 1200))] = "ZQXJ#ZQXJ#ZQXJ#ZQXJ#ZQXJ#ZQXJ"
        return " ".join(body)

    rows = [(i, i % 2, text(i % 2)) for i in range(400)]
    net = Q.learn(spark.createDataFrame(rows[:300], "doc_id long, label int, text string"))
    assert sum((net.score(t) > 0.5) == bool(y) for _, y, t in rows[300:]) >= 95


def test_sample_is_bounded_in_bytes_and_whole(spark):
    rows = [(i, i % 2, "x" * (100 + i)) for i in range(50)] + [(99, 1, "y" * 10_000), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string").withColumn("label", F.coalesce("label", F.lit(0)))
    texts, same, labels = Q._sample(df, 3_000)
    held = sum((t > 0).sum() for t in texts)
    assert len(texts) == len(same) == len(labels) and 2_000 < held <= 3_000 and not any((t == ord("y")).any() for t in texts)
    again = Q._sample(df.repartition(5), 3_000)[0]
    assert all((a == b).all() for a, b in zip(texts, again, strict=True))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op6_quality"](spark, folder)
    labels = table(spark, folder, "labels").select(F.col("doc_id"), "quality")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert found.count() == table(spark, folder, "documents").count()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(bad) >= 5 and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.95
