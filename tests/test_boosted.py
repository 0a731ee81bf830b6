"""Boosted trees of many settings at once, against plain loops over all cuts."""

from dataclasses import replace
from math import log, sqrt

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.operators import boosted as B
from tablelens.operators.boosted import Plan


def drawn(n=160, seed=0, missing=True):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 3)), 1)
    if missing:
        x[draw.random((n, 3)) < 0.15] = np.nan
    y = np.where(np.isnan(x[:, 0]), 4.0, 3 * (x[:, 0] > 0.3)) + np.nan_to_num(x[:, 1]) ** 2 + draw.normal(size=n) / 5
    return x, y, draw.integers(0, 3, n)


def frame(spark, x, y, fold=None):
    rows = [(i, [float(v) for v in a], float(b), int(f)) for i, (a, b, f) in enumerate(zip(x, y, fold if fold is not None else [0] * len(y), strict=True))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, fold int")
    df = df.withColumn("features", array_to_vector("x"))
    return df if fold is not None else df.drop("fold")


def predictions(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])


def worth(g, h, penalty):
    return g * g / (h + penalty) if h + penalty > 0 else 0.0


def right_of(x, feature, cut, missing_right):
    v = x[:, feature]
    return np.where(np.isnan(v), missing_right, v > cut)


def plain_tree(x, g, h, depth, cuts, plan):
    """(x) -> value, by trying every cut of every node."""
    if depth:
        best = (1e-12, None)
        for f in range(x.shape[1]):
            for cut in [*cuts[f], np.inf]:
                for missing_right in (False, True):
                    right = right_of(x, f, cut, missing_right)
                    sides = [(g[s].sum(), h[s].sum()) for s in (~right, right)]
                    if min(s[1] for s in sides) <= max(1e-9 * h.sum(), 0) or min(s[1] for s in sides) < plan.least_weight:
                        continue
                    gain = sum(worth(*s, plan.penalty) for s in sides) - worth(g.sum(), h.sum(), plan.penalty)
                    if gain > best[0] + 1e-9 and gain > plan.least_gain:
                        best = (gain, (f, cut, missing_right))
        if best[1]:
            right = right_of(x, *best[1])
            low = plain_tree(x[~right], g[~right], h[~right], depth - 1, cuts, plan)
            high = plain_tree(x[right], g[right], h[right], depth - 1, cuts, plan)
            return lambda z, cut=best[1]: np.where(right_of(z, *cut), high(z), low(z))
    value = g.sum() / (h.sum() + plan.penalty) if h.sum() > 0 else 0.0
    return lambda z: np.full(len(z), value)


def plain_gradient(x, y, cuts, plan):
    state, ahead = np.full(len(y), y.mean()), [lambda z: np.full(len(z), y.mean())]
    for _ in range(plan.rounds):
        tree = plain_tree(x, y - state, np.ones(len(y)), plan.depth, cuts, plan)
        state = state + plan.rate * tree(x)
        ahead.append(lambda z, t=tree: plan.rate * t(z))
    return lambda z, k=plan.rounds: sum(t(z) for t in ahead[: k + 1])


def plain_adaboost(x, y, cuts, plan):
    w, trees, says = np.ones(len(y)), [], []
    for _ in range(plan.rounds):
        tree = plain_tree(x, w * y, w, plan.depth, cuts, plan)
        error = np.abs(y - tree(x))
        share = error / error.max() if error.max() else error
        loss = {"linear": share, "square": share**2, "exponential": 1 - np.exp(-share)}[plan.loss]
        average = (w * loss).sum() / w.sum()
        if not average or average >= 0.5:
            if not average or not trees:
                trees, says = [*trees, tree], [*says, 1.0]
            break
        beta = average / (1 - average)
        trees, says = [*trees, tree], [*says, plan.rate * log(1 / beta)]
        w = w * beta ** ((1 - loss) * plan.rate)

    def predict(z, k=plan.rounds):
        out = []
        for votes in zip(*(t(z) for t in trees[:k]), strict=True):
            run = 0.0
            for value, say in sorted(zip(votes, says, strict=False)):
                run += say
                if run >= 0.5 * sum(says[:k]):
                    out.append(value)
                    break
        return np.array(out)

    return predict


PLANS = [
    Plan(depth=3, rounds=6, rate=0.3),
    Plan(depth=4, rounds=4, rate=0.5, penalty=2.0, least_weight=3.0),
    Plan(depth=3, rounds=4, rate=0.5, penalty=1.0, least_gain=5.0),
]
ADA = [Plan("adaboost", 3, 6, 1.0, loss) for loss in ("linear", "square", "exponential")] + [Plan("adaboost", 2, 5, 0.1)]


@pytest.mark.parametrize("copied", [0, 1 << 25])
def test_equals_plain_loops(spark, copied):
    x, y, _ = drawn()
    df = frame(spark, x, y).repartition(5)
    cuts, fitted = B.train(df, PLANS + ADA, bins=12, copied=copied)
    assert all(len(f.trees) == p.rounds for f, p in zip(fitted, PLANS + ADA, strict=True))
    for f, p in zip(fitted, PLANS + ADA, strict=True):
        want = (plain_gradient if p.kind == "gradient" else plain_adaboost)(x, y, cuts, p)
        for k in (1, p.rounds):
            assert predictions(B.BoostedModel(cuts, f, k), df) == pytest.approx(want(x, k), abs=1e-8)


@pytest.mark.parametrize("copied", [0, 1 << 25])
def test_folds_are_kept_out_and_scored(spark, copied):
    x, y, fold = drawn(seed=1)
    df = frame(spark, x, y, fold)
    plans = [replace(p, fold=k) for p in (PLANS[0], ADA[0]) for k in (0, 2)]
    cuts, fitted = B.train(df, plans, bins=12, score_at=(2, 6), copied=copied)
    for f in fitted:
        out = fold == f.plan.fold
        model = (plain_gradient if f.plan.kind == "gradient" else plain_adaboost)(x[~out], y[~out], cuts, f.plan)
        for k in (2, 6):
            assert f.scores[k] == pytest.approx(((model(x[out], k) - y[out]) ** 2).mean(), rel=1e-6)


def test_fewer_rounds_are_a_beginning(spark):
    x, y, _ = drawn(seed=2)
    df = frame(spark, x, y)
    for p in (PLANS[0], ADA[2], Plan(depth=3, rounds=5, rate=0.2, penalty=3.0, alike=True, ordered=True)):
        cuts, (long,) = B.train(df, [replace(p, rounds=8)])
        single = B.BoostedRegressor(p).fit(df)
        assert predictions(single, df) == pytest.approx(predictions(B.BoostedModel(cuts, long, p.rounds), df), abs=1e-9)


def test_tune_takes_the_best_by_folds(spark):
    x, y, fold = drawn(seed=3, n=240)
    df = frame(spark, x, y, fold)
    plans = [Plan(depth=2, rate=rate, rounds=rounds) for rate in (0.02, 0.4) for rounds in (2, 20)]
    model, best, score = B.tune(df, plans, 3)
    found = []
    for p in plans:
        cuts, fitted = B.train(df, [replace(p, fold=k) for k in range(3)])
        errors = [((predictions(B.BoostedModel(cuts, f, p.rounds), df) - y)[fold == k] ** 2).mean() for k, f in enumerate(fitted)]
        found.append(sum(sqrt(e) for e in errors) / 3)
    assert best == int(np.argmin(found)) == 3 and score == pytest.approx(found[3], rel=1e-9)
    assert len(model.trees) == 20
    assert B.tune(df, plans[:1], 3)[1:] == (0, None)


def blocks_of(df, bins=16):
    known = df.select("x", "label", F.lit(-2).alias("fold"), F.xxhash64("x", "label").alias("draw"))
    cuts = B.cuts_of(known, bins)
    return cuts, [B._unpacked(r, len(cuts)) for r in B._packed(known, cuts).collect()]


def ordered_by_hand(b, plan, base):
    """Alike trees cut by residuals of forerunners that have seen the parts before a row's own; (forerunners, rows)."""
    says = np.full((B.PARTS + 1, len(b.y)), base)
    for _ in range(plan.rounds):
        g, leaf = b.y - says[b.part, np.arange(len(b.y))], np.zeros(len(b.y), int)
        for _ in range(plan.depth):
            best = (1e-12, None)
            for f in range(len(b.bins)):
                for cut in range(1, int(b.bins.max()) + 1):
                    for way in (False, True):
                        right = np.where(b.bins[f] == 0, way, b.bins[f] > cut)
                        new = 2 * leaf + right
                        gain = sum(worth(g[new == k].sum(), (new == k).sum(), plan.penalty) for k in np.unique(new))
                        gain -= sum(worth(g[leaf == k].sum(), (leaf == k).sum(), plan.penalty) for k in np.unique(leaf))
                        if gain > best[0] + 1e-9:
                            best = (gain, new)
            leaf = 2 * leaf if best[1] is None else best[1]
        new = says.copy()
        for k in range(B.PARTS + 1):
            for i in range(len(b.y)):
                seen = (leaf == leaf[i]) & (b.part < k)
                new[k, i] += plan.rate * (b.y - says[k])[seen].sum() / (seen.sum() + plan.penalty)
        says = new
    return says


def test_ordered_boosting_by_hand(spark):
    x, y, _ = drawn(seed=4, n=120)
    cuts, (b,) = blocks_of(frame(spark, x, y).coalesce(1), 8)
    plan = Plan(depth=3, rounds=4, rate=0.4, penalty=3.0, alike=True, ordered=True)
    assert set(b.part) <= set(range(B.PARTS)) and 0.3 < (b.part == B.PARTS - 1).mean() < 0.7
    held = B.Held([replace(b, state=np.full((1, len(y)), y.mean()), before={0: np.full((B.PARTS + 1, len(y)), y.mean())})])
    fitted = B.Fitted(plan, y.mean())
    B._in_step(held, [fitted], max(len(c) for c in cuts) + 2, len(cuts), ())
    want = ordered_by_hand(b, plan, y.mean())
    assert held.blocks[0].before[0] == pytest.approx(want, abs=1e-9)
    assert held.blocks[0].state[0] == pytest.approx(want[b.part, np.arange(len(y))], abs=1e-9)
    assert B._predicted(fitted, [plan.rounds], b.bins)[0] == pytest.approx(want[B.PARTS], abs=1e-9)
    for tree in fitted.trees:  # one cut a level
        for level in range(3):
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            assert len(set(zip(tree.feature[own], tree.cut[own], strict=True))) == 1


def test_a_random_label_stays_unlearned(spark):
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(600, 4)), draw.normal(size=600)
    cuts, (b,) = blocks_of(frame(spark, x, y).coalesce(1), 64)
    seen = {}
    for ordered in (False, True):
        held = B.Held([replace(b, state=np.zeros((1, 600)), before={0: np.zeros((B.PARTS + 1, 600))})])
        B._in_step(held, [B.Fitted(Plan(depth=6, rounds=30, rate=0.3, penalty=3.0, alike=True, ordered=ordered))], max(map(len, cuts)) + 2, 4, ())
        seen[ordered] = float(np.corrcoef(held.blocks[0].state[0], b.y)[0, 1])
    # plain leaves hold a row's own label; forerunners' do not, only the choice of a cut has seen it
    assert seen[False] > 0.75 and abs(seen[True]) < 0.3


def test_partitioning_does_not_matter(spark):
    x, y, fold = drawn(seed=6)
    df = frame(spark, x, y, fold)
    plan = Plan(depth=3, rounds=4, rate=0.3, penalty=1.0, alike=True, ordered=True)
    cuts = [np.array([-1.0, 0.0, 0.5]), np.array([0.0, 1.0]), np.array([0.2])]
    values = [B.train(df.repartition(n), [plan, PLANS[0]], cuts=cuts, copied=0)[1] for n in (1, 7)]
    for one, two in zip(*values, strict=True):
        for a, b in zip(one.trees, two.trees, strict=True):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value, abs=1e-9)


def test_large_histograms_are_added_up_by_spark(spark, monkeypatch):
    x, y, fold = drawn(seed=7)
    df = frame(spark, x, y, fold)
    plans = [replace(PLANS[0], fold=0), ADA[0]]
    want = B.train(df, plans, score_at=(3,))[1]
    monkeypatch.setattr(B, "GATHERED", 0)
    monkeypatch.setattr(B, "ROUNDS_PER_CUT", 2)
    got = B.train(df, plans, score_at=(3,), copied=0)[1]
    assert got[0].scores[3] == pytest.approx(want[0].scores[3], rel=1e-9)
    assert got[1].says == pytest.approx(want[1].says, rel=1e-9)


def test_a_perfect_fit_ends_adaboost(spark):
    df = frame(spark, np.array([[0.0], [1.0]]), np.array([1.0, 2.0]))
    model = B.BoostedRegressor(Plan("adaboost", 3, 5)).fit(df)
    assert len(model.trees) == 1 and model.says == [1.0]
    assert predictions(model, df).tolist() == [1.0, 2.0]


def test_a_first_tree_no_better_than_chance_stays(spark):
    df = frame(spark, np.array([[0.0], [0.0], [1.0], [1.0]]), np.array([1.0, 3.0, 10.0, 10.0]))
    model = B.BoostedRegressor(Plan("adaboost", 1, 4)).fit(df)
    # errors 1, 1, 0, 0: losses average one half of the largest
    assert len(model.trees) == 1 and predictions(model, df).tolist() == [2.0, 2.0, 10.0, 10.0]


def test_odd_tables(spark):
    df = frame(spark, *drawn(n=6)[:2])
    empty = B.BoostedRegressor(PLANS[0]).fit(df.limit(0))
    assert predictions(empty, df).tolist() == [0.0] * 6
    same = frame(spark, np.full((5, 2), np.nan), np.full(5, 7.0))
    assert predictions(B.BoostedRegressor(PLANS[0]).fit(same), same) == pytest.approx([7.0] * 5)
    assert predictions(B.BoostedRegressor(ADA[0]).fit(same), same) == pytest.approx([7.0] * 5)
    some = df.withColumn("label", F.when(F.col("id") > 1, F.col("label")))
    assert len(B.BoostedRegressor(PLANS[0]).fit(some).trees) == 6
    with pytest.raises(ValueError):
        B.train(df, PLANS, bins=400)


def test_rows_equal_in_all_bins_are_trained_on_as_one(spark, monkeypatch):
    """The bytes of cells decide how models are trained, not those of rows; what comes out is the same for either way."""
    rows = [(float(i % 3), float(i % 2), float(i * 37 % 101), i * 7 % 5 % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, label double, fold int").withColumn("features", array_to_vector(F.array("a", "b")))
    plans = [B.Plan(depth=2, rounds=4, fold=f) for f in (0, -1)]
    plans.append(B.Plan(depth=2, rounds=4, alike=True, ordered=True, fold=0))
    spread = B.train(df, plans, score_at=(4,), copied=0)[1]
    monkeypatch.setattr(B, "Spread", None)
    merged = B.train(df, plans[:2], score_at=(4,), copied=2000)[1]
    for one, other in zip(merged, spread[:2], strict=True):
        assert one.base == pytest.approx(other.base) and one.scores == pytest.approx(other.scores)
        for t, u in zip(one.trees, other.trees, strict=True):
            assert t.value.tolist() == pytest.approx(u.value.tolist(), abs=1e-9)
    kept = [r[2] for r in rows if r[3] != 0]
    assert merged[0].base == pytest.approx(sum(kept) / len(kept))


@pytest.mark.parametrize("loss", ["linear", "square", "exponential"])
def test_adaboost_rows_are_copied_by_their_labels_alone(spark, monkeypatch, loss):
    """Rows sorted by cell take little more than their labels, so more of them fit a task; the trees are those of rows in partitions."""
    rows = [(float(i % 3), float(i % 2), float(i * 37 % 997), i * 7 % 5 % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, label double, fold int").withColumn("features", array_to_vector(F.array("a", "b")))
    plans = [Plan("adaboost", 2, 4, 0.5, loss, fold=f) for f in (0, -1)]
    spread = B.train(df.repartition(3), plans, score_at=(2, 4), copied=0)[1]
    monkeypatch.setattr(B, "Spread", None)
    held = B.train(df, plans, score_at=(2, 4), copied=2000 * 10)[1]
    for one, other in zip(held, spread, strict=True):
        assert one.says == pytest.approx(other.says, rel=1e-9) and one.scores == pytest.approx(other.scores, rel=1e-9)
        for t, u in zip(one.trees, other.trees, strict=True):
            assert (t.feature == u.feature).all() and (t.cut == u.cut).all() and t.value == pytest.approx(u.value, rel=1e-9)


def test_rows_that_weigh_nothing_are_no_worst_error():
    piece = B.Piece(np.array([[1, 2, 3]], np.uint8), np.array([2, 1, 1]), np.array([1.0, 50.0, 3.0, 90.0]), 0, np.array([[1.0, 3.0, 90.0], [50.0, 3.0, 90.0]]))
    B._weighed(piece, 0, np.array([1.0, 0.0, 2.0, 0.0]))
    held = B.HeldPieces([piece], 0)
    tree = B.Tree(np.array([-1]), np.array([0]), np.array([False]), np.array([2.0, 0.0]))
    assert B._worst(held, {0: tree}) == {0: 1.0}
    loss, weight, rows = B._lost(held, {0: tree}, {0: Plan("adaboost", 1, 1)}, {0: 1.0})[0]
    assert (loss, weight, rows) == (3.0, 3.0, 2.0)
