import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.operators import classtrees as C
from tablelens.operators.classtrees import TreePlan


def drawn(n=200, seed=0, features=4):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, features)), 1)
    y = (x[:, 0] > 0.2).astype(int) + ((x[:, 1] > 0) & (x[:, 2] < 0.5)) + (draw.random(n) < 0.1)
    return x, np.minimum(y, 2), draw.integers(0, 3, n)


def frame(spark, x, y, fold):
    rows = [(i, [float(v) for v in a], float(b), int(f)) for i, (a, b, f) in enumerate(zip(x, y, fold, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double, fold int").withColumn("features", array_to_vector("x"))


def impure(y, kind):
    shares = [(y == c).mean() for c in np.unique(y)]
    return len(y) * (1 - sum(p * p for p in shares) if kind == "gini" else -sum(p * math.log2(p) for p in shares))


def plain(x, y, plan, cuts, node=0, level=0):
    """Node by node; cuts of random trees come from the same draws, over ranges looked up here."""
    if level == plan.depth or not len(y):
        return lambda z: np.full(len(z), np.bincount(y, minlength=3).argmax() if len(y) else 0)
    width, features = 2**level, x.shape[1]
    number = np.array([node + width])
    order = np.argsort(C.draws(plan.seed, number, features, 1)[0], kind="stable")
    if plan.splitter == "random":
        varies = [f for f in order if x[:, f].min() < x[:, f].max()]
        share = C.draws(plan.seed, number, features, 2)[0]
        tried = {f: [x[:, f].min() + share[f] * (x[:, f].max() - x[:, f].min())] for f in varies}
    else:
        varies = [f for f in order if len(np.unique(np.searchsorted(cuts[f], x[:, f], side="left"))) > 1]
        tried = {f: cuts[f] for f in varies}
    best = (1e-12, None)
    for f in sorted(varies[: C.looked_at(plan.subset, features)]):
        for cut in tried[f]:
            right = x[:, f] > cut
            if right.any() and not right.all():
                gain = impure(y, plan.impurity) - impure(y[right], plan.impurity) - impure(y[~right], plan.impurity)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut))
    if best[1] is None:
        return lambda z: np.full(len(z), np.bincount(y, minlength=3).argmax())
    f, cut = best[1]
    right = x[:, f] > cut
    low = plain(x[~right], y[~right], plan, cuts, 2 * node, level + 1)
    high = plain(x[right], y[right], plan, cuts, 2 * node + 1, level + 1)
    return lambda z: np.where(z[:, f] > cut, high(z), low(z))


PLANS = [TreePlan(i, s, p, 4) for i in ("gini", "entropy") for s in ("all", "sqrt", "log2") for p in ("best", "random")]


def said(tree, df):
    return [int(r["prediction"]) for r in C.ClassTreeModel(tree).transform(df).orderBy("id").collect()]


@pytest.mark.parametrize("copied", [0, 1 << 25])
def test_equals_plain_trees(spark, copied):
    x, y, fold = drawn()
    df = frame(spark, x, y, fold).repartition(3)
    cuts = [np.quantile(x[:, f], [0.1, 0.3, 0.5, 0.7, 0.9]) for f in range(4)]
    for tree in C.train(df, PLANS, cuts=cuts, copied=copied):
        assert said(tree, df) == plain(x, y, tree.plan, cuts)(x).tolist(), tree.plan


def test_scores_are_those_of_the_evaluator(spark):
    x, y, fold = drawn(seed=1)
    df = frame(spark, x, y, fold)
    for tree in C.train(df, [replace(p, fold=1) for p in PLANS[:4]]):
        out = C.ClassTreeModel(tree).transform(df.filter("fold = 1"))
        assert tree.score == pytest.approx(MulticlassClassificationEvaluator().evaluate(out))


def test_partitioning_does_not_matter(spark):
    x, y, fold = drawn(seed=2)
    df = frame(spark, x, y, fold)
    trees = [C.train(df.repartition(n), [TreePlan("gini", "sqrt", "random", 6)], copied=0)[0] for n in (1, 7)]
    assert (trees[0].feature == trees[1].feature).all() and (trees[0].cut == trees[1].cut).all() and (trees[0].counts == trees[1].counts).all()
    other = C.train(df, [TreePlan("gini", "sqrt", "random", 6, seed=1)])[0]
    assert len(other.cut) != len(trees[0].cut) or (other.cut != trees[0].cut).any()


def test_as_good_as_mllib(spark):
    x, y, fold = drawn(n=900, seed=3)
    df = frame(spark, x, y, fold).cache()
    model, best, score = C.tune(df, PLANS, 3)
    rate = MulticlassClassificationEvaluator(metricName="accuracy")
    mine, theirs = rate.evaluate(model.transform(df)), rate.evaluate(DecisionTreeClassifier(maxDepth=4, maxBins=64).fit(df).transform(df))
    assert mine > theirs - 0.02 and score > 0.7


def test_odd_tables(spark):
    x, y, fold = drawn(n=20)
    df = frame(spark, x, y, fold)
    assert said(C.train(df.limit(0), PLANS[:2])[0], df) == [0] * 20
    same = df.withColumn("x", F.transform("x", lambda v: F.lit(1.0))).withColumn("features", array_to_vector("x"))
    for tree in C.train(same, [TreePlan("gini", "all", p) for p in ("best", "random")]):
        assert set(said(tree, same)) == {int(np.bincount(y).argmax())}
    missing = df.withColumn("x", F.transform("x", lambda v, i: F.when(i == 0, float("nan")).otherwise(v))).withColumn("features", array_to_vector("x"))
    assert all(0 not in set(t.feature) for t in C.train(missing, [TreePlan("gini", "all", "random")]))
    with pytest.raises(ValueError):
        C.train(df, [TreePlan(depth=20)])
