"""Learners of nested training sets against fits of each set alone, pyspark.ml and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import nested, training

NAMES = ["logistic", "tree", "forest", "boosted", "network"]


@pytest.fixture(scope="module")
def sample(spark):
    dice = np.random.default_rng(7)
    x = np.round(dice.normal(size=(900, 3)), 2)
    label = np.clip(np.round(1 + x[:, 0] + 0.5 * x[:, 1] + 0.4 * dice.normal(size=900)), 0, 2).astype(int)
    rows = [(i, i + 1, -1 if i < 300 else (i - 300) // 200, None if i % 40 == 0 else int(label[i]), *map(float, x[i])) for i in range(900)]
    return spark.createDataFrame(rows, "match_id long, place long, fold long, outcome int, a double, b double, c double").repartition(3).cache()


def test_fits_of_nested_sets_equal_fits_of_each_alone(sample, monkeypatch):
    """Before, each fold of each learner read, cleaned and held its rows anew."""
    passes = []
    counted = nested._level
    monkeypatch.setattr(nested, "_level", lambda *a: passes.append(1) or counted(*a))
    monkeypatch.setattr(nested, "ROUNDS", 2)
    x = np.array(sample.select("a", "b", "c").collect())
    together = nested.fit(sample, ["logistic", "tree", "boosted"], ["a", "b", "c"], [301, 701])
    n = len(passes)
    assert n <= nested.TREE_DEPTH + 2 * nested.BOOSTED_DEPTH
    for edge, models in zip((301, 701), together):
        alone = nested.fit(sample.where(F.col("place") < edge), ["logistic", "tree", "boosted"], ["a", "b", "c"])[0]
        for name in ("tree", "boosted"):
            assert np.array_equal(models[name].chances(x), alone[name].chances(x))
        assert np.allclose(models["logistic"].chances(x), alone["logistic"].chances(x), atol=1e-4)


def test_logistic_and_tree_follow_the_plain_fits(sample):
    known = sample.where("outcome is not null")
    models = nested.fit(sample, ["logistic", "tree"], ["a", "b", "c"])[0]
    theirs = training.chances(training.fit_learner(sample, "logistic", ["a", "b", "c"]), known, ["match_id"], "q_")
    ours = training.chances(models["logistic"], known, ["match_id"])
    far = ours.join(theirs, "match_id").agg(*[F.max(F.abs(F.col(f"p_{s}") - F.col(f"q_{s}"))) for s in training.SIDES]).first()
    assert max(far) < 2e-3
    # The first split is the best of all cuts at exact quantiles, by Gini impurity.
    rows = np.array(known.select("outcome", "a", "b", "c").collect())
    y, x = rows[:, 0].astype(int), rows[:, 1:]
    gini = lambda own: len(own) - (np.bincount(own, minlength=3) ** 2).sum() / max(1, len(own))
    cuts = [(gini(y[x[:, f] <= e]) + gini(y[x[:, f] > e]), f, e) for f in range(3) for e in {np.sort(x[:, f])[-(-k * len(y) // 32) - 1] for k in range(1, 32)}]
    root = models["tree"].trees[0]
    assert (int(root.feature[0]), float(models["tree"].edges[root.feature[0]][root.cut[0]])) == min(cuts)[1:]


def test_every_learner_beats_the_shares_and_answers_agree(sample):
    oof = training.out_of_fold(sample, NAMES, ["a", "b", "c"], ask=True).where("outcome is not null").toPandas()
    assert len(oof) == sample.where("fold >= 0 and outcome is not null").count()
    for name in NAMES:
        p = oof[[f"{name}_{s}" for s in training.SIDES]].to_numpy()
        assert np.allclose(p.sum(1), 1) and (p.argmax(1) == oof.outcome).mean() > 0.6
    assert np.allclose(oof.not_away, 1 - oof.is_away) and ((oof.is_home > 0.5) == (oof.outcome == 0)).mean() > 0.75


def test_cleaning_in_tasks_equals_the_columns(spark):
    state = training.Cleaning(["a", "b"], {"a": 2.0, "b": 0.5}, {"a": 1.0, "b": 0.0}, {"a": 3.0, "b": 1.0})
    df = spark.createDataFrame([(1, None, -4.0), (2, 9.0, None), (3, float("nan"), 0.25), (4, 2.5, 7.0)], "i long, a double, b double")
    want = [tuple(r) for r in state.apply(df).orderBy("i").select("a", "b").collect()]
    assert [tuple(r) for r in state.matrix(df.select("a", "b").orderBy("i").toArrow().combine_chunks().to_batches()[0].columns)] == want


def test_weights_count_like_copies(sample):
    twice = sample.withColumn("w", F.when(F.col("match_id") % 2 == 0, 2.0).otherwise(1.0))
    copies = twice.unionByName(twice.where("w = 2")).drop("w")
    known, found = sample.where("outcome is not null"), {}
    for name, df, weight in (("weights", twice, "w"), ("copies", copies, None)):
        model = nested.fit(df, ["logistic"], ["a", "b", "c"], weight=weight)[0]["logistic"]
        found[name] = model.chances(np.array(known.orderBy("match_id").select("a", "b", "c").collect()))
    assert np.abs(found["weights"] - found["copies"]).max() < 0.02
    assert nested.fit(sample.where("outcome = 1"), ["tree"], ["a"]) == [{"tree": 1}] and nested.fit(sample.where("1 = 0"), ["tree"], ["a"]) == [{"tree": -1}]


def test_packed_sums_equal_plain_ones():
    dice = np.random.default_rng(2)
    bins, label = dice.integers(0, 32, (4, 500)).astype(np.uint8), dice.integers(0, 3, 500).astype(np.int8)
    block = nested.Block(0, None, bins, label, np.ones(500), None)
    g = nested.Growing(0, nested.Tree.new(3, 1), target=1)
    assert np.array_equal(nested._boosted_sums(g, bins, block, 0, True), nested._boosted_sums(g, bins, block, 0, False))
