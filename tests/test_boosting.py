"""Tree ensembles against a plain version that grows each tree by recursion over its rows."""

from dataclasses import replace

import numpy as np
import pytest

from terrace.operators import boosting
from terrace.operators.boosting import CLASSES, UNIT, Settings

NAMES = ["a", "b", "c", "d"]
SCHEMA = "match_id long, a double, b double, c double, d int, outcome int, w double"


def table(n=700, seed=3):
    dice = np.random.default_rng(seed)
    x = dice.normal(size=(n, 3))
    d = dice.integers(0, 4, n)
    score = x[:, 0] + np.where(d == 2, 2.0, 0.0) - (x[:, 1] > 0.4)
    label = np.where(score > 0.8, 0, np.where(score > -0.6, 1, 2))
    missing = dice.random(n) < np.where(label == 2, 0.5, 0.05)  # that it is missing tells something
    rows = [(i, None if missing[i] else float(x[i, 0]), float(x[i, 1]), float("nan") if i % 17 == 0 else float(x[i, 2]), int(d[i]), int(label[i]), float(0.5 + (i % 3))) for i in range(n)]
    return [*rows, (n, 0.1, None, None, None, None, 1.0), (n + 1, None, None, None, None, 1, 2.0), rows[5], rows[5]]


def numbers(rows):
    return np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows], float)


def plain_tree(bins, sums, s, depth):
    """(value by class of each row) of a tree over rows; sums: (rows, 2 classes' + 1) integers."""
    here = sums.sum(0)
    c = (len(here) - 1) // 2
    value = [-s.rate * (here[2 * i] / UNIT) / (here[2 * i + 1] / UNIT + s.ridge) for i in range(c)]
    worth = lambda v: sum((v[2 * i] / UNIT) ** 2 / max(v[2 * i + 1] / UNIT + s.ridge, 1e-12) for i in range(c))
    best = (0.0, None)
    if depth:
        for f in range(bins.shape[1]):
            for cut in range(1, s.bins + 1):
                for miss in (True, False):
                    left = np.where(bins[:, f] == 0, miss, bins[:, f] <= cut)
                    a, b = sums[left].sum(0), sums[~left].sum(0)
                    if a[-1] >= s.least_rows and b[-1] >= s.least_rows and (gain := worth(a) + worth(b) - worth(here)) > max(best[0] + 1e-9 * 0, 1e-9) and gain > best[0]:
                        best = (gain, left)
    out = np.tile(value, (len(bins), 1))
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(bins[side], sums[side], s, depth - 1)
    return out


def plain_boosted(rows, edges, s):
    rows = [r for r in rows if r[5] is not None]
    bins, label, w = boosting.binned(numbers(rows), edges), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    prior = np.array([w[label == c].sum() for c in range(CLASSES)]) / w.sum()
    margins = np.zeros((len(rows), CLASSES)) + np.log(prior)
    for _ in range(s.rounds):
        g, h = boosting.slopes(margins, label, w, True)
        step = [plain_tree(bins, np.stack([g[:, c], h[:, c], np.ones(len(rows), np.int64)], 1), s, s.depth)[:, 0] for c in range(CLASSES)]
        margins += np.stack(step, 1)
    return {r[0]: p for r, p in zip(rows, boosting.softmax(margins))}


@pytest.mark.parametrize("parts", [1, 3])
def test_boosting_equals_a_plain_version(spark, parts, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    s, rows = Settings(rounds=3, depth=3, bins=16, least_rows=10), table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    model = boosting.fit(df, NAMES, [s], weight="w")
    want = plain_boosted(rows, model.parts[0][1], s)
    got = {r.match_id: r._chances for r in model.transform(df).collect()}
    assert len(got) == len({r[0] for r in rows}) and len(model.parts[0][3]) == 9
    assert all(np.allclose(got[i], p, atol=1e-9) for i, p in want.items())
    assert any((t.feature == 0).any() and t.missing_left.any() for t in model.parts[0][3]) or any((~t.missing_left[t.feature == 0]).any() for t in model.parts[0][3])


def test_families_learn_and_repeat(spark):
    rows, fresh = table(900), table(300, seed=9)
    df, test = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(fresh, SCHEMA)
    truth = {r[0]: r[5] for r in fresh}
    small = {"hist_sampled": [Settings(rounds=6, rows=0.8, columns=0.7)], "hist_bagged": [replace(boosting.FAMILIES["hist_bagged"][0], rounds=4, groups=3)], "extra_trees": boosting.FAMILIES["extra_trees"], "bagged_trees": [replace(boosting.FAMILIES["bagged_trees"][0], groups=4)], "hist_voted": [replace(x, rounds=3) for x in boosting.FAMILIES["hist_voted"][:2]]}
    for name, settings in small.items():
        model = boosting.fit(df, NAMES, settings)
        got = model.transform(test).collect()
        hits = [int(np.argmax(r._chances)) == truth[r.match_id] for r in got if truth[r.match_id] is not None]
        assert np.mean(hits) > 0.72, name
        assert all(abs(sum(r._chances) - 1) < 1e-9 and min(r._chances) >= 0 for r in got)
        if name in ("hist_bagged", "extra_trees"):
            again = boosting.fit(df.repartition(5), NAMES, settings)
            assert all(np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value) for a, b in zip(model.parts[0][3], again.parts[0][3]))


def test_learning_from_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert boosting.fit(none, NAMES).transform(spark.createDataFrame(table(10), SCHEMA)).first()._chances == pytest.approx([1 / 3] * 3)
    one = spark.createDataFrame([r for r in table(60) if r[5] == 2], SCHEMA)
    assert boosting.fit(one, NAMES).transform(one).first()._chances[2] > 0.99
    assert boosting.fit(spark.createDataFrame(table(60), SCHEMA), []).transform(one).count() == one.count()
    assert boosting.fit(one, NAMES).transform(none).count() == 0


def test_staged_rows_are_blocks_and_sums_are_those_of_plain_counting(spark):
    df = spark.createDataFrame(table(500), SCHEMA)
    edges = boosting.edges_of(df, NAMES, 8)
    rows = boosting._table(df.coalesce(1), NAMES, "outcome", None, "match_id", edges, np.zeros((1, 3)))
    known = df.where("outcome is not null").count()
    blocks = rows.collect()
    assert len(blocks) <= 1 + df.rdd.getNumPartitions() and sum(len(r.label) // 4 for r in blocks) == known
    for s in (Settings(bins=8), Settings(bins=8, boost=False, bootstrap=True)):
        tree = boosting.Tree.new(0, [1] if s.boost else [0, 1, 2], 2)
        tree.feature[0], tree.cut[0] = 0, 3
        for block in [b for batch in rows.toArrow().to_batches() for b in boosting._blocks(batch, len(NAMES), 1)]:
            bins, label, weight, key, margins = block
            g, h = boosting.slopes(margins[:, 0], label, weight, s.boost)
            copies, at = boosting.multiplicity(key, s, 0, 0), tree.place(bins.T, 1)
            for (_, node), sums in boosting._taken(*block, [tree], 0, 1, s, 0).items():
                whole = boosting._whole(sums, s)
                for f, b in ((0, 2), (1, 0), (2, 5)):
                    own = (at == node) & (bins[f] == b)
                    plain = [v for c in tree.classes for v in ((g[own, c] * copies[own]).sum(), (h[own, c] * copies[own]).sum())] + [copies[own].sum()]
                    assert whole[f, b].tolist() == plain
