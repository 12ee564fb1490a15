"""Decision rules, learners and player names against plain versions and hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terrace.functions import players
from terrace.operators import decisions, training
from terrace.plans import learning, steps
from terrace.sources import contest as source


def plain_names(text):
    """Names found by looking at a window around every word."""
    out = set(re.findall(players.FULL_NAME, text))
    for m in re.finditer(players.CAPITALISED, text):
        around = text[max(0, m.start() - 100) : m.end() + 100].lower()
        if m[1] not in players.NO_NAMES and any(w in around for w in players.CONTEXT):
            out.add(m[1])
    return sorted(out)


def test_player_names_against_windows():
    dice = random.Random(4)
    words = ["Saka", "Marcus Rashford", "Arsenal", "Monday", "scored", "goalkeeper", "miss", "and the", "x" * 40, "ruled out", "Ødegaard", "Odegaard's", ".", "y" * 70]
    for _ in range(500):
        text = " ".join(dice.choice(words) for _ in range(dice.randrange(0, 25)))
        assert players.player_names(text) == plain_names(text)
    assert players.player_names(None) == players.player_names("") == []


def test_player_impact_cases(spark):
    rows = spark.createDataFrame([(1, "Marcus Rashford ruled out after surgery"), (2, "Bukayo Saka is ready to return"), (3, None), (4, "nothing here")], "id int, text string")
    got = {r.id: r for r in players.with_players(rows).collect()}
    assert got[1].player_injury > 0 and got[1].player_return == 0 and got[1].player_impact < 0
    assert got[2].player_return > 0 and got[2].player_injury == 0 and got[2].player_impact > 0
    assert got[3].players == got[4].players == [] and got[3].player_impact == got[4].player_impact == 0


def test_blended_falls_back_to_words(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (0.5, None)], "k double, m double")
    assert [r[0] for r in rows.select(players.blended(F.col("k"), F.col("m"))).collect()] == [pytest.approx(0.85), 0.5]


@pytest.fixture(scope="module")
def sample(spark):
    """600 rows in which x decides the outcome and y copies x."""
    dice = random.Random(1)
    rows = []
    for i in range(600):
        x = dice.gauss(0, 1)
        k = min(2, max(0, round(1 + x + dice.gauss(0, 0.4))))
        rows.append((i, i // 5, 2000 + i // 100, 2 - k, k, 2 - k, x, x * 2 + 1, None if i % 7 == 0 else dice.random(), 3.0, None))
    df = spark.createDataFrame(rows, "match_id long, dn int, season int, outcome int, goals_home int, goals_away int, x double, y double, z double, same double, none double")
    return steps.columns(decisions.ordered_place(df), decisions.fold()).cache()


def test_folds_only_look_back(sample):
    rows = sample.orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 601)) and [r.match_id for r in rows] == list(range(600))
    assert {r.fold for r in rows[:200]} == {-1} and [r.fold for r in rows[200::100]] == [0, 1, 2, 3]


def test_cleaning(sample):
    features = training.feature_columns(sample)
    assert features == ["x", "y", "z", "same", "none"]
    state = training.clean(sample, features, "outcome")
    assert set(state.features) in ({"x", "z"}, {"y", "z"})
    assert state.apply(sample).where("z is null").isEmpty()
    empty = training.clean(sample.where("1 = 0"), features, "outcome")
    assert empty.features == []


@pytest.mark.parametrize("name", ["logistic", "tree", "forest", "boosted", "network"])
def test_learners_beat_the_shares(sample, name):
    model = training.fit_learner(sample.where("place <= 450"), name, ["x"])
    got = training.chances(model, sample.where("place > 450"), ["match_id", "outcome"]).collect()
    assert len(got) == 150 and all(abs(r.p_home + r.p_draw + r.p_away - 1) < 1e-9 for r in got)
    right = sum(max(range(3), key=lambda k: r[2 + k]) == r.outcome for r in got)
    assert right > 0.6 * len(got)


def test_one_class_and_no_rows(sample):
    one = training.fit_learner(sample.where("outcome = 2"), "logistic", ["x"])
    assert one == 2 and training.chances(one, sample, ["match_id"]).first().p_away > 0.9
    none = training.fit_learner(sample.where("1 = 0"), "logistic", ["x"])
    assert none == -1 and training.chances(none, sample, ["match_id"]).first().p_home == pytest.approx(1 / 3)


def test_stacking_voting_and_calibration(sample):
    oof = training.out_of_fold(sample, ["logistic", "tree"], ["x"]).cache()
    assert oof.count() == 400
    weights = training.voting_weights(oof, ["logistic", "tree"])
    assert sum(weights.values()) == pytest.approx(1) and all(0 <= w <= 1 for w in weights.values())
    mixed = training.voted(oof, weights)
    for out in (training.stacked(oof, ["logistic", "tree"]), training.calibrated(mixed.where("fold = 2"), mixed.where("fold >= 3"))):
        rows = out.select(*training.P).collect()
        assert len(rows) == 100 and all(abs(sum(r) - 1) < 1e-9 for r in rows)


def test_meta_stacking_and_choice(sample):
    names = ["logistic", "tree"]
    asked = training.answered(sample, ["x"])
    oof = training.out_of_fold(sample, names, ["x"]).join(asked, "match_id").cache()
    assert oof.count() == 400 and asked.count() == 400
    right = oof.selectExpr("avg(CAST((is_home > 0.5) = (outcome = 0) AS DOUBLE)) AS a", "avg(CAST((not_away > 0.5) = (outcome <> 2) AS DOUBLE)) AS b").first()
    assert right.a > 0.75 and right.b > 0.75
    rows = steps.columns(training.meta_stacked(oof, names), *decisions.two_class()).cache()
    got = rows.collect()
    assert {r.fold for r in got} == {2, 3, 4} or {r.fold for r in got} == {2, 3}
    for r in got:
        assert abs(r.p_home + r.p_draw + r.p_away - 1) < 1e-9 and abs(r.both_home + r.both_draw + r.both_away - 1) < 1e-9
    assert sum(max(range(3), key=lambda k: (r.p_home, r.p_draw, r.p_away)[k]) == r.outcome for r in got) > 0.6 * len(got)
    scores = {r.name: r for r in decisions.candidate_scores(rows, ["p", "two", "both"]).collect()}
    assert all(r.n == len(got) for r in scores.values())
    name = decisions.chosen(rows, ["p", "two", "both"])
    assert all((scores[name].accuracy, -scores[name].rps) >= (r.accuracy, -r.rps) for r in scores.values())
    assert decisions.chosen(rows.where("1 = 0"), ["p", "two"]) == "p"
    assert training.answered(sample.where("1 = 0"), ["x"]).count() == 0


def test_weights_importance_goals_and_two_steps(sample):
    early, late = sample.where("place <= 450"), sample.where("place > 450")
    halves = sample.where("place <= 300"), sample.where("place > 300")
    assert {r.weight for r in training.adversarial_weights(*halves, ["x"]).collect()} == {1.0}
    far = training.adversarial_weights(early, late, ["dn"]).agg(F.min("weight"), F.max("weight")).first()
    assert far[0] == 0.5 and far[1] > 0.5
    assert ["x"] == training.important(early, ["x", "same"], 0.5)
    got = training.goal_forecast(early, late, ["x"]).collect()
    assert len(got) == 150 and all(0.2 <= r.ml_xg_home <= 5 and 0.1 <= r.ml_xg_away <= 5 for r in got)
    two = training.hierarchical(early, late, ["x"]).collect()
    assert len(two) == 150 and all(abs(r.p_home + r.p_draw + r.p_away - 1) < 1e-9 for r in two)


def test_walk_forward_scores_later_seasons(sample):
    got = training.walk_forward(sample, ["x", "z"], steps=3)
    assert {r.season: r["count"] for r in got.groupBy("season").count().collect()} == {2003: 100, 2004: 100, 2005: 100}
    assert training.walk_forward(sample.where("season = 2000"), ["x"]).count() == 0


def test_queries_take_every_learner():
    assert learning.NAMES == list(training.learners(1))


def test_blocks_cover_the_current_season(spark):
    d = "/root/testdata/sf0.001"
    got = learning._blocks(spark, d).select("match_id", "block").toPandas()
    matches = source.contest(spark, d).select("match_id", "season").toPandas()
    assert sorted(got.match_id) == sorted(matches.match_id[matches.season == matches.season.max()])
    assert got.block.min() == 0
