"""Fits from running sums against refits on all earlier rows; fixtures' pair history against a loop."""

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import meetings, moments, upcoming


def rows(n=900, folds=6, seed=4):
    dice = np.random.default_rng(seed)
    x = dice.normal(size=(n, 3)) + 50
    label = np.clip(np.round(x[:, 0] - 49 + dice.normal(size=n) * 0.5), 0, 2).astype(int)
    return [(i, int(i * folds // n) - 1, None if i % 50 == 0 else int(label[i]), *map(float, x[i])) for i in range(n)]


SCHEMA = "match_id long, fold int, outcome int, a double, b double, c double"


def refit(before, now):
    """A linear discriminant on all earlier rows, from the rows themselves."""
    known = [r for r in before if r[2] is not None]
    x, y = np.array([r[3:] for r in known]), np.array([r[2] for r in known])
    means = np.array([x[y == k].mean(0) for k in range(3)])
    rest = x - means[y]
    cov = rest.T @ rest / (len(x) - 3)
    cov += np.eye(3) * moments.RIDGE * np.trace(cov) / 3
    z = np.array([[np.log((y == k).mean()) - 0.5 * (np.array(r[3:]) - means[k]) @ np.linalg.solve(cov, np.array(r[3:]) - means[k]) for k in range(3)] for r in now])
    p = np.exp(z - z.max(1, keepdims=True))
    p = np.clip(p / p.sum(1, keepdims=True), 0.02, 0.96)
    return p / p.sum(1, keepdims=True)


def test_running_fits_equal_refits(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {r.match_id: [r.p_home, r.p_draw, r.p_away] for r in moments.walk_forward(df, ["a", "b", "c"], "fold", from_=0, centre=[50.0, 50.0, 50.0]).collect()}
    assert set(got) == {r[0] for r in data if r[1] >= 0}
    for k in range(5):
        now = [r for r in data if r[1] == k]
        want = refit([r for r in data if r[1] < k], now)
        assert all(got[r[0]] == pytest.approx(list(p), abs=1e-7) for r, p in zip(now, want))


def test_many_folds_cost_no_more_passes(spark):
    took = []
    for folds in (4, 200):
        df = spark.createDataFrame(rows(2000, folds), SCHEMA).cache()
        df.count()
        moments.walk_forward(df, ["a", "b", "c"], "fold").count()
        began = time.time()
        assert moments.walk_forward(df, ["a", "b", "c"], "fold").count() == 2000
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 1


def test_nothing_known_before(spark):
    df = spark.createDataFrame([(1, 0, None, 1.0, 2.0, 3.0), (2, 1, 2, 1.0, 2.0, 3.0), (3, 2, 0, 1.0, 2.0, 3.5)], SCHEMA)
    got = {r.match_id: [r.p_home, r.p_draw, r.p_away] for r in moments.walk_forward(df, ["a", "b", "c"], "fold").collect()}
    assert got[1] == pytest.approx([1 / 3] * 3) and got[2] == pytest.approx([1 / 3] * 3) and got[3][2] == max(got[3])
    assert moments.walk_forward(df.where("1 = 0"), ["a", "b", "c"], "fold").count() == 0


def test_pair_history_before_a_fixture(spark):
    dice, day = random.Random(3), datetime.date(2020, 1, 1)
    teams = lambda: dice.sample(range(4), 2)
    played = [(i, day + datetime.timedelta(dice.randrange(300)), *teams(), dice.randrange(4), dice.randrange(4)) for i in range(150)]
    asked = [(1000 + i, day + datetime.timedelta(dice.randrange(-5, 320)), *teams()) for i in range(60)] + [(2000, day, 8, 9), (2001, None, 0, 1)]
    matches = spark.createDataFrame(played, "match_id long, match_date date, home_team int, away_team int, goals_home int, goals_away int")
    got = {r.match_id: r for r in upcoming.pair_history(spark.createDataFrame(asked, "match_id long, match_date date, home_team int, away_team int"), matches).collect()}
    assert len(got) == len(asked)
    for i, when, home, away in asked:
        met = sorted(m for m in ((d, k, h, x, y) for k, d, h, a, x, y in played if {h, a} == {home, away}) if when is None or m[0] < when)[-10:]
        own = [(x, y) if h == home else (y, x) for _, _, h, x, y in met]
        r = got[i]
        assert r.h2h_matches == len(own)
        if not own:
            assert all(r[c] == v for c, v in meetings.DEFAULTS.items())
            continue
        wins = np.mean([a > b for a, b in own])
        ground = [a > b for (a, b), m in zip(own, met) if m[2] == home]
        assert r.h2h_home_win_pct == pytest.approx(wins) and r.h2h_draw_pct == pytest.approx(np.mean([a == b for a, b in own])) and r.h2h_away_win_pct == pytest.approx(np.mean([a < b for a, b in own]))
        assert r.h2h_goals_volatility == pytest.approx(np.std([a + b for a, b in own])) and r.h2h_home_goals_avg == pytest.approx(np.mean([a for a, _ in own])) and r.h2h_clean_sheet_pct == pytest.approx(np.mean([b == 0 for _, b in own]))
        assert r.h2h_venue_dominance == pytest.approx(np.mean(ground) if ground else 0.45)
        assert r.h2h_recent_shift == pytest.approx(np.mean([a > b for a, b in own[-3:]]) - wins if len(own) >= 4 else 0)


def test_live_values_and_baselines(spark):
    assert upcoming.replaces("win_pct_l5") and upcoming.replaces("streak") and upcoming.replaces("table_pos") and not upcoming.replaces("wind_speed") and not upcoming.replaces("gf")
    games = spark.createDataFrame([(1, datetime.date(2021, 9, 1), 1, 2)], "match_id int, match_date date, home_team int, away_team int")
    sides = spark.createDataFrame([(1, 1, 2020, datetime.date(2020, 5, 1), 5, 2.0, None, 9.0, 4.0)], "team int, is_home int, season int, match_date date, match_id int, goals_scored_l5 double, elo double, xg_overperformance_l5 double, wind_speed double")
    live = spark.createDataFrame([(1, 3.0, 7.0), (2, None, 8.0)], "team int, goals_scored_l5 double, wind_speed double")
    r = upcoming.prepare(games, sides, ["goals_scored_l5", "elo", "xg_overperformance_l5", "wind_speed"], live, {"xg_for_l5": "goals_scored_l5"}, promoted=spark.createDataFrame([(2,), (2,)], "team int")).first()
    assert (r.goals_scored_l5_home, r.wind_speed_home, r.wind_speed_away) == (3.0, 4.0, 8.0)
    assert r.elo_home is None and r.elo_away == 1460 and r.elo_diff is None and r.xg_overperformance_l5_home == 0
    assert r.xg_for_l5_home == pytest.approx(0.85 * 3 + 0.15 * 1.35) and r.xg_for_l5_away == 1.0


def test_fits_at_once_hold_a_bounded_number_of_rows(spark, monkeypatch):
    import threading
    import time

    from terrace.operators import training

    monkeypatch.setattr(training, "ROWS_HELD", 1000)
    lock, running, most = threading.Lock(), [0], [0]

    def work(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05)
        with lock:
            running[0] -= 1
        return i

    for rows, limit in ((0, 8), (400, 2), (5000, 1)):
        most[0] = 0
        assert training.at_once(spark.range(1), work, list(range(10)), rows) == list(range(10))
        assert most[0] <= limit


def test_rows_of_a_fit_stay_where_they_lie(spark):
    from terrace.operators import training

    df = spark.range(0, 300_000, 1, 6)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(training._dealt(df, 300_000)) and training._dealt(df, 10).rdd.getNumPartitions() == 1
    assert training._dealt(df.coalesce(1), 300_000).rdd.getNumPartitions() > 1


def test_fixtures_of_a_day_share_their_pairs_history(spark):
    """Before, every fixture took ten rows of its own, and the latest rows came from a sort of all."""
    day = datetime.date(2020, 1, 1)
    played = [(i, day if i % 3 else None, *((1, 2) if i % 2 else (2, 1)), i % 4, i % 3) for i in range(40)]
    matches = spark.createDataFrame(played, "match_id long, match_date date, home_team int, away_team int, goals_home int, goals_away int")
    fixtures = spark.range(5000).selectExpr("id AS match_id", "DATE'2021-01-01' AS match_date", "2 AS home_team", "1 AS away_team")
    assert upcoming._histories(fixtures, matches, 10).count() == 1
    got = upcoming.pair_history(fixtures, matches).agg(*[f(c) for c in ("h2h_matches", "h2h_home_goals_avg") for f in (F.min, F.max)]).first()
    last = [p for p in played if p[1]][-10:]
    assert got[:2] == (10, 10) and got[2] == got[3] == pytest.approx(np.mean([x if h == 2 else y for _, _, h, _, x, y in last]))


def test_latest_rows_by_venue(spark):
    dice = random.Random(8)
    rows = [(dice.choice([1, 2, 3]), i % 2, dice.choice([2019, 2020, None]), dice.choice([None, *[datetime.date(2020, 1, d) for d in (1, 2, 3)]]), i, dice.choice([None, float(i)])) for i in range(60)]
    rows += [(4, 1, 2019, datetime.date(2019, 1, 1), 100, 1.0), (5, 1, 2020, None, 101, 2.0)]
    sides = spark.createDataFrame(rows, "team int, is_home int, season int, match_date date, match_id long, x double")
    found = upcoming.latest_by_venue(sides, ["x"])
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.team: (r.home.x, r.away.x) for r in found.collect()}
    latest = lambda some: max(some, key=lambda r: (r[3] is not None, r[3] or datetime.date.min, r[4]))[5] if some else None
    assert set(got) == {1, 2, 3, 5}
    for team, values in got.items():
        own = [r for r in rows if r[0] == team]
        for at, value in zip((1, 0), values):
            there = [r for r in own if r[1] == at]
            x = latest([r for r in there if r[2] == 2020] or there)
            assert value == (latest(own) if x is None else x)
