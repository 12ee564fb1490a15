"""Recurrences, windows, names and streams against plain loops and hand-made cases."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.functions import metrics, text
from terrace.operators import goals, history, joins, ratings
from terrace.plans import registry, steps
from terrace.sources import contest as source
from terrace.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matches(spark):
    return source.contest(spark, SF).where("home_team < 8 and away_team < 8").withColumn("league", F.lit(1)).cache()


@pytest.fixture(scope="module")
def ordered(matches):
    return matches.toPandas().sort_values(["match_date", "match_id"])


def test_elo_against_a_loop(matches, ordered):
    got = ratings.rate(matches, ratings.Elo).toPandas().set_index("match_id")
    elo, season = {}, None
    for r in ordered.itertuples():
        if season is not None and r.season != season:
            elo = {t: 0.9 * v + 150.0 for t, v in elo.items()}
        season = r.season
        h, a = elo.get(r.home_team, 1500.0), elo.get(r.away_team, 1500.0)
        assert got.elo_home[r.match_id] == pytest.approx(h) and got.elo_away[r.match_id] == pytest.approx(a)
        s = 1.0 if r.goals_home > r.goals_away else 0.0 if r.goals_home < r.goals_away else 0.5
        d = 20 * (1 + 0.7 * math.log(1 + abs(r.goals_home - r.goals_away))) * (s - 1 / (1 + 10 ** (-(h - a + 65) / 400)))
        elo[r.home_team], elo[r.away_team] = h + d, a - d


def test_no_history_leaks_forward(matches, ordered):
    layers, names = history.rolling_form((3,))
    rows = lambda m: steps.columns(source.sides(m), *layers).select("match_id", "team", *names).toPandas().sort_values(["match_id", "team"])
    cut = ordered.match_date.iloc[len(ordered) // 2]
    before = rows(matches)
    changed = rows(matches.withColumn("goals_home", F.when(F.col("match_date") > F.lit(cut), 6).otherwise(F.col("goals_home"))))
    early = ordered[ordered.match_date <= cut].match_id
    pd.testing.assert_frame_equal(before[before.match_id.isin(early)], changed[changed.match_id.isin(early)])


def test_streak_against_a_loop(matches, ordered):
    layers, _ = history.runs()
    got = steps.columns(source.sides(matches), *layers).toPandas().set_index(["match_id", "team"])
    past: dict = {}
    for r in ordered.itertuples():
        for team, pts in ((r.home_team, r.home_points), (r.away_team, r.away_points)):
            h = past.setdefault(team, [])
            n = 0
            for p in reversed(h):
                if p != h[-1]:
                    break
                n += 1
            want = n if h and h[-1] == 3 else -n if h and h[-1] == 0 else 0
            assert got.streak[(r.match_id, team)] == want
        past[r.home_team].append(r.home_points)
        past[r.away_team].append(r.away_points)


def test_as_of_takes_one_snapshot_for_all_teams(spark):
    m = spark.sql("SELECT 1L AS match_id, DATE'2020-03-15' AS match_date, 1 AS home_team, 2 AS away_team")
    s = spark.sql("SELECT * FROM VALUES (DATE'2020-01-01', 1, 1400D), (DATE'2020-01-01', 2, 1500D), (DATE'2020-03-01', 1, 1450D), (DATE'2020-04-01', 2, 1600D) AS t(snapshot_date, team, elo)")
    r = joins.as_of_ratings(m, s).first()
    assert r.elo_pre_home == 1450 and r.elo_pre_away is None


def test_team_names(spark):
    known = {"Wolves": "Wolverhampton", "Brighton and Hove": "Brighton", "Leeds": "Leeds"}
    rows = spark.createDataFrame([(" Wolves FC ",), ("Brighton & Hove AFC",), ("Leeds",), ("Nobody FC",), (None,)], "n string")
    assert [r[0] for r in rows.select(text.normalised_team("n", known)).collect()] == ["Wolverhampton", "Brighton", "Leeds", "Nobody FC", None]


def test_token_sentiment_cases(spark):
    rows = spark.createDataFrame([("a very good win",), ("not win",), ("clean sheet again",), ("",), (None,)], "t string")
    got = [r[0].sentiment for r in rows.select(text.token_sentiment("t")).collect()]
    assert got == [1.0, -1.0, 1.0, 0.0, 0.0]


def test_embedded_json_and_titles(spark):
    rows = spark.createDataFrame([(r"x = JSON.parse('\x7B\x22a\x22\x3A5\x7D')", "<title>f</title><title>g</title><title>News <b>x</b></title>")], "s string, h string")
    r = rows.select(text.embedded_json("s", "a int").alias("j"), text.feed_titles("h").alias("t")).first()
    assert r.j.a == 5 and r.t == ["News x"]


def test_goal_grid_sums_to_one_and_fit_is_centred(spark, matches):
    fixtures = spark.sql("SELECT 1L AS match_id, 1.4D AS lambda_home, 1.1D AS lambda_away")
    cells = goals.score_grid(fixtures, -0.05).first().cells
    assert len(cells) == 64 and sum(c.p for c in cells) == pytest.approx(1)
    shown = goals.outcomes(fixtures, -0.05).first()
    assert len(shown.top_scorelines) == 12 and shown.p_home == pytest.approx(sum(c.p for c in cells if c.h > c.a)) and shown.over_2_5 == pytest.approx(sum(c.p for c in cells if c.h + c.a > 2))
    assert shown.top_scorelines[0] == max(cells, key=lambda c: c.p)[:2].__str__().strip("()").replace(", ", "-")
    model = goals.GoalModel.fit(matches)
    assert abs(model.attack.sum()) < 1e-6 and 0 <= model.home <= 1


def test_event_windows_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = live.event_counts(stream, "1 day").writeStream.format("memory").queryName("ev_stream").option("checkpointLocation", str(tmp_path / "ck")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("ev_stream").agg(F.sum("n")).first()[0] == events.count()


def test_simulation_draws_the_actual_outcome(spark):
    rows = lambda o: spark.createDataFrame([(0.9, 0.1, 0.0, o)] * 400 + [(0.9, 0.1, 0.0, None)], "p_home double, p_draw double, p_away double, outcome int")
    home, draw, away = (metrics.simulated_accuracy(rows(o)).first() for o in range(3))
    assert home.q50 == pytest.approx(0.9, abs=0.003) and draw.q50 == pytest.approx(0.1, abs=0.003) and tuple(away) == (0, 0, 0)
    assert draw.q05 == pytest.approx(0.1 - 1.645 * 0.015, abs=0.004) and draw.q95 == pytest.approx(0.1 + 1.645 * 0.015, abs=0.004)
    assert metrics.simulated_accuracy(rows(1)).first() == draw


def test_ratings_take_every_match_and_keep_leagues_apart(spark, matches):
    want = sorted(r[0] for r in source.contest(spark, SF).select("match_id").collect())
    assert sorted(r[0] for r in registry.QUERIES["r01_elo"](spark, SF).select("match_id").collect()) == want
    two = matches.unionByName(matches.withColumns({"league": F.lit(2), "match_id": -F.col("match_id")}))
    rows = {r.match_id: r.elo_home for r in ratings.rate(two, ratings.Elo).collect()}
    one = {r.match_id: r.elo_home for r in ratings.rate(matches, ratings.Elo).collect()}
    assert all(rows[k] == v for k, v in one.items()) and len(rows) == 2 * len(one)


def test_rows_without_a_partner(spark):
    from terrace.functions import players
    from terrace.operators import upcoming

    games = spark.createDataFrame([(1, 1, 2), (2, 2, 9), (3, None, 1)], "match_id int, home_team int, away_team int").withColumn("match_date", F.lit("2020-03-04").cast("date"))
    side = spark.createDataFrame([(1, 0.5), (1, 0.2), (7, 0.1)], "match_id int, xg double")
    got = {r.match_id: r.xg for r in joins.with_side_table(games, side, ["match_id"]).collect()}
    assert got == {1: 0.2, 2: None, 3: None}
    assert {r.xg for r in joins.with_side_table(games, side, ["match_id"], {"xg": 0.0}).collect()} == {0.2, 0.0}

    base = spark.createDataFrame([(1, 3.0, None), (2, 4.0, 9.0), (3, 5.0, 8.0)], "match_id int, shots_home double, temperature double")
    live = spark.createDataFrame([(1, 7.0, 1.0), (2, None, 2.0)], "match_id int, shots_home double, temperature double")
    rows = joins.override(base, live, "match_id", ["shots_home", "temperature"], ("shots",)).orderBy("match_id").collect()
    assert [(r.shots_home, r.temperature) for r in rows] == [(7.0, 1.0), (4.0, 9.0), (5.0, 8.0)]

    news = spark.createDataFrame([(1, 0.5), (2, -0.25)], "team int, sentiment double")
    rows = players.match_sentiment(games, news, ["sentiment"], ["sentiment"]).orderBy("match_id").collect()
    assert [(r.live_sentiment_home, r.live_sentiment_away, r.live_sentiment_diff) for r in rows] == [(0.5, -0.25, 0.75), (-0.25, 0.0, -0.25), (0.0, 0.5, -0.5)]

    params = spark.createDataFrame([(1, 0.4, 0.2), (2, 0.0, -0.2)], "team int, attack double, defence double")
    rows = {r.match_id: r for r in goals.rates(games, params, 0.25, 0.1).collect()}
    assert rows[2].lambda_away == pytest.approx(math.exp(0.1 + 0.2 + 0.2)) and rows[2].lambda_home == pytest.approx(math.exp(0.1 + 0.0 - 0.0 + 0.25))

    played = spark.createDataFrame([(1, 1, 2019, 5, 2.0), (2, 0, 2018, 4, 1.0)], "team int, is_home int, season int, match_id int, gf double").withColumn("match_date", F.lit("2019-10-01").cast("date"))
    rows = upcoming.prepare(games, played, ["gf"], spark.createDataFrame([(2, 3.0)], "team int, gf double")).orderBy("match_id").collect()
    assert [(r.gf_home, r.gf_away) for r in rows] == [(2.0, 3.0), (3.0, None), (None, 2.0)]


def test_unknown_chances_stay_unknown(spark):
    """least() and greatest() skip nulls; a clipped null must not become a bound."""
    from terrace.functions import columns
    from terrace.operators import decisions, training

    row = spark.sql("SELECT CAST(NULL AS DOUBLE) AS p_home, 0.3D AS p_draw, 0.5D AS p_away, CAST(NULL AS DOUBLE) AS shin_prob_home, 0.2D AS shin_prob_draw, 0.5D AS shin_prob_away, 0D AS sentiment_home, 0D AS sentiment_away, 0D AS injury_home, 0D AS injury_away, 0D AS instability_home, 0D AS instability_away")
    mixed = steps.columns(row, *columns.blend()).first()
    assert mixed.blend_home is None and mixed.blend_draw is None
    assert steps.columns(row, *columns.live_adjustment()).first().live_home is None
    assert row.select(*[x.alias(n) for n, x in zip("hda", training.clipped([F.col("p_home"), F.col("p_draw"), F.col("p_away")]))]).first().h is None
    made = spark.sql("SELECT " + ", ".join(f"{'CAST(NULL AS DOUBLE)' if n == 'm1' else 0.3} AS {n}_{o}" for n in ("dc", "m1") for o in decisions.SIDES))
    blend = decisions.adaptive_blend("dc", ["m1"])
    assert all(steps.columns(made, *blend).first()[c] is None for c in blend[-1])
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS s, 1 AS n").select(text.amplified(F.col("s"), F.col("n"))[0].alias("a")).first().a is None
