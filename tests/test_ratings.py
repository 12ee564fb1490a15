"""R1-R3 against loops, by league, and as a stream over shuffled micro-batches."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.operators import ratings
from terrace.plans import registry
from terrace.sources import contest as source
from terrace.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matches(spark):
    return source.competitions(spark, SF).cache()


@pytest.fixture(scope="module")
def ordered(matches):
    return matches.toPandas().sort_values(["league", "match_date", "match_id"])


def test_every_match_has_a_league(matches, ordered):
    assert ordered.league.nunique() == 15 and ordered.match_id.is_unique
    for name in ("r01_elo", "r02_pi", "r03_glicko"):
        got = registry.QUERIES[name](matches.sparkSession, SF)
        assert sorted(r.match_id for r in got.select("match_id").collect()) == sorted(ordered.match_id)


def test_pi_against_a_loop(matches, ordered):
    got = ratings.rate(matches, ratings.Pi).toPandas().set_index("match_id")
    for _, rows in ordered.groupby("league"):
        ha, hd, aa, ad = {}, {}, {}, {}
        for r in rows.itertuples():
            h, a = r.home_team, r.away_team
            x = [ha.get(h, 1.0), hd.get(h, 1.0), aa.get(a, 1.0), ad.get(a, 1.0)]
            own = got.loc[r.match_id]
            assert [own.pi_home_attack, own.pi_home_defense, own.pi_away_attack, own.pi_away_defense] == pytest.approx(x)
            assert own.pi_rating_home == pytest.approx(x[0] - x[3]) and own.pi_rating_away == pytest.approx(x[2] - x[1]) and own.pi_diff == pytest.approx(x[0] - x[3] - x[2] + x[1])
            eh, ea = max(0.1, 1.36 * math.exp(x[0] - x[3])), max(0.1, 1.36 * math.exp(x[2] - x[1]))
            dh, da = (r.goals_home - eh) / max(eh, 0.5), (r.goals_away - ea) / max(ea, 0.5)
            ha[h], hd[h] = x[0] + 0.05 * dh, x[1] - 0.05 * 0.6 * da
            aa[a], ad[a] = x[2] + 0.05 * da, x[3] - 0.05 * 0.6 * dh


def glicko_update(mu, rd, vol, other_mu, other_rd, score):
    """One rating period of one game, the volatility by twenty Newton steps on ln(vol^2)."""
    s, tau = 173.7178, 0.5
    g = 1 / math.sqrt(1 + 3 * (other_rd / s) ** 2 / math.pi**2)
    e = 1 / (1 + math.exp(-g * (mu - other_mu) / s))
    info = g**2 * e * (1 - e)
    v = 1 / max(info, 1e-6)
    delta, phi = v * g * (score - e), rd / s
    x, new = math.log(vol**2), vol
    for _ in range(20):
        ex = math.exp(x)
        d = phi**2 + v + ex
        f1 = -1 / tau**2 - ex * (phi**2 + v) / (2 * d**2)
        if abs(f1) < 1e-10:
            break
        f = -(x - math.log(new**2)) / tau**2 + ex * (delta**2 - d**2) / (2 * d**2) / d * d / d
        x -= f / f1
        new = math.exp(x / 2)
    new = min(max(new, 0.01), 0.2)
    rd2 = 1 / math.sqrt(1 / (rd**2 + new**2) + info)
    return mu + rd2 * g * (score - e) * s, min(rd2, 200.0), new


def test_glicko_against_a_loop(matches, ordered):
    got = ratings.rate(matches, ratings.Glicko).toPandas().set_index("match_id")
    for _, rows in ordered.groupby("league"):
        state, season = {}, None
        for r in rows.itertuples():
            if season is not None and r.season != season:
                state = {t: (m, min(200.0, math.sqrt(rd**2 + 100 * v**2)), v) for t, (m, rd, v) in state.items()}
            season = r.season
            h, a = state.get(r.home_team, (1500.0, 200.0, 0.06)), state.get(r.away_team, (1500.0, 200.0, 0.06))
            own = got.loc[r.match_id]
            assert [own.glicko_mu_home, own.glicko_rd_home, own.glicko_vol_home, own.glicko_mu_away, own.glicko_rd_away, own.glicko_vol_away] == pytest.approx([*h, *a], rel=1e-9)
            assert own.glicko_confidence_diff == pytest.approx(h[0] / max(h[1], 10) - a[0] / max(a[1], 10))
            score = 1.0 if r.goals_home > r.goals_away else 0.0 if r.goals_home < r.goals_away else 0.5
            state[r.home_team] = glicko_update(*h, a[0], a[1], score)
            state[r.away_team] = glicko_update(*a, *state[r.home_team][:2], 1 - score)


def test_leagues_are_apart_and_parallel(matches):
    tasks = ratings.rate(matches, ratings.Elo).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 12  # of 15 leagues; some meet in one task by their hash
    alone = ratings.rate(matches.where("league = 1002"), ratings.Elo).toPandas().set_index("match_id").sort_index()
    both = ratings.rate(matches, ratings.Elo).toPandas().set_index("match_id").sort_index()
    pd.testing.assert_frame_equal(both.loc[alone.index], alone)


@pytest.mark.parametrize("system", [ratings.Elo, ratings.Pi, ratings.Glicko])
def test_stream_equals_batch(spark, matches, tmp_path, system):
    """Rows come up to a year late; a last match far ahead lets the watermark pass all others."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    try:
        cols = ["league", "match_date", *ratings._IN]
        some = matches.where("league in (1, 1002)").select(*cols)
        rows = sorted(some.collect(), key=lambda r: (r.match_date, r.match_id))
        dice = random.Random(1)
        first = rows[0].match_date
        batch = [(max(0, (r.match_date - first).days + dice.randrange(-180, 180)) // 700, r) for r in rows]
        for b in sorted({b for b, _ in batch}):
            own = [tuple(r) for k, r in batch if k == b]
            dice.shuffle(own)
            spark.createDataFrame(own, some.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        last = [(k, first.replace(year=2100), -k, 2100, -1, -2, 0, 0) for k in (1, 1002)]
        spark.createDataFrame(last, some.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(some.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"stream_{system.__name__.lower()}"
        q = live.stream_ratings(stream, system, late="365 days").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        got = spark.table(name).toPandas().set_index("match_id").sort_index()
        want = ratings.rate(some, system).toPandas().set_index("match_id").sort_index()
        pd.testing.assert_frame_equal(got, want)
        teams = spark.read.format("statestore").option("stateVarName", "teams").load(str(tmp_path / "ck"))
        assert teams.count() <= sum(len({t for r in rows if r.league == k for t in (r.home_team, r.away_team)}) for k in (1, 1002))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
