"""Features of matches still to be played, from what is known of both teams.

sides has two rows a played match (team, is_home, season, match_date, match_id and features);
the last day of each team is found first, then the latest rows among those of that day, so nothing
grows with a team's history. Of a pair's meetings at most ten go with a fixture, found by their
number; fixtures of a pair on one day share them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import players
from terrace.operators.meetings import DEFAULTS

#: An average team's goals a match, and the part of a team's own in an estimate.
MEAN_GOALS, OWN_GOALS = 1.35, 0.85
#: What live values replace whatever earlier seasons say; others only fill gaps.
ALWAYS = (
    "ppg_", "goals_scored_", "goals_conceded_", "clean_sheets_", "btts_pct_", "over25_pct_", "win_pct_", "draw_pct_", "loss_pct_",
    "table_", "streak_", "volatility_", "goal_trend_", "defense_trend_", "unbeaten_", "winless_", "weighted_streak_", "points_velocity_",
    "home_form_", "away_form_", "early_goals_", "comeback_", "first_goal_", "bottom3_", "top6_", "home_in_top4", "away_in_top4",
    "position_gap", "relegation_battle", "promotion_zone_match",
)
#: What a promoted team gets where nothing is known of it, at home and away.
BASELINES = {
    "elo": (1460, 1460), "elo_momentum": (0, 0), "pi_rating": (-0.3, -0.3), "pi_attack": (0.9, 0.85), "pi_defense": (-0.2, -0.25),
    "glicko_mu": (1550, 1550), "glicko_rd": (60, 60), "glicko_confidence": (0.7, 0.7),
    "xg_for_l5": (1.1, 1.0), "xg_for_l10": (1.1, 1.0), "xg_for_l20": (1.1, 1.0), "xg_against_l5": (1.5, 1.6), "xg_against_l10": (1.4, 1.5), "xg_against_l20": (1.4, 1.5),
    "xg_overperformance_l5": (0, 0), "xg_overperformance_l10": (0, 0), "attack_vs_defense": (0.8, 0.7), "attack_def_mismatch": (0, 0), "form_elo_divergence": (0, 0),
    "defensive_solidity": (0.4, 0.35), "upset_tendency": (0.3, 0.3),
}
#: Estimates agree with goals, so nothing is over or under them.
NO_SURPLUS = "xg_overperformance"
MEETINGS = 10
#: What the history of a fixture depends on.
_FIXTURE = ("home_team", "away_team", "match_date")


def replaces(column: str) -> bool:
    """Whether a live value of the column goes before a known one."""
    return f"{column}_".startswith(ALWAYS)


def latest_by_venue(sides: DataFrame, columns: list[str]) -> DataFrame:
    """(team, home, away): for each venue the team's last match there in the current season,
    else there at all; values it lacks come from its last match anywhere. Teams without a match
    in the current season (promoted ones) have no row: older values would mislead."""
    last = F.broadcast(sides.agg(F.max("season").alias("_now")))  # one row
    when, row, now = F.struct("match_date", "match_id"), F.struct(*columns), F.col("season") == F.col("_now")
    pick = lambda on: F.max_by(row, F.when(on, when))
    # Rows of a team's last days alone are compared: a struct's latest takes a sort of all it sees.
    all_ = sides.crossJoin(last).withColumn("_is_now", now)
    days = all_.groupBy("team", "is_home", "_is_now").agg(F.max("match_date").alias("_day"))
    ends = days.select(*[F.col(c).alias(f"_of_{c}") for c in days.columns])
    sides = all_.join(ends, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("team", "is_home", "_is_now")] + [F.col("match_date").eqNullSafe(F.col("_of__day"))]), "left_semi")
    rows = {"_any": pick(F.lit(True)), **{f"_{n}{k}": pick((F.col("is_home") == at) & on) for n, at in (("home", 1), ("away", 0)) for k, on in (("_now", now), ("", F.lit(True)))}}
    per = sides.groupBy("team").agg(F.max(now).alias("_plays"), *[x.alias(n) for n, x in rows.items()]).where("_plays")
    at = lambda n: F.struct(*[F.coalesce(F.when(F.col(f"_{n}_now").isNotNull(), F.col(f"_{n}_now.{c}")).otherwise(F.col(f"_{n}.{c}")), F.col(f"_any.{c}")).alias(c) for c in columns])
    return per.select("team", at("home").alias("home"), at("away").alias("away"))


def prepare(fixtures: DataFrame, sides: DataFrame, columns: list[str], live: DataFrame | None = None, estimated: dict[str, str] | None = None, stale: list[str] = (), promoted: DataFrame | None = None, meetings: DataFrame | None = None, news: tuple[DataFrame, list[str], list[str]] | None = None) -> DataFrame:
    """fixtures (match_id, match_date, home_team, away_team) with c_home, c_away and c_diff for
    each column, P26's calendar, and the stale columns as null. live (team and some of columns)
    goes before them where ``replaces`` says so or they have none; estimated names columns (x: y)
    whose value is drawn from y towards the mean, and what is over expectation is then 0 (P27).
    promoted (team) get ``BASELINES`` where a column is still null. meetings, the matches
    played, add the pair's history before the fixture's day, and news (rows by team, columns,
    those with a difference) the live_ sentiment of both teams."""
    known = latest_by_venue(sides, columns)
    out = fixtures if meetings is None else _with_history(fixtures, meetings)
    for side, k in (("home", 0), ("away", 1)):
        look = known.select(F.col("team").alias(f"{side}_team"), *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in columns])
        out = out.join(look, f"{side}_team", "left")
        if live is not None:
            fresh = [c for c in columns if c in live.columns]
            out = out.join(live.select(F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"_{c}") for c in fresh]), f"{side}_team", "left")
            order = lambda c, s=side: (f"_{c}", f"{c}_{s}") if replaces(c) else (f"{c}_{s}", f"_{c}")
            out = out.withColumns({f"{c}_{side}": F.coalesce(*order(c)) for c in fresh}).drop(*[f"_{c}" for c in fresh])
        for name, of in (estimated or {}).items():
            out = out.withColumn(f"{name}_{side}", F.coalesce(OWN_GOALS * F.col(f"{of}_{side}") + (1 - OWN_GOALS) * MEAN_GOALS, F.col(f"{name}_{side}") if name in columns else F.lit(None).cast("double")))
        if estimated and (over := [c for c in columns if c.startswith(NO_SURPLUS)]):
            out = out.withColumns({f"{c}_{side}": F.lit(0.0) for c in over})
        if promoted is not None:
            new = promoted.select(F.col("team").alias(f"{side}_team"), F.lit(True).alias("_new")).distinct()
            bases = {f"{c}_{side}": v[k] for c, v in BASELINES.items() if c in columns or c in (estimated or {})}
            out = out.join(new, f"{side}_team", "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.when(F.col("_new"), F.lit(float(v)))) for c, v in bases.items()}).drop("_new")
    names = [*columns, *[n for n in (estimated or {}) if n not in columns]]
    out = calendar(out.withColumns({f"{c}_diff": F.col(f"{c}_home") - F.col(f"{c}_away") for c in names}))
    if news is not None:
        out = players.match_sentiment(out, *news)
    return out.withColumns({c: F.lit(None).cast("double") for c in stale}) if stale else out


def pair_history(fixtures: DataFrame, matches: DataFrame, most: int = MEETINGS) -> DataFrame:
    """match_id and the h2h_ columns of each fixture from its pair's last meetings, in the order
    of their days, before the fixture's own; the usual values where they never met."""
    return _with_history(fixtures, matches, most).select("match_id", *DEFAULTS)


def _with_history(fixtures: DataFrame, matches: DataFrame, most: int = MEETINGS) -> DataFrame:
    """fixtures with the h2h_ columns, joined by both teams and the day."""
    found = _histories(fixtures, matches, most).select(*[F.col(c).alias(f"_{c}") for c in _FIXTURE], *DEFAULTS)
    joined = fixtures.join(found, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _FIXTURE]), "left")
    return joined.select(*fixtures.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])


def _histories(fixtures: DataFrame, matches: DataFrame, most: int) -> DataFrame:
    """The h2h_ columns for each (home_team, away_team, match_date) of fixtures whose pair met before.
    Meetings are numbered along the pair: days are counted and summed first, so that meetings of
    one day are the largest sort. Only those of days that are asked for get their number, and a
    fixture asks for at most ``most`` numbers, whatever the pair has."""
    pair = {"lo": F.least("home_team", "away_team"), "hi": F.greatest("home_team", "away_team")}
    along, games = Window.partitionBy("lo", "hi"), matches.withColumns(pair).withColumn("day", F.col("match_date"))
    days = games.groupBy("lo", "hi", "day").agg(F.count("*").alias("_n")).withColumn("n", F.sum("_n").over(along.orderBy("day")))
    asked = fixtures.select(*_FIXTURE).distinct().withColumns(pair).withColumn("day", F.col("match_date"))
    # A day's fixtures come before its meetings, so the last number seen is that of an earlier day.
    both = asked.withColumns({"n": F.lit(None).cast("long"), "_asks": F.lit(True)}).unionByName(days.drop("_n"), allowMissingColumns=True)
    seen = F.last("n", ignorenulls=True).over(along.orderBy(F.col("day").asc_nulls_last(), F.col("n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = both.withColumn("n", seen).where("_asks and n is not null").select(*_FIXTURE, "lo", "hi", "n")
    ends = at.select("lo", "hi", "n").distinct().withColumn("_end", F.lit(True))
    after = F.min(F.when(F.col("_end"), F.col("n"))).over(along.orderBy("n").rowsBetween(0, Window.unboundedFollowing))
    needed = days.join(ends, ["lo", "hi", "n"], "left").withColumn("_after", after).where(F.col("_after") - F.col("n") < most)
    of = needed.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("day").alias("_of"), (F.col("n") - F.col("_n")).alias("_ahead"))
    there = games.join(of, (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & F.col("day").eqNullSafe(F.col("_of")))
    number = F.col("_ahead") + F.row_number().over(Window.partitionBy("lo", "hi", "day").orderBy("match_id"))
    played = there.select("lo", "hi", number.alias("k"), F.col("home_team").alias("host"), "goals_home", "goals_away")
    view = ["home_team", "away_team", "lo", "hi", "n"]
    wanted = at.select(*view).distinct().withColumn("k", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - most + 1), F.col("n"))))
    met = wanted.join(played, ["lo", "hi", "k"])
    at_home = F.col("host") == F.col("home_team")
    own, other = F.when(at_home, F.col("goals_home")).otherwise(F.col("goals_away")), F.when(at_home, F.col("goals_away")).otherwise(F.col("goals_home"))
    rows = met.select(*view, "k", at_home.alias("at_home"), own.alias("own"), other.alias("other"))
    share = lambda condition, of="true": F.expr(f"avg(CASE WHEN k IS NOT NULL AND {of} THEN CASE WHEN {condition} THEN 1D ELSE 0D END END)")
    found = rows.groupBy(*view).agg(
        F.count("k").alias("h2h_matches"), share("own > other").alias("h2h_home_win_pct"), share("own = other").alias("h2h_draw_pct"), F.avg(F.col("own") + F.col("other")).alias("h2h_avg_goals"),
        F.stddev_pop(F.col("own") + F.col("other")).alias("h2h_goals_volatility"), share("own > 0 AND other > 0").alias("h2h_btts_rate"), share("own + other > 2").alias("h2h_over25_rate"),
        F.avg("own").alias("h2h_home_goals_avg"), F.avg("other").alias("h2h_away_goals_avg"), share("own > other", "at_home").alias("h2h_venue_dominance"),
        share("own > other", "k > n - 3").alias("_last"), share("other = 0").alias("h2h_clean_sheet_pct"),
    )
    more = {"h2h_away_win_pct": 1 - F.col("h2h_home_win_pct") - F.col("h2h_draw_pct"), "h2h_recent_shift": F.when(F.col("h2h_matches") >= 4, F.col("_last") - F.col("h2h_home_win_pct")).otherwise(0.0), "h2h_xg_dominance": F.lit(0.0), "h2h_home_scoring_trend": F.lit(0.0)}
    full = found.withColumns(more).select(*[F.col(c).alias(f"_{c}") for c in view], *DEFAULTS)
    return at.join(full, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in view])).select(*_FIXTURE, *DEFAULTS)


def calendar(fixtures: DataFrame) -> DataFrame:
    """What the day of a match alone tells of season and weather."""
    month, weekday = F.month("match_date"), F.weekday("match_date")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return fixtures.withColumns({
        "month_no": month, "day_of_week": weekday, "is_midweek": flag(weekday.isin(1, 2, 3)), "is_early_season": flag(month.isin(8, 9)), "is_run_in": flag(month.isin(4, 5)),
        "is_cold": flag(month.isin(11, 12, 1, 2)), "season_progress": F.when(month.isNotNull(), F.least(F.pmod(month - 8, F.lit(12)) / 10.0, F.lit(1.0))),
    })
