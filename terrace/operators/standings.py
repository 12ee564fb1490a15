"""League tables as of each match, and gameweeks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.blocks import numbered

_KEY = ["match_date", "match_id"]
#: Matches of a block of days, and those whose tables a task holds at once.
ROWS, SLICE = 50_000, 4096


def season_teams(matches: DataFrame) -> DataFrame:
    """(season, team, first_date, first_id, n_teams): who plays, from when."""
    seen = matches.select("season", *_KEY, F.explode(F.array("home_team", "away_team")).alias("team"))
    first = seen.groupBy("season", "team").agg(F.min(F.struct(*_KEY)).alias("f"))
    return first.select("season", "team", F.col("f.match_date").alias("first_date"), F.col("f.match_id").alias("first_id"), F.count("*").over(Window.partitionBy("season")).alias("n_teams"))


def table_before(matches: DataFrame, rows: int = ROWS) -> DataFrame:
    """Both teams' place, points and goal difference before each match of a season, among
    the teams seen so far; ties by points, difference, goals, then team.

    A season is cut into blocks of days. What each team has at a block's start comes from sums of
    its earlier blocks: a row a block and team. Within a block the running sums of all teams are
    arrays, so matches are never multiplied by teams outside a task's slices of ``SLICE``."""
    m = numbered(matches.where("season IS NOT NULL").select("season", *_KEY, "home_team", "away_team", "goals_home", "goals_away", "home_points", "away_points"), rows)
    sides = m.select("season", "block", F.explode(F.array(*[F.struct(F.col(f"{s}_team").alias("team"), F.col(f"{s}_points").alias("p"), (F.col(f"goals_{s}") - F.col(f"goals_{o}")).alias("d"), F.col(f"goals_{s}").alias("f")) for s, o in (("home", "away"), ("away", "home"))])).alias("x"))
    per = sides.groupBy("season", "block", "x.team").agg(*[F.sum(f"x.{c}").alias(c) for c in "pdf"])
    blocks = per.select("season", "block").distinct()
    teams = per.groupBy("season", "team").agg(F.min("block").alias("since"))
    before = Window.partitionBy("season", "team").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = blocks.join(teams, "season").join(per, ["season", "block", "team"], "left")
    starts = every.select("season", "block", "team", (F.col("since") < F.col("block")).alias("seen"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(c) for c in "pdf"])
    state = starts.groupBy(F.col("season").alias("at_season"), F.col("block").alias("at_block")).agg(F.array_sort(F.collect_list(F.struct("team", "seen", "p", "d", "f"))).alias("state"))  # a season's teams
    out = f"match_id {matches.schema['match_id'].dataType.simpleString()}, n_teams long, " + ", ".join(f"table_{c}_{s} long" for c in ("pos", "pts", "gd") for s in ("home", "away"))
    left = m.withColumns({c: F.col(c).cast("long") for c in ("home_points", "away_points", "goals_home", "goals_away")})
    return left.groupBy("season", "block").cogroup(state.groupBy("at_season", "at_block")).applyInArrow(_block_table, out)


def _block_table(games, state):
    """The table before each match of a block, from what its teams have at its start."""
    games = games.sort_by([(c, "ascending") for c in _KEY])
    start = state.column("state")[0].values
    team, seen, p, d, f = (start.field(c).to_numpy(zero_copy_only=False) for c in ("team", "seen", "p", "d", "f"))
    now, known = np.stack([p, d, f]), seen.astype(bool)
    home, away = (np.searchsorted(team, games.column(f"{s}_team").to_numpy()) for s in ("home", "away"))
    hp, ap, hf, af = (games.column(c).to_numpy() for c in ("home_points", "away_points", "goals_home", "goals_away"))
    parts = []
    for at in range(0, games.num_rows, SLICE):
        h, a = home[at : at + SLICE], away[at : at + SLICE]
        n = len(h)
        row = np.arange(n)
        gain, here = np.zeros((3, n + 1, len(team)), np.int64), np.zeros((n, len(team)), bool)
        for k, (x, y) in enumerate(((hp, ap), (hf - af, af - hf), (hf, af))):
            gain[k, row + 1, h] = x[at : at + SLICE]
            gain[k, row + 1, a] = y[at : at + SLICE]
        gain[:, 0] = now
        run = gain.cumsum(axis=1)
        now, run = run[:, -1], run[:, :-1]
        here[row, h] = here[row, a] = True
        here[0] |= known
        here = np.logical_or.accumulate(here, axis=0)
        known = here[-1]
        own = []
        for t in (h, a):
            pts, gd, goals = (r[row, t][:, None] for r in run)
            level = run[0] == pts
            even = level & (run[1] == gd)
            ahead = (run[0] > pts) | (level & (run[1] > gd)) | (even & (run[2] > goals)) | (even & (run[2] == goals) & (np.arange(len(team)) < t[:, None]))
            own.append(((ahead & here).sum(axis=1) + 1, pts[:, 0], gd[:, 0]))
        parts.append([own[s][c] for c in range(3) for s in (0, 1)])
    cells = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)]
    return pa.table([games.column("match_id"), pa.array(np.full(games.num_rows, len(team), np.int64)), *cells], names=["match_id", "n_teams", *[f"table_{c}_{s}" for c in ("pos", "pts", "gd") for s in ("home", "away")]])


#: Flags over the table: W6's own and P14's.
TABLE_FLAGS = {
    "table_pos_diff": "table_pos_away - table_pos_home", "table_pts_diff": "table_pts_home - table_pts_away",
    "home_in_top4": "CASE WHEN table_pos_home <= 4 THEN 1 ELSE 0 END", "away_in_top4": "CASE WHEN table_pos_away <= 4 THEN 1 ELSE 0 END",
    "home_in_relegation": "CASE WHEN table_pos_home >= 18 THEN 1 ELSE 0 END", "away_in_relegation": "CASE WHEN table_pos_away >= 18 THEN 1 ELSE 0 END",
    "position_gap": "abs(table_pos_home - table_pos_away)", "top6_home": "CASE WHEN table_pos_home <= 6 THEN 1 ELSE 0 END", "top6_away": "CASE WHEN table_pos_away <= 6 THEN 1 ELSE 0 END",
    "bottom3_home": "CASE WHEN table_pos_home >= n_teams - 2 THEN 1 ELSE 0 END", "bottom3_away": "CASE WHEN table_pos_away >= n_teams - 2 THEN 1 ELSE 0 END",
    "promotion_zone_match": "CASE WHEN table_pos_home <= 6 AND table_pos_away <= 6 THEN 1 ELSE 0 END",
    "relegation_battle": "CASE WHEN table_pos_home >= n_teams - 5 AND table_pos_away >= n_teams - 5 THEN 1 ELSE 0 END",
}


def table_sql(contest_sql: str) -> str:
    run = lambda c: f"coalesce(sum({c}) OVER b, 0)"
    gain = lambda a, b: f"CASE WHEN team = home_team THEN {a} WHEN team = away_team THEN {b} ELSE 0 END"
    picks = ", ".join(f"CAST(max(CASE WHEN team = {s}_team THEN {c} END) AS BIGINT) AS table_{c}_{s}" for c in ("pos", "pts", "gd") for s in ("home", "away"))
    return f"""WITH c AS ({contest_sql}), seen AS (SELECT season, match_date, match_id, unnest([home_team, away_team]) AS team FROM c),
    st AS (SELECT season, team, min((match_date, match_id)) AS f, count(*) OVER (PARTITION BY season) AS n_teams FROM seen GROUP BY season, team),
    g AS (SELECT c.*, team, n_teams, {gain('home_points', 'away_points')} AS p, {gain('goals_home', 'goals_away')} AS gf, {gain('goals_away', 'goals_home')} AS ga
          FROM c JOIN st ON c.season = st.season AND f <= (match_date, match_id)),
    s AS (SELECT match_id, team, home_team, away_team, n_teams, {run('p')} AS pts, {run('gf')} - {run('ga')} AS gd, {run('gf')} AS goals FROM g
          WINDOW b AS (PARTITION BY season, team ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pts DESC, gd DESC, goals DESC, team) AS pos FROM s)
    SELECT match_id, CAST(max(n_teams) AS BIGINT) AS n_teams, {picks} FROM r WHERE team IN (home_team, away_team) GROUP BY match_id"""


def gameweeks(matches: DataFrame) -> DataFrame:
    """A week ends where the next distinct date is more than 3 days on, capped at
    38; date_rank numbers a season's dates. Only distinct dates are ordered."""
    dates = matches.select("season", "match_date", "dn").distinct()
    by = Window.partitionBy("season").orderBy("dn")
    new = F.when(F.col("dn") - F.lag("dn").over(by) > 3, 1).otherwise(0)
    weeks = dates.withColumn("new", new).select(
        "season", "match_date", F.least(F.sum("new").over(by) + 1, F.lit(38)).cast("long").alias("gameweek"), F.dense_rank().over(by).cast("long").alias("date_rank")
    )
    return matches.join(weeks, ["season", "match_date"]).select("match_id", "gameweek", "date_rank", (F.col("gameweek") / 38).alias("season_progress"))


def gameweeks_sql(contest_sql: str) -> str:
    return f"""WITH c AS ({contest_sql}), d AS (SELECT DISTINCT season, match_date, dn FROM c),
    n AS (SELECT *, CASE WHEN dn - lag(dn) OVER w > 3 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY season ORDER BY dn)),
    g AS (SELECT season, match_date, CAST(least(sum(new) OVER w + 1, 38) AS BIGINT) AS gameweek, dense_rank() OVER w AS date_rank FROM n WINDOW w AS (PARTITION BY season ORDER BY dn))
    SELECT match_id, gameweek, date_rank, gameweek / 38 AS season_progress FROM c JOIN g USING (season, match_date)"""
