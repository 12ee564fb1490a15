"""Head-to-head history of a pair, in the order that prefers reversed venues.

The last ten meetings of each orientation are kept as one short array a row, and carried
along the pair's matches as the latest value of either orientation; nothing grows with the
number of meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrace.plans import steps

NAMES = [
    "h2h_home_win_pct", "h2h_draw_pct", "h2h_away_win_pct", "h2h_avg_goals", "h2h_matches", "h2h_venue_dominance", "h2h_goals_volatility", "h2h_btts_rate",
    "h2h_over25_rate", "h2h_home_goals_avg", "h2h_away_goals_avg", "h2h_recent_shift", "h2h_xg_dominance", "h2h_home_scoring_trend", "h2h_clean_sheet_pct",
]
#: What a pair without a meeting gets.
DEFAULTS = {
    "h2h_home_win_pct": 0.45, "h2h_draw_pct": 0.27, "h2h_away_win_pct": 0.28, "h2h_avg_goals": 2.7, "h2h_matches": 0, "h2h_venue_dominance": 0.45,
    "h2h_goals_volatility": 0, "h2h_btts_rate": 0.5, "h2h_over25_rate": 0.5, "h2h_home_goals_avg": 1.5, "h2h_away_goals_avg": 1.2, "h2h_recent_shift": 0,
    "h2h_xg_dominance": 0, "h2h_home_scoring_trend": 0, "h2h_clean_sheet_pct": 0.3,
}
_PAIR = "PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY match_date, match_id"


def _mean(of: str, rows: str = "m") -> str:
    return f"(aggregate({rows}, 0D, (s, x) -> s + {of}) / nullif(size({rows}), 0))"


def _when(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1D ELSE 0D END"


def head_to_head(matches: DataFrame) -> DataFrame:
    """match_id and the features of ``NAMES``."""
    own = "collect_list(struct(goals_home AS g1, goals_away AS g2, xg_home AS x1, xg_away AS x2)) OVER (PARTITION BY home_team, away_team ORDER BY match_date, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    carried = lambda side: f"last(CASE WHEN {side} THEN met END, true) OVER ({_PAIR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    up, down = "home_team < away_team", "home_team > away_team"
    turn = lambda rows, home, swap: f"transform(coalesce({rows}, array()), x -> struct({'x.g2' if swap else 'x.g1'} AS g1, {'x.g1' if swap else 'x.g2'} AS g2, {home} AS at_home, {'x.x2 - x.x1' if swap else 'x.x1 - x.x2'} AS dx))"
    layers = [
        {"met": own},
        {"up_met": carried(up), "down_met": carried(down)},
        {"same": f"CASE WHEN {up} THEN up_met ELSE down_met END", "other": f"CASE WHEN {up} THEN down_met ELSE up_met END"},
        {"every": f"concat({turn('same', 'true', False)}, {turn('other', 'false', True)})"},
        {"m": "slice(every, greatest(size(every) - 9, 1), 10)"},
        {"n": "size(m)", "at_home": "filter(m, x -> x.at_home)", "known_x": "filter(m, x -> x.dx IS NOT NULL)", "head": "slice(m, 1, greatest(CAST(floor(size(m) / 2) AS INT), 0))",
         "tail": "slice(m, CAST(floor(size(m) / 2) AS INT) + 1, 10)", "last3": "slice(m, greatest(size(m) - 2, 1), 3)", "hw": _mean(_when("x.g1 > x.g2")), "dr": _mean(_when("x.g1 = x.g2")), "goals": _mean("(x.g1 + x.g2)")},
        {
            "h2h_home_win_pct": "hw", "h2h_draw_pct": "dr", "h2h_away_win_pct": "1 - hw - dr", "h2h_avg_goals": "goals", "h2h_matches": "n",
            "h2h_venue_dominance": _mean(_when("x.g1 > x.g2"), "at_home"),
            "h2h_goals_volatility": f"CASE WHEN n > 0 THEN sqrt({_mean('pow(x.g1 + x.g2 - goals, 2)')}) END",
            "h2h_btts_rate": _mean(_when("x.g1 > 0 AND x.g2 > 0")), "h2h_over25_rate": _mean(_when("x.g1 + x.g2 > 2")), "h2h_home_goals_avg": _mean("x.g1"), "h2h_away_goals_avg": _mean("x.g2"),
            "h2h_recent_shift": f"CASE WHEN n >= 4 THEN {_mean(_when('x.g1 > x.g2'), 'last3')} - hw ELSE 0 END",
            "h2h_xg_dominance": _mean("x.dx", "known_x"),
            "h2h_home_scoring_trend": f"CASE WHEN n >= 4 THEN {_mean('x.g1', 'tail')} - {_mean('x.g1', 'head')} ELSE 0 END",
            "h2h_clean_sheet_pct": _mean(_when("x.g2 = 0")),
        },
    ]
    return steps.columns(matches, *layers).selectExpr("match_id", *[f"coalesce({n}, {DEFAULTS[n]}) AS {n}" for n in NAMES])


def oracle(contest_sql: str) -> str:
    d = DEFAULTS
    return f"""WITH c AS ({contest_sql}),
    p AS (SELECT m.match_id, o.match_id AS oid, o.home_team <> m.home_team AS rv, o.match_date AS od,
      CASE WHEN o.home_team = m.home_team THEN o.goals_home ELSE o.goals_away END AS g1, CASE WHEN o.home_team = m.home_team THEN o.goals_away ELSE o.goals_home END AS g2,
      CASE WHEN o.home_team = m.home_team THEN o.xg_home - o.xg_away ELSE o.xg_away - o.xg_home END AS dx
      FROM c m JOIN c o ON least(m.home_team, m.away_team) = least(o.home_team, o.away_team) AND greatest(m.home_team, m.away_team) = greatest(o.home_team, o.away_team)
      AND (o.match_date, o.match_id) < (m.match_date, m.match_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY rv DESC, od DESC, oid DESC) AS k FROM p),
    t AS (SELECT *, count(*) OVER (PARTITION BY match_id) AS n FROM r WHERE k <= 10),
    a AS (SELECT match_id, max(n) AS n, avg((g1 > g2)::INT) AS hw, avg((g1 = g2)::INT) AS dr, avg(g1 + g2) AS goals, avg((g1 > g2)::INT) FILTER (NOT rv) AS venue, stddev_pop(g1 + g2) AS vol,
      avg((g1 > 0 AND g2 > 0)::INT) AS btts, avg((g1 + g2 > 2)::INT) AS o25, avg(g1) AS g1a, avg(g2) AS g2a, avg((g1 > g2)::INT) FILTER (k <= 3) AS l3, avg(dx) AS dxa,
      avg(g1) FILTER (k <= n - n // 2) AS late, avg(g1) FILTER (k > n - n // 2) AS early, avg((g2 = 0)::INT) AS cs FROM t GROUP BY 1)
    SELECT match_id, coalesce(hw, {d['h2h_home_win_pct']}) AS h2h_home_win_pct, coalesce(dr, {d['h2h_draw_pct']}) AS h2h_draw_pct, coalesce(1 - hw - dr, {d['h2h_away_win_pct']}) AS h2h_away_win_pct,
      coalesce(goals, {d['h2h_avg_goals']}) AS h2h_avg_goals, coalesce(n, 0) AS h2h_matches, coalesce(venue, 0.45) AS h2h_venue_dominance, coalesce(vol, 0) AS h2h_goals_volatility,
      coalesce(btts, 0.5) AS h2h_btts_rate, coalesce(o25, 0.5) AS h2h_over25_rate, coalesce(g1a, 1.5) AS h2h_home_goals_avg, coalesce(g2a, 1.2) AS h2h_away_goals_avg,
      CASE WHEN n >= 4 THEN l3 - hw ELSE 0 END AS h2h_recent_shift, coalesce(dxa, 0) AS h2h_xg_dominance, CASE WHEN n >= 4 THEN late - early ELSE 0 END AS h2h_home_scoring_trend,
      coalesce(cs, 0.3) AS h2h_clean_sheet_pct
    FROM c LEFT JOIN a USING (match_id)"""
