"""Histories as windows: what was known of a team just before each match.

Every operator emits before it updates: frames end one row before the current one. The order
is (match_date, match_id); a team's rows form one window partition, spread over as many tasks
as there are teams.
"""

from __future__ import annotations

import math

TEAM = "PARTITION BY team ORDER BY match_date, match_id"
ROLLING_WINDOWS = (3, 5, 8, 10, 15, 20)


#: How far back the windows of a history look: kinds of rows and how many of each, all rows first.
LOOKS_BACK = {
    "rolling_form": [("true", max(ROLLING_WINDOWS))], "sequence": [("true", 11)], "expected_points": [("true", 20)], "rest": [("true", 1)], "scoring": [("true", 10)], "strengths": [("true", 10)],
    "momentum": [("true", 10), ("is_home = 1", 5), ("is_home = 0", 5), ("xgf IS NOT NULL", 5)],
}


def last(n: int, by: str = TEAM) -> str:
    return f"({by} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


PRIOR = f"({TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
VENUE = "PARTITION BY team, is_home ORDER BY match_date, match_id"
RN = {"rn": f"row_number() OVER ({TEAM})", "prior": f"count(*) OVER {PRIOR}"}


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def share(condition: str, frame: str) -> str:
    return f"avg(CAST({flag(condition)} AS DOUBLE)) OVER {frame}"


def rolling_frames(windows=ROLLING_WINDOWS) -> tuple[list[dict], list[str]]:
    """W1 by its definition: a frame for each metric and window. The twin of ``rolling_form``."""
    layer: dict[str, str] = {}
    for w in windows:
        f = last(w)
        layer |= {
            f"ppg_l{w}": f"avg(CAST(pts AS DOUBLE)) OVER {f}", f"goals_scored_l{w}": f"avg(CAST(gf AS DOUBLE)) OVER {f}", f"goals_conceded_l{w}": f"avg(CAST(ga AS DOUBLE)) OVER {f}",
            f"xg_for_l{w}": f"avg(xgf) OVER {f}", f"xg_against_l{w}": f"avg(xga) OVER {f}", f"xg_overperformance_l{w}": f"avg(gf - xgf) OVER {f}",
            f"clean_sheets_l{w}": share("ga = 0", f), f"btts_pct_l{w}": share("gf > 0 AND ga > 0", f), f"over25_pct_l{w}": share("gf + ga > 2", f),
            f"win_pct_l{w}": share("pts = 3", f), f"draw_pct_l{w}": share("pts = 1", f), f"loss_pct_l{w}": share("pts = 0", f),
            f"shots_for_l{w}": f"avg(shots_f) OVER {f}", f"shots_against_l{w}": f"avg(shots_a) OVER {f}",
            f"sot_pct_l{w}": f"sum(sot_f) OVER {f} / nullif(sum(shots_f) OVER {f}, 0) * 100",
            f"possession_l{w}": "CAST(NULL AS DOUBLE)", f"pass_accuracy_l{w}": "CAST(NULL AS DOUBLE)",
        }
    return [layer], list(layer)


def rolling_form(windows=ROLLING_WINDOWS) -> tuple[list[dict], list[str]]:
    """17 metrics over each window, null without history; the optional columns that the
    view lacks (possession, pass accuracy) stay null. Each quantity is summed once along the
    team's matches; a window's sum is that sum less the one so many rows before, so work
    doesn't grow with windows and their lengths."""
    wins = {"wins": "pts = 3", "draws": "pts = 1", "losses": "pts = 0", "clean": "ga = 0", "btts": "gf > 0 AND ga > 0", "over": "gf + ga > 2"}
    of = {"pts": "pts", "gf": "gf", "ga": "ga", **{k: flag(c) for k, c in wins.items()}, "sxf": "xgf", "sxa": "xga", "sov": "gf - xgf", "shf": "shots_f", "sha": "shots_a", "sot": "sot_f"}
    sums = {f"c_{k}": f"coalesce(sum({e}) OVER {PRIOR}, 0)" for k, e in of.items()}
    counts = {f"k_{k}": f"count({of[k]}) OVER {PRIOR}" for k in ("sxf", "sxa", "sov", "shf", "sha")}
    layer: dict[str, str] = {}
    for w in windows:
        late = lambda c, w=w: f"({c} - coalesce(lag({c}, {w}) OVER ({TEAM}), 0))"
        mean = lambda k, w=w: f"CASE WHEN prior > 0 THEN {late(f'c_{k}')} / CAST(least(prior, {w}) AS DOUBLE) END"
        some = lambda k: f"{late(f'c_{k}')} / CAST(nullif({late(f'k_{k}')}, 0) AS DOUBLE)"
        layer |= {
            f"ppg_l{w}": mean("pts"), f"goals_scored_l{w}": mean("gf"), f"goals_conceded_l{w}": mean("ga"),
            f"xg_for_l{w}": some("sxf"), f"xg_against_l{w}": some("sxa"), f"xg_overperformance_l{w}": some("sov"),
            f"clean_sheets_l{w}": mean("clean"), f"btts_pct_l{w}": mean("btts"), f"over25_pct_l{w}": mean("over"),
            f"win_pct_l{w}": mean("wins"), f"draw_pct_l{w}": mean("draws"), f"loss_pct_l{w}": mean("losses"),
            f"shots_for_l{w}": some("shf"), f"shots_against_l{w}": some("sha"),
            f"sot_pct_l{w}": f"{late('c_sot')} / nullif({late('c_shf')}, 0) * 100",
            f"possession_l{w}": "CAST(NULL AS DOUBLE)", f"pass_accuracy_l{w}": "CAST(NULL AS DOUBLE)",
        }
    return [{"prior": RN["prior"], **sums, **counts}, layer], list(layer)


def runs() -> tuple[list[dict], list[str]]:
    """Streak (wins positive, losses negative, draws 0), unbeaten and winless runs, as
    gaps from the last row that breaks them."""
    back = {"lag_pts": f"lag(pts) OVER ({TEAM})", **RN}
    breaks = {
        "lost_at": f"max(CASE WHEN pts = 0 THEN rn END) OVER {PRIOR}",
        "won_at": f"max(CASE WHEN pts = 3 THEN rn END) OVER {PRIOR}",
        "turned_at": f"max(CASE WHEN lag_pts IS NULL OR lag_pts <> pts THEN rn END) OVER {PRIOR}",
    }
    out = {
        "streak": "CASE WHEN lag_pts = 3 THEN rn - turned_at WHEN lag_pts = 0 THEN turned_at - rn ELSE 0 END",
        "unbeaten_run": "rn - 1 - coalesce(lost_at, 0)",
        "winless_run": "rn - 1 - coalesce(won_at, 0)",
    }
    return [back, breaks, out], list(out)


def momentum() -> tuple[list[dict], list[str]]:
    """Volatility, acceleration, trends, venue form, congestion within 14 days, xG trend.
    earlier_days is the number of matches in the 14 days before the match's own."""
    m = lambda c, k: f"avg(CAST({c} AS DOUBLE)) OVER {last(k)}"
    seen = {**RN, "xg_no": f"count(xgf) OVER ({TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "venue_prior": f"count(*) OVER ({VENUE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"}
    xg = lambda k: f"avg(xgf) OVER (PARTITION BY team ORDER BY xg_no RANGE BETWEEN {k - 1} PRECEDING AND 0 FOLLOWING)"
    recent = {"xg3": xg(3), "xg5": xg(5)}
    before = {"xg3b": f"lag(xg3) OVER ({TEAM})", "xg5b": f"lag(xg5) OVER ({TEAM})", "xg_prior": f"coalesce(lag(xg_no) OVER ({TEAM}), 0)"}
    trend = lambda c: f"CASE WHEN prior >= 8 THEN {m(c, 3)} - {m(c, 8)} ELSE 0 END"
    out = {
        "volatility": f"CASE WHEN prior >= 3 THEN stddev_pop(CAST(pts AS DOUBLE)) OVER {last(10)} ELSE 0 END",
        "form_accel": f"CASE WHEN prior >= 8 THEN ({m('pts', 3)} - {m('pts', 8)}) / 3 ELSE 0 END",
        "goal_trend": trend("gf"), "defense_trend": trend("ga"), "points_velocity": trend("pts"),
        "venue_form": f"CASE WHEN venue_prior >= 2 THEN avg(CAST(pts AS DOUBLE)) OVER {last(5, VENUE)} / 3 WHEN is_home = 1 THEN 0.5 ELSE 0.33 END",
        "congestion": "earlier_days + row_number() OVER (PARTITION BY team, dn ORDER BY match_id) - 1",
        "xg_trend": "CASE WHEN xg_prior >= 5 THEN xg3b - xg5b ELSE 0 END",
    }
    return [seen, recent, before, out], list(out)


def surprise() -> tuple[list[dict], list[str]]:
    """Share of upsets among the team's last 20 entries. An upset writes an entry for its
    winner only, so the frame counts entries, not matches."""
    upset = "(gap_elo > 50 AND result = 'A' OR gap_elo < -50 AND result = 'H')"
    entry = {"entry": f"CASE WHEN {upset} AND pts = 3 THEN 1 WHEN {upset} THEN NULL ELSE 0 END"}
    number = {"entry_no": f"count(entry) OVER ({TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}
    upto = {"rate": "avg(CAST(entry AS DOUBLE)) OVER (PARTITION BY team ORDER BY entry_no RANGE BETWEEN 19 PRECEDING AND 0 FOLLOWING)"}
    out = {"upset_tendency": f"coalesce(lag(rate) OVER ({TEAM}), 0)"}
    return [entry, number, upto, out], list(out)


def sequence() -> tuple[list[dict], list[str]]:
    """Last five results, base-3 pattern, bounce, collapse and consistency."""
    lags = {f"seq_last{i}": f"lag(pts, {i}) OVER ({TEAM})" for i in range(1, 6)}
    pair = {**RN, **lags, "bounced": flag(f"pts = 3 AND lag(pts) OVER ({TEAM}) = 0"), "collapsed": flag(f"pts = 0 AND lag(pts) OVER ({TEAM}) = 3")}
    inner = f"({TEAM} ROWS BETWEEN 10 PRECEDING AND 2 PRECEDING)"
    rate = lambda hit, base: f"CASE WHEN prior >= 5 THEN sum({hit}) OVER {last(9)} / CAST(greatest(coalesce(sum({flag(base)}) OVER {inner}, 0), 1) AS DOUBLE) ELSE 0.5 END"
    out = {
        "seq_wdl_pattern": f"CASE WHEN prior >= 3 THEN {' + '.join(f'coalesce(seq_last{i}, 0) * {3 ** (i - 1)}' for i in range(1, 6))} ELSE 0 END",
        "seq_bounce_back": rate("bounced", "pts = 0"),
        "seq_collapse": rate("collapsed", "pts = 3"),
        "seq_consistency": f"CASE WHEN prior >= 5 THEN 1 / (1 + stddev_pop(CAST(pts AS DOUBLE)) OVER {last(10)}) ELSE 0.5 END",
    }
    return [pair, out], [*lags, *out]


def manager() -> tuple[list[dict], list[str]]:
    """Tenure restarts where the last five results average under 0.6 points."""
    reset = {"reset": f"CASE WHEN count(*) OVER {last(5)} = 5 AND avg(CAST(pts AS DOUBLE)) OVER {last(5)} < 0.6 THEN 1 ELSE 0 END"}
    island = {"island": f"sum(reset) OVER ({TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}
    tenure = {"manager_tenure": "row_number() OVER (PARTITION BY team, island ORDER BY match_date, match_id)"}
    return [reset, island, tenure, {"new_manager_bounce": flag("manager_tenure <= 5")}], ["manager_tenure", "new_manager_bounce"]


def keeper() -> tuple[list[dict], list[str]]:
    """Clean-sheet quality, consistency of goals against, clean-sheet streak."""
    broken = {"leaked_at": f"max(CASE WHEN ga > 0 THEN rn END) OVER {PRIOR}"}
    out = {
        "gk_quality": f"CASE WHEN prior >= 5 THEN {share('ga = 0', last(10))} * 2 - avg(CAST(ga AS DOUBLE)) OVER {last(10)} / 3 + 0.5 ELSE 0.5 END",
        "gk_consistency": f"CASE WHEN prior >= 5 THEN 1 / (1 + stddev_pop(CAST(ga AS DOUBLE)) OVER {last(10)}) ELSE 0.5 END",
        "gk_cs_streak": "rn - 1 - coalesce(leaked_at, 0)",
    }
    return [RN, broken, out], list(out)


def strengths() -> tuple[list[dict], list[str]]:
    """W10, first half: attack and defence over the last ten, null before five."""
    out = {n: f"CASE WHEN prior >= 5 THEN avg(CAST({c} AS DOUBLE)) OVER {last(10)} END" for n, c in (("attack", "gf"), ("defence", "ga"))}
    return [RN, out], list(out)


def pmf(rate: str, goals: int) -> str:
    return f"exp(-({rate})) * pow({rate}, {goals}) / {math.factorial(goals)}"


def grid(home: str, away: str, condition, goals: int = 6) -> str:
    """Sum of the score probabilities 0..goals-1 that meet a condition; not renormalised."""
    return "(" + " + ".join(f"({pmf(home, i)}) * ({pmf(away, j)})" for i in range(goals) for j in range(goals) if condition(i, j)) + ")"


def poisson_layers() -> tuple[list[dict], list[str]]:
    """W10, second half: on attack_home, defence_away, attack_away, defence_home."""
    rates = {
        "poisson_home_lambda": "CASE WHEN attack_home IS NULL OR attack_away IS NULL THEN NULL ELSE greatest(0.3, attack_home * defence_away / 1.35 * 1.1) END",
        "poisson_away_lambda": "CASE WHEN attack_home IS NULL OR attack_away IS NULL THEN NULL ELSE greatest(0.2, attack_away * defence_home / 1.35 * 0.9) END",
    }
    h, a = rates
    out = {
        "poisson_total_lambda": f"{h} + {a}", "poisson_diff": f"{h} - {a}",
        "poisson_home_win": grid(h, a, lambda i, j: i > j), "poisson_draw": grid(h, a, lambda i, j: i == j), "poisson_away_win": grid(h, a, lambda i, j: i < j),
        "poisson_over25": grid(h, a, lambda i, j: i + j > 2), "poisson_btts": grid(h, a, lambda i, j: i and j),
    }
    return [rates, out], [*rates, *out]


def expected_points() -> tuple[list[dict], list[str]]:
    """Points over those that expected goals give, summed and as a trend."""
    sound = "xgf > 0 AND xga > 0"
    x = {"xpts": f"CASE WHEN {sound} THEN 3 * {grid('xgf', 'xga', lambda i, j: i > j)} + {grid('xgf', 'xga', lambda i, j: i == j)} WHEN is_home = 1 THEN 1.5 ELSE 1.2 END"}
    out = {
        "xpts_surplus": f"CASE WHEN prior >= 3 THEN sum(pts - xpts) OVER {last(20)} ELSE 0 END",
        "xpts_trend": f"CASE WHEN prior >= 5 THEN avg(pts - xpts) OVER {last(5)} ELSE 0 END",
    }
    return [RN, x, out], list(out)


def rest() -> tuple[list[dict], list[str]]:
    """Days since the last match (7 before the first), plain and capped at 30."""
    days = {"rest_days": f"CASE WHEN lag(dn) OVER ({TEAM}) IS NULL THEN 7 ELSE greatest(0, dn - lag(dn) OVER ({TEAM})) END"}
    return [days, {"rest_days_capped": "least(rest_days, 30)", "fresh_flag": flag("rest_days >= 6"), "fatigue_flag": flag("rest_days <= 2")}], ["rest_days", "rest_days_capped", "fresh_flag", "fatigue_flag"]


def scoring() -> tuple[list[dict], list[str]]:
    """Early goals, comebacks, clean sheets and first goals of the last ten."""
    half = {**RN, "hf": "coalesce(ht_gf, 0)", "hc": "coalesce(ht_ga, 0)"}
    f = last(10)
    out = {
        "early_goals_pct": f"CASE WHEN prior >= 5 THEN coalesce(sum(hf) OVER {f} / CAST(nullif(sum(gf) OVER {f}, 0) AS DOUBLE), 0) END",
        "comeback_rate": f"CASE WHEN prior >= 5 THEN coalesce(sum({flag('hf < hc AND gf >= ga')}) OVER {f} / CAST(nullif(sum({flag('hf < hc')}) OVER {f}, 0) AS DOUBLE), 0) END",
        "clean_sheet_rate": f"CASE WHEN prior >= 5 THEN {share('ga = 0', f)} END",
        "first_goal_rate": f"CASE WHEN prior >= 5 THEN {share('hf > 0 AND hc = 0', f)} END",
    }
    return [half, out], list(out)


def referee() -> tuple[list[dict], list[str]]:
    """Expanding averages of a referee's matches; nulls are skipped."""
    f = "(PARTITION BY referee ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    known = lambda e: f"CASE WHEN referee IS NOT NULL THEN {e} END"
    out = {"referee_avg_fouls": known(f"avg(fouls) OVER {f}"), "referee_avg_yellows": known(f"avg(yellows) OVER {f}"), "referee_home_bias": known(f"{share('home_points = 3', f)} - 0.46")}
    return [out], list(out)
