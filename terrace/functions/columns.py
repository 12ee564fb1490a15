"""Pure column operators (P4-P6, P8-P13, P17, P19-P21, P23, P25) as SQL expressions.

Missing values are NULL, never NaN; flags read a NULL comparison as false; divisions by zero
give NULL."""

from __future__ import annotations


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def sign(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1 WHEN {x} < 0 THEN -1 WHEN {x} = 0 THEN 0 END"


#: Points, totals and flags. is_home teams' points come with the view.
BASIC = {
    "total_goals": "goals_home + goals_away",
    "over_2_5": flag("goals_home + goals_away > 2"),
    "btts": flag("goals_home > 0 AND goals_away > 0"),
    "is_rain": flag("precipitation > 0.5"),
}


def contextual(weekday: str) -> dict[str, str]:
    """P8's day and weather, and progress by month alone; weekday gives 0 for Monday."""
    return {
        "is_midweek": flag(f"{weekday} IN (1, 2, 3)"), "month_no": "month(match_date)", "day_of_week": weekday,
        "is_cold": flag("coalesce(temperature, 10) < 5"), "is_hot": flag("coalesce(temperature, 10) > 25"), "is_windy": flag("coalesce(wind_speed, 10) > 25"),
        "calendar_progress": "least(((month(match_date) + 4) % 12) / CAST(10 AS DOUBLE), 1)",
        "weather_impact": "coalesce(precipitation, 0) * coalesce(wind_speed, 0) / 100",
    }


def season_stage() -> dict[str, str]:
    """Rest and the stage of the season by gameweek (19 where there is none)."""
    week = "coalesce(gameweek, 19)"
    return {
        "rest_diff": "coalesce(rest_home, 7) - coalesce(rest_away, 7)", "season_progress": f"{week} / CAST(38 AS DOUBLE)",
        "is_early_season": flag(f"{week} <= 5"), "is_late_season": flag(f"{week} >= 33"), "is_run_in": flag(f"{week} >= 30"),
    }


# Bookmakers in order of trust, opening and closing.
OPENING, CLOSING = ("pin", "b365", "avg", "iw", "wh"), ("pin", "b365", "avg")


def priced(available: set[str]) -> dict[str, str]:
    """Opening and closing odds from the first bookmaker with a number; closing odds fall
    back on opening ones. available: the columns there are."""
    first = lambda names: [f"TRY_CAST({n} AS DOUBLE)" for n in names if n in available]
    out = {}
    for o in ("home", "draw", "away"):
        opening = first(f"odds_{b}_{o}" for b in OPENING)
        closing = first(f"odds_{b}_{o}_close" for b in CLOSING) + opening
        out[f"odds_{o}_open"] = f"coalesce({', '.join([*opening, 'NULL'])})"
        out[f"odds_{o}_close"] = f"coalesce({', '.join([*closing, 'NULL'])})"
    return out


def trainer_extras() -> dict[str, str]:
    """Odds drift, entropy of the opening market, agreement of ratings and market. On
    implied_prob_* and elo_diff; a null on either side stays null."""
    drift = {f"odds_drift_{o}": f"implied_prob_{o}_close - implied_prob_{o}_open" for o in ("home", "draw", "away")}
    entropy = "-(" + " + ".join(f"implied_prob_{o}_open * ln(CASE WHEN implied_prob_{o}_open > 0.01 THEN implied_prob_{o}_open ELSE 0.01 END)" for o in ("home", "draw", "away")) + ")"
    return drift | {"open_market_entropy": entropy, "elo_market_agree": "1 - abs(1 / (1 + pow(10, -elo_diff / 400)) - implied_prob_home_open)"}


def market() -> list[dict[str, str]]:
    """Implied probabilities and overround of opening and closing odds, movement."""
    raw, out, moved = {}, {}, {}
    for p in ("open", "close"):
        for o in ("home", "draw", "away"):
            raw[f"raw_{o}_{p}"] = f"1 / nullif(odds_{o}_{p}, 0)"
        out[f"market_overround_{p}"] = f"raw_home_{p} + raw_draw_{p} + raw_away_{p}"
        out |= {f"implied_prob_{o}_{p}": f"raw_{o}_{p} / (raw_home_{p} + raw_draw_{p} + raw_away_{p})" for o in ("home", "draw", "away")}
    moved = {f"odds_movement_{o}": f"implied_prob_{o}_close - implied_prob_{o}_open" for o in ("home", "draw", "away")}
    last = {
        "steam_move_flag": flag("abs(odds_movement_home) > 0.05"),
        "market_favorite": "CASE WHEN implied_prob_home_close > implied_prob_away_close THEN 1 WHEN implied_prob_away_close > implied_prob_home_close THEN -1 ELSE 0 END",
        "market_entropy": "-(" + " + ".join(f"implied_prob_{o}_close * ln(greatest(implied_prob_{o}_close, 0.01))" for o in ("home", "draw", "away")) + ")",
    }
    return [raw, out, moved, last]


def shin() -> list[dict[str, str]]:
    """Shin's probabilities; odds must all be over 1."""
    o = ("home", "draw", "away")
    sound = " AND ".join(f"odds_{x}_open > 1" for x in o)
    first = {f"ip_{x}": f"CASE WHEN {sound} THEN 1 / odds_{x}_open END" for x in o}
    total = {"ip_sum": "ip_home + ip_draw + ip_away"}
    z = {"z": "CASE WHEN ip_sum IS NULL THEN NULL ELSE greatest(0, least(0.3, (ip_sum - 1) / 2)) END"}
    true = {f"tp_{x}": f"CASE WHEN z IS NULL THEN NULL ELSE greatest(0.01, (sqrt(z * z + 4 * (1 - z) * ip_{x} * ip_{x} / ip_sum) - z) / (2 * (1 - z))) END" for x in o}
    out = {f"shin_prob_{x}": f"tp_{x} / (tp_home + tp_draw + tp_away)" for x in o}
    last = {
        "shin_home_draw_ratio": "shin_prob_home / CASE WHEN shin_prob_draw IS NULL THEN NULL ELSE greatest(shin_prob_draw, 0.05) END",
        "shin_home_away_ratio": "shin_prob_home / CASE WHEN shin_prob_away IS NULL THEN NULL ELSE greatest(shin_prob_away, 0.05) END",
        "shin_decisiveness": "greatest(shin_prob_home, shin_prob_draw, shin_prob_away) - least(shin_prob_home, shin_prob_draw, shin_prob_away)",
    }
    return [first, total, z, true, out, last]


def interactions() -> dict[str, str]:
    """P10, P11, P12 over ratings elo_*, pi_*, form *_l5, table_pos_* and rest."""
    pressure = lambda c: f"CASE WHEN {c} <= 4 OR {c} >= 18 THEN 1 WHEN {c} BETWEEN 5 AND 7 THEN 0.5 ELSE 0 END"
    out = {
        "rest_diff": "rest_home - rest_away",
        "elo_rest_interaction_home": "elo_home * ln(1 + rest_home)", "elo_rest_interaction_away": "elo_away * ln(1 + rest_away)",
        "form_home_advantage": "coalesce(ppg_home_l5, 1.5) * 1.1", "form_away_disadvantage": "coalesce(ppg_away_l5, 1.5) * 0.9",
        "rating_concordance": flag(f"({sign('elo_diff')}) = ({sign('pi_diff')})"),
        "ext_elo_diff": "elo_pre_home - elo_pre_away", "elo_agreement": flag(f"({sign('elo_diff')}) = ({sign('coalesce(elo_pre_home - elo_pre_away, 0)')})"),
        "weighted_streak_home_l5": "ppg_home_l5 * (1 + elo_momentum_home / 20)", "weighted_streak_away_l5": "ppg_away_l5 * (1 + elo_momentum_away / 20)",
        "combined_rating_diff": "(elo_diff / 200 + pi_diff * 2 + (table_pos_away - table_pos_home) / CAST(5 AS DOUBLE)) / 3",
        "weighted_streak_home_l10": "ppg_home_l10 * (1 + elo_momentum_home / 20)", "weighted_streak_away_l10": "ppg_away_l10 * (1 + elo_momentum_away / 20)",
        "attack_def_mismatch_home": "pi_home_attack + pi_away_defense", "attack_def_mismatch_away": "pi_away_attack + pi_home_defense",
        "derby_intensity": "is_derby * season_progress", "weather_impact": "coalesce(precipitation, 0) * coalesce(wind_speed, 0) / 100",
        "position_pressure_home": pressure("table_pos_home"), "position_pressure_away": pressure("table_pos_away"),
    }
    for side, opp, base in (("home", "away", 1.3), ("away", "home", 1.1)):
        clipped = f"CASE WHEN goals_conceded_{opp}_l5 IS NULL THEN 1.3 ELSE greatest(goals_conceded_{opp}_l5, 0.3) END"
        out |= {
            f"attack_vs_defense_{side}": f"coalesce(goals_scored_{side}_l5, 1.3) / ({clipped})",
            f"expected_{side}_goals": f"(coalesce(goals_scored_{side}_l5, {base}) + coalesce(goals_conceded_{opp}_l5, {base})) / 2",
            f"form_elo_divergence_{side}": f"coalesce(ppg_{side}_l5, 1.5) / 3.0 - 1 / (1 + pow(10, -(elo_{side} - 1500) / 400))",
            f"defensive_solidity_{side}": f"coalesce(clean_sheets_{side}_l5, 0.2) * 2 - coalesce(goals_conceded_{side}_l5, 1.3) / 3",
        }
    return out


def blend(model: float = 0.6, market: float = 0.4) -> list[dict[str, str]]:
    """Clip, renormalise, mix with the market where it is known, the most
    likely outcome (first wins ties) and its tier. On p_home, p_draw, p_away and shin_prob_*."""
    o = ("home", "draw", "away")
    known = " AND ".join(f"shin_prob_{x} IS NOT NULL" for x in o)
    clip = {f"c_{x}": f"CASE WHEN p_{x} IS NOT NULL THEN greatest(0.02, least(0.96, p_{x})) END" for x in o}
    norm = {f"n_{x}": f"c_{x} / (c_home + c_draw + c_away)" for x in o}
    mixed = {f"m_{x}": f"CASE WHEN {known} THEN {model} * n_{x} + {market} * shin_prob_{x} ELSE n_{x} END" for x in o}
    out = {f"blend_{x}": f"m_{x} / (m_home + m_draw + m_away)" for x in o}
    return [clip, norm, mixed, out, {"pick": argmax("blend_home", "blend_draw", "blend_away"), "top_prob": "greatest(blend_home, blend_draw, blend_away)"}, {"tier": tier("top_prob")}]


def argmax(h: str, d: str, a: str) -> str:
    return f"CASE WHEN {h} >= {d} AND {h} >= {a} THEN 0 WHEN {d} >= {a} THEN 1 ELSE 2 END"


def tier(p: str) -> str:
    return f"CASE WHEN {p} >= 0.70 THEN 'ELITE' WHEN {p} >= 0.60 THEN 'VERY HIGH' WHEN {p} >= 0.50 THEN 'HIGH' WHEN {p} >= 0.42 THEN 'MEDIUM' ELSE 'LOW' END"


def live_adjustment() -> list[dict[str, str]]:
    """Sentiment, injuries and unsettled managers move the outcome, clipped and
    renormalised. On p_*, sentiment_*, injury_*, instability_*."""
    home = "0.03 * (sentiment_home - sentiment_away) - 0.025 * (injury_home - injury_away)"
    shift = {
        "q_home": f"p_home + {home} - CASE WHEN instability_home > 0.3 THEN 0.02 ELSE 0 END + CASE WHEN instability_away > 0.3 THEN 0.01 ELSE 0 END",
        "q_away": f"p_away - ({home}) - CASE WHEN instability_away > 0.3 THEN 0.02 ELSE 0 END + CASE WHEN instability_home > 0.3 THEN 0.01 ELSE 0 END",
        "q_draw": "p_draw",
    }
    clip = {f"k_{x}": f"CASE WHEN q_{x} IS NOT NULL THEN greatest(0.02, least(0.95, q_{x})) END" for x in ("home", "draw", "away")}
    return [shift, clip, {f"live_{x}": f"k_{x} / (k_home + k_draw + k_away)" for x in ("home", "draw", "away")}]


def finite(names: list[str]) -> dict[str, str]:
    """The named columns, null where they are infinite."""
    return {f"{n}_finite": f"CASE WHEN abs({n}) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE {n} END" for n in names}
