"""SQL twins of team histories, written apart from ``operators.history``: what was known before a
match is a list of all that a team has played, and every feature is worked out from its end."""

from __future__ import annotations

BEFORE = "OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _list(of: str, where: str = "true") -> str:
    return f"coalesce(list({of}) FILTER ({where}) {BEFORE}, [])"


def _run(past: str, breaks: str) -> str:
    """How many of the latest entries come before one that breaks the run."""
    return f"coalesce(nullif(list_position(list_transform(list_reverse({past}), lambda x: {breaks}), true), 0), len({past}) + 1) - 1"


def runs() -> list[dict[str, str]]:
    return [{"p": _list("pts")}, {
        "streak": f"CASE p[-1] WHEN 3 THEN {_run('p', 'x <> 3')} WHEN 0 THEN -({_run('p', 'x <> 0')}) ELSE 0 END",
        "unbeaten_run": _run("p", "x = 0"), "winless_run": _run("p", "x = 3"),
    }]


def momentum() -> list[dict[str, str]]:
    lists = {"p": _list("pts"), "g": _list("gf"), "c": _list("ga"), "days": _list("dn"), "x": _list("xgf", "xgf IS NOT NULL"), "here": f"coalesce(list(pts) {BEFORE.replace('BY team', 'BY team, is_home')}, [])"}
    late = lambda of: f"CASE WHEN len(p) < 8 THEN 0 ELSE list_avg({of}[-3:]) - list_avg({of}[-8:]) END"
    return [lists, {
        "volatility": "CASE WHEN len(p) < 3 THEN 0 ELSE list_stddev_pop(p[-10:]) END", "form_accel": f"({late('p')}) / 3.0::DOUBLE", "goal_trend": late("g"), "defense_trend": late("c"), "points_velocity": late("p"),
        "venue_form": "CASE WHEN len(here) > 1 THEN list_avg(here[-5:]) / 3 ELSE [0.33, 0.5][is_home + 1] END",
        "congestion": "len(list_filter(days, lambda t: t >= dn - 14))",
        "xg_trend": "CASE WHEN len(x) < 5 THEN 0 ELSE list_avg(x[-3:]) - list_avg(x[-5:]) END",
    }]


def surprise() -> list[dict[str, str]]:
    wrote = {"upset": "CASE WHEN gap_elo > 50 THEN result = 'A' WHEN gap_elo < -50 THEN result = 'H' ELSE false END"}
    return [wrote, {"said": _list("CASE WHEN upset THEN 1 ELSE 0 END", "NOT upset OR pts = 3")}, {"upset_tendency": "coalesce(list_avg(said[-20:]), 0)"}]


def sequence() -> list[dict[str, str]]:
    steps = lambda was, now: f"len(list_filter(range(2, len(q) + 1), lambda i: q[i - 1] = {was} AND q[i] = {now}))"
    rate = lambda was, now: f"CASE WHEN len(p) < 5 THEN 0.5 ELSE {steps(was, now)} / greatest(1, len(list_filter(q[:-2], lambda x: x = {was}))) END"
    return [{"p": _list("pts")}, {"q": "p[-10:]"}, {
        **{f"seq_last{i}": f"p[-{i}]" for i in range(1, 6)},
        "seq_wdl_pattern": f"CASE WHEN len(p) < 3 THEN 0 ELSE {' + '.join(f'coalesce(p[-{i}], 0) * {w}' for i, w in zip(range(1, 6), (1, 3, 9, 27, 81)))} END",
        "seq_bounce_back": rate(0, 3), "seq_collapse": rate(3, 0), "seq_consistency": "CASE WHEN len(p) < 5 THEN 0.5 ELSE 1 / (list_stddev_pop(q) + 1) END",
    }]


def manager() -> list[dict[str, str]]:
    left = {"p": _list("pts")}
    turn = {"turn": "len(p) >= 5 AND list_sum(p[-5:]) < 3"}
    since = {"turns": "list(turn) OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}
    return [left, turn, since, {"manager_tenure": "coalesce(nullif(list_position(list_reverse(turns), true), 0), len(turns))"}, {"new_manager_bounce": "(manager_tenure < 6)::INT"}]


def keeper() -> list[dict[str, str]]:
    return [{"c": _list("ga")}, {
        "gk_quality": "CASE WHEN len(c) < 5 THEN 0.5 ELSE 0.5 + 2 * len(list_filter(c[-10:], lambda x: x = 0)) / len(c[-10:]) - list_avg(c[-10:]) / 3 END",
        "gk_consistency": "CASE WHEN len(c) < 5 THEN 0.5 ELSE 1 / (list_stddev_pop(c[-10:]) + 1) END", "gk_cs_streak": _run("c", "x > 0"),
    }]


def expected_points() -> list[dict[str, str]]:
    goals = "[1, 1, 2, 6, 24, 120]"
    chance = f"(SELECT sum(CASE WHEN h > a THEN 3 WHEN h = a THEN 1 ELSE 0 END * exp(-xgf - xga) * xgf ** h * xga ** a / ({goals}[h + 1] * {goals}[a + 1])) FROM range(6) i(h), range(6) j(a))"
    return [{"due": f"CASE WHEN least(xgf, xga) > 0 AND xgf IS NOT NULL AND xga IS NOT NULL THEN {chance} ELSE [1.2, 1.5][is_home + 1]::DOUBLE END"}, {"d": _list("pts - due")}, {
        "xpts_surplus": "CASE WHEN len(d) < 3 THEN 0 ELSE list_sum(d[-20:]) END", "xpts_trend": "CASE WHEN len(d) < 5 THEN 0 ELSE list_avg(d[-5:]) END",
    }]


def rest() -> list[dict[str, str]]:
    return [{"days": _list("dn")}, {"rest_days": "CASE WHEN len(days) = 0 THEN 7 ELSE greatest(dn - days[-1], 0) END"}, {"rest_days_capped": "CASE WHEN rest_days > 30 THEN 30 ELSE rest_days END", "fresh_flag": "(rest_days > 5)::INT", "fatigue_flag": "(rest_days < 3)::INT"}]


def scoring() -> list[dict[str, str]]:
    game = "struct_pack(f := coalesce(ht_gf, 0), c := coalesce(ht_ga, 0), g := gf, a := ga)"
    n = lambda condition: f"len(list_filter(m, lambda x: {condition}))"
    known = lambda value: f"CASE WHEN len(every) >= 5 THEN {value} END"
    return [{"every": _list(game)}, {"m": "every[-10:]"}, {
        "early_goals_pct": known("coalesce(list_sum(list_transform(m, lambda x: x.f)) / nullif(list_sum(list_transform(m, lambda x: x.g)), 0), 0)"),
        "comeback_rate": known(f"coalesce({n('x.f < x.c AND x.g >= x.a')} / nullif({n('x.f < x.c')}, 0), 0)"),
        "clean_sheet_rate": known(f"{n('x.a = 0')} / len(m)"), "first_goal_rate": known(f"{n('x.f > 0 AND x.c = 0')} / len(m)"),
    }]


def referee() -> list[dict[str, str]]:
    by = BEFORE.replace("BY team", "BY referee")
    past = lambda of, where: f"coalesce(list({of}) FILTER ({where}) {by}, [])"
    return [{"f": past("fouls", "fouls IS NOT NULL"), "y": past("yellows", "yellows IS NOT NULL"), "w": past("(home_points = 3)::INT", "true")},
            {n: f"CASE WHEN referee IS NOT NULL THEN {e} END" for n, e in (("referee_avg_fouls", "list_avg(f)"), ("referee_avg_yellows", "list_avg(y)"), ("referee_home_bias", "list_avg(w) - 0.46"))}]


def strengths() -> list[dict[str, str]]:
    last = lambda of: f"CASE WHEN len({of}) > 4 THEN list_avg({of}[-10:]) END"
    return [{"g": _list("gf"), "c": _list("ga")}, {"attack": last("g"), "defence": last("c")}]


def poisson() -> list[dict[str, str]]:
    goals, l1, l2 = "[1, 1, 2, 6, 24, 120]", "poisson_home_lambda", "poisson_away_lambda"
    known = lambda value: f"CASE WHEN attack_home IS NOT NULL AND attack_away IS NOT NULL THEN {value} END"
    chance = lambda on: f"(SELECT sum(({on})::INT * exp(-{l1} - {l2}) * {l1} ** h * {l2} ** a / ({goals}[h + 1] * {goals}[a + 1])) FROM range(6) i(h), range(6) j(a))"
    rates = {l1: known("greatest(1.1 * attack_home * defence_away / 1.35, 0.3)"), l2: known("greatest(0.9 * attack_away * defence_home / 1.35, 0.2)")}
    shown = {"home_win": "h > a", "draw": "h = a", "away_win": "h < a", "over25": "h + a >= 3", "btts": "least(h, a) > 0"}
    return [rates, {"poisson_total_lambda": f"{l1} + {l2}", "poisson_diff": f"{l1} - {l2}", **{f"poisson_{n}": chance(on) for n, on in shown.items()}}]
