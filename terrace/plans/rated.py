"""SQL twins of R1-R3: a recursion whose step takes the next match of every league at once,
with lists by team as state."""

from __future__ import annotations

from terrace.plans import steps
from terrace.sources import contest as source

TEAMS = 25
#: Goals as a score, the margin and the home team's expectation, as the formulas need them.
_RESULT = "CASE WHEN gh > ga THEN 1.0::DOUBLE WHEN gh < ga THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END"


def _set(lists: str, home: str, away: str) -> str:
    return f"list_transform({lists}, lambda x, i: CASE WHEN i = h + 1 THEN {home} WHEN i = a + 1 THEN {away} ELSE x END)"


def _recursion(start: dict[str, str], turn: dict[str, str], layers: list[dict[str, str]], after: dict[str, str], out: dict[str, str]) -> str:
    """start: the state's lists before any match; turn: those at a new season; layers: what a
    step computes; after: the state after it; out: the columns of a match."""
    keep, shown = ", ".join(start), ", ".join(out)
    turned = ", ".join(f"CASE WHEN s.season <> m.season THEN {turn[n]} ELSE s.{n} END AS {n}" if n in turn else f"s.{n}" for n in start)
    step = steps.sql(f"SELECT m.league, m.k, m.season, m.match_id, m.h, m.a, m.gh, m.ga, {turned} FROM s JOIN m ON m.league = s.league AND m.k = s.k + 1", *layers)
    first = ", ".join(f"{e} AS {n}" for n, e in start.items())
    nothing = ", ".join(f"NULL::DOUBLE AS {n}" for n in out)
    return f"""WITH RECURSIVE m AS (SELECT league, season, match_id, home_team AS h, away_team AS a, goals_home AS gh, goals_away AS ga, row_number() OVER (PARTITION BY league ORDER BY match_date, match_id) AS k FROM ({source.COMPETITIONS_SQL})),
s AS (SELECT league, 0::BIGINT AS k, NULL::INT AS season, NULL::BIGINT AS match_id, {first}, {nothing} FROM (SELECT DISTINCT league FROM m)
UNION ALL SELECT league, k, season, match_id, {', '.join(f'{e} AS {n}' for n, e in after.items())}, {', '.join(f'{e} AS {n}' for n, e in out.items())} FROM ({step}))
SELECT match_id, {shown} FROM s WHERE match_id IS NOT NULL"""


def _all(value: str) -> str:
    return f"list_transform(range({TEAMS}), lambda t: {value})"


def elo_sql() -> str:
    mood = lambda t: f"coalesce(list_avg(moves[{t} + 1]), 0)"
    layers = [{"rh": "r[h + 1]", "ra": "r[a + 1]", "mh": mood("h"), "ma": mood("a")}, {"edge": "rh - ra + 65"},
              {"move": f"20 * (1 + 0.7::DOUBLE * ln(1 + abs(gh - ga))) * ({_RESULT} - 1 / (1 + pow(10::DOUBLE, -edge / 400)))"}]
    keep = lambda t, sign: f"list_concat(x, [{sign}move])[-5:]"
    after = {"r": _set("r", "x + move", "x - move"), "moves": _set("moves", keep("h", ""), keep("a", "-"))}
    out = {"elo_home": "rh", "elo_away": "ra", "elo_diff": "edge", "elo_momentum_home": "mh", "elo_momentum_away": "ma", "elo_momentum_diff": "mh - ma"}
    return _recursion({"r": _all("1500::DOUBLE"), "moves": _all("[]::DOUBLE[]")}, {"r": "list_transform(s.r, lambda x: x + 0.1::DOUBLE * (1500 - x))"}, layers, after, out)


def pi_sql() -> str:
    layers = [{"x1": "ha[h + 1]", "x2": "hd[h + 1]", "x3": "aa[a + 1]", "x4": "ad[a + 1]"}, {"lh": "x1 - x4", "la": "x3 - x2"},
              {"eh": "greatest(0.1::DOUBLE, 1.36::DOUBLE * exp(lh))", "ea": "greatest(0.1::DOUBLE, 1.36::DOUBLE * exp(la))"},
              {"dh": "0.05::DOUBLE * (gh - eh) / greatest(eh, 0.5)", "da": "0.05::DOUBLE * (ga - ea) / greatest(ea, 0.5)"}]
    one = lambda n, t, v: f"list_transform({n}, lambda x, i: CASE WHEN i = {t} + 1 THEN x {v} ELSE x END)"
    after = {"ha": one("ha", "h", "+ dh"), "hd": one("hd", "h", "- 0.6::DOUBLE * da"), "aa": one("aa", "a", "+ da"), "ad": one("ad", "a", "- 0.6::DOUBLE * dh")}
    out = {"pi_home_attack": "x1", "pi_home_defense": "x2", "pi_away_attack": "x3", "pi_away_defense": "x4", "pi_rating_home": "lh", "pi_rating_away": "la", "pi_diff": "lh - la"}
    return _recursion(dict.fromkeys(("ha", "hd", "aa", "ad"), _all("1::DOUBLE")), {}, layers, after, out)


def glicko_sql() -> str:
    s = "173.7178::DOUBLE"

    def updated(n: str, own: tuple[str, str, str], other: tuple[str, str], score: str) -> list[dict[str, str]]:
        mu, rd, vol = own
        newton = f"w - exp(w) * ({n}q * {n}q / pow({n}b + exp(w), 2) - 1) / (2 * ({n}b + exp(w))) / (-4 - exp(w) * {n}b / (2 * pow({n}b + exp(w), 2)))"
        return [
            {f"{n}g": f"1 / sqrt(1 + 3 * pow({other[1]} / {s}, 2) / pow(pi(), 2))"},
            {f"{n}e": f"1 / (1 + exp(-{n}g * ({mu} - {other[0]}) / {s}))"},
            {f"{n}i": f"{n}g * {n}g * {n}e * (1 - {n}e)"},
            {f"{n}v": f"1 / greatest({n}i, 1e-6::DOUBLE)"},
            {f"{n}q": f"{n}v * {n}g * ({score} - {n}e)", f"{n}b": f"pow({rd} / {s}, 2) + {n}v"},
            {f"{n}vol": f"least(0.2::DOUBLE, greatest(0.01::DOUBLE, exp(list_reduce(list_concat([ln({vol} * {vol})], list_transform(range(20), lambda t: 0::DOUBLE)), lambda w, z: {newton}) / 2)))"},
            {f"{n}new": f"1 / sqrt(1 / ({rd} * {rd} + {n}vol * {n}vol) + {n}i)"},
            {f"{n}mu": f"{mu} + {n}new * {n}g * ({score} - {n}e) * {s}", f"{n}rd": f"least({n}new, 200::DOUBLE)"},
        ]

    layers = [{"score": _RESULT, **{f"{t}{c}": f"{n}[{t} + 1]" for t in "ha" for c, n in (("m", "mu"), ("r", "rd"), ("v", "vol"))}}]
    layers += updated("p", ("hm", "hr", "hv"), ("am", "ar"), "score") + updated("q", ("am", "ar", "av"), ("pmu", "prd"), "(1 - score)")
    after = {"mu": _set("mu", "pmu", "qmu"), "rd": _set("rd", "prd", "qrd"), "vol": _set("vol", "pvol", "qvol")}
    trust = {"home": "hm / greatest(hr, 10)", "away": "am / greatest(ar, 10)"}
    out = {"glicko_mu_home": "hm", "glicko_mu_away": "am", "glicko_rd_home": "hr", "glicko_rd_away": "ar", "glicko_vol_home": "hv", "glicko_vol_away": "av", "glicko_mu_diff": "hm - am", "glicko_rd_diff": "hr - ar",
           **{f"glicko_confidence_{t}": e for t, e in trust.items()}, "glicko_confidence_diff": f"{trust['home']} - {trust['away']}"}
    start = {"mu": _all("1500::DOUBLE"), "rd": _all("200::DOUBLE"), "vol": _all("0.06::DOUBLE"), "seen": _all("false")}
    # Only teams that have played widen at a new season; for the others rd is at its cap already.
    return _recursion(start, {"rd": "list_transform(s.rd, lambda x, i: least(200::DOUBLE, sqrt(x * x + 100 * s.vol[i] * s.vol[i])))"}, layers, after | {"seen": "seen"}, out)
