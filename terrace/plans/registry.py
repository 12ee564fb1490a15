"""Every registered query of the contest operators, with its SQL twin."""

from __future__ import annotations

from terrace.operators import blocks, history
from terrace.plans import steps, twins
from terrace.sources import contest as source
from terrace.sources.staging import Staged

QUERIES: dict = {}
ORACLES: dict = {}


def _histories(spark, d: str, layers: list, kinds, extra=None):
    """Layers of sides: in blocks, over written matches, where kinds say how far they look back."""
    if kinds is None:
        return steps.columns(source.sides(source.contest(spark, d)), *layers)
    kept = source.contest(spark, d).select(*source.OF_SIDES)
    return blocks.histories(Staged(kept, "matches").rows, layers, kinds, extra=extra)


def _sides(name: str, spec, whole: tuple[str, ...] = (), twin=None, kinds=None, extra=None) -> None:
    """A history of both teams: name_home and name_away of each match. twin: the layers of the
    SQL, where they are written apart. kinds: what its windows look back at."""
    layers, names = spec
    final = steps.rounded(["match_id", *[f"{n}_{s}" for n in names for s in ("home", "away") if n in whole]], [f"{n}_{s}" for n in names for s in ("home", "away") if n not in whole])
    QUERIES[name] = lambda spark, d: steps.both_sides(_histories(spark, d, layers, kinds, extra), names).selectExpr(*final)
    ORACLES[name] = steps.final_sql(steps.both_sides_sql(steps.sql(source.SIDES_SQL, *(twin or layers)), names), final)


def _matches(name: str, spec, whole: tuple[str, ...] = (), twin=None) -> None:
    layers, names = spec
    final = steps.rounded(["match_id", *[n for n in names if n in whole]], [n for n in names if n not in whole])
    QUERIES[name] = lambda spark, d: steps.columns(source.contest(spark, d), *layers).selectExpr(*final)
    ORACLES[name] = steps.final_sql(steps.sql(source.CONTEST_SQL, *(twin or layers)), final)


_sides("w01_rolling_form", history.rolling_form(), twin=history.rolling_frames()[0], kinds=history.LOOKS_BACK["rolling_form"])
_sides("w03_runs", history.runs(), ("streak", "unbeaten_run", "winless_run"), twin=twins.runs())
_sides("w04_momentum", history.momentum(), ("congestion",), twin=twins.momentum(), kinds=history.LOOKS_BACK["momentum"], extra=blocks.days_before)
_sides("w05_surprise", history.surprise(), twin=twins.surprise())
_sides("w07_sequence", history.sequence(), (*[f"seq_last{i}" for i in range(1, 6)], "seq_wdl_pattern"), twin=twins.sequence(), kinds=history.LOOKS_BACK["sequence"])
_sides("w08_manager", history.manager(), ("manager_tenure", "new_manager_bounce"), twin=twins.manager())
_sides("w09_keeper", history.keeper(), ("gk_cs_streak",), twin=twins.keeper())
_sides("w11_expected_points", history.expected_points(), twin=twins.expected_points(), kinds=history.LOOKS_BACK["expected_points"])
_sides("w12_rest", history.rest(), ("rest_days", "rest_days_capped", "fresh_flag", "fatigue_flag"), twin=twins.rest(), kinds=history.LOOKS_BACK["rest"])
_sides("w13_scoring", history.scoring(), twin=twins.scoring(), kinds=history.LOOKS_BACK["scoring"])
_matches("w15_referee", history.referee(), twin=twins.referee())


def _poisson() -> None:
    layers, names = history.strengths()
    more, out = history.poisson_layers()
    final = steps.rounded(["match_id"], out)
    QUERIES["w10_poisson"] = lambda spark, d: steps.columns(steps.both_sides(_histories(spark, d, layers, history.LOOKS_BACK["strengths"]), names), *more).selectExpr(*final)
    ORACLES["w10_poisson"] = steps.final_sql(steps.sql(steps.both_sides_sql(steps.sql(source.SIDES_SQL, *twins.strengths()), names), *twins.poisson()), final)


_poisson()


def _more() -> None:
    from terrace.functions import columns
    from terrace.operators import meetings, standings

    final = steps.rounded(["match_id", "h2h_matches"], [n for n in meetings.NAMES if n != "h2h_matches"])
    QUERIES["w02_head_to_head"] = lambda spark, d: meetings.head_to_head(source.contest(spark, d)).selectExpr(*final)
    ORACLES["w02_head_to_head"] = steps.final_sql(meetings.oracle(source.CONTEST_SQL), final)
    flags = ["match_id", "n_teams", *[f"table_{c}_{s}" for c in ("pos", "pts", "gd") for s in ("home", "away")], *standings.TABLE_FLAGS]
    QUERIES["w06_league_table"] = lambda spark, d: steps.columns(standings.table_before(Staged(source.contest(spark, d), "matches").rows), standings.TABLE_FLAGS).selectExpr(*steps.rounded(flags, []))
    ORACLES["w06_league_table"] = steps.final_sql(steps.sql(standings.table_sql(source.CONTEST_SQL), standings.TABLE_FLAGS), steps.rounded(flags, []))
    weeks = steps.rounded(["match_id", "gameweek", "date_rank"], ["season_progress"])
    QUERIES["w16_gameweeks"] = lambda spark, d: standings.gameweeks(source.contest(spark, d)).selectExpr(*weeks)
    ORACLES["w16_gameweeks"] = steps.final_sql(standings.gameweeks_sql(source.CONTEST_SQL), weeks)

    def pure(name, layers, whole, other, plain=(), duck_layers=None):
        out = steps.rounded(["match_id", *whole], other, plain)
        QUERIES[name] = lambda spark, d: steps.columns(source.contest(spark, d), *layers).selectExpr(*out)
        ORACLES[name] = steps.final_sql(steps.sql(source.CONTEST_SQL, *(duck_layers or layers)), out)

    pure("p05_basic_flags", [columns.BASIC], list(columns.BASIC), [])
    ints = ["is_midweek", "month_no", "day_of_week", "is_cold", "is_hot", "is_windy"]
    pure("p08_contextual", [columns.contextual("weekday(match_date)")], ints, ["calendar_progress", "weather_impact"], duck_layers=[columns.contextual("isodow(match_date) - 1")])
    market = columns.market()
    pure("p09_market", market, ["steam_move_flag", "market_favorite"], [*market[1], *market[2], "market_entropy"])
    shin = columns.shin()
    pure("p13_shin", shin, [], [*shin[4], *shin[5]])
    rated = {
        "elo_home": "CAST(1400 + match_id % 211 AS DOUBLE)", "elo_away": "CAST(1400 + match_id % 197 AS DOUBLE)", "elo_diff": "gap_elo", "pi_diff": "(match_id % 21 - 10) / CAST(10 AS DOUBLE)",
        "elo_momentum_home": "CAST(match_id % 7 - 3 AS DOUBLE)", "elo_momentum_away": "CAST(match_id % 5 - 2 AS DOUBLE)", "elo_pre_home": "CASE WHEN match_id % 4 = 0 THEN NULL ELSE CAST(1500 + match_id % 97 AS DOUBLE) END", "elo_pre_away": "CAST(1500 + match_id % 89 AS DOUBLE)",
        "table_pos_home": "match_id % 20 + 1", "table_pos_away": "match_id % 19 + 1", "rest_home": "match_id % 15", "rest_away": "match_id % 12",
        "ppg_home_l10": "(match_id % 31) / CAST(10 AS DOUBLE)", "ppg_away_l10": "(match_id % 29) / CAST(10 AS DOUBLE)", "is_derby": "match_id % 2", "season_progress": "(match_id % 38 + 1) / CAST(38 AS DOUBLE)",
        **{f"pi_{s}_{k}": f"(match_id % {m} - 4) / CAST(10 AS DOUBLE)" for s, k, m in (("home", "attack", 9), ("home", "defense", 8), ("away", "attack", 7), ("away", "defense", 11))},
        **{f"{n}_{s}_l5": f"CASE WHEN match_id % {m + k} = 0 THEN NULL ELSE (match_id % {m}) / CAST(5 AS DOUBLE) END" for n, m in (("ppg", 16), ("goals_scored", 14), ("goals_conceded", 13), ("clean_sheets", 6)) for k, s in ((3, "home"), (5, "away"))},
    }
    inter = columns.interactions()
    whole = ["rest_diff", "rating_concordance", "elo_agreement"]
    pure("p10_interactions", [rated, inter], whole, [n for n in inter if n not in whole])
    probs = {"p_home": "(20 + match_id % 53) / CAST(100 AS DOUBLE)", "p_draw": "(match_id % 31) / CAST(100 AS DOUBLE)", "p_away": "(15 + match_id % 47) / CAST(100 AS DOUBLE)"}
    mix = columns.blend()
    pure("p25_blend_and_tier", [*shin, probs, *mix], ["pick"], ["blend_home", "blend_draw", "blend_away", "top_prob"], ("tier",))
    live = {f"{n}_{s}": f"(match_id % {m + k}) / CAST({m} AS DOUBLE)" for n, m in (("sentiment", 11), ("injury", 7), ("instability", 13)) for k, s in ((0, "home"), (2, "away"))}
    pure("p23_live_adjustment", [probs, live, *columns.live_adjustment()], [], ["live_home", "live_draw", "live_away"])


_more()

#: Side tables that the driver's tables lack, from keys alone; the same text for both engines
#: but for the form of a date series.
_PROBS = {"p_home": "(30 + match_id % 41) / CAST(100 AS DOUBLE)", "p_draw": "(10 + match_id % 17) / CAST(100 AS DOUBLE)", "p_away": "(60 - match_id % 41 - match_id % 17) / CAST(100 AS DOUBLE)", "outcome": "CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END"}
_SNAP = "CAST(1300 + (team * 37 + month(snapshot_date) * 11) % 300 AS DOUBLE)"


def _relational() -> None:
    from pyspark.sql import functions as F

    from terrace.functions import columns
    from terrace.operators import aggregates, joins

    C, S = source.CONTEST_SQL, source.SIDES_SQL

    def add(name, query, oracle, final):
        QUERIES[name] = lambda spark, d: query(spark, d).selectExpr(*final)
        ORACLES[name] = steps.final_sql(oracle, final)

    def xg_side(spark, d):
        keep = source.contest(spark, d)
        return keep.select("match_date", "home_team", "away_team", F.col("xg_home").alias("us_home"), F.col("xg_away").alias("us_away"))

    add("j01_expected_goals", lambda s, d: joins.with_side_table(source.contest(s, d), xg_side(s, d), ["match_date", "home_team", "away_team"]),
        f"WITH c AS ({C}), u AS (SELECT match_date, home_team, away_team, xg_home AS us_home, xg_away AS us_away, row_number() OVER (PARTITION BY match_date, home_team, away_team ORDER BY xg_home NULLS FIRST, xg_away NULLS FIRST) AS k FROM c) SELECT match_id, us_home, us_away FROM c LEFT JOIN (SELECT * FROM u WHERE k = 1) USING (match_date, home_team, away_team)",
        steps.rounded(["match_id"], ["us_home", "us_away"]))

    def snapshots(spark, d):
        """At each month's end the ratings of the teams that played in it; a team that did not has none."""
        return source.sides(source.contest(spark, d)).selectExpr("last_day(match_date) AS snapshot_date", "team").distinct().selectExpr("*", f"{_SNAP} AS elo")

    snap_sql = f"SELECT *, {_SNAP} AS elo FROM (SELECT DISTINCT last_day(match_date) AS snapshot_date, team FROM ({S}))"
    add("j03_as_of_ratings", lambda s, d: joins.as_of_ratings(source.contest(s, d), snapshots(s, d)),
        f"WITH c AS ({C}), sn AS ({snap_sql}), ds AS (SELECT DISTINCT snapshot_date AS sd FROM sn) SELECT match_id, h.elo AS elo_pre_home, a.elo AS elo_pre_away FROM c ASOF LEFT JOIN ds ON match_date >= sd LEFT JOIN sn h ON h.snapshot_date = sd AND h.team = home_team LEFT JOIN sn a ON a.snapshot_date = sd AND a.team = away_team",
        steps.rounded(["match_id"], ["elo_pre_home", "elo_pre_away"]))
    pairs = lambda s, d: source.read(s, d, "nation").selectExpr("n_nationkey AS a", "(n_nationkey * 7 + 3) % 25 AS b")
    add("j05_derby", lambda s, d: joins.derby(source.contest(s, d), pairs(s, d)),
        f"WITH c AS ({C}), p AS (SELECT DISTINCT least(n_nationkey, (n_nationkey * 7 + 3) % 25) AS lo, greatest(n_nationkey, (n_nationkey * 7 + 3) % 25) AS hi FROM nation) SELECT match_id, CASE WHEN lo IS NULL THEN 0 ELSE 1 END AS is_derby FROM c LEFT JOIN p ON least(home_team, away_team) = lo AND greatest(home_team, away_team) = hi",
        steps.rounded(["match_id", "is_derby"], []))
    lat = [f"latest_{c}_{v}" for c in ("gf", "pts") for v in ("home", "away")]
    lats = ", ".join(f"coalesce(arg_max({c}, (match_date, match_id)) FILTER (is_home = {k}), arg_max({c}, (match_date, match_id))) AS latest_{c}_{v}" for c in ("gf", "pts") for k, v in ((1, "home"), (0, "away")))
    add("j08_latest_by_venue", lambda s, d: joins.latest(source.sides(source.contest(s, d)), ["gf", "pts"]), f"SELECT team, {lats} FROM ({S}) GROUP BY team", steps.rounded(["team", *lat], []))
    add("j09_promoted", lambda s, d: joins.newcomers(source.read(s, d, "orders").selectExpr("year(o_orderdate) AS season", "o_custkey"), "season", "o_custkey"),
        "WITH p AS (SELECT DISTINCT year(o_orderdate) AS season, o_custkey AS team FROM orders) SELECT season, team FROM p WHERE season > (SELECT min(season) FROM p) AND (season - 1, team) NOT IN (SELECT season, team FROM p)", steps.rounded(["season", "team"], []))
    live = lambda s, d: source.contest(s, d).selectExpr("match_id", "sot_home AS shots_home", "sot_away AS temperature")
    add("j10_live_override", lambda s, d: joins.override(source.contest(s, d).select("match_id", "shots_home", "temperature"), live(s, d), "match_id", ["shots_home", "temperature"], ("shots",)),
        f"WITH c AS ({C}) SELECT c.match_id, coalesce(l.sot_home, c.shots_home) AS shots_home, coalesce(c.temperature, l.sot_away) AS temperature FROM c LEFT JOIN c l USING (match_id)",
        steps.rounded(["match_id"], ["shots_home", "temperature"]))
    add("l03_first_of_pair", lambda s, d: joins.first_of_pair(source.contest(s, d)),
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY home_team, away_team ORDER BY match_date, match_id) AS k FROM ({C})) WHERE k = 1", steps.rounded(["match_id", "home_team", "away_team"], []))
    add("l07_union_ragged", lambda s, d: joins.union_ragged(source.contest(s, d).where("match_id % 2 = 0").select("match_id", "goals_home"), source.contest(s, d).where("match_id % 2 = 1").select("match_id", "xg_home")),
        f"WITH c AS ({C}) SELECT match_id, goals_home, NULL AS xg_home FROM c WHERE match_id % 2 = 0 UNION ALL SELECT match_id, NULL, xg_home FROM c WHERE match_id % 2 = 1", steps.rounded(["match_id", "goals_home"], ["xg_home"]))
    add("a01_team_totals", lambda s, d: aggregates.team_totals(source.sides(source.contest(s, d))),
        f"SELECT team, sum(gf) AS goals_for, sum(ga) AS goals_against, count(*) AS games, min(dn) AS first_dn, max(dn) AS last_dn FROM ({S}) GROUP BY team", steps.rounded(["team", "goals_for", "goals_against", "games", "first_dn", "last_dn"], []))
    add("a03_injury_burden", lambda s, d: aggregates.share_of_largest(source.read(s, d, "supplier").where("s_acctbal < 2000").groupBy("s_nationkey").agg(F.count("*").alias("injuries")), "s_nationkey", "injuries"),
        "SELECT s_nationkey, count(*) AS injuries, count(*) / greatest(max(count(*)) OVER (), 1) AS burden FROM supplier WHERE s_acctbal < 2000 GROUP BY 1", steps.rounded(["s_nationkey", "injuries"], ["burden"]))
    probe = ["xg_home", "shots_home", "temperature", "odds_home_open", "goals_home"]
    live_cols = [*[f"{n}_l{w}" for w in history.ROLLING_WINDOWS for n in ("ppg", "goals_scored", "goals_conceded", "clean_sheets", "btts_pct", "over25_pct", "win_pct", "draw_pct", "loss_pct")],
                 *[f"{s}_{n}_l{w}" for s in ("home", "away") for w in history.ROLLING_WINDOWS for n in ("ppg", "gf", "ga", "cs")], "volatility", "goal_trend", "defense_trend", "points_velocity", "weighted_streak"]
    add("a07_live_season", lambda s, d: aggregates.live_season(source.sides(source.contest(s, d))), aggregates.live_season_sql(S), steps.rounded(["team", "total_matches", "table_pts", "table_gd", "total_gf", "total_ga", "table_pos"], live_cols))
    long = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS x FROM c" for c in probe)
    add("a08_profile", lambda s, d: aggregates.profile(source.contest(s, d), probe),
        f"WITH c AS ({C}), l AS ({long}) SELECT name, count(x) AS n, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99, var_samp(x) AS variance FROM l GROUP BY name",
        steps.rounded(["n"], ["median", "q01", "q99", "variance"], ("name",)))
    cors = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM c" for i, a in enumerate(probe) for b in probe[i + 1 :])
    add("a09_correlations", lambda s, d: aggregates.correlations(source.contest(s, d), probe), f"WITH c AS ({C}) {cors}", steps.rounded([], ["r"], ("a", "b")))
    add("a10_class_shares", lambda s, d: aggregates.frequencies(source.contest(s, d), "result"), f"SELECT result, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ({C}) GROUP BY result", steps.rounded(["n"], ["share"], ("result",)))
    tiers = [_PROBS, {"pick": columns.argmax("p_home", "p_draw", "p_away"), "top": "greatest(p_home, p_draw, p_away)"}, {"tier": columns.tier("top"), "correct": "CASE WHEN pick = outcome THEN CAST(1 AS DOUBLE) ELSE 0 END"}]
    add("a11_tier_accuracy", lambda s, d: aggregates.tier_accuracy(steps.columns(source.contest(s, d), *tiers)),
        f"SELECT coalesce(tier, 'ALL') AS tier, count(*) AS n, avg(correct) AS accuracy FROM ({steps.sql(C, *tiers)}) GROUP BY ROLLUP (tier)", steps.rounded(["n"], ["accuracy"], ("tier",)))
    cal = " UNION ALL ".join(f"SELECT {i} AS k, {p} AS p, CASE WHEN outcome = {i} THEN 1.0 ELSE 0.0 END AS hit FROM c" for i, p in enumerate(("p_home", "p_draw", "p_away")))
    add("a12_calibration", lambda s, d: aggregates.calibration(steps.columns(source.contest(s, d), _PROBS)),
        f"WITH c AS ({steps.sql(C, _PROBS)}), l AS ({cal}) SELECT k, CAST(floor(p * 10) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(hit) AS rate FROM l WHERE p >= 0 AND p < 1 GROUP BY 1, 2 HAVING count(*) > 5",
        steps.rounded(["k", "bin", "n"], ["mean_p", "rate"]))
    models = {"m1": "match_id % 3", "m2": "(match_id + 1) % 3", "m3": "match_id % 2", "m4": "(match_id // 7) % 3", "m5": "match_id % 5 % 3"}
    spark_models = models | {"m4": "(match_id div 7) % 3"}
    cnt = lambda v: "(" + " + ".join(f"CASE WHEN {m} = {v} THEN 1 ELSE 0 END" for m in models) + ")"
    vote = "CASE " + " ".join(f"WHEN {cnt(m)} = greatest({cnt(0)}, {cnt(1)}, {cnt(2)}) THEN {m}" for m in models) + " END"
    add("a16_votes", lambda s, d: aggregates.votes(steps.columns(source.contest(s, d), spark_models), list(models)),
        steps.sql(C, models, {"vote": vote}, {"agreement": f"{cnt('vote')} / 5"}), steps.rounded(["match_id", "vote"], ["agreement"]))


_relational()


def _models() -> None:
    from pyspark.sql import functions as F

    from terrace.functions import metrics, text
    from terrace.operators import goals, ratings
    from terrace.plans import rated

    C = source.CONTEST_SQL

    def add(name, query, oracle, final):
        QUERIES[name] = lambda spark, d: query(spark, d).selectExpr(*final)
        ORACLES[name] = steps.final_sql(oracle, final)

    forecast = lambda s, d: steps.columns(source.contest(s, d), _PROBS, {"market_home": "p_away", "market_draw": "p_draw", "market_away": "p_home"})
    P = steps.sql(C, _PROBS, {"pick": "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END"})
    r2 = "(pow(p_home - CASE WHEN outcome <= 0 THEN 1 ELSE 0 END, 2) + pow(p_home + p_draw - CASE WHEN outcome <= 1 THEN 1 ELSE 0 END, 2))"
    long = " UNION ALL ".join(f"SELECT {i} AS k, {p} AS p, CASE WHEN outcome = {i} THEN 1.0 ELSE 0.0 END AS hit FROM c" for i, p in enumerate(("p_home", "p_draw", "p_away")))
    add("m08_forecast_metrics", lambda s, d: metrics.summary(forecast(s, d)),
        f"WITH c AS ({P}), l AS ({long}), b AS (SELECT sum(gap) AS gap FROM (SELECT abs(sum(p) - sum(hit)) AS gap FROM l WHERE p >= 0 AND p < 1 GROUP BY k, floor(p * 10))) SELECT count(*) AS n, avg(CASE WHEN pick = outcome THEN 1.0 ELSE 0 END) AS accuracy, avg({r2}) / 2 AS rps, avg({r2}) / 3 AS rps_ref, avg(-ln(greatest(CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 1e-15))) AS log_loss, max(gap) / (3 * count(*)) AS ece FROM c, b",
        steps.rounded(["n"], ["accuracy", "rps", "rps_ref", "log_loss", "ece"]))
    boost = "CASE age WHEN 0 THEN 12.0 WHEN 1 THEN 5.0 WHEN 2 THEN 2.5 WHEN 3 THEN 1.2 ELSE greatest(0.1, exp(-0.4 * age)) END"
    add("m06_time_weights", lambda s, d: metrics.time_weights(source.contest(s, d)),
        f"WITH c AS (SELECT *, dense_rank() OVER (ORDER BY season DESC) - 1 AS age, max(dn) OVER () - dn AS days FROM ({C})), w AS (SELECT match_id, exp(-0.0015 * days) * {boost} AS w FROM c) SELECT match_id, w / avg(w) OVER () AS weight FROM w", steps.rounded(["match_id"], ["weight"]))
    add("m09_draw_thresholds", lambda s, d: metrics.draw_thresholds(forecast(s, d)),
        f"WITH c AS ({P}) SELECT t, avg(CASE WHEN CASE WHEN floor(p_draw * 200 + 1e-9) >= t THEN 1 WHEN p_home >= p_away THEN 0 ELSE 2 END = outcome THEN 1.0 ELSE 0 END) AS accuracy FROM c, range(30, 91) g(t) GROUP BY t", steps.rounded(["t"], ["accuracy"]))
    add("m20_binary_thresholds", lambda s, d: metrics.binary_thresholds(forecast(s, d).withColumn("y", (F.col("outcome") == 0).cast("int")), "p_home", "y"),
        f"WITH c AS (SELECT floor(p_home * 100 + 1e-9) AS l, CASE WHEN outcome = 0 THEN 1 ELSE 0 END AS y FROM ({P})), s AS (SELECT t, sum(CASE WHEN l >= t THEN y ELSE 0 END) AS tp, sum(CASE WHEN l >= t THEN 1 ELSE 0 END) AS called, sum(y) AS y, count(*) AS n FROM c, range(30, 71) g(t) GROUP BY t) SELECT t, tp / nullif(called, 0) AS precision, tp / nullif(y, 0) AS recall, 2 * tp / nullif(called + y, 0) AS f1, (n - called - y + 2 * tp) / n AS accuracy FROM s",
        steps.rounded(["t"], ["precision", "recall", "f1", "accuracy"]))
    own, mk = "CASE pick WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END", "CASE pick WHEN 0 THEN p_away WHEN 1 THEN p_draw ELSE p_home END"
    add("m22_value_picks", lambda s, d: metrics.value_picks(forecast(s, d)), f"SELECT pick, count(*) AS n, avg(CASE WHEN pick = outcome THEN 1.0 ELSE 0 END) AS accuracy, avg({own}) AS mean_p FROM ({P}) WHERE {own} - {mk} > 0.1 GROUP BY pick", steps.rounded(["pick", "n"], ["accuracy", "mean_p"]))
    add("l05_confident_share", lambda s, d: metrics.confident_share(forecast(s, d)),
        f"WITH c AS (SELECT *, row_number() OVER (ORDER BY greatest(p_home, p_draw, p_away) DESC, match_id) AS place, count(*) OVER () AS total FROM ({P})) SELECT share, count(*) AS n, avg(CASE WHEN pick = outcome THEN 1.0 ELSE 0 END) AS accuracy FROM c, (SELECT unnest([5, 10, 20, 30, 50, 100]) AS share) WHERE place <= greatest(1, floor(total * share / 100)) GROUP BY share",
        steps.rounded(["share", "n"], ["accuracy"]))
    QUERIES["m19_simulated_accuracy"] = lambda s, d: metrics.simulated_accuracy(forecast(s, d))

    for name, system, twin in (("r01_elo", ratings.Elo, rated.elo_sql()), ("r02_pi", ratings.Pi, rated.pi_sql()), ("r03_glicko", ratings.Glicko, rated.glicko_sql())):
        add(name, lambda s, d, system=system: ratings.rate(source.competitions(s, d), system), twin, steps.rounded(["match_id"], system.columns))

    # the goal model at fixed parameters, all from keys
    par = "SELECT n_nationkey AS team, (n_nationkey % 7 - 3) / CAST(10 AS DOUBLE) AS attack, (n_nationkey % 5 - 2) / CAST(8 AS DOUBLE) AS defence FROM nation"
    params = lambda s, d: source.read(s, d, "nation").selectExpr("n_nationkey AS team", "(n_nationkey % 7 - 3) / CAST(10 AS DOUBLE) AS attack", "(n_nationkey % 5 - 2) / CAST(8 AS DOUBLE) AS defence")
    home, rho, mu = 0.25, -0.05, 0.2
    out = ["lambda_home", "lambda_away", "p_home", "p_draw", "p_away", "over_2_5", "btts"]
    pm = lambda lam, k: f"exp(-{lam}) * pow({lam}, {k}) / factorial(CAST({k} AS INT))"
    tau = f"CASE WHEN h = 0 AND a = 0 THEN 1 - lh * la * {rho} WHEN h = 0 AND a = 1 THEN 1 + lh * {rho} WHEN h = 1 AND a = 0 THEN 1 + la * {rho} WHEN h = 1 AND a = 1 THEN 1 - {rho} ELSE 1 END"
    add("m03_goal_model", lambda s, d: goals.outcomes(goals.rates(source.contest(s, d), params(s, d), home, mu), rho).withColumn("top_scorelines", F.concat_ws("|", "top_scorelines")),
        f"""WITH p AS ({par}), av AS (SELECT avg(attack) AS att, avg(defence) AS dfn FROM p), c AS ({C}),
        r AS (SELECT match_id, exp({mu} + coalesce(h.attack, att) - coalesce(a.defence, dfn) + {home}) AS lh, exp({mu} + coalesce(a.attack, att) - coalesce(h.defence, dfn)) AS la FROM c CROSS JOIN av LEFT JOIN p h ON h.team = home_team LEFT JOIN p a ON a.team = away_team),
        g0 AS (SELECT match_id, lh, la, h, a, {pm('lh', 'h')} * {pm('la', 'a')} * {tau} AS p FROM r, range(8) x(h), range(8) y(a)),
        g AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY h >= 7 OR a >= 7, round(p / total, 12) DESC, h, a) AS place FROM (SELECT *, sum(p) OVER (PARTITION BY match_id) AS total FROM g0))
        SELECT match_id, max(lh) AS lambda_home, max(la) AS lambda_away, sum(CASE WHEN h > a THEN p ELSE 0 END) / sum(p) AS p_home, sum(CASE WHEN h = a THEN p ELSE 0 END) / sum(p) AS p_draw, sum(CASE WHEN h < a THEN p ELSE 0 END) / sum(p) AS p_away,
        sum(CASE WHEN h + a > 2 THEN p ELSE 0 END) / sum(p) AS over_2_5, sum(CASE WHEN h > 0 AND a > 0 THEN p ELSE 0 END) / sum(p) AS btts, string_agg(h || '-' || a, '|' ORDER BY place) FILTER (place <= 12) AS top_scorelines FROM g GROUP BY match_id""", steps.rounded(["match_id"], out, ("top_scorelines",)))  # fmt: skip
    rk = lambda c, o: f"floor(rank() OVER (ORDER BY {c} {o}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    add("m04_team_ratings", lambda s, d: goals.team_ratings(params(s, d), home, mu),
        f"SELECT *, {rk('attack', 'DESC')} AS attack_rank, {rk('defence', 'ASC')} AS defense_rank FROM (SELECT team, round(attack, 4) AS attack, round(defence, 4) AS defence, round(exp({mu} + attack + {home}), 2) AS expected_home_goals, round(exp({mu} + attack), 2) AS expected_away_goals FROM ({par}))",
        steps.rounded(["team", "attack_rank", "defense_rank"], ["attack", "defence", "expected_home_goals", "expected_away_goals"]))
    add("m05_bivariate_rates", lambda s, d: goals.bivariate_rates(source.contest(s, d)), f"SELECT avg(goals_home) AS mean_home, avg(goals_away) AS mean_away, greatest(0, 0.3 * corr(goals_home, goals_away)) AS lambda_3 FROM ({C})", steps.rounded([], ["mean_home", "mean_away", "lambda_3"]))
    QUERIES["m01_goal_model_fit"] = lambda s, d: (m := goals.GoalModel.fit(source.contest(s, d))).table(s).withColumns({"home": F.lit(m.home), "rho": F.lit(m.rho), "mu": F.lit(m.mu)})

    # news text, on documents with words that invented prose has
    lex = {**text.POSITIVE, **text.NEGATIVE, "the": 0.3, "tion": 0.5, "er": -0.2, "und": -0.4}
    hit = lambda w: f"(length(t) - length(replace(t, '{w}', ''))) / {float(len(w))}"
    hits = " + ".join(hit(w) for w in lex)
    weighed = " + ".join(f"{hit(w)} * {x}" for w, x in lex.items())
    add("t01_lexicon_score", lambda s, d: source.spread(source.read(s, d, "documents").select("doc_id", "text")).select("doc_id", text.lexicon_score("text", lex).alias("score")),
        f"SELECT doc_id, CASE WHEN {hits} > 0 THEN least(1, greatest(-1, ({weighed}) / ({hits}))) ELSE 0 END AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)", steps.rounded(["doc_id"], ["score"]))
    asp = {k: [*v, *more] for (k, v), more in zip(text.ASPECTS.items(), (["in(?:g|t)"], ["th.an"], ["[aeiou]{3}"], ["die?"], ["que"], ["ment"]))}
    n_of = lambda ps: " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN 1 ELSE 0 END" for p in ps)
    add("t02_aspects", lambda s, d: source.read(s, d, "documents").select("doc_id", *[text.aspect("text", p).alias(k) for k, p in asp.items()], text.morale("text", asp["morale"]).alias("morale_score")),
        f"SELECT doc_id, {', '.join(f'{n_of(p)} AS {k}' for k, p in asp.items())}, ({n_of(asp['morale'][:10])} - ({n_of(asp['morale'][10:])})) / greatest({n_of(asp['morale'])}, 1) AS morale_score FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)",
        steps.rounded(["doc_id", *asp], ["morale_score"]))
    fo, ag, ne, am = [*text.TERMS_FOR, "the", "of", "by the"], [*text.TERMS_AGAINST, "and", "with", "of the", "der"], [*text.NEGATORS, "in", "to"], [*text.AMPLIFIERS, "on", "die"]
    q = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
    m4 = ["sentiment", "positive", "negative", "subjectivity"]
    token_sql = f"""WITH w AS (SELECT doc_id, source, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS ws FROM documents)),
    b AS (SELECT *, coalesce(lag(w) OVER o, '') AS p, w || ' ' || coalesce(lead(w) OVER o, '') AS ph FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    f AS (SELECT *, p IN {q(ne)} AS turned, CASE WHEN p IN {q(am)} THEN 1.5 ELSE 1.0 END AS x FROM b),
    s AS (SELECT doc_id, max(n) AS n, sum(CASE WHEN w IN {q(fo)} THEN CASE WHEN turned THEN 0 ELSE x END WHEN w IN {q(ag)} AND turned THEN x * 0.5 ELSE 0 END + CASE WHEN ph IN {q(fo)} AND NOT turned THEN 1.5 WHEN ph IN {q(ag)} AND turned THEN 0.5 ELSE 0 END) AS u,
      sum(CASE WHEN w IN {q(fo)} AND turned THEN x WHEN w NOT IN {q(fo)} AND w IN {q(ag)} AND NOT turned THEN x ELSE 0 END + CASE WHEN ph IN {q(fo)} AND turned THEN 1.5 WHEN ph NOT IN {q(fo)} AND ph IN {q(ag)} AND NOT turned THEN 1.5 ELSE 0 END) AS v FROM f GROUP BY doc_id),
    r AS (SELECT doc_id, source, CASE WHEN u + v > 0 THEN round((u - v)::DOUBLE / greatest(u + v, 1), 4) ELSE 0 END AS sentiment, CASE WHEN u + v > 0 THEN round(u::DOUBLE / n, 4) ELSE 0 END AS positive, CASE WHEN u + v > 0 THEN round(v::DOUBLE / n, 4) ELSE 0 END AS negative, CASE WHEN u + v > 0 THEN round(least((u + v)::DOUBLE / (n * 0.1::DOUBLE), 1), 4) ELSE 0 END AS subjectivity FROM documents LEFT JOIN s USING (doc_id))"""
    tokens = lambda s, d: source.spread(source.read(s, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", text.token_sentiment("text", fo, ag, ne, am).alias("s")).select("doc_id", "source", "s.*")
    add("t09_token_sentiment", tokens, f"{token_sql} SELECT * FROM r", steps.rounded(["doc_id"], m4))
    add("a14_sentiment_by_team", lambda s, d: text.by_team(tokens(s, d), "source"),
        f"{token_sql} SELECT source, {', '.join(f'avg({c}) AS {c}' for c in m4)}, count(*) AS volume, CASE WHEN count(*) = 1 THEN 0.5 ELSE greatest(0, 1 - stddev_samp(sentiment)) END AS consensus FROM r GROUP BY source", steps.rounded(["volume"], [*m4, "consensus"], ("source",)))
    add("s14_feed_titles", lambda s, d: source.read(s, d, "pages").select("page_id", F.concat_ws("|", text.feed_titles("html", 0)).alias("titles"), text.short_hash("html").alias("digest")),
        "SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)[1:30], lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), '|') AS titles, sha256(html)[:16] AS digest FROM pages", steps.rounded(["page_id"], [], ("titles", "digest")))
    add("s06_event_json", lambda s, d: source.read(s, d, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k int")["k"]).alias("k_sum"), F.count("*").alias("n")),
        "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS INT)) AS k_sum, count(*) AS n FROM events GROUP BY event_type", steps.rounded(["k_sum", "n"], [], ("event_type",)))


_models()


def _rest() -> None:
    """Rows whose SQL is written apart from the query's own expressions."""
    from pyspark.sql import functions as F

    from terrace.functions import columns, metrics, text
    from terrace.operators import decisions, goals, upcoming

    C, S = source.CONTEST_SQL, source.SIDES_SQL

    def add(name, query, oracle, final):
        QUERIES[name] = lambda spark, d: query(spark, d).selectExpr(*final)
        ORACLES[name] = steps.final_sql(oracle, final)

    raw = {"odds_pin_home": "CASE WHEN match_id % 3 = 0 THEN NULL WHEN match_id % 5 = 0 THEN 'n/a' ELSE CAST(odds_home_open AS STRING) END", "odds_b365_home": "CASE WHEN match_id % 7 = 0 THEN NULL ELSE '2.5' END", "odds_wh_home": "'3.25'", "odds_b365_home_close": "CASE WHEN match_id % 2 = 0 THEN '2.75' END", "odds_avg_draw": "'3.5'"}
    add("p06_odds_priority", lambda s, d: source.contest(s, d).selectExpr("match_id", *[f"{e} AS {n}" for n, e in raw.items()]).selectExpr("match_id", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in columns.priced(set(raw)).items()]),
        f"""SELECT match_id, oh AS odds_home_open, 3.5 AS odds_draw_open, NULL AS odds_away_open, CASE WHEN match_id % 2 = 0 THEN 2.75 ELSE oh END AS odds_home_close, 3.5 AS odds_draw_close, NULL AS odds_away_close
        FROM (SELECT match_id, CASE WHEN match_id % 3 <> 0 AND match_id % 5 <> 0 AND odds_home_open IS NOT NULL THEN odds_home_open WHEN match_id % 7 <> 0 THEN 2.5 ELSE 3.25 END AS oh FROM ({C}))""",
        steps.rounded(["match_id"], [f"odds_{o}_{p}" for o in ("home", "draw", "away") for p in ("open", "close")]))
    week = {"gameweek": "CASE WHEN match_id % 10 = 0 THEN NULL ELSE match_id % 38 + 1 END", "rest_home": "CASE WHEN match_id % 4 = 0 THEN NULL ELSE match_id % 12 END", "rest_away": "match_id % 9"}
    add("p08_season_stage", lambda s, d: steps.columns(source.contest(s, d), week, columns.season_stage()),
        f"""SELECT match_id, CASE WHEN match_id % 4 = 0 THEN 7 ELSE match_id % 12 END - match_id % 9 AS rest_diff, w / 38.0 AS season_progress, (w < 6)::INT AS is_early_season, (w > 32)::INT AS is_late_season, (w > 29)::INT AS is_run_in
        FROM (SELECT match_id, CASE WHEN match_id % 10 = 0 THEN 19 ELSE match_id % 38 + 1 END AS w FROM ({C}))""",
        steps.rounded(["match_id", "rest_diff", "is_early_season", "is_late_season", "is_run_in"], ["season_progress"]))
    market = columns.market()
    add("p17_trainer_extras", lambda s, d: steps.columns(source.contest(s, d), *market[:2], {"elo_diff": "gap_elo"}, columns.trainer_extras()),
        f"""WITH o AS (SELECT match_id, gap_elo, 1 / odds_home_open AS a, 1 / odds_draw_open AS b, 1 / odds_away_open AS c, 1 / odds_home_close AS d, 1 / odds_draw_close AS e, 1 / odds_away_close AS f FROM ({C})),
        q AS (SELECT match_id, gap_elo, a / (a + b + c) AS h, b / (a + b + c) AS x, c / (a + b + c) AS w, d / (d + e + f) AS h2, e / (d + e + f) AS x2, f / (d + e + f) AS w2 FROM o)
        SELECT match_id, h2 - h AS odds_drift_home, x2 - x AS odds_drift_draw, w2 - w AS odds_drift_away, -(h * ln(greatest(h, 0.01)) + x * ln(greatest(x, 0.01)) + w * ln(greatest(w, 0.01))) AS open_market_entropy, 1 - abs(1 / (1 + 10 ** (-gap_elo / 400)) - h) AS elo_market_agree FROM q""",
        steps.rounded(["match_id"], list(columns.trainer_extras())))
    add("m05_team_strengths", lambda s, d: goals.bivariate_strengths(source.sides(source.contest(s, d))),
        f"SELECT team, avg(gf) / (SELECT avg(gf) FROM ({S})) AS attack, avg(ga) / (SELECT avg(gf) FROM ({S})) AS defence FROM ({S}) GROUP BY team", steps.rounded(["team"], ["attack", "defence"]))
    lam = {"lambda_1": "(5 + match_id % 20) / CAST(10 AS DOUBLE)", "lambda_2": "(3 + match_id % 17) / CAST(10 AS DOUBLE)", "lambda_3": "(match_id % 4) / CAST(20 AS DOUBLE)"}
    pm = lambda x, k: f"exp(-{x}) * CASE WHEN {k} = 0 THEN 1 ELSE pow({x}, {k}) END / factorial(CAST({k} AS INT))"
    add("m05_bivariate_outcomes", lambda s, d: goals.bivariate_outcomes(source.contest(s, d).selectExpr("match_id", *[f"{e} AS {n}" for n, e in lam.items()])),
        f"""WITH l AS (SELECT DISTINCT {', '.join(f'{e} AS {n}' for n, e in lam.items())} FROM ({C})), g AS (SELECT l.*, i, j, k, {pm('lambda_3', 'k')} * {pm('lambda_1', '(i - k)')} * {pm('lambda_2', '(j - k)')} AS p FROM l, range(8) a(i), range(8) b(j), range(8) c(k) WHERE k <= i AND k <= j),
        s AS (SELECT lambda_1, lambda_2, lambda_3, sum(p) FILTER (i > j) / sum(p) AS p_home, sum(p) FILTER (i = j) / sum(p) AS p_draw, sum(p) FILTER (i < j) / sum(p) AS p_away FROM g GROUP BY 1, 2, 3)
        SELECT match_id, p_home, p_draw, p_away FROM (SELECT match_id, {', '.join(f'{e} AS {n}' for n, e in lam.items())} FROM ({C})) JOIN s USING (lambda_1, lambda_2, lambda_3)""",
        steps.rounded(["match_id"], ["p_home", "p_draw", "p_away"]))
    add("p28_best_score", lambda s, d: source.contest(s, d).selectExpr("match_id", "CAST(match_id % 3 AS INT) AS outcome", "CASE WHEN match_id % 5 = 0 THEN array('2-0', '1-0') ELSE array('1-1', '0-2', '2-1', '1-3') END AS scores").withColumn("score", goals.best_score("scores", "outcome")),
        f"SELECT match_id, CASE WHEN match_id % 5 = 0 THEN '2-0' WHEN match_id % 3 = 0 THEN '2-1' WHEN match_id % 3 = 1 THEN '1-1' ELSE '0-2' END AS score FROM ({C})", steps.rounded(["match_id"], [], ("score",)))
    chances = {"p_home": "(30 + match_id % 41) / CAST(120 AS DOUBLE)", "p_draw": "(10 + match_id % 29) / CAST(120 AS DOUBLE)", "p_away": "(60 - match_id % 41 + match_id % 17) / CAST(120 AS DOUBLE)", "outcome": "CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END",
               "market_home": "CASE WHEN match_id % 10 = 0 THEN NULL ELSE (25 + match_id % 37) / CAST(100 AS DOUBLE) END", "market_draw": "(20 + match_id % 23) / CAST(100 AS DOUBLE)", "market_away": "(15 + match_id % 31) / CAST(100 AS DOUBLE)"}
    priced = lambda s, d: steps.columns(source.contest(s, d), chances)
    P = steps.sql(C, chances)
    pick = lambda p: f"list_position([{p}_home, {p}_draw, {p}_away], greatest({p}_home, {p}_draw, {p}_away)) - 1"
    add("m09_market_deferral", lambda s, d: steps.columns(priced(s, d), decisions.deferred()),
        f"SELECT match_id, CASE WHEN p_home < 0.45 AND p_draw < 0.45 AND p_away < 0.45 AND match_id % 10 <> 0 THEN {pick('market')} ELSE {pick('p')} END AS pick_deferred FROM ({P})", steps.rounded(["match_id", "pick_deferred"], []))
    grid = ", ".join(f"{a}::DOUBLE" for a in decisions.BLEND_SHARES)
    add("m09_super_blend", lambda s, d: decisions.super_blend(priced(s, d), ["p", "market"], 0.3),
        f"""SELECT 'p' AS first, 'market' AS second, alpha, avg(CASE WHEN t IS NOT NULL THEN (CASE WHEN round(x / t, 9) > 0.3 THEN 1 WHEN h >= w THEN 0 ELSE 2 END = outcome)::INT END) AS accuracy, avg(((h / t - (outcome = 0)::INT) ** 2 + ((h + x) / t - (outcome < 2)::INT) ** 2) / 2) AS rps
        FROM (SELECT *, h + x + w AS t FROM (SELECT outcome, alpha, alpha * p_home + (1 - alpha) * market_home AS h, alpha * p_draw + (1 - alpha) * market_draw AS x, alpha * p_away + (1 - alpha) * market_away AS w FROM ({P}), (SELECT unnest([{grid}]) AS alpha))) GROUP BY alpha""",
        steps.rounded([], ["alpha", "accuracy", "rps"], ("first", "second")))
    add("m22_agreement", lambda s, d: metrics.agreement(priced(s, d)),
        f"SELECT ({pick('p')} = {pick('market')})::INT AS agree, count(*) AS n, avg(({pick('p')} = outcome)::INT) AS accuracy FROM ({P}) WHERE match_id % 10 <> 0 GROUP BY 1", steps.rounded(["agree", "n"], ["accuracy"]))
    add("m22_decisive", lambda s, d: metrics.decisive(priced(s, d)),
        f"""SELECT margin, count(*) AS n, avg(hit) AS accuracy FROM (SELECT round(list_reverse_sort([p_home, p_draw, p_away])[1] - list_reverse_sort([p_home, p_draw, p_away])[2], 9) AS m, ({pick('p')} = outcome)::INT AS hit FROM ({P})), (SELECT unnest([{', '.join(f'{m}::DOUBLE' for m in metrics.MARGINS)}]) AS margin) WHERE m >= margin GROUP BY margin""",
        steps.rounded(["n"], ["margin", "accuracy"]))
    signals = "length(coalesce(text, '')) AS z"
    news = {"score": "CASE WHEN z % 9 = 0 THEN NULL ELSE (z % 21 - 10) / CAST(10 AS DOUBLE) END", "has_content": "CASE WHEN z % 4 = 0 THEN 0 ELSE 1 END", "injury": "z % 3", "manager": "z % 2", "transfer": "z % 4", "morale": "(z % 11 - 5) / CAST(5 AS DOUBLE)", "tactical": "CASE WHEN z % 6 = 0 THEN 1 ELSE 0 END", "key_player": "CASE WHEN z % 5 = 0 THEN 1 ELSE 0 END"}
    rates = [("injury", "injury_risk"), ("manager", "manager_instability"), ("transfer", "transfer_activity"), ("tactical", "tactical_disruption"), ("key_player", "key_player_concern")]
    add("a13_team_news", lambda s, d: text.team_news(steps.columns(source.read(s, d, "documents").selectExpr("source AS team", signals), news)),
        f"""WITH a AS ({steps.sql(f"SELECT source AS team, {signals} FROM documents", news)}), b AS (SELECT *, CASE WHEN has_content = 1 THEN score END AS c FROM a)
        SELECT team, coalesce(avg(c), 0) AS sentiment, least(1, count(c) / 10) AS confidence, count(*) AS volume, {', '.join(f'CASE WHEN count(c) > 0 THEN least(1, sum({x}) / count(*)) ELSE 0 END AS {y}' for x, y in rates)},
        CASE count(c) WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 1 - stddev_pop(c) END AS consensus, CASE WHEN count(c) > 0 THEN greatest(-1, least(1, avg(morale))) ELSE 0 END AS morale FROM b GROUP BY team""",
        steps.rounded(["volume"], ["sentiment", "confidence", *[y for _, y in rates], "consensus", "morale"], ("team",)))
    add("t07_recency", lambda s, d: source.read(s, d, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS at").withColumn("weight", text.recency("at", "2024-01-04 00:00:00")),
        "SELECT event_id, greatest(0.3, 1 - date_diff('second', ts, TIMESTAMP '2024-01-04 00:00:00') / 3600.0 / 120) AS weight FROM events", steps.rounded(["event_id"], ["weight"]))
    add("t08_injury_amplified", lambda s, d: source.read(s, d, "documents").selectExpr("doc_id", "(length(text) % 21 - 10) / CAST(10 AS DOUBLE) AS raw", "length(text) % 5 AS injuries").withColumn("score", text.amplified(F.col("raw"), F.col("injuries"))[0]).withColumn("mention", text.amplified(F.col("raw"), F.col("injuries"))[1]),
        "SELECT doc_id, greatest(-1, least(1, (length(text) % 21 - 10) / 10.0 - 0.12 * (length(text) % 5))) AS score, (length(text) % 5 > 0)::INT AS mention FROM documents", steps.rounded(["doc_id", "mention"], ["score"]))

    # every fixture turned round and put after the last season
    feats = ["gf", "ga", "xgf", "shots_f"]
    played = lambda s, d: source.sides(source.contest(s, d))
    to_come = lambda s, d: source.contest(s, d).selectExpr("match_id", "date_add(match_date, 3000) AS match_date", "away_team AS home_team", "home_team AS away_team")
    fresh = lambda s, d: source.read(s, d, "nation").selectExpr("n_nationkey AS team", "CAST(n_nationkey % 7 AS DOUBLE) AS shots_f", "CAST(n_nationkey % 5 AS INT) AS ga")
    prepared = lambda s, d: upcoming.prepare(to_come(s, d), played(s, d), feats, fresh(s, d), {"xg_estimate": "gf"}, ["odds_home_close"])
    top = lambda c, on: f"arg_max_null({c}, (match_date, match_id)) FILTER ({on})"
    venue = lambda c, at: f"coalesce(CASE WHEN bool_or(is_home = {at} AND season = m) THEN {top(c, f'is_home = {at} AND season = m')} ELSE {top(c, f'is_home = {at}')} END, {top(c, 'true')})"
    live = {"shots_f": "coalesce({0}, {1} % 7)", "ga": "coalesce({0}, {1} % 5)"}
    cols = [live.get(c, "{0}").format(f"{t}.{c}_{v}", f"{v}_team") + f" AS {c}_{v}" for c in feats for t, v in (("h", "home"), ("a", "away"))]
    add("m23_upcoming", prepared,
        f"""WITH s AS (SELECT *, max(season) OVER () AS m FROM ({S})),
        k AS (SELECT team, {', '.join(f'{venue(c, at)} AS {c}_{v}' for c in feats for at, v in ((1, 'home'), (0, 'away')))} FROM s GROUP BY team HAVING bool_or(season = m)),
        u AS (SELECT match_id, match_date + 3000 AS match_date, away_team AS home_team, home_team AS away_team FROM ({C})),
        j AS (SELECT u.*, {', '.join(cols)} FROM u LEFT JOIN k h ON h.team = home_team LEFT JOIN k a ON a.team = away_team)
        SELECT *, {', '.join(f'{c}_home - {c}_away AS {c}_diff' for c in feats)}, 0.85 * gf_home + 0.2025 AS xg_estimate_home, 0.85 * gf_away + 0.2025 AS xg_estimate_away, 0.85 * (gf_home - gf_away) AS xg_estimate_diff,
        month(match_date) AS month_no, isodow(match_date) - 1 AS day_of_week, (isodow(match_date) IN (2, 3, 4))::INT AS is_midweek, (month(match_date) IN (8, 9))::INT AS is_early_season, (month(match_date) IN (4, 5))::INT AS is_run_in, (month(match_date) IN (11, 12, 1, 2))::INT AS is_cold,
        least(((month(match_date) + 4) % 12) / 10.0, 1) AS season_progress, NULL AS odds_home_close FROM j""",
        steps.rounded(["match_id", "month_no", "day_of_week", "is_midweek", "is_early_season", "is_run_in", "is_cold"], [*[f"{c}_{x}" for c in [*feats, "xg_estimate"] for x in ("home", "away", "diff")], "season_progress", "odds_home_close"]))


_rest()


def _learning() -> None:
    from terrace.plans import forecasts, intake, learning

    learning.register(QUERIES, ORACLES)
    forecasts.register(QUERIES, ORACLES)
    intake.register(QUERIES, ORACLES)


_learning()
