"""Queries of decision rules, learners and player news; registered by ``registry``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import players
from terrace.operators import blocks, decisions, moments, standings, training
from terrace.plans import steps
from terrace.sources import contest as source
from terrace.sources.staging import Staged

C = source.CONTEST_SQL
PROBS = {"p_home": "(30 + match_id % 41) / CAST(100 AS DOUBLE)", "p_draw": "(10 + match_id % 29) / CAST(100 AS DOUBLE)", "p_away": "(60 - match_id % 41 - match_id % 17) / CAST(100 AS DOUBLE)", "outcome": "CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END"}
MARKET = {"market_home": "CASE WHEN match_id % 10 = 0 THEN NULL ELSE (25 + match_id % 37) / CAST(100 AS DOUBLE) END", "market_draw": "(20 + match_id % 23) / CAST(100 AS DOUBLE)", "market_away": "(15 + match_id % 31) / CAST(100 AS DOUBLE)"}
LEARNED = {f"{n}_{o}": f"({k} + (match_id * {k}) % {m}) / CAST(100 AS DOUBLE)" for n, k in (("dc", 17), ("m1", 11), ("m2", 23), ("m3", 29)) for o, m in (("home", 53), ("draw", 19), ("away", 43))}
TEAMS = {"sentiment": "(team * 7 % 11 - 5) / CAST(10 AS DOUBLE)", "volume": "team * 3 % 8", "consensus": "(team * 5 % 9) / CAST(9 AS DOUBLE)", "burden": "(team % 4) / CAST(4 AS DOUBLE)"}
FORM = {"ppg_l5_home": "CASE WHEN match_id % 9 = 0 THEN NULL ELSE (match_id % 16) / CAST(5 AS DOUBLE) END", "ppg_l5_away": "(match_id % 13) / CAST(5 AS DOUBLE)"}
#: Learners that the queries below fit.
NAMES = ["logistic", "tree", "forest", "boosted", "network"]


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, for what is read several times: no executor has to hold it."""
    return Staged(df, name).rows


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """Matches with form over five, odds and weather, ordered by ``place``, and the fold. The
    matches are joined from the order tables once: what follows reads them three times."""
    matches = _kept(source.contest(spark, d), "matches")
    known = ["match_id", "dn", "match_date", "season", "home_team", "away_team", "goals_home", "goals_away", "gap_elo", "temperature", "wind_speed", "precipitation", "odds_home_open", "odds_draw_open", "odds_away_open"]
    rows = blocks.placed_form(matches.withColumn("outcome", F.expr(PROBS["outcome"])), [*known, "outcome"])
    return steps.columns(rows.where("dn IS NOT NULL"), decisions.fold())


def _oof(spark: SparkSession, d: str) -> DataFrame:
    """The learners' chances out of fold."""
    table = _kept(feature_table(spark, d), "features")
    features = training.feature_columns(table)
    state = training.clean(table.where("fold = -1"), features, "outcome")
    return training.out_of_fold(table, NAMES, state.features, state=state)


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Earlier and last-fold matches, cleaned by the earlier ones."""
    table = _kept(feature_table(spark, d), "features")
    before, last = table.where("fold < 3"), table.where("fold >= 3")
    state = training.clean(before, training.feature_columns(table), "outcome")
    return state.apply(before), state.apply(last), state.features


def _stacked(spark: SparkSession, d: str) -> DataFrame:
    return training.stacked(_oof(spark, d), NAMES)


def _voted(spark: SparkSession, d: str) -> DataFrame:
    oof = _kept(_oof(spark, d), "forecasts")
    weights = training.voting_weights(oof.where("fold < 3"), NAMES)
    return training.voted(oof.where("fold >= 3"), weights).select("match_id", "outcome", *training.P)


def _meta(spark: SparkSession, d: str) -> DataFrame:
    """Stacked chances of folds 2 and later, with the learners' chances and the answers."""
    table = _kept(feature_table(spark, d), "features")
    state = training.clean(table.where("fold = -1"), training.feature_columns(table), "outcome")
    oof = _kept(training.out_of_fold(table, NAMES, state.features, ask=True, state=state), "forecasts")
    return training.meta_stacked(oof, NAMES)


def _meta_stacked(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d).where("fold >= 3").select("match_id", "fold", "outcome", *training.P)


def _best_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """The candidate that is best on fold 2, for the folds after it."""
    weights = [f"({' + '.join(f'{n}_{o}' for n in NAMES)}) / CAST({len(NAMES)} AS DOUBLE) AS weighted_{o}" for o in decisions.SIDES]
    rows = _kept(steps.columns(_meta(spark, d).selectExpr("*", *weights), *decisions.two_class()), "candidates")
    name = decisions.chosen(rows.where("fold = 2"), ["p", "weighted", "two", "both"])
    return rows.where("fold >= 3").select("match_id", F.lit(name).alias("method"), *[F.col(f"{name}_{o}").alias(f"p_{o}") for o in decisions.SIDES])


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    oof = _kept(training.voted(_oof(spark, d), dict.fromkeys(NAMES, 1 / len(NAMES))), "forecasts")
    return training.calibrated(oof.where("fold = 2"), oof.where("fold >= 3")).select("match_id", "outcome", *training.P)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    before, last, features = _split(spark, d)
    return last.select("match_id", *features)


def _important(spark: SparkSession, d: str) -> DataFrame:
    before, _, features = _split(spark, d)
    kept = set(training.important(before, features))
    return spark.createDataFrame([(c, c in kept) for c in features], "feature string, kept boolean")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return training.adversarial_weights(*_split(spark, d))


def _goals(spark: SparkSession, d: str) -> DataFrame:
    return training.goal_forecast(*_split(spark, d))


def _family(name: str):
    """Chances of the last folds by one family of tree ensembles, fitted on the earlier ones;
    features keep their gaps."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        table = _kept(feature_table(spark, d), "features")
        model = training.fit_learner(table.where("fold < 3"), name, training.feature_columns(table))
        return training.chances(model, table.where("fold >= 3"), ["match_id", "outcome"])

    return query


def _running(by: str, first: int):
    """Chances of each fold or season by the fit on all earlier ones, from running sums."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        table = _kept(feature_table(spark, d), "features")
        state = training.clean(table.where("fold = -1"), training.feature_columns(table), "outcome")
        centre = [state.medians[c] for c in state.features]
        return moments.walk_forward(state.apply(table), state.features, by, from_=first, centre=centre)

    return query


def _two_steps(spark: SparkSession, d: str) -> DataFrame:
    return training.hierarchical(*_split(spark, d))


def _seasons(spark: SparkSession, d: str) -> DataFrame:
    table = _kept(feature_table(spark, d), "features")
    return training.walk_forward(table, training.feature_columns(table))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    weeks = standings.gameweeks(source.contest(spark, d)).select("match_id", "gameweek")
    table = _kept(training.latest_block(feature_table(spark, d).join(weeks, "match_id")), "features")
    return training.walk_forward(table, [c for c in training.feature_columns(table) if c not in ("gameweek", "block")], by="block", steps=None)


def register(queries: dict, oracles: dict) -> None:
    def pure(name, layers, whole, other):
        out = steps.rounded(["match_id", *whole], other)
        queries[name] = lambda spark, d: steps.columns(source.contest(spark, d), *layers).selectExpr(*out)
        oracles[name] = steps.final_sql(steps.sql(C, *layers), out)

    def add(name, query, oracle, final):
        queries[name] = lambda spark, d: query(spark, d).selectExpr(*final)
        oracles[name] = steps.final_sql(oracle, final)

    rules = decisions.draw_rules()
    pure("p22_draw_rules", [PROBS, MARKET, rules], list(rules), [])
    blend = decisions.adaptive_blend("dc", ["m1", "m2", "m3"])
    pure("p24_adaptive_blend", [LEARNED, *blend], ["structural_pick", "learned_pick"], ["structural_weight", *blend[-1]])
    priced = lambda s, d: steps.columns(source.contest(s, d), PROBS, MARKET)
    base = steps.sql(C, PROBS, MARKET)
    hundredths = lambda x: f"round({x} * 100, 6)"
    accuracy = lambda called: f"avg(CASE WHEN CASE WHEN {called} THEN 1 WHEN p_home >= p_away THEN 0 ELSE 2 END = outcome THEN 1.0 ELSE 0 END)"
    grid = lambda a, b: f"range({a[0]}, {a[1] + 1}) g(x), range({b[0]}, {b[1] + 1}) h(y)"
    close = f"{hundredths('abs(p_home - p_away)')} < x AND {hundredths('p_draw')} > y"
    add("m09_closeness", lambda s, d: decisions.closeness_search(priced(s, d)),
        f"SELECT x AS margin, y AS least, {accuracy(close)} AS accuracy FROM ({base}), {grid(decisions.MARGINS, decisions.CLOSE_DRAWS)} GROUP BY x, y", steps.rounded(["margin", "least"], ["accuracy"]))
    agreed = f"{hundredths('market_draw')} > x AND {hundredths('p_draw')} > y"
    add("m09_market_draws", lambda s, d: decisions.market_draw_search(priced(s, d)),
        f"SELECT x AS market, y AS model, {accuracy(agreed)} AS accuracy FROM ({base}), {grid(decisions.MARKET_DRAWS, decisions.MODEL_DRAWS)} GROUP BY x, y", steps.rounded(["market", "model"], ["accuracy"]))
    known = "market_home IS NOT NULL AND market_draw IS NOT NULL AND market_away IS NOT NULL"
    mk = {f"k_{o}": f"CASE WHEN {known} THEN market_{o} ELSE {v} END" for o, v in zip(decisions.SIDES, (0.45, 0.27, 0.28))}
    mixed = {f"b_{o}": f"alpha * p_{o} + (1 - alpha) * k_{o} / (k_home + k_draw + k_away)" for o in decisions.SIDES}
    fused = steps.sql(f"SELECT * FROM ({base}), (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in decisions.ALPHAS)}]) AS alpha)", mk, mixed, {"t": "b_home + b_draw + b_away"})
    add("m13_market_fusion", lambda s, d: decisions.fusion_search(priced(s, d)),
        f"SELECT alpha, avg((pow(b_home / t - CASE WHEN outcome <= 0 THEN 1 ELSE 0 END, 2) + pow((b_home + b_draw) / t - CASE WHEN outcome <= 1 THEN 1 ELSE 0 END, 2)) / 2) AS rps, avg(CASE WHEN CASE WHEN b_home >= b_draw AND b_home >= b_away THEN 0 WHEN b_draw >= b_away THEN 1 ELSE 2 END = outcome THEN 1.0 ELSE 0 END) AS accuracy FROM ({fused}) GROUP BY alpha",
        steps.rounded([], ["alpha", "rps", "accuracy"]))
    answers = {f"is_{o}": f"(match_id * {k} % {m}) / CAST(50 AS DOUBLE)" for o, k, m in (("home", 7, 41), ("draw", 5, 23), ("away", 3, 37))}
    ranked = "((h - (outcome = 0)::INT) ** 2 + (h + x - (outcome < 2)::INT) ** 2) / 2"
    forecasts = {"p": ("p_home", "p_draw", "p_away"), "market": ("market_home", "market_draw", "market_away"), "two": ("i / t", "j / t", "k / t"),
                 "both": tuple(f"(0.4::DOUBLE * {y} / t + 0.6::DOUBLE * p_{o}) / (0.4::DOUBLE + 0.6::DOUBLE * (p_home + p_draw + p_away))" for o, y in zip(decisions.SIDES, "ijk"))}
    long = " UNION ALL ".join(f"SELECT '{n}' AS name, outcome, {h} AS h, {x} AS x, {w} AS w FROM c" for n, (h, x, w) in forecasts.items())
    add("m13_candidates", lambda s, d: decisions.candidate_scores(steps.columns(priced(s, d), answers, *decisions.two_class()), list(forecasts)),
        f"""WITH b AS (SELECT *, match_id * 7 % 41 / 50 AS i, match_id * 5 % 23 / 50 AS j, match_id * 3 % 37 / 50 AS k FROM ({base})), c AS (SELECT *, nullif(i + j + k, 0) AS t FROM b),
        l AS (SELECT * FROM ({long}) WHERE h + x + w IS NOT NULL)
        SELECT name, count(*) AS n, avg((list_position([round(h, 9), round(x, 9), round(w, 9)], round(greatest(h, x, w), 9)) - 1 = outcome)::INT) AS accuracy, avg({ranked}) AS rps FROM l GROUP BY name""",
        steps.rounded(["n"], ["accuracy", "rps"], ("name",)))
    add("m11_folds", lambda s, d: steps.columns(decisions.ordered_place(source.contest(s, d)), decisions.fold()),
        steps.sql(f"SELECT match_id, row_number() OVER (ORDER BY dn, match_id) AS place, count(*) OVER () AS total FROM ({C})", decisions.fold()), steps.rounded(["match_id", "place", "fold"], []))
    teams = lambda s, d: steps.columns(source.read(s, d, "nation").selectExpr("n_nationkey AS team"), TEAMS)
    teams_sql = steps.sql("SELECT n_nationkey AS team FROM nation", TEAMS)
    both = lambda p: ", ".join(f"coalesce({t}.{n}, 0) AS {p}{n}_{s}" for n in TEAMS for t, s in (("h", "home"), ("a", "away")))
    joined = lambda p: f"SELECT c.*, {both(p)} FROM ({steps.sql(C, FORM)}) c LEFT JOIN ({teams_sql}) h ON h.team = home_team LEFT JOIN ({teams_sql}) a ON a.team = away_team"
    sides = lambda p: [f"{p}{n}_{s}" for n in TEAMS for s in ("home", "away")]
    add("t10_match_sentiment", lambda s, d: players.match_sentiment(source.contest(s, d), teams(s, d), list(TEAMS), ["sentiment"]),
        steps.sql(joined("live_"), {"live_sentiment_diff": "live_sentiment_home - live_sentiment_away"}), steps.rounded(["match_id"], [*sides("live_"), "live_sentiment_diff"]))
    extra = {"sentiment_diff": "sentiment_home - sentiment_away", "burden_diff": "burden_home - burden_away", **{f"sentiment_form_{s}": f"sentiment_{s} * coalesce(ppg_l5_{s}, 1.5)" for s in ("home", "away")}}
    add("t11_historical_sentiment", lambda s, d: players.historical_sentiment(steps.columns(source.contest(s, d), FORM), teams(s, d)), steps.sql(joined(""), extra), steps.rounded(["match_id"], [*sides(""), *extra]))
    queries["t05_player_impact"] = lambda s, d: players.with_players(source.read(s, d, "documents").select("doc_id", "text")).drop("text")
    queries.update({
        "m07_cleaned": _cleaned, **{f"m10_{n}": _family(n) for n in ("hist_boosted", "hist_voted", "extra_trees")}, "m11_out_of_fold": _oof, "m11_running_folds": _running("fold", 0), "m18_running_seasons": _running("season", 1995), "m12_stacked": _stacked, "m12_voted": _voted, "m12_meta_stacked": _meta_stacked, "m13_best_ensemble": _best_ensemble, "m14_calibrated": _calibrated, "m15_weights": _weights,
        "m16_important": _important, "m17_goals": _goals, "m18_seasons": _seasons, "m18_blocks": _blocks, "m21_two_steps": _two_steps,
    })
