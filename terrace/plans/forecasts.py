"""Scores and thresholds of forecasts that the goal model makes (M3), against the market's own
chances: the same operators as on made-up ones, their SQL written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import columns, metrics
from terrace.operators import aggregates, decisions
from terrace.plans import steps
from terrace.sources import contest as source
from terrace.sources.staging import Staged

GOALS = "m03_goal_model"


def register(queries: dict, oracles: dict) -> None:
    def forecast(spark: SparkSession, d: str) -> DataFrame:
        games = source.contest(spark, d)
        market = games.selectExpr("match_id", "result", "1 / odds_home_open AS a", "1 / odds_draw_open AS b", "1 / odds_away_open AS c")
        shares = market.selectExpr("match_id", "CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS outcome", *[f"round({x} / (a + b + c), 6) AS market_{o}" for x, o in zip("abc", ("home", "draw", "away"))])
        made = queries[GOALS](spark, d).select("match_id", "p_home", "p_draw", "p_away").join(shares, "match_id")
        return Staged(made, "forecasts").rows  # each score reads them several times

    base = f"""SELECT match_id, p_home, p_draw, p_away, list_position(['H', 'D', 'A'], result) - 1 AS outcome, round((1 / odds_home_open) / t, 6) AS market_home, round((1 / odds_draw_open) / t, 6) AS market_draw, round((1 / odds_away_open) / t, 6) AS market_away
    FROM (SELECT *, 1 / odds_home_open + 1 / odds_draw_open + 1 / odds_away_open AS t FROM ({source.CONTEST_SQL})) JOIN ({oracles[GOALS]}) USING (match_id)"""
    f = f"f AS ({base}), q AS (SELECT *, list_position([p_home, p_draw, p_away], greatest(p_home, p_draw, p_away)) - 1 AS pick, greatest(p_home, p_draw, p_away) AS top FROM f)"

    def add(name, query, oracle, final):
        queries[name] = lambda spark, d: query(forecast(spark, d)).selectExpr(*final)
        oracles[name] = steps.final_sql(oracle, final)

    long = "UNION ALL ".join(f"SELECT {i} AS k, p_{o} AS p, (outcome = {i})::INT AS hit FROM f " for i, o in enumerate(("home", "draw", "away")))
    add("m08_goal_forecasts", metrics.summary,
        f"""WITH {f}, l AS ({long}), e AS (SELECT sum(abs(gap)) AS gap FROM (SELECT sum(p - hit) AS gap FROM l WHERE p < 1 GROUP BY k, CAST(floor(p * 10) AS INT)))
        SELECT count(*) AS n, avg((pick = outcome)::INT) AS accuracy, avg((p_home - (outcome = 0)::INT) ** 2 + (p_home + p_draw - (outcome <= 1)::INT) ** 2) / 2 AS rps, avg((p_home - (outcome = 0)::INT) ** 2 + (p_home + p_draw - (outcome <= 1)::INT) ** 2) / 3 AS rps_ref,
        avg(-ln(greatest([p_home, p_draw, p_away][outcome + 1], 1e-15))) AS log_loss, any_value(gap) / (3 * count(*)) AS ece FROM q, e""",
        steps.rounded(["n"], ["accuracy", "rps", "rps_ref", "log_loss", "ece"]))
    add("m09_goal_draws", metrics.draw_thresholds,
        f"WITH {f} SELECT t, avg((outcome = CASE WHEN floor(p_draw * 200 + 1e-9) >= t THEN 1 ELSE CASE WHEN p_away > p_home THEN 2 ELSE 0 END END)::INT) AS accuracy FROM q, range(30, 91) g(t) GROUP BY t", steps.rounded(["t"], ["accuracy"]))
    add("m20_goal_wins", lambda df: metrics.binary_thresholds(df.withColumn("y", (F.col("outcome") == 0).cast("int")), "p_home", "y"),
        f"""WITH {f}, c AS (SELECT t, floor(p_home * 100 + 1e-9) >= t AS called, outcome = 0 AS won FROM q, range(30, 71) g(t))
        SELECT t, avg(won::INT) FILTER (called) AS precision, avg(called::INT) FILTER (won) AS recall, 2 * count(*) FILTER (called AND won) / nullif(count(*) FILTER (called) + count(*) FILTER (won), 0) AS f1, avg((called = won)::INT) AS accuracy FROM c GROUP BY t""",
        steps.rounded(["t"], ["precision", "recall", "f1", "accuracy"]))
    add("m22_goal_value", metrics.value_picks,
        f"WITH {f} SELECT pick, count(*) AS n, avg((pick = outcome)::INT) AS accuracy, avg(top) AS mean_p FROM q WHERE top - [market_home, market_draw, market_away][pick + 1] > 0.1 GROUP BY pick", steps.rounded(["pick", "n"], ["accuracy", "mean_p"]))
    add("l05_goal_shares", metrics.confident_share,
        f"""WITH {f}, o AS (SELECT *, row_number() OVER (ORDER BY top DESC, match_id) AS place FROM q), s AS (SELECT unnest([5, 10, 20, 30, 50, 100]) AS share)
        SELECT share, count(*) AS n, avg((pick = outcome)::INT) AS accuracy FROM s JOIN o ON place <= greatest(1, (SELECT count(*) FROM q) * share // 100) GROUP BY share""", steps.rounded(["share", "n"], ["accuracy"]))  # fmt: skip
    add("a11_goal_tiers", lambda df: aggregates.tier_accuracy(steps.columns(df, {"pick": columns.argmax("p_home", "p_draw", "p_away"), "top": "greatest(p_home, p_draw, p_away)"}, {"tier": columns.tier("top"), "correct": "CASE WHEN pick = outcome THEN CAST(1 AS DOUBLE) ELSE 0 END"})),
        f"""WITH {f}, t AS (SELECT CASE WHEN top < 0.42 THEN 'LOW' WHEN top < 0.5 THEN 'MEDIUM' WHEN top < 0.6 THEN 'HIGH' WHEN top < 0.7 THEN 'VERY HIGH' ELSE 'ELITE' END AS tier, (pick = outcome)::INT AS hit FROM q)
        SELECT tier, count(*) AS n, avg(hit) AS accuracy FROM t GROUP BY tier UNION ALL SELECT 'ALL', count(*), avg(hit) FROM t""", steps.rounded(["n"], ["accuracy"], ("tier",)))  # fmt: skip
    add("a12_goal_calibration", aggregates.calibration,
        f"WITH {f}, l AS ({long}) SELECT k, CAST(floor(p * 10) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(hit) AS rate FROM l WHERE p < 1 GROUP BY ALL HAVING count(*) >= 6", steps.rounded(["k", "bin", "n"], ["mean_p", "rate"]))
    grid = ", ".join(f"{a}::DOUBLE" for a in decisions.ALPHAS)
    add("m13_goal_fusion", decisions.fusion_search,
        f"""WITH {f}, k AS (SELECT outcome, p_home, p_draw, p_away, coalesce(market_home, 0.45) AS h, CASE WHEN market_home IS NULL THEN 0.27 ELSE market_draw END AS x, CASE WHEN market_home IS NULL THEN 0.28 ELSE market_away END AS w FROM f),
        b AS (SELECT alpha, outcome, alpha * p_home + (1 - alpha) * h / (h + x + w) AS i, alpha * p_draw + (1 - alpha) * x / (h + x + w) AS j, alpha * p_away + (1 - alpha) * w / (h + x + w) AS l FROM k, (SELECT unnest([{grid}]) AS alpha))
        SELECT alpha, avg(((i / (i + j + l) - (outcome = 0)::INT) ** 2 + ((i + j) / (i + j + l) - (outcome < 2)::INT) ** 2) / 2) AS rps, avg((list_position([i, j, l], greatest(i, j, l)) - 1 = outcome)::INT) AS accuracy FROM b GROUP BY alpha""",
        steps.rounded([], ["alpha", "rps", "accuracy"]))
