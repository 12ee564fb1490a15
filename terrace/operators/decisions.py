"""Rules that turn probabilities into picks, and searches over them.

Rows carry p_home, p_draw, p_away and, where the market is used, market_home, market_draw,
market_away; outcomes are 0 home, 1 draw, 2 away. Rules are SQL expressions over these, so a
null probability never calls a draw. A search turns rows into counts once: rows never meet
the grid, and what the grid meets is one row a pair of levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("home", "draw", "away")
#: Grids in hundredths, both ends included.
MARGINS, CLOSE_DRAWS = (3, 24), (15, 34)
MARKET_DRAWS, MODEL_DRAWS = (25, 39), (15, 34)
ALPHAS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75)

_ELSE = "WHEN p_home >= p_away THEN 0 ELSE 2 END"


def draw_rules(threshold: float = 0.28, margin: float = 0.08, least: float = 0.25, market: float = 0.3) -> dict[str, str]:
    """A draw from a threshold on, between close sides, or where the market agrees."""
    return {
        "pick_threshold": f"CASE WHEN p_draw > {threshold} THEN 1 {_ELSE}",
        "pick_close": f"CASE WHEN abs(p_home - p_away) < {margin} AND p_draw > {least} THEN 1 {_ELSE}",
        "pick_market": f"CASE WHEN market_draw > {market} AND p_draw > {least} THEN 1 {_ELSE}",
    }


def adaptive_blend(structural: str, learners: list[str]) -> list[dict[str, str]]:
    """The structural forecast ``structural``_home, _draw, _away against the mean of the
    learners'. Its weight grows when the two disagree about the winner, most when the learners
    are sure of theirs; otherwise it follows the spread between the learners."""
    from terrace.functions.columns import argmax

    n, clip = len(learners), lambda x, a, b: f"CASE WHEN {x} IS NOT NULL THEN greatest({a}, least({b}, {x})) END"
    mean = {f"mean_{o}": f"({' + '.join(f'{x}_{o}' for x in learners)}) / CAST({n} AS DOUBLE)" for o in SIDES}
    spread = {f"dev_{o}": f"sqrt(({' + '.join(f'pow({x}_{o} - mean_{o}, 2)' for x in learners)}) / CAST({n} AS DOUBLE))" for o in SIDES}
    facts = {
        "structural_pick": argmax(*[f"{structural}_{o}" for o in SIDES]), "learned_pick": argmax(*[f"mean_{o}" for o in SIDES]),
        "sure": f"greatest({structural}_home, {structural}_draw, {structural}_away)", "learned_top": "greatest(mean_home, mean_draw, mean_away)",
        "mean_dev": "(dev_home + dev_draw + dev_away) / CAST(3 AS DOUBLE)",
    }
    weight = {
        "structural_weight": f"CASE WHEN learned_top > 0.7 AND structural_pick <> learned_pick THEN {clip('0.55 + (sure - 0.5) * 0.8', 0.55, 0.75)} "
        f"WHEN structural_pick <> learned_pick AND sure > 0.5 THEN {clip('0.45 + (sure - 0.5)', 0.4, 0.6)} ELSE {clip('0.3 + (mean_dev - 0.08) * 1.5', 0.3, 0.5)} END"
    }
    mixed = {f"mixed_{o}": clip(f"structural_weight * {structural}_{o} + (1 - structural_weight) * mean_{o}", 0.02, 0.95) for o in SIDES}
    return [mean, spread, facts, weight, mixed, {f"adaptive_{o}": f"mixed_{o} / (mixed_home + mixed_draw + mixed_away)" for o in SIDES}]


def _search(df: DataFrame, a, b, a_range: tuple[int, int], b_range: tuple[int, int], called, names: tuple[str, str]) -> DataFrame:
    """Accuracy of every (x, y) of a grid when a draw is called where called(level a, x) and
    level b is above y."""
    other = F.when(F.col("p_home") >= F.col("p_away"), 0).otherwise(2)
    counts = df.groupBy(a.alias("la"), b.alias("lb")).agg(F.count("*").alias("n"), F.sum((F.col("outcome") == 1).cast("int")).alias("draws"), F.sum((other == F.col("outcome")).cast("int")).alias("plain"))
    grid = df.sparkSession.range(a_range[0], a_range[1] + 1).select(F.col("id").cast("int").alias("x")).crossJoin(df.sparkSession.range(b_range[0], b_range[1] + 1).select(F.col("id").cast("int").alias("y")))
    hit = F.when(called(F.col("la"), F.col("x")) & (F.col("lb") > F.col("y")), F.col("draws")).otherwise(F.col("plain"))
    return counts.crossJoin(F.broadcast(grid)).groupBy("x", "y").agg((F.sum(hit) / F.sum("n")).alias("accuracy")).select(F.col("x").alias(names[0]), F.col("y").alias(names[1]), "accuracy")


def _level(x):
    """ceil of hundredths: x > k / 100 exactly when its level is above k."""
    return F.coalesce(F.ceil(F.round(x * 100, 6)).cast("int"), F.lit(-1))


def closeness_search(df: DataFrame) -> DataFrame:
    """M9's second rule over its grid: margin and least, in hundredths, with accuracy."""
    gap = F.coalesce(F.floor(F.round(F.abs(F.col("p_home") - F.col("p_away")) * 100, 6)).cast("int"), F.lit(1 << 20))
    return _search(df, gap, _level(F.col("p_draw")), MARGINS, CLOSE_DRAWS, lambda level, x: level < x, ("margin", "least"))


def market_draw_search(df: DataFrame) -> DataFrame:
    """M9's third rule over its grid: market and model thresholds in hundredths."""
    return _search(df, _level(F.col("market_draw")), _level(F.col("p_draw")), MARKET_DRAWS, MODEL_DRAWS, lambda level, x: level > x, ("market", "model"))


def fusion_search(df: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(alpha, rps, accuracy) of alpha * model + (1 - alpha) * market, in one pass with
    two aggregates an alpha. A row without all market chances takes 0.45, 0.27, 0.28."""
    known = F.col("market_home").isNotNull() & F.col("market_draw").isNotNull() & F.col("market_away").isNotNull()
    market = [F.when(known, F.col(f"market_{o}")).otherwise(v) for o, v in zip(SIDES, (0.45, 0.27, 0.28))]
    rows = df.select("outcome", *[F.col(f"p_{o}").alias(f"p{i}") for i, o in enumerate(SIDES)], *[m.alias(f"m{i}") for i, m in enumerate(market)])
    rows = rows.withColumn("s", F.col("m0") + F.col("m1") + F.col("m2"))

    def scores(alpha: float):
        h, d, a = (alpha * F.col(f"p{i}") + (1 - alpha) * F.col(f"m{i}") / F.col("s") for i in range(3))
        total = h + d + a
        pick = F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)
        rps = (F.pow(h / total - (F.col("outcome") <= 0).cast("int"), 2) + F.pow((h + d) / total - (F.col("outcome") <= 1).cast("int"), 2)) / 2
        return F.struct(F.lit(alpha).alias("alpha"), F.avg(rps).alias("rps"), F.avg((pick == F.col("outcome")).cast("double")).alias("accuracy"))

    return rows.agg(F.array(*map(scores, alphas)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


UNSURE = 0.45
#: Shares of the first forecast in a blend of two.
BLEND_SHARES = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75)


def deferred(unsure: float = UNSURE) -> dict[str, str]:
    """M9: our pick, or the market's favourite where our best chance is under ``unsure`` and
    the market is known."""
    from terrace.functions.columns import argmax

    known = "market_home IS NOT NULL AND market_draw IS NOT NULL AND market_away IS NOT NULL"
    market = argmax("market_home", "market_draw", "market_away")
    return {"pick_deferred": f"CASE WHEN greatest(p_home, p_draw, p_away) < {unsure} AND {known} THEN {market} ELSE {argmax('p_home', 'p_draw', 'p_away')} END"}


def super_blend(df: DataFrame, forecasts: list[str], draw_from: float = 0.0, shares: tuple[float, ...] = BLEND_SHARES) -> DataFrame:
    """M9: (first, second, alpha, accuracy, rps) of every two of the forecasts name_home,
    name_draw, name_away, blended alpha to 1 - alpha and renormalised; a draw is called above
    draw_from (never at 0). One pass, two aggregates a blend; rows lacking a chance are left out
    of that blend."""
    def scores(first: str, second: str, alpha: float):
        h, d, a = (alpha * F.col(f"{first}_{o}") + (1 - alpha) * F.col(f"{second}_{o}") for o in SIDES)
        total = h + d + a
        other = F.when(h >= a, 0).otherwise(2)
        pick = F.when(F.round(d / total, 9) > draw_from, 1).otherwise(other) if draw_from > 0 else other
        rps = (F.pow(h / total - (F.col("outcome") <= 0).cast("int"), 2) + F.pow((h + d) / total - (F.col("outcome") <= 1).cast("int"), 2)) / 2
        hit = F.when(total.isNotNull(), (pick == F.col("outcome")).cast("double"))
        return F.struct(F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(alpha).alias("alpha"), F.avg(hit).alias("accuracy"), F.avg(rps).alias("rps"))

    pairs = [scores(x, y, alpha) for i, x in enumerate(forecasts) for y in forecasts[i + 1 :] for alpha in shares]
    return df.agg(F.array(*pairs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def two_class(stacked: str = "p", share: float = 0.4) -> list[dict[str, str]]:
    """The forecast two_home, two_draw, two_away from three answers is_home, is_draw and
    is_away, and both_*: ``share`` of it to the rest of ``stacked``_*. Null where no answer is
    above zero."""
    two = {f"two_{o}": f"is_{o} / nullif(is_home + is_draw + is_away, 0)" for o in SIDES}
    raw = {f"sum_{o}": f"{share} * two_{o} + {1 - share} * {stacked}_{o}" for o in SIDES}
    return [two, raw, {f"both_{o}": f"sum_{o} / nullif(sum_home + sum_draw + sum_away, 0)" for o in SIDES}]


def candidate_scores(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, n, accuracy, rps) of the forecasts name_home, name_draw, name_away, in one
    pass with three aggregates a forecast. Rows without an outcome or a chance are left out of
    that forecast; the earlier side wins ties (chances to 9 places)."""

    def scores(name: str):
        h, d, a = (F.col(f"{name}_{o}") for o in SIDES)
        known = (h + d + a + F.col("outcome")).isNotNull()
        rh, rd, ra = (F.round(x, 9) for x in (h, d, a))
        pick = F.when((rh >= rd) & (rh >= ra), 0).when(rd >= ra, 1).otherwise(2)
        rps = (F.pow(h - (F.col("outcome") <= 0).cast("int"), 2) + F.pow(h + d - (F.col("outcome") <= 1).cast("int"), 2)) / 2
        return F.struct(F.lit(name).alias("name"), F.count_if(known).alias("n"), F.avg(F.when(known, (pick == F.col("outcome")).cast("double"))).alias("accuracy"), F.avg(F.when(known, rps)).alias("rps"))

    return df.agg(F.array(*map(scores, names)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def chosen(df: DataFrame, names: list[str]) -> str:
    """The forecast of the highest accuracy on df, then of the lowest ranked score, then the
    first named; the first named where nothing can be scored."""
    found = {r.name: r for r in candidate_scores(df, names).collect() if r.n}
    return min((n for n in names if n in found), key=lambda n: (-found[n].accuracy, found[n].rps), default=names[0])


def best(searched: DataFrame, by: str, high: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """The first row of a search, ties by the named columns."""
    return searched.orderBy(F.desc(by) if high else F.asc(by), *ties).limit(1)


def ordered_place(df: DataFrame, day: str = "dn", key: str = "match_id") -> DataFrame:
    """df with ``place``: 1-based position by (day, key), and ``total``. Days are counted and
    summed first, so a day, not the whole table, is the largest sort."""
    days = df.groupBy(day).agg(F.count("*").alias("_n"))
    whole = Window.orderBy(day)
    ahead = days.select(day, (F.sum("_n").over(whole) - F.col("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy(day).orderBy(key))
    return df.join(ahead, day).withColumn("place", F.col("_ahead") + inside).drop("_ahead")


def fold(place: str = "place", total: str = "total", folds: int = 5) -> dict[str, str]:
    """The fold in which a row is validated (-1: only trained on). Fold k is trained on
    everything before it; the first two chunks are never validated."""
    size = f"CAST(floor({total} / CAST({folds + 1} AS DOUBLE)) AS BIGINT)"
    at = f"CAST(floor(({place} - 1 - 2 * {size}) / CAST(nullif({size}, 0) AS DOUBLE)) AS BIGINT)"
    return {"fold": f"CASE WHEN {place} - 1 >= 2 * {size} AND {at} < {folds} THEN {at} ELSE -1 END"}
