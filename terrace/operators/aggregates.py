"""Sums, frequencies, quantiles, tiers, calibration, live-season statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.history import ROLLING_WINDOWS


def team_totals(sides: DataFrame) -> DataFrame:
    """A1, A5: goals, games and first and last day of each team."""
    return sides.groupBy("team").agg(
        F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"), F.count("*").alias("games"), F.min("dn").alias("first_dn"), F.max("dn").alias("last_dn")
    )


def share_of_largest(counts: DataFrame, key: str, value: str) -> DataFrame:
    """A3: value over the largest value (over 1 at least)."""
    top = counts.agg(F.greatest(F.max(value), F.lit(1)).alias("_top"))
    return counts.crossJoin(F.broadcast(top)).select(key, value, (F.col(value) / F.col("_top")).alias("burden"))


def live_season(sides: DataFrame) -> DataFrame:
    """Each team's current form: nine averages over its last 3 to 20 matches, points and
    goals by venue, volatility, trends, weighted points, totals and league place."""
    back = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("match_date"), F.desc("match_id")))
    rows = sides.withColumn("k", back("team")).withColumn("v", back("team", "is_home"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    stats = {
        "ppg": F.col("pts"), "goals_scored": F.col("gf"), "goals_conceded": F.col("ga"), "clean_sheets": one(F.col("ga") == 0), "btts_pct": one((F.col("gf") > 0) & (F.col("ga") > 0)),
        "over25_pct": one(F.col("gf") + F.col("ga") > 2), "win_pct": one(F.col("pts") == 3), "draw_pct": one(F.col("pts") == 1), "loss_pct": one(F.col("pts") == 0),
    }
    aggs = [F.avg(F.when(F.col("k") <= w, e)).alias(f"{n}_l{w}") for w in ROLLING_WINDOWS for n, e in stats.items()]
    for side, at in (("home", 1), ("away", 0)):
        here = lambda w, at=at: (F.col("is_home") == at) & (F.col("v") <= w)
        aggs += [F.avg(F.when(here(w), e)).alias(f"{side}_{n}_l{w}") for w in ROLLING_WINDOWS for n, e in (("ppg", F.col("pts")), ("gf", F.col("gf")), ("ga", F.col("ga")), ("cs", stats["clean_sheets"]))]
    upto = lambda a, b, c: F.avg(F.when(F.col("k").between(a, b), F.col(c)))
    n, weight = F.count("*"), F.when(F.col("k") <= 10, F.pow(F.lit(1.5), -F.col("k")))
    aggs += [
        n.alias("total_matches"), F.stddev_pop(F.when(F.col("k") <= 10, F.col("pts"))).alias("volatility"),
        F.when(n >= 10, upto(1, 5, "gf") - upto(6, 10, "gf")).otherwise(0.0).alias("goal_trend"), F.when(n >= 10, upto(6, 10, "ga") - upto(1, 5, "ga")).otherwise(0.0).alias("defense_trend"),
        F.when(n >= 5, upto(1, 5, "pts") - F.avg("pts")).otherwise(0.0).alias("points_velocity"), (F.sum(weight * F.col("pts")) / F.sum(weight)).alias("weighted_streak"),
        F.sum("pts").alias("table_pts"), (F.sum("gf") - F.sum("ga")).alias("table_gd"), F.sum("gf").alias("total_gf"), F.sum("ga").alias("total_ga"),
    ]
    placed = rows.groupBy("team").agg(*aggs)
    return placed.withColumn("table_pos", F.row_number().over(Window.orderBy(F.desc("table_pts"), F.desc("table_gd"), "team")))


def live_season_sql(sides_sql: str) -> str:
    one = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
    stats = {"ppg": "pts", "goals_scored": "gf", "goals_conceded": "ga", "clean_sheets": one("ga = 0"), "btts_pct": one("gf > 0 AND ga > 0"), "over25_pct": one("gf + ga > 2"), "win_pct": one("pts = 3"), "draw_pct": one("pts = 1"), "loss_pct": one("pts = 0")}
    cols = [f"avg({e}) FILTER (k <= {w}) AS {n}_l{w}" for w in ROLLING_WINDOWS for n, e in stats.items()]
    cols += [f"avg({e}) FILTER (is_home = {at} AND v <= {w}) AS {s}_{n}_l{w}" for s, at in (("home", 1), ("away", 0)) for w in ROLLING_WINDOWS for n, e in (("ppg", "pts"), ("gf", "gf"), ("ga", "ga"), ("cs", stats["clean_sheets"]))]
    u = lambda a, b, c: f"avg({c}) FILTER (k BETWEEN {a} AND {b})"
    cols += [
        "count(*) AS total_matches", "stddev_pop(pts) FILTER (k <= 10) AS volatility", f"CASE WHEN count(*) >= 10 THEN {u(1, 5, 'gf')} - {u(6, 10, 'gf')} ELSE 0 END AS goal_trend",
        f"CASE WHEN count(*) >= 10 THEN {u(6, 10, 'ga')} - {u(1, 5, 'ga')} ELSE 0 END AS defense_trend", f"CASE WHEN count(*) >= 5 THEN {u(1, 5, 'pts')} - avg(pts) ELSE 0 END AS points_velocity",
        "sum(pow(1.5, -k) * pts) FILTER (k <= 10) / sum(pow(1.5, -k)) FILTER (k <= 10) AS weighted_streak", "sum(pts) AS table_pts", "sum(gf) - sum(ga) AS table_gd", "sum(gf) AS total_gf", "sum(ga) AS total_ga",
    ]
    w = "ORDER BY match_date DESC, match_id DESC"
    return f"""SELECT *, row_number() OVER (ORDER BY table_pts DESC, table_gd DESC, team) AS table_pos FROM (SELECT team, {', '.join(cols)} FROM
    (SELECT *, row_number() OVER (PARTITION BY team {w}) AS k, row_number() OVER (PARTITION BY team, is_home {w}) AS v FROM ({sides_sql})) GROUP BY team)"""


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, median, q01, q99, variance) of each column, exact quantiles with linear
    interpolation, sample variance; nulls are skipped. One pass over a long form."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias("name", "x"))
    q = lambda p: F.percentile("x", F.lit(p))
    return long.groupBy("name").agg(F.count("x").alias("n"), q(0.5).alias("median"), q(0.01).alias("q01"), q(0.99).alias("q99"), F.var_samp("x").alias("variance"))


def league_averages(df: DataFrame, columns: list[str], season: str = "season") -> DataFrame:
    """One row with the mean of each column over the last season."""
    last = F.broadcast(df.agg(F.max(season).alias("_last")))  # one row
    return df.join(last, F.col(season) == F.col("_last")).agg(*[F.avg(c).alias(c) for c in columns])


def season_spans(df: DataFrame, key: str, season: str = "season") -> DataFrame:
    """A5: least and greatest key and the number of rows of each season."""
    return df.groupBy(season).agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count("*").alias("n"))


#: Size of a quantile sketch: it is exact up to this many values and keeps about three times as
#: many at most; ranks read from it are off by less than RANK_ERROR of all values.
SKETCH, RANK_ERROR = 65_535, 0.0002


def sketches(df: DataFrame, columns: list[str], size: int = SKETCH) -> DataFrame:
    """One row with a mergeable sketch of each column, named as it; nulls are skipped. One
    pass with map-side partial sketches, whose size does not depend on the rows."""
    return df.agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(size)).alias(c) for c in columns])


def sketch_quantiles(found: DataFrame, columns: list[str], at: tuple[float, ...] = (0.01, 0.5, 0.99)) -> DataFrame:
    """(name, n, and q01, q50, .. for each share): the least value whose rank reaches it;
    null where a column has no value."""
    rows = [F.struct(F.lit(c).alias("name"), F.kll_sketch_get_n_double(c).alias("n"), *[F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(q))).alias(f"q{round(q * 100):02d}") for q in at]) for c in columns]
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sketch_ranks(found: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """(name, value, rank): the share of a column's values that are at most the given one."""
    rows = [F.struct(F.lit(c).alias("name"), F.lit(v).cast("double").alias("value"), F.when((F.kll_sketch_get_n_double(c) > 0) & F.lit(v is not None), F.kll_sketch_get_rank_double(c, F.lit(float(v or 0)))).alias("rank")) for c, v in values.items()]
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def head_and_tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """L2: the first and the last n rows in an order, with their end and place. Each end is kept
    by tasks first, n rows a task."""
    place = F.row_number().over(Window.partitionBy("end").orderBy(*[F.col(f"k.{c}") for c in order]))
    first = df.orderBy(*order).limit(n).select(F.lit("head").alias("end"), F.struct(*order).alias("k"), *df.columns)
    last = df.orderBy(*[F.desc(c) for c in order]).limit(n).select(F.lit("tail").alias("end"), F.struct(*order).alias("k"), *df.columns)
    return first.unionByName(last).withColumn("place", place).drop("k")


def largest(df: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest value, equal ones by the named columns."""
    return df.orderBy(by.desc_nulls_last(), *ties).limit(n)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for a < b over rows where both are known; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)).cast("double"), F.when(F.col(a).isNotNull(), F.col(b)).cast("double"))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), both(a, b).alias("r")) for a, b in pairs]).alias("rows"))
    return one.select(F.explode("rows").alias("row")).select("row.*")


def frequencies(df: DataFrame, key: str) -> DataFrame:
    """A10: share of each class."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.select(key, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def tier_accuracy(df: DataFrame) -> DataFrame:
    """Matches and accuracy of each tier, and of all under 'ALL'. df: (tier, correct)."""
    return df.rollup("tier").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy")).select(F.coalesce("tier", F.lit("ALL")).alias("tier"), "n", "accuracy")


def calibration(df: DataFrame, bins: int = 10, more_than: int = 5) -> DataFrame:
    """(outcome, bin, n, mean_p, rate) of each class in half-open bins; p = 1 falls in
    none. df: (p_home, p_draw, p_away, outcome 0..2)."""
    each = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("p")) for i, c in enumerate(("p_home", "p_draw", "p_away"))])
    long = df.select(F.explode(each).alias("e"), "outcome").select("e.*", (F.col("e.k") == F.col("outcome")).cast("double").alias("hit"))
    binned = long.where("p >= 0 and p < 1").withColumn("bin", F.floor(F.col("p") * bins).cast("int"))
    return binned.groupBy("k", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("rate")).where(F.col("n") > more_than)


def votes(df: DataFrame, models: list[str]) -> DataFrame:
    """The class most models name, ties to the one named first, and its share."""
    all_ = F.array(*models)
    count = lambda v: F.size(F.filter(all_, lambda x: x == v))
    best = F.array_max(F.transform(all_, lambda v, i: F.struct(F.size(F.filter(all_, lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("v"))))
    return df.withColumn("vote", best["v"]).withColumn("agreement", count(F.col("vote")) / len(models))
