"""Forecast metrics and searches over decision rules.

Outcomes are 0 home, 1 draw, 2 away; probabilities p_home, p_draw, p_away."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = ("p_home", "p_draw", "p_away")


def rps(divisor: int = 2) -> Column:
    """Ranked probability score of a row; divisor 3 gives the variant that also averages
    over the last, always equal, class."""
    hit = lambda k: (F.col("outcome") <= k).cast("double")
    return (F.pow(F.col("p_home") - hit(0), 2) + F.pow(F.col("p_home") + F.col("p_draw") - hit(1), 2)) / divisor


def picked() -> Column:
    h, d, a = map(F.col, P)
    return F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)


def summary(df: DataFrame) -> DataFrame:
    """M8: n, accuracy, both scores, log loss and expected calibration error (half-open bins)."""
    chance = F.element_at(F.array(*P), F.col("outcome") + 1)
    scored = df.select("*", rps(2).alias("_r"), rps(3).alias("_r3"), (picked() == F.col("outcome")).cast("double").alias("_hit"), (-F.log(F.greatest(chance, F.lit(1e-15)))).alias("_ll"))
    plain = scored.agg(F.count("*").alias("n"), F.avg("_hit").alias("accuracy"), F.avg("_r").alias("rps"), F.avg("_r3").alias("rps_ref"), F.avg("_ll").alias("log_loss"))
    long = df.select("outcome", F.posexplode(F.array(*P)).alias("k", "p"))
    bins = long.where("p >= 0 and p < 1").groupBy("k", F.floor(F.col("p") * 10).alias("bin")).agg(F.sum("p").alias("s"), F.sum((F.col("outcome") == F.col("k")).cast("double")).alias("hits"))
    gap = bins.agg(F.sum(F.abs(F.col("s") - F.col("hits"))).alias("gap"))
    return plain.crossJoin(gap).select("n", "accuracy", "rps", "rps_ref", "log_loss", F.coalesce(F.col("gap") / (3 * F.col("n")), F.lit(0.0)).alias("ece"))


def time_weights(matches: DataFrame, xi: float = 0.0015) -> DataFrame:
    """Decay by days and season, divided by the mean. Seasons are few: ranked apart
    from the matches."""
    seasons = matches.select("season").distinct().withColumn("age", F.dense_rank().over(Window.orderBy(F.desc("season"))) - 1)
    boost = F.when(F.col("age") == 0, 12.0).when(F.col("age") == 1, 5.0).when(F.col("age") == 2, 2.5).when(F.col("age") == 3, 1.2).otherwise(F.greatest(F.lit(0.1), F.exp(-0.4 * F.col("age"))))
    last = matches.agg(F.max("dn").alias("_last"))
    raw = matches.join(seasons, "season").crossJoin(F.broadcast(last)).withColumn("_w", F.exp(-xi * (F.col("_last") - F.col("dn"))) * boost)
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).select("match_id", (F.col("_w") / F.col("_mean")).alias("weight"))


def draw_thresholds(df: DataFrame, low: int = 30, high: int = 90) -> DataFrame:
    """M9: accuracy when a draw is called from threshold t/200 on, for every t: counts by
    bucketed draw probability, so rows never meet the grid."""
    grid = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    other = F.when(F.col("p_home") >= F.col("p_away"), 0).otherwise(2)
    level = F.floor(F.col("p_draw") * 200 + 1e-9).cast("int")
    counts = df.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum((F.col("outcome") == 1).cast("int")).alias("draws"), F.sum((other == F.col("outcome")).cast("int")).alias("plain"))
    return grid.crossJoin(F.broadcast(counts)).groupBy("t").agg((F.sum(F.when(F.col("level") >= F.col("t"), F.col("draws")).otherwise(F.col("plain"))) / F.sum("n")).alias("accuracy"))


def binary_thresholds(df: DataFrame, p: str, label: str) -> DataFrame:
    """Precision, recall, F1 and accuracy of label at thresholds 0.30 to 0.70."""
    level = F.floor(F.col(p) * 100 + 1e-9).cast("int")
    counts = df.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(label).alias("y"))
    t = df.sparkSession.range(30, 71).select(F.col("id").cast("int").alias("t"))
    called = F.col("level") >= F.col("t")
    s = t.crossJoin(F.broadcast(counts)).groupBy("t").agg(F.sum(F.when(called, F.col("y")).otherwise(0)).alias("tp"), F.sum(F.when(called, F.col("n")).otherwise(0)).alias("called"), F.sum("y").alias("y"), F.sum("n").alias("n"))
    precision, recall = F.try_divide("tp", "called"), F.try_divide("tp", "y")
    return s.select("t", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), F.col("called") + F.col("y")).alias("f1"), ((F.col("n") - F.col("called") - F.col("y") + 2 * F.col("tp")) / F.col("n")).alias("accuracy"))


def value_picks(df: DataFrame, edge: float = 0.10) -> DataFrame:
    """Where the model's pick beats the market's chance of it by more than edge."""
    at = lambda names: F.element_at(F.array(*names), picked() + 1)
    won = (picked() == F.col("outcome")).cast("double")
    chosen = df.where(at(P) - at(("market_home", "market_draw", "market_away")) > edge)
    return chosen.groupBy(picked().alias("pick")).agg(F.count("*").alias("n"), F.avg(won).alias("accuracy"), F.avg(at(P)).alias("mean_p"))


MARGINS = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4)


def agreement(df: DataFrame) -> DataFrame:
    """Matches and accuracy of our pick where the market's favourite is the same (agree 1)
    and where it isn't (0). Rows without market chances are left out."""
    h, d, a = (F.col(f"market_{o}") for o in ("home", "draw", "away"))
    market = F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)
    known = df.where("market_home is not null and market_draw is not null and market_away is not null")
    return known.groupBy((picked() == market).cast("int").alias("agree")).agg(F.count("*").alias("n"), F.avg((picked() == F.col("outcome")).cast("double")).alias("accuracy"))


def decisive(df: DataFrame, margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """Matches and accuracy from each margin of the first chance over the second on, in one
    pass with an aggregate a margin."""
    ranked = F.sort_array(F.array(*P), asc=False)
    rows = df.select(F.round(F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)), 9).alias("m"), (picked() == F.col("outcome")).cast("double").alias("hit"))
    one = lambda t: F.struct(F.lit(t).alias("margin"), F.count_if(F.col("m") >= t).alias("n"), F.avg(F.when(F.col("m") >= t, F.col("hit"))).alias("accuracy"))
    return rows.agg(F.array(*map(one, margins)).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("n > 0")


def confident_share(df: DataFrame, shares: tuple[int, ...] = (5, 10, 20, 30, 50, 100)) -> DataFrame:
    """Accuracy of the most confident share of rows, at least one. Confidence is binned
    to 1e-4 and rows of a bin are ranked by match_id, so no sort gathers all rows: a running
    sum over bins, then a rank inside each."""
    top = F.greatest(*P)
    rows = df.select("match_id", top.alias("c"), (picked() == F.col("outcome")).cast("int").alias("hit"), F.floor(top * 10000).cast("int").alias("b"))
    before = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("b").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = rows.join(bins, "b").withColumn("place", F.col("ahead") + F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "match_id")))
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    counts = ranked.crossJoin(total).select("hit", F.explode(F.array(*map(F.lit, shares))).alias("share"), "place", "total").where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("total") * F.col("share") / 100)))
    return counts.groupBy("share").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


def simulated_accuracy(df: DataFrame, runs: int = 10_000, seed: int = 42) -> DataFrame:
    """Share of matches whose drawn result is the actual one, as quantiles over
    seeded runs. Matches without an outcome or a chance are left out."""
    per = _simulated(df, runs, seed)
    return per.agg(*[F.percentile("a", F.lit(q)).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)])


def simulated_rank(df: DataFrame, runs: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: the mean over the runs, the accuracy of the likeliest results, and the
    share of runs that are at most as good."""
    actual = df.where("outcome between 0 and 2").agg(F.avg((picked() == F.col("outcome")).cast("double")).alias("actual"))
    per = _simulated(df, runs, seed).crossJoin(F.broadcast(actual))  # one row
    return per.agg(F.avg("a").alias("mean"), F.first("actual").alias("actual"), F.avg((F.col("a") <= F.col("actual")).cast("double")).alias("rank"))


def _simulated(df: DataFrame, runs: int, seed: int) -> DataFrame:
    """(run, a). A match is hit with the chance of its actual outcome; matches of one chance
    are hit together by an exact binomial draw for each run, so only (run, hits) of a task
    is shuffled."""
    chance = F.when(F.col("outcome").between(0, 2), F.element_at(F.array(*P), F.col("outcome").cast("int") + 1)).cast("double")
    buckets = df.groupBy(chance.alias("c")).agg(F.count("*").alias("n")).where("c is not null")

    def draw(batches):
        hits, total = np.zeros(runs, np.int64), 0
        for batch in batches:
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dice = np.random.default_rng([seed, int(np.float64(c).view(np.uint64))])  # whatever task holds it
                hits += dice.binomial(n, min(1.0, max(0.0, c)), runs)
                total += n
        if total:
            yield pa.record_batch({"run": pa.array(np.arange(runs)), "hits": pa.array(hits), "n": pa.array(np.full(runs, total))})

    return buckets.mapInArrow(draw, "run long, hits long, n long").groupBy("run").agg((F.sum("hits") / F.sum("n")).alias("a"))
