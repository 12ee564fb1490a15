"""The low-score-corrected goal model.

Fitting sees sufficient statistics only: weights summed by (home, away, goals) in Spark, a
table bounded by teams squared times scores. While it has at most ``MOST_CELLS`` rows it goes to
the driver, else every value and gradient of the likelihood is a pass of which each task sends
one sum. The likelihood is climbed by a projected quasi-Newton method within bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GOALS = 8
XI = 0.002
MOST_CELLS = 2_000_000
#: Bounds of a team's parameters, home advantage, rho and mu; weight of the sum-to-zero penalty.
TEAM_BOUND, OTHER_BOUNDS, PENALTY = 2.0, ((0.0, 1.0), (-0.5, 0.5), (-1.0, 1.0)), 100.0
START = (0.25, -0.05, 0.2)
#: Scores that the correction changes.
LOW = ((0, 0), (0, 1), (1, 0), (1, 1))


def weighted_scores(matches: DataFrame, xi: float = XI) -> DataFrame:
    """(home_team, away_team, goals_home, goals_away, w): decayed weights by days."""
    last = F.broadcast(matches.agg(F.max("dn").alias("_last")))
    w = F.exp(F.lit(-xi) * (F.col("_last") - F.col("dn")))
    return matches.crossJoin(last).groupBy("home_team", "away_team", "goals_home", "goals_away").agg(F.sum(w).alias("w"))


class GoalModel:
    """attack, defence by team; home advantage, rho, mu."""

    def __init__(self, teams: list, attack: np.ndarray, defence: np.ndarray, home: float, rho: float, mu: float):
        self.teams, self.attack, self.defence, self.home, self.rho, self.mu = teams, attack, defence, home, rho, mu

    @classmethod
    def fit(cls, matches: DataFrame, xi: float = XI, steps: int = 500, most_cells: int = MOST_CELLS) -> GoalModel:
        """The optimum within the bounds. An empty table gives a model without teams."""
        scores = weighted_scores(matches, xi).persist()
        try:
            size, total = scores.agg(F.count("*"), F.sum("w")).first()
            if not size:
                return cls([], np.zeros(0), np.zeros(0), *START)
            teams = sorted(r[0] for r in scores.select(F.explode(F.array("home_team", "away_team"))).distinct().collect())
            loss = _local(scores, teams) if size <= most_cells else _spread(scores, teams)
            n = len(teams)
            theta, _, _ = minimise(lambda x: _penalised(loss, x, n, total), np.concatenate([np.zeros(2 * n), START]), *bounds(n), steps=steps)
        finally:
            scores.unpersist()
        return cls(teams, theta[:n], theta[n : 2 * n], *map(float, theta[2 * n :]))

    def table(self, spark) -> DataFrame:
        """(team, attack, defence), a row a team."""
        return spark.createDataFrame([(t, float(x), float(y)) for t, x, y in zip(self.teams, self.attack, self.defence)], "team int, attack double, defence double")


def bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = (np.concatenate([np.full(2 * n, x * TEAM_BOUND), [b[k] for b in OTHER_BOUNDS]]) for k, x in ((0, -1), (1, 1)))
    return low, high


def likelihood(theta: np.ndarray, n: int, h, a, x, y, w) -> tuple[float, np.ndarray]:
    """The sum of w times the log-likelihood of scores, without its constant part, and its gradient."""
    att, dfn, (home, rho, mu) = theta[:n], theta[n : 2 * n], theta[2 * n :]
    lh, la = (np.exp(np.clip(z, math.log(0.01), math.log(15))) for z in (mu + att[h] - dfn[a] + home, mu + att[a] - dfn[h]))
    inside = [(z > 0.01) & (z < 15) for z in (lh, la)]
    gh, ga, grho = x - lh, y - la, np.zeros_like(lh)
    value = x * np.log(lh) - lh + y * np.log(la) - la
    # What the correction is and how it changes with log lambda_home, log lambda_away and rho.
    for i, j in LOW:
        m = (x == i) & (y == j)
        p, q = lh[m], la[m]
        tau, by_h, by_a, by_rho = {
            (0, 0): (1 - p * q * rho, -p * q * rho, -p * q * rho, -p * q),
            (0, 1): (1 + p * rho, p * rho, 0 * p, p),
            (1, 0): (1 + q * rho, 0 * q, q * rho, q),
            (1, 1): (1 - rho + 0 * p, 0 * p, 0 * p, -1 + 0 * p),
        }[i, j]
        sound, tau = tau > 1e-10, np.maximum(tau, 1e-10)
        value[m] += np.log(tau)
        gh[m] += sound * by_h / tau
        ga[m] += sound * by_a / tau
        grho[m] += sound * by_rho / tau
    gh, ga = gh * inside[0] * w, ga * inside[1] * w
    add = lambda idx, v: np.bincount(idx, weights=v, minlength=n)
    return float((w * value).sum()), np.concatenate([add(h, gh) + add(a, ga), -add(a, gh) - add(h, ga), [gh.sum(), (w * grho).sum(), gh.sum() + ga.sum()]])


def _penalised(loss, theta: np.ndarray, n: int, total: float) -> tuple[float, np.ndarray]:
    """What is minimised, over the sum of weights, so that a gradient means the same at any size."""
    value, slope = loss(theta)
    sums = theta[:n].sum(), theta[n : 2 * n].sum()
    pull = np.concatenate([np.full(n, 2 * PENALTY * sums[0]), np.full(n, 2 * PENALTY * sums[1]), np.zeros(3)])
    return (-value + PENALTY * (sums[0] ** 2 + sums[1] ** 2)) / total, (-slope + pull) / total


_CELL = ["home_team", "away_team", "goals_home", "goals_away", "w"]


def _numbers(table, teams: np.ndarray) -> tuple:
    h, a, x, y, w = (table.column(i).to_numpy(zero_copy_only=False) for i in range(len(_CELL)))
    return np.searchsorted(teams, h), np.searchsorted(teams, a), x.astype(float), y.astype(float), w


def _local(scores: DataFrame, teams: list):
    cells = _numbers(scores.select(*_CELL).toArrow().combine_chunks().to_batches()[0], np.array(teams))
    return lambda theta: likelihood(theta, len(teams), *cells)


def _spread(scores: DataFrame, teams: list):
    """The same from a pass: a task sends one row of sums."""
    named, n = np.array(teams), len(teams)

    def loss(theta):
        def run(batches):
            total, slope = 0.0, np.zeros(2 * n + 3)
            for batch in batches:
                if batch.num_rows:
                    value, more = likelihood(theta, n, *_numbers(batch, named))
                    total, slope = total + value, slope + more
            yield pa.record_batch({"value": pa.array([total]), "slope": pa.array([slope.tolist()], pa.list_(pa.float64()))})

        found = scores.select(*_CELL).mapInArrow(run, "value double, slope array<double>").collect()
        return sum(r.value for r in found), np.sum([r.slope for r in found], axis=0)

    return loss


def minimise(fun, x: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 500, tolerance: float = 1e-8, memory: int = 12) -> tuple[np.ndarray, float, np.ndarray]:
    """(x, value, gradient) of a smooth function within bounds: limited-memory quasi-Newton steps
    in the coordinates that are free, projected, with backtracking. Ends when no coordinate can
    improve by ``tolerance`` along its gradient."""
    x = np.clip(x, low, high)
    value, g = fun(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(np.clip(x - g, low, high) - x).max() < tolerance:
            break
        free = ~((x <= low) & (g > 0) | (x >= high) & (g < 0))
        for attempt in (pairs, []):
            d = -_two_loops(g * free, [(s * free, y * free) for s, y in attempt]) * free
            if d @ g < 0:
                break
        t = 1.0 if pairs else min(1.0, 1.0 / max(1e-12, np.abs(g).max()))
        for _ in range(60):
            new = np.clip(x + t * d, low, high)
            at, slope = fun(new)
            if at <= value + 1e-4 * (g @ (new - x)) + 4e-16 * abs(value):
                break
            t /= 2
        else:
            if not pairs:
                break
            pairs = []
            continue
        s, y = new - x, slope - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        x, value, g = new, at, slope
    return x, value, g


def _two_loops(g: np.ndarray, pairs: list) -> np.ndarray:
    """The inverse curvature of the pairs (step, change of gradient) applied to g."""
    q, known = g.copy(), []
    sound = [(s, y, 1 / (s @ y)) for s, y in pairs if s @ y > 1e-14 * (y @ y) and s @ y > 0]
    for s, y, r in reversed(sound):
        known.append(r * (s @ q))
        q -= known[-1] * y
    if sound:
        s, y, r = sound[-1]
        q *= 1 / (r * (y @ y))
    for (s, y, r), k in zip(sound, reversed(known)):
        q += s * (k - r * (y @ q))
    return q


def rates(fixtures: DataFrame, params: DataFrame, home: float, mu: float) -> DataFrame:
    """fixtures with lambda_home and lambda_away; unknown teams get mean parameters."""
    mean = F.broadcast(params.agg(F.avg("attack").alias("_att"), F.avg("defence").alias("_def")))
    out = fixtures.crossJoin(mean)
    for s in ("home", "away"):
        out = out.join(params.select(F.col("team").alias(f"{s}_team"), F.col("attack").alias(f"{s}_att"), F.col("defence").alias(f"{s}_def")), f"{s}_team", "left")
    own = lambda s, k: F.coalesce(f"{s}_{k}", f"_{k}")
    return out.withColumn("lambda_home", F.exp(F.lit(mu) + own("home", "att") - own("away", "def") + F.lit(home))).withColumn("lambda_away", F.exp(F.lit(mu) + own("away", "att") - own("home", "def"))).drop(
        "_att", "_def", "home_att", "home_def", "away_att", "away_def"
    )


def _marginals(fixtures: DataFrame, rho: float, goals: int) -> DataFrame:
    """fixtures with the chance of each number of goals, _h0.. and _a0.., the changes that the
    correction makes to the four low scores, _d00.. (M2), and the sum of all cells, _total."""
    pmf = {f"_{s}{k}": F.exp(-F.col(lam)) * F.pow(F.col(lam), F.lit(float(k))) / float(math.factorial(k)) for s, lam in (("h", "lambda_home"), ("a", "lambda_away")) for k in range(goals)}
    lh, la = F.col("lambda_home"), F.col("lambda_away")
    change = {(0, 0): -lh * la * rho, (0, 1): lh * rho, (1, 0): la * rho, (1, 1): F.lit(-rho)}
    out = fixtures.withColumns(pmf).withColumns({f"_d{i}{j}": F.col(f"_h{i}") * F.col(f"_a{j}") * c for (i, j), c in change.items()})
    one = lambda s: _sum([F.col(f"_{s}{k}") for k in range(goals)])
    return out.withColumn("_total", one("h") * one("a") + _sum([F.col(f"_d{i}{j}") for i, j in LOW]))


def _sum(columns: list):
    return sum(columns[1:], columns[0])


def _cell(i: int, j: int):
    p = F.col(f"_h{i}") * F.col(f"_a{j}")
    return (p + F.col(f"_d{i}{j}") if (i, j) in LOW else p) / F.col("_total")


def score_grid(fixtures: DataFrame, rho: float, goals: int = GOALS) -> DataFrame:
    """fixtures with cells: array of (h, a, p), summing to 1. M3."""
    cells = F.array(*[F.struct(F.lit(i).alias("h"), F.lit(j).alias("a"), _cell(i, j).alias("p")) for i in range(goals) for j in range(goals)])
    return _marginals(fixtures, rho, goals).select(*fixtures.columns, cells.alias("cells"))


def outcomes(fixtures: DataFrame, rho: float, goals: int = GOALS, top: int = 12, shown: int = 7) -> DataFrame:
    """M3, L4: outcome, over 2.5, both score, and the likeliest scores (7 x 7; equal ones by
    home, then away goals). Sums run over the numbers of goals of one side, not over cells."""
    h, a = ([F.col(f"_{s}{k}") for k in range(goals)] for s in "ha")
    low = lambda *cells: _sum([F.col(f"_d{i}{j}") for i, j in cells])
    upto = lambda x, k: _sum(x[:k])
    home = _sum([h[i] * upto(a, i) for i in range(1, goals)]) + low((1, 0))
    away = _sum([a[j] * upto(h, j) for j in range(1, goals)]) + low((0, 1))
    draw = _sum([h[k] * a[k] for k in range(goals)]) + low((0, 0), (1, 1))
    few = h[0] * upto(a, 3) + h[1] * upto(a, 2) + h[2] * a[0] + low(*LOW)
    both = (upto(h, goals) - h[0]) * (upto(a, goals) - a[0]) + low((1, 1))
    part = {"p_home": home, "p_draw": draw, "p_away": away, "btts": both}
    # A cell as one number, so that plain numbers are sorted: its chance to 12 places, then its place.
    size = shown * shown
    coded = [F.floor(_cell(i, j) * 1e12 + 0.5) * size + (size - 1 - (i * shown + j)) for i in range(shown) for j in range(shown)]
    names = F.array(*[F.lit(f"{i}-{j}") for i in range(shown) for j in range(shown)])
    scores = F.transform(F.slice(F.sort_array(F.array(*coded), asc=False), 1, top), lambda c: F.get(names, (size - 1 - F.pmod(c, F.lit(size))).cast("int")))
    out = _marginals(fixtures, rho, goals)
    return out.select("match_id", "lambda_home", "lambda_away", *[(x / F.col("_total")).alias(n) for n, x in part.items()], (1 - few / F.col("_total")).alias("over_2_5"), scores.alias("top_scorelines"))


def best_score(scores: str, outcome: str):
    """The likeliest score that fits an outcome (0 home, 1 draw, 2 away), else the
    likeliest of all."""
    goals = lambda s, k: F.element_at(F.split(s, "-"), k).cast("int")
    sign = F.when(F.col(outcome) == 0, 1).when(F.col(outcome) == 1, 0).otherwise(-1)
    fits = F.filter(F.col(scores), lambda s: F.signum(goals(s, 1) - goals(s, 2)) == sign)
    return F.coalesce(F.get(fits, F.lit(0)), F.get(F.col(scores), F.lit(0)))


def team_ratings(params: DataFrame, home: float, mu: float) -> DataFrame:
    """Ranks average over ties and drop the fraction."""
    def rank(order, value):
        return F.floor(F.rank().over(Window.orderBy(order)) + (F.count("*").over(Window.partitionBy(value)) - 1) / 2).cast("int")

    rounded = params.select("team", F.round("attack", 4).alias("attack"), F.round("defence", 4).alias("defence"), F.round(F.exp(F.lit(mu) + F.col("attack") + F.lit(home)), 2).alias("expected_home_goals"), F.round(F.exp(F.lit(mu) + F.col("attack")), 2).alias("expected_away_goals"))
    return rounded.withColumn("attack_rank", rank(F.desc("attack"), "attack")).withColumn("defense_rank", rank(F.asc("defence"), "defence"))


def bivariate_rates(matches: DataFrame) -> DataFrame:
    """M5: global means and the shared rate max(0, 0.3 r), one row."""
    return matches.agg(F.avg("goals_home").alias("mean_home"), F.avg("goals_away").alias("mean_away"), F.greatest(F.lit(0.0), 0.3 * F.corr(F.col("goals_home").cast("double"), F.col("goals_away").cast("double"))).alias("lambda_3"))


def bivariate_strengths(sides: DataFrame) -> DataFrame:
    """M5: a team's goals for and against a game over the mean of all games (1.3 without any),
    one row a team. sides: two rows a match."""
    mean = F.broadcast(sides.agg(F.coalesce(F.nullif(F.avg("gf"), F.lit(0.0)), F.lit(1.3)).alias("_mean")))  # one row
    per = sides.groupBy("team").agg(F.sum("gf").alias("_f"), F.sum("ga").alias("_a"), F.count("*").alias("_n"))
    return per.crossJoin(mean).select("team", (F.col("_f") / F.col("_n") / F.col("_mean")).alias("attack"), (F.col("_a") / F.col("_n") / F.col("_mean")).alias("defence"))


def bivariate_outcomes(fixtures: DataFrame, goals: int = GOALS) -> DataFrame:
    """M5: outcomes of two Poisson counts that share a third: on lambda_1, lambda_2 (what is
    each side's own) and lambda_3, the chance of (h, a) is the sum over k shared goals. The
    grid is renormalised."""
    own = {f"_{s}{k}": F.exp(-F.col(lam)) * F.pow(F.col(lam), F.lit(float(k))) / float(math.factorial(k)) for s, lam in (("h", "lambda_1"), ("a", "lambda_2"), ("s", "lambda_3")) for k in range(goals)}
    out = fixtures.withColumns(own)
    cell = lambda i, j: _sum([F.col(f"_s{k}") * F.col(f"_h{i - k}") * F.col(f"_a{j - k}") for k in range(min(i, j) + 1)])
    part = lambda fits: _sum([cell(i, j) for i in range(goals) for j in range(goals) if fits(i, j)])
    out = out.select("match_id", part(lambda i, j: i > j).alias("_x"), part(lambda i, j: i == j).alias("_y"), part(lambda i, j: i < j).alias("_z"))
    total = F.col("_x") + F.col("_y") + F.col("_z")
    return out.select("match_id", (F.col("_x") / total).alias("p_home"), (F.col("_y") / total).alias("p_draw"), (F.col("_z") / total).alias("p_away"))
