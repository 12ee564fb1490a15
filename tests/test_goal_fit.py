"""M1: the fitted optimum against an objective and an optimiser written apart."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import goals
from terrace.sources import contest as source

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def matches(spark):
    return source.contest(spark, SF).where("home_team < 6 and away_team < 6 and season >= 1995").cache()


def plain_objective(rows, teams, xi):
    """Row by row: minus the weighted log-likelihood plus the penalty."""
    last = max(r.dn for r in rows)
    n = len(teams)

    def value(theta):
        out = 0.0
        for r in rows:
            i, j = teams.index(r.home_team), teams.index(r.away_team)
            lh = min(15, max(0.01, math.exp(theta[-1] + theta[i] - theta[n + j] + theta[-3])))
            la = min(15, max(0.01, math.exp(theta[-1] + theta[j] - theta[n + i])))
            x, y, rho = r.goals_home, r.goals_away, theta[-2]
            tau = {(0, 0): 1 - lh * la * rho, (0, 1): 1 + lh * rho, (1, 0): 1 + la * rho, (1, 1): 1 - rho}.get((x, y), 1.0)
            log_p = x * math.log(lh) - lh - math.lgamma(x + 1) + y * math.log(la) - la - math.lgamma(y + 1)
            out += math.exp(-xi * (last - r.dn)) * (log_p + math.log(max(tau, 1e-10)))
        return -out + 100 * (sum(theta[:n]) ** 2 + sum(theta[n : 2 * n]) ** 2)

    return value


def slope_of(value, x, step=1e-6):
    return np.array([(value(x + step * e) - value(x - step * e)) / (2 * step) for e in np.eye(len(x))])


def test_fit_is_the_optimum(matches):
    rows = matches.collect()
    model = goals.GoalModel.fit(matches)
    n = len(model.teams)
    theta = np.concatenate([model.attack, model.defence, [model.home, model.rho, model.mu]])
    value = plain_objective(rows, model.teams, goals.XI)
    total = sum(math.exp(-goals.XI * (max(r.dn for r in rows) - r.dn)) for r in rows)
    low, high = goals.bounds(n)
    g = slope_of(value, theta) / total
    assert np.abs(np.clip(theta - g, low, high) - theta).max() < 1e-6
    assert abs(model.attack.sum()) < 1e-5 and abs(model.defence.sum()) < 1e-5
    # an optimiser of another kind: damped Newton steps on differences of the slope, from elsewhere
    x = np.clip(theta + np.random.default_rng(1).normal(size=len(theta)) * 0.05, low + 1e-3, high - 1e-3)
    cells = goals._local(goals.weighted_scores(matches), model.teams)
    fast = lambda t: goals._penalised(cells, t, n, total)
    for _ in range(40):
        g = fast(x)[1]
        hess = np.array([(fast(x + 1e-5 * e)[1] - fast(x - 1e-5 * e)[1]) / 2e-5 for e in np.eye(len(x))])
        free = ~((x <= low + 1e-12) & (g > 0) | (x >= high - 1e-12) & (g < 0))
        step = np.zeros(len(x))
        step[free] = -np.linalg.solve(hess[np.ix_(free, free)] + 1e-9 * np.eye(free.sum()), g[free])
        t = 1.0
        while fast(np.clip(x + t * step, low, high))[0] > fast(x)[0] and t > 1e-6:
            t /= 2
        x = np.clip(x + t * step, low, high)
    assert x == pytest.approx(theta, abs=1e-5)


def test_gradient_against_differences(matches):
    scores = goals.weighted_scores(matches)
    teams = sorted({r.home_team for r in scores.collect()} | {r.away_team for r in scores.collect()})
    cells = goals._local(scores, teams)
    x = np.random.default_rng(2).normal(size=2 * len(teams) + 3) * 0.1
    assert cells(x)[1] == pytest.approx(slope_of(lambda t: cells(t)[0], x), rel=1e-5, abs=1e-5)


def test_fit_in_tasks_equals_fit_on_the_driver(matches):
    a, b = goals.GoalModel.fit(matches), goals.GoalModel.fit(matches, most_cells=0)
    assert np.allclose(a.attack, b.attack, atol=1e-5) and np.allclose(a.defence, b.defence, atol=1e-5) and [a.home, a.rho, a.mu] == pytest.approx([b.home, b.rho, b.mu], abs=1e-5)


def test_bounds_hold_and_are_reached():
    target = np.array([3.0, -0.2, 0.5])
    low, high = np.array([-1.0, -1.0, 0.6]), np.array([1.0, 1.0, 2.0])
    x, value, g = goals.minimise(lambda t: (float(((t - target) ** 2 * [1, 50, 3]).sum() + (t[0] * t[1]) ** 2), 2 * (t - target) * [1, 50, 3] + 2 * np.array([t[0] * t[1] ** 2, t[1] * t[0] ** 2, 0])), np.zeros(3), low, high)
    assert x[0] == 1.0 and x[2] == 0.6 and x[1] == pytest.approx(-0.2 * 50 / 51, abs=1e-7)


def test_empty_table(spark, matches):
    model = goals.GoalModel.fit(matches.where("1 = 0"))
    assert model.teams == [] and model.table(spark).count() == 0
