"""Elo, Pi and Glicko-2, the recurrences that couple two teams a row.

They can't be windows: each row reads what the last rows of two teams wrote. A league is one
sequence, so leagues are the unit of work: dealt whole, sorted inside, read batch by batch
(``mapInArrow``). State is a few numbers a team, which ``own`` gives and ``put`` takes back; in
streams the same step functions run on keyed state of these fields.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = 1500.0
ELO = dict(k=20.0, home_adv=65.0, regression=0.1)
PI = dict(rate=0.05, gamma=0.6, base=1.36)
GLICKO = dict(rd=200.0, vol=0.06, tau=0.5, scale=173.7178)

_IN = ["match_id", "season", "home_team", "away_team", "goals_home", "goals_away"]
ELO_COLUMNS = ["elo_home", "elo_away", "elo_diff", "elo_momentum_home", "elo_momentum_away", "elo_momentum_diff"]
PI_COLUMNS = ["pi_home_attack", "pi_home_defense", "pi_away_attack", "pi_away_defense", "pi_rating_home", "pi_rating_away", "pi_diff"]
GLICKO_COLUMNS = [f"glicko_{c}_{s}" for c in ("mu", "rd", "vol") for s in ("home", "away")] + ["glicko_mu_diff", "glicko_rd_diff"] + [f"glicko_confidence_{s}" for s in ("home", "away", "diff")]


class Elo:
    """Margin-scaled Elo with a pull to the mean at each new season."""

    columns = ELO_COLUMNS
    fields = "rating double, moves array<double>"

    def __init__(self) -> None:
        self.rating: dict = {}
        self.moves: dict = {}

    def own(self, team) -> tuple:
        return self.rating[team], list(self.moves.get(team, ()))

    def put(self, team, state: tuple) -> None:
        self.rating[team], self.moves[team] = state[0], deque(state[1], maxlen=5)

    def new_season(self) -> None:
        r = ELO["regression"]
        self.rating = {t: x + r * (START - x) for t, x in self.rating.items()}

    def step(self, home, away, gh: int, ga: int) -> list[float]:
        h, a = self.rating.get(home, START), self.rating.get(away, START)
        edge = h - a + ELO["home_adv"]
        recent = [self.moves.setdefault(t, deque(maxlen=5)) for t in (home, away)]
        mood = [sum(m) / len(m) if m else 0.0 for m in recent]
        expected = 1 / (1 + 10 ** (-edge / 400))
        actual = (1 + (gh > ga) - (gh < ga)) / 2
        move = ELO["k"] * (1 + 0.7 * math.log1p(abs(gh - ga))) * (actual - expected)
        self.rating[home], self.rating[away] = h + move, a - move
        recent[0].append(move)
        recent[1].append(-move)
        return [h, a, edge, *mood, mood[0] - mood[1]]


class Pi:
    """Attack and defence at home and away; only the venue's own pair moves."""

    columns = PI_COLUMNS
    fields = "home_attack double, home_defense double, away_attack double, away_defense double"

    def __init__(self) -> None:
        self.at_home: dict = {}
        self.away: dict = {}

    def own(self, team) -> tuple:
        return *self.at_home.get(team, (1.0, 1.0)), *self.away.get(team, (1.0, 1.0))

    def put(self, team, state: tuple) -> None:
        self.at_home[team], self.away[team] = tuple(state[:2]), tuple(state[2:])

    def new_season(self) -> None:
        pass

    def step(self, home, away, gh: int, ga: int) -> list[float]:
        (h_att, h_def), (a_att, a_def) = self.at_home.get(home, (1.0, 1.0)), self.away.get(away, (1.0, 1.0))
        lead_home, lead_away = h_att - a_def, a_att - h_def
        miss = []
        for goals, lead in ((gh, lead_home), (ga, lead_away)):
            expected = max(0.1, PI["base"] * math.exp(lead))
            miss.append(PI["rate"] * (goals - expected) / max(expected, 0.5))
        self.at_home[home] = (h_att + miss[0], h_def - PI["gamma"] * miss[1])
        self.away[away] = (a_att + miss[1], a_def - PI["gamma"] * miss[0])
        return [h_att, h_def, a_att, a_def, lead_home, lead_away, lead_home - lead_away]


class Glicko:
    """Glicko-2 with the rating and its scale mixed as defined: the away team's update sees
    the home team's new state."""

    columns = GLICKO_COLUMNS
    fields = "mu double, rd double, vol double"

    def __init__(self) -> None:
        self.state: dict = {}

    def own(self, team) -> tuple:
        return self.state[team]

    def put(self, team, state: tuple) -> None:
        self.state[team] = tuple(state)

    def new_season(self) -> None:
        self.state = {t: (mu, min(GLICKO["rd"], math.sqrt(rd * rd + 100 * vol * vol)), vol) for t, (mu, rd, vol) in self.state.items()}

    @staticmethod
    def updated(own: tuple, other: tuple, score: float) -> tuple:
        mu, rd, vol = own
        s = GLICKO["scale"]
        g = 1 / math.sqrt(1 + 3 * (other[1] / s) ** 2 / math.pi**2)
        e = 1 / (1 + math.exp(-g * (mu - other[0]) / s))
        information = g * g * e * (1 - e)
        v = 1 / max(information, 1e-6)
        surprise = v * g * (score - e)
        spread, tau2 = (rd / s) ** 2 + v, GLICKO["tau"] ** 2
        at, new = math.log(vol * vol), vol
        for _ in range(20):  # Newton; the anchor is the current value, so it drops out
            x = math.exp(at)
            d = spread + x
            slope = -1 / tau2 - x * spread / (2 * d * d)
            if abs(slope) < 1e-10:
                break
            value = (math.log(new * new) - at) / tau2 + x * (surprise**2 / d**2 - 1) / (2 * d)
            at -= value / slope
            new = math.exp(at / 2)
        new = min(0.2, max(0.01, new))
        new_rd = 1 / math.sqrt(1 / (rd * rd + new * new) + information)
        return mu + new_rd * g * (score - e) * s, min(new_rd, GLICKO["rd"]), new

    def step(self, home, away, gh: int, ga: int) -> list[float]:
        fresh = (START, GLICKO["rd"], GLICKO["vol"])
        h, a = self.state.get(home, fresh), self.state.get(away, fresh)
        trust = [x[0] / max(x[1], 10) for x in (h, a)]
        score = (1 + (gh > ga) - (gh < ga)) / 2
        self.state[home] = self.updated(h, a, score)
        self.state[away] = self.updated(a, self.state[home], 1 - score)
        return [h[0], a[0], h[1], a[1], h[2], a[2], h[0] - a[0], h[1] - a[1], *trust, trust[0] - trust[1]]


def _walk(batches: Iterator[pa.RecordBatch], system: type) -> Iterator[pa.RecordBatch]:
    """Ratings over rows in order of league, date and match; state is kept per team alone."""
    names = ["match_id", *system.columns]
    now, rating, season = object(), None, None
    for batch in batches:
        out = []
        for league, match_id, when, home, away, gh, ga in zip(*(batch.column(c).to_pylist() for c in ("_league", *_IN))):
            if league != now:
                now, rating, season = league, system(), None
            if season is not None and when != season:
                rating.new_season()
            season = when
            out.append([match_id, *rating.step(home, away, gh, ga)])
        if out:
            yield pa.record_batch({n: pa.array(v, pa.int64() if n == "match_id" else pa.float64()) for n, v in zip(names, zip(*out))})


def rate(matches: DataFrame, system: type, league: str = "league", tasks: int = 64) -> DataFrame:
    """match_id and the system's columns before each match. matches needs the league and the
    contest's columns; goals must be known. Leagues are dealt to tasks whole and sorted there
    by Spark, which spills; Python takes one Arrow batch at a time. The number of tasks is
    given, since Spark would put small leagues together by their bytes, not by their work."""
    schema = ", ".join(["match_id long", *[f"{c} double" for c in system.columns]])
    rows = matches.select(F.col(league).alias("_league"), "match_date", *_IN)
    ordered = rows.repartition(tasks, "_league").sortWithinPartitions("_league", "match_date", "match_id")
    return ordered.mapInArrow(lambda batches: _walk(batches, system), schema)
