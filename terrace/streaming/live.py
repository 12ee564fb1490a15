"""Structured Streaming: R1-R3 on keyed state; tumbling and session windows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its column families here.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


def _end_of(day: date) -> int:
    """The last millisecond of a day, as watermarks count."""
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000) + _DAY_MS - 1


class Rated(StatefulProcessor):
    """A league's ratings. Matches wait, by day and id, until the watermark has passed their
    day; a timer then rates all that have come due, in order. State is one row a team, a row a
    waiting match and the season, each with a schema; a match reads and writes its two teams."""

    def __init__(self, system: type):
        self.system = system

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.teams = handle.getMapState("teams", "team int", self.system.fields)
        self.waiting = handle.getMapState("waiting", "day date, match_id long", "season int, home_team int, away_team int, goals_home int, goals_away int")
        self.season = handle.getValueState("season", "season int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples():
                self.waiting.updateValue((r.match_date, int(r.match_id)), (int(r.season), int(r.home_team), int(r.away_team), int(r.goals_home), int(r.goals_away)))
            for day in part.match_date.unique():
                self.handle.registerTimer(_end_of(day))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if _end_of(k[0]) <= until)
        season = self.season.get()[0] if self.season.exists() else None
        out = []
        for (day, match_id), (year, home, away, gh, ga) in due:
            if season is not None and year != season:
                self._turn()
            season, one = year, self.system()
            for team in (home, away):
                if self.teams.containsKey((team,)):
                    one.put(team, tuple(self.teams.getValue((team,))))
            out.append((match_id, *one.step(home, away, gh, ga)))
            for team in (home, away):
                self.teams.updateValue((team,), one.own(team))
            self.waiting.removeKey((day, match_id))
        if out:
            self.season.update((season,))
            yield pd.DataFrame(out, columns=["match_id", *self.system.columns])
        else:
            yield pd.DataFrame()

    def _turn(self) -> None:
        """A new season for all teams."""
        every = self.system()
        held = [(k[0], tuple(v)) for k, v in self.teams.iterator()]
        for team, state in held:
            every.put(team, state)
        every.new_season()
        for team, _ in held:
            self.teams.updateValue((team,), every.own(team))

    def close(self) -> None:
        pass


def stream_ratings(matches: DataFrame, system: type, league: str = "league", late: str = "14 days") -> DataFrame:
    """R1-R3 over a stream, as ``ratings.rate`` gives them: match_id and the system's columns.
    Matches may come in any order within ``late`` of the newest; what comes later is dropped by
    the watermark. A match is rated once the watermark has passed its day. Needs
    ``STATE_STORE`` as spark.sql.streaming.stateStore.providerClass."""
    schema = ", ".join(["match_id long", *[f"{c} double" for c in system.columns]])
    rows = matches.select(league, "match_date", "match_id", "season", "home_team", "away_team", "goals_home", "goals_away", F.col("match_date").cast("timestamp").alias("at"))
    return rows.withWatermark("at", late).groupBy(league).transformWithStateInPandas(Rated(system), schema, "append", "eventTime")


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values of each type in tumbling windows; late rows past the watermark go."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
