"""Lookups, as-of ratings, latest records, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["match_date", "match_id"]


def with_side_table(matches: DataFrame, side: DataFrame, keys: list[str], defaults: dict | None = None) -> DataFrame:
    """Left join on keys; side keeps its first row a key (lowest values), so
    repeated side rows never multiply matches; missing values take defaults."""
    extra = [c for c in side.columns if c not in keys]
    one = side.groupBy(*keys).agg(*[F.min_by(c, F.struct(*[F.col(x) for x in extra])).alias(c) for c in extra])
    out = matches.join(one, keys, "left")
    return out.fillna(defaults) if defaults else out


def as_of_ratings(matches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Both teams' rating in the latest snapshot on or before the match. The snapshot is
    chosen among all dates, then the team is looked up in it alone: a team that it lacks
    gets null. snapshots: (snapshot_date, team, elo). Only distinct dates are ordered."""
    taken = snapshots.select(F.col("snapshot_date").alias("d"), F.col("snapshot_date").alias("s")).distinct()
    days = taken.unionByName(matches.select(F.col("match_date").alias("d"), F.lit(None).cast("date").alias("s")).distinct())
    upto = Window.orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    dated = days.withColumn("snapshot_date", F.max("s").over(upto)).where("s is null").select(F.col("d").alias("match_date"), "snapshot_date")
    out = matches.join(dated, "match_date", "left")
    for side in ("home", "away"):
        rating = snapshots.select("snapshot_date", F.col("team").alias(f"{side}_team"), F.col("elo").alias(f"elo_pre_{side}"))
        out = out.join(rating, ["snapshot_date", f"{side}_team"], "left")
    return out


def derby(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether the unordered pair is among pairs (a, b)."""
    known = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.lit(1).alias("is_derby")).distinct()
    keyed = matches.withColumn("lo", F.least("home_team", "away_team")).withColumn("hi", F.greatest("home_team", "away_team"))
    return keyed.join(known, ["lo", "hi"], "left").withColumn("is_derby", F.coalesce("is_derby", F.lit(0))).drop("lo", "hi")


def latest(sides: DataFrame, columns: list[str]) -> DataFrame:
    """A team's latest values at home, away and anywhere, with the venue's own first and
    then anywhere: one grouped pass with max_by."""
    at = F.struct(*ORDER)
    pick = lambda c, on: F.max_by(c, F.when(on, at)) if on is not None else F.max_by(c, at)
    aggs = [F.coalesce(pick(c, F.col("is_home") == v), pick(c, None)).alias(f"latest_{c}_{n}") for c in columns for v, n in ((1, "home"), (0, "away"))]
    return sides.groupBy("team").agg(*aggs)


def promoted(now: DataFrame, before: DataFrame) -> DataFrame:
    """Teams of now (team) that before (team) lacks."""
    return now.select("team").distinct().join(before.select("team").distinct(), "team", "left_anti")


def newcomers(played: DataFrame, season: str, team: str) -> DataFrame:
    """J9 over all seasons: (season, team) of teams that did not play the season before; the
    first season has none."""
    seen = played.select(F.col(season).alias("season"), F.col(team).alias("team")).distinct()
    first = F.broadcast(seen.agg(F.min("season").alias("_first")))  # one row
    before = seen.select((F.col("season") + 1).alias("season"), "team")
    return seen.join(before, ["season", "team"], "left_anti").crossJoin(first).where("season > _first").drop("_first")


def override(base: DataFrame, live: DataFrame, key: str, columns: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """Live values where base has none, and always for columns with such a prefix."""
    renamed = live.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(renamed, key, "left")
    new = {c: F.coalesce(f"_{c}", c) if c.startswith(always) and always else F.coalesce(c, f"_{c}") for c in columns}
    return joined.withColumns(new).drop(*[f"_{c}" for c in columns])


def first_of_pair(fixtures: DataFrame) -> DataFrame:
    """L3: the earliest row of each (home_team, away_team)."""
    place = F.row_number().over(Window.partitionBy("home_team", "away_team").orderBy(*ORDER))
    return fixtures.withColumn("_n", place).where("_n = 1").drop("_n")


def union_ragged(*parts: DataFrame) -> DataFrame:
    """Union by name, missing columns null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
