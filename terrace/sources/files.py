"""Result files, snapshots, nested JSON, sinks.

Files are read by Spark's readers where they lie (local or shared folders); nothing is
fetched. Columns that a file lacks are null; lines that can't be parsed go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers of result files and our names for them.
HEADERS = {
    "Date": "date", "Time": "kickoff_time", "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHG": "goals_home", "FTAG": "goals_away", "FTR": "result",
    "HTHG": "ht_goals_home", "HTAG": "ht_goals_away", "HTR": "ht_result", "Referee": "referee", "HS": "shots_home", "AS": "shots_away", "HST": "sot_home", "AST": "sot_away",
    "HC": "corners_home", "AC": "corners_away", "HF": "fouls_home", "AF": "fouls_away", "HY": "yellows_home", "AY": "yellows_away", "HR": "reds_home", "AR": "reds_away",
    "PSH": "odds_pin_home", "PSD": "odds_pin_draw", "PSA": "odds_pin_away", "B365H": "odds_b365_home", "B365D": "odds_b365_draw", "B365A": "odds_b365_away",
    "AvgH": "odds_avg_home", "AvgD": "odds_avg_draw", "AvgA": "odds_avg_away", "IWH": "odds_iw_home", "IWD": "odds_iw_draw", "IWA": "odds_iw_away", "WHH": "odds_wh_home", "WHD": "odds_wh_draw", "WHA": "odds_wh_away",
    "PSCH": "odds_pin_home_close", "PSCD": "odds_pin_draw_close", "PSCA": "odds_pin_away_close", "B365CH": "odds_b365_home_close", "B365CD": "odds_b365_draw_close", "B365CA": "odds_b365_away_close",
    "AvgCH": "odds_avg_home_close", "AvgCD": "odds_avg_draw_close", "AvgCA": "odds_avg_away_close",
}
#: What some seasons call the goals and the result.
OLDER = {"HG": "FTHG", "AG": "FTAG", "Res": "FTR"}
STANDINGS = "standings array<struct<table: array<struct<position: int, team: struct<id: long, name: string>, playedGames: int, won: int, draw: int, lost: int, goalsFor: int, goalsAgainst: int, goalDifference: int, points: int, form: string>>>>"
INJURIES = "response array<struct<player: struct<name: string, type: string, reason: string>, team: struct<id: long, name: string>>>"


def day(text: Column) -> Column:
    """A date with the day first, its year in four or two digits."""
    return F.to_date(F.coalesce(F.try_to_timestamp(text, F.lit("dd/MM/yyyy")), F.try_to_timestamp(text, F.lit("dd/MM/yy"))))


def season_file(spark: SparkSession, path: str, label: str, encoding: str = "UTF-8") -> DataFrame:
    """One season's matches under our names; rows without goals go, empty ones too."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("encoding", encoding).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns]).na.drop("all")
    if "FTHG" not in raw.columns:
        raw = raw.withColumnsRenamed(OLDER)
    kept = raw.select(*[F.col(f"`{c}`").alias(HEADERS[c]) for c in raw.columns if c in HEADERS]).withColumn("season", F.lit(label))
    if "date" in kept.columns:
        kept = kept.withColumn("date", day(F.col("date")))
    goals = {c: F.expr(f"try_cast({c} AS INT)") for c in ("goals_home", "goals_away") if c in kept.columns}
    return kept.withColumns(goals).na.drop(subset=list(goals)) if goals else kept


def seasons(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All seasons by label, columns that one lacks null; order is the reader's to ask for."""
    frames = [season_file(spark, paths[label], label) for label in sorted(paths)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def rating_snapshots(spark: SparkSession, folder: str, country: str = "ENG") -> DataFrame:
    """S3: (snapshot_date, team, elo) of snapshot files named by their day, in either of two
    layouts, told apart by the number of fields."""
    lines = spark.read.text(folder).select(F.split("value", ",").alias("p"), F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1).alias("d"))
    wide = F.size("p") > 4
    at = lambda new, old: F.trim(F.when(wide, F.get("p", F.lit(new))).otherwise(F.get("p", F.lit(old))))
    rows = lines.select(F.to_date("d").alias("snapshot_date"), at(1, 0).alias("team"), at(2, 1).alias("country"), at(4, 3).alias("raw"))
    return rows.where(F.col("country") == country).select("snapshot_date", "team", F.expr("try_cast(raw AS DOUBLE)").alias("elo")).where("elo is not null")


def fixtures(spark: SparkSession, path: str, division: str = "E0") -> DataFrame:
    """Fixtures of one division; a byte-order mark in the header is dropped."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿ï»¿").strip() for c in raw.columns])
    return raw.where(F.trim("Div") == division).select(day(F.col("Date")).alias("date"), F.trim("HomeTeam").alias("home_team"), F.trim("AwayTeam").alias("away_team"))


def documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents that span lines, one row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def standings(spark: SparkSession, path: str) -> DataFrame:
    """A row for each team of the first table of each document."""
    rows = documents(spark, path, STANDINGS).select(F.explode(F.get("standings", F.lit(0))["table"]).alias("e"))
    return rows.select("e.position", F.col("e.team.name").alias("team"), F.col("e.team.id").alias("team_id"), "e.points", F.col("e.playedGames").alias("played"), "e.won", "e.draw", "e.lost", F.col("e.goalsFor").alias("goals_for"), F.col("e.goalsAgainst").alias("goals_against"), F.col("e.goalDifference").alias("goal_diff"), "e.form")


def injuries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each reported player; missing parts are null."""
    rows = documents(spark, path, INJURIES).select(F.explode("response").alias("e"))
    return rows.select(F.col("e.player.name").alias("player"), F.col("e.team.name").alias("team"), F.col("e.team.id").alias("team_id"), F.col("e.player.type").alias("type"), F.col("e.player.reason").alias("reason"))


def without(df: DataFrame, *parts: str) -> DataFrame:
    """Df without the columns whose names hold one of the parts."""
    return df.drop(*[c for c in df.columns if any(p in c for p in parts)])


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both, in a's order."""
    return [c for c in a.columns if c in set(b.columns)]


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def write_table(df: DataFrame, path: str, drop_empty: bool = False) -> None:
    """K1: df in place of what is at path; with drop_empty an empty df leaves nothing."""
    if drop_empty and df.isEmpty():
        place, fs = _path(df.sparkSession, path)
        fs.delete(place, True)
    else:
        df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """K2: one JSON document a line."""
    df.write.mode("overwrite").json(path)


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K3: old rows with what new knows of them, and new rows; columns of either."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full")
    pick = lambda c: F.coalesce(*[F.col(f"{a}.{c}") for a, df in (("n", new), ("o", old)) if c in df.columns])
    return both.select(*[pick(c).alias(c) for c in dict.fromkeys([*old.columns, *new.columns])])


def update_json(spark: SparkSession, path: str, new: DataFrame, key: str) -> None:
    """K3: reads, merges and replaces JSON rows. What is read is set aside once all is written, so
    after a crash either the old rows or the new ones are found."""
    place, fs = _path(spark, path)
    left = _path(spark, f"{path}.old")[0]
    if not fs.exists(place) and fs.exists(left):  # a run ended between its two renames
        fs.rename(left, place)
    if not fs.exists(place):
        write_json(new, path)
        return
    fresh, old = (_path(spark, f"{path}.{end}")[0] for end in ("next", "old"))
    write_json(merged(spark.read.json(path), new, key), f"{path}.next")
    fs.delete(old, True)
    fs.rename(place, old)
    fs.rename(fresh, place)
    fs.delete(old, True)
