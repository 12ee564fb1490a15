"""S1 in one scan, S2's id ranges, S4, S6 and S7: what feeds and files hold, as rows.

Nothing is fetched: documents are text columns or files where they lie. Everything is one plan
whatever the number of files, feeds or ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.sources.files import HEADERS, OLDER, day

#: What bytes 128 to 159 mean in windows-1252; five of them mean nothing.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
#: A field of a line: quoted, with doubled quotes inside, or plain.
FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
#: The daily series of a weather document, and our names for them.
SERIES = {"temperature_2m_mean": "temperature", "relative_humidity_2m_mean": "humidity", "wind_speed_10m_max": "wind_speed", "precipitation_sum": "precipitation"}
WEATHER = f"daily struct<time: array<string>, {', '.join(f'{s}: array<double>' for s in SERIES)}>"
#: Two layouts of match feeds.
SCHEDULED = "matches array<struct<utcDate: string, homeTeam: struct<name: string>, awayTeam: struct<name: string>>>"
LISTED = "response array<struct<fixture: struct<date: string, status: struct<short: string>>, teams: struct<home: struct<name: string>, away: struct<name: string>>>>"
TO_COME = ("NS", "TBD", "PST")
BUFFER = 250


def text_of(content: Column) -> Column:
    """Bytes as text: UTF-8 if they are that, else latin-1, or windows-1252 where latin-1
    would give control characters."""
    old = F.decode(content, "ISO-8859-1")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(old, "".join(map(chr, range(128, 160))), CP1252))


def fields_of(line: Column) -> Column:
    """The trimmed fields of a line, without the quotes around them."""
    plain = lambda x: F.trim(F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.transform(F.regexp_extract_all(line, F.lit(FIELD), F.lit(1)), plain)


def season_scan(spark: SparkSession, labels: dict[str, str]) -> DataFrame:
    """The matches of all season files by label, from one scan: a file is a row of bytes (a
    season is some hundred lines), each of its lines is mapped by its own header. Columns are those
    of ``HEADERS``, null where a file lacks them. Empty lines, lines with more fields than the
    header and lines without goals go."""
    plain = lambda path: F.regexp_replace(path, r"^(\w+):/+", "$1:/")
    raw = spark.read.format("binaryFile").load(list(labels)).select(plain(F.col("path")).alias("path"), text_of(F.col("content")).alias("text"))
    named = spark.createDataFrame([(_qualified(spark, p), label) for p, label in labels.items()], "at string, season string").select(plain(F.col("at")).alias("path"), "season")
    lines = raw.join(named, "path").select("season", F.split(F.regexp_replace("text", "^﻿", ""), r"\r?\n").alias("lines"))
    rows = lines.select("season", fields_of(F.get("lines", F.lit(0))).alias("header"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    cut = rows.select("season", "header", fields_of(F.col("line")).alias("fields")).where(F.exists("fields", lambda x: x != "") & (F.size("fields") <= F.size("header")))
    at = lambda name: F.nullif(F.get("fields", (F.array_position("header", name) - 1).cast("int")), F.lit(""))
    new = F.array_contains("header", "FTHG")
    older = {v: k for k, v in OLDER.items()}
    value = lambda name: F.when(new, at(name)).otherwise(at(older[name])) if name in older else at(name)
    out = cut.select("season", *[value(name).alias(ours) for name, ours in HEADERS.items()])
    goals = {c: F.expr(f"try_cast({c} AS INT)") for c in ("goals_home", "goals_away")}
    return out.withColumns({"date": day(F.col("date")), **goals}).na.drop(subset=list(goals))


def _qualified(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def id_ranges(probes: DataFrame, season: str = "season", key: str = "id", buffer: int = BUFFER) -> DataFrame:
    """(season, low, high) from probes that belong to the league, widened by a buffer."""
    return probes.groupBy(season).agg(F.greatest(F.lit(1), F.min(key) - buffer).alias("low"), (F.max(key) + buffer).alias("high"))


def in_ranges(rows: DataFrame, ranges: DataFrame, key: str = "id", width: int = 512) -> DataFrame:
    """Rows whose key lies in any of the ranges (low, high), once each. Ranges are cut at
    multiples of ``width``, so this is an equi-join on the stretch, not a nested loop."""
    cut = ranges.select("low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("_stretch"))
    spans = cut.select("_stretch", F.greatest("low", F.col("_stretch") * width).alias("_from"), F.least("high", (F.col("_stretch") + 1) * width - 1).alias("_to")).distinct()
    here = F.floor(F.col(key) / width)
    return rows.join(spans, (here == F.col("_stretch")) & F.col(key).between(F.col("_from"), F.col("_to")), "left_semi")


def weather_jobs(matches: DataFrame) -> DataFrame:
    """(home_team, year, first, last): which days each document must cover."""
    year = F.year("match_date").alias("year")
    return matches.where("match_date is not null").groupBy("home_team", year).agg(F.min("match_date").alias("first"), F.max("match_date").alias("last"))


def weather(documents: DataFrame, text: str = "body") -> DataFrame:
    """(home_team, day, temperature, humidity, wind_speed, precipitation), one row a day and
    team, of documents (home_team, text) with a series of days and parallel series of values.
    A value a series lacks at a day's position is null, as all are of a series that is missing;
    days that can't be read go. Of repeated days the row with the greatest values stays."""
    rows = documents.select("home_team", F.from_json(text, WEATHER)["daily"].alias("d")).select("home_team", "d", F.posexplode("d.time").alias("at", "day"))
    values = [F.get(F.col(f"d.{s}"), F.col("at")).alias(n) for s, n in SERIES.items()]
    known = rows.select("home_team", F.expr("try_cast(day AS DATE)").alias("day"), *values).where("day is not null")
    return known.groupBy("home_team", "day").agg(F.max(F.struct(*SERIES.values())).alias("w")).select("home_team", "day", "w.*")


def with_weather(matches: DataFrame, found: DataFrame) -> DataFrame:
    """Matches with the weather of their day at the home team."""
    return matches.drop(*SERIES.values()).join(found.withColumnRenamed("day", "match_date"), ["home_team", "match_date"], "left")


def _fixture(home: str, away: str) -> list[Column]:
    return [F.expr("try_cast(substring(utc, 1, 10) AS DATE)").alias("date"), F.col(home).alias("home_team"), F.col(away).alias("away_team"), F.when(F.length("utc") > 16, F.substring("utc", 12, 5)).otherwise("").alias("time")]


def scheduled(documents: DataFrame, text: str = "body") -> DataFrame:
    """Fixtures (date, home_team, away_team, time) of feeds with a list of matches."""
    rows = documents.select(F.explode(F.from_json(text, SCHEDULED)["matches"]).alias("m")).withColumn("utc", F.coalesce("m.utcDate", F.lit("")))
    return _named(rows.select(*_fixture("m.homeTeam.name", "m.awayTeam.name")))


def listed(documents: DataFrame, text: str = "body") -> DataFrame:
    """Fixtures of feeds with a list of responses; only those still to come."""
    rows = documents.select(F.explode(F.from_json(text, LISTED)["response"]).alias("m")).where(F.col("m.fixture.status.short").isin(*TO_COME)).withColumn("utc", F.coalesce("m.fixture.date", F.lit("")))
    return _named(rows.select(*_fixture("m.teams.home.name", "m.teams.away.name")))


def _named(rows: DataFrame) -> DataFrame:
    return rows.where("home_team <> '' and away_team <> ''")


def cascade(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any, all in one plan; by pair of teams the
    earliest, rows without a date last."""
    ranked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)])
    first = F.broadcast(ranked.agg(F.min("_rank").alias("_first")))  # one row
    order = Window.partitionBy("home_team", "away_team").orderBy(F.col("date").asc_nulls_last(), F.col("time").asc_nulls_last())
    return ranked.join(first, F.col("_rank") == F.col("_first")).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_rank", "_first", "_place")
