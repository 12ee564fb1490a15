"""Files in one scan, id ranges, weather series, feeds and sketches on small cases."""

import datetime
import json
import random

import pytest

from terrace.operators import aggregates
from terrace.sources import files, intake


def test_many_season_files_in_one_scan(spark, tmp_path):
    labels = {}
    for i in range(1000):
        path = tmp_path / f"f{i:04d}.csv"
        head, row = ("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,Referee", f"1{i % 10}/08/2021,X,Y,{i % 7},1,H,R") if i % 2 else ("HomeTeam,Date,AwayTeam,HG,AG,Res", f"X,1{i % 10}/08/21,Y,{i % 7},1,H")
        path.write_bytes(f"{head}\n{row}\n".encode())
        labels[str(path)] = f"s{i}"
    got = intake.season_scan(spark, labels)
    rows = {r.season: r for r in got.collect()}
    assert len(rows) == 1000 and all(rows[f"s{i}"].goals_home == i % 7 and rows[f"s{i}"].date == datetime.date(2021, 8, 10 + i % 10) for i in range(1000))
    assert rows["s1"].referee == "R" and rows["s2"].referee is None and set(got.columns) == {"season", *files.HEADERS.values()}


def test_scan_reads_quotes_encodings_and_bad_lines(spark, tmp_path):
    head = "Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,Referee"
    cases = {
        "utf": ("﻿" + head + '\r\n14/08/2021,"A, ""B"" FC",Málaga,2,1,H,\r\n,,,,,,\r\n').encode("utf-8"),
        "latin": (head + "\n15/08/2021,Málaga,X,0,0,D,R\n16/08/2021,too,many,1,1,D,R,extra,fields\n17/08/2021,no,goals,,,D\n").encode("latin-1"),
        "windows": (head + "\n18/08/2021,O’Neil–Ž,Y,3,0,H\n").encode("cp1252"),
        "empty": b"", "header": head.encode(),
    }
    for name, raw in cases.items():
        (tmp_path / f"{name}.csv").write_bytes(raw)
    got = {r.season: r for r in intake.season_scan(spark, {str(tmp_path / f"{n}.csv"): n for n in cases}).collect()}
    assert set(got) == {"utf", "latin", "windows"}
    assert got["utf"].home_team == 'A, "B" FC' and got["utf"].away_team == "Málaga" and got["utf"].referee is None
    assert got["latin"].home_team == "Málaga" and got["windows"].home_team == "O’Neil–Ž" and got["windows"].referee is None


def test_id_ranges_against_a_loop(spark):
    dice = random.Random(2)
    rows = [(i, dice.randrange(4)) for i in dice.sample(range(1, 30_000), 4000)] + [(None, 1)]
    events = spark.createDataFrame(rows, "id long, season int")
    probes = [(i, s) for i, s in rows if i is not None and i % 100 == 1 and s < 2]
    ranges = {s: (max(1, min(i for i, k in probes if k == s) - 250), max(i for i, k in probes if k == s) + 250) for s in {s for _, s in probes}}
    found = intake.id_ranges(events.where("id % 100 = 1 and season < 2"))
    assert {r.season: (r.low, r.high) for r in found.collect()} == ranges
    narrow = spark.createDataFrame([(5, 5), (100, 1200), (1100, 1300), (511, 512), (29_000, 40_000)], "low long, high long")
    got = sorted(r.id for r in intake.in_ranges(events, narrow).collect())
    assert got == sorted(i for i, _ in rows if i is not None and any(a <= i <= b for a, b in [(5, 5), (100, 1300), (511, 512), (29_000, 40_000)]))
    assert intake.in_ranges(events, narrow.where("1 = 0")).count() == 0
    plan = intake.in_ranges(events, narrow)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ragged_weather(spark):
    body = {"daily": {"time": ["2020-01-01", "2020-01-02", "bad", "2020-01-04"], "temperature_2m_mean": [1.0, None], "relative_humidity_2m_mean": None, "wind_speed_10m_max": [3.0, 4.0, 5.0, 6.0]}}
    docs = spark.createDataFrame([("A", json.dumps(body)), ("A", json.dumps({"daily": {"time": ["2020-01-02"], "temperature_2m_mean": [7.5]}})), ("B", json.dumps({"daily": {}})), ("C", "no json"), ("D", None)], "home_team string, body string")
    got = {(r.home_team, r.day.day): tuple(r)[2:] for r in intake.weather(docs).collect()}
    assert got == {("A", 1): (1.0, None, 3.0, None), ("A", 2): (7.5, None, None, None), ("A", 4): (None, None, 6.0, None)}
    games = spark.createDataFrame([(1, "A", datetime.date(2020, 1, 1), 99.0), (2, "A", datetime.date(2020, 1, 3), 99.0), (3, "B", None, 99.0)], "match_id int, home_team string, match_date date, temperature double")
    assert {r.match_id: r.temperature for r in intake.with_weather(games, intake.weather(docs)).collect()} == {1: 1.0, 2: None, 3: None}
    assert [tuple(r) for r in intake.weather_jobs(games).collect()] == [("A", 2020, datetime.date(2020, 1, 1), datetime.date(2020, 1, 3))]


def test_fixture_cascade(spark):
    feed = {"matches": [{"utcDate": "2024-05-02T15:00:00Z", "homeTeam": {"name": "A"}, "awayTeam": {"name": "B"}}, {"utcDate": "2024-05-01", "homeTeam": {"name": "A"}, "awayTeam": {"name": "B"}}, {"utcDate": None, "homeTeam": {"name": "C"}, "awayTeam": {"name": "D"}}, {"utcDate": "2024-05-01T12:00:00Z", "homeTeam": {"name": ""}, "awayTeam": {"name": "D"}}, {"homeTeam": None, "awayTeam": {"name": "D"}}]}
    other = {"response": [{"fixture": {"date": "2024-06-01T12:30:00+00:00", "status": {"short": s}}, "teams": {"home": {"name": h}, "away": {"name": "Z"}}} for s, h in (("NS", "P"), ("FT", "Q"), ("PST", "R"))]}
    make = lambda *bodies: spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    none = spark.createDataFrame([], "date date, home_team string, away_team string, time string")
    a, b = intake.scheduled(make(feed, {}, {"matches": []})), intake.listed(make(other))
    got = lambda *s: sorted((r.home_team, r.away_team, str(r.date), r.time) for r in intake.cascade(list(s)).collect())
    assert got(none, a, b) == [("A", "B", "2024-05-01", ""), ("C", "D", "None", "")]
    assert got(none, a.where("1 = 0"), b) == [("P", "Z", "2024-06-01", "12:30"), ("R", "Z", "2024-06-01", "12:30")]
    assert got(none, none) == []


def test_sketch_error_and_size(spark):
    rows = lambda n: spark.range(n).selectExpr("cast((id * 7919) % 1000003 as double) AS x", "cast(NULL AS double) AS y")
    sizes = []
    for n in (200_000, 800_000):
        df, k = rows(n), 4096
        found = aggregates.sketches(df, ["x", "y"], k).cache()
        sizes.append(found.selectExpr("octet_length(x) AS n").first().n)
        for r in aggregates.sketch_quantiles(found, ["x", "y"]).collect():
            if r.name == "y":
                assert r.n == 0 and r.q50 is None
                continue
            for q, v in ((0.01, r.q01), (0.5, r.q50), (0.99, r.q99)):
                true = df.where(f"x <= {v}").count() / n
                assert abs(true - q) < 0.002
        got = {r.name: r["rank"] for r in aggregates.sketch_ranks(found, {"x": 250_000.0, "y": 1.0}).collect()}
        assert got["x"] == pytest.approx(df.where("x <= 250000").count() / n, abs=0.002) and got["y"] is None
    assert sizes[1] < 1.5 * sizes[0] and sizes[1] < 4096 * 8 * 4
