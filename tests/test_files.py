"""Result files, snapshots, nested JSON and sinks on small local files."""

import datetime
import json

from pyspark.sql import functions as F

from terrace.sources import files


def test_season_files_of_two_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365H,Other\n14/08/2021,X,Y,2,1,H,1.9,q\n,,,,,,,\n15/08/21,Y,Z,,,,2.1,q\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffDate,HomeTeam,AwayTeam,HG,AG,Res,Referee\n01/09/20,Z,X,0,0,D,R\n", encoding="utf-8")
    got = files.seasons(spark, {"2021-22": str(tmp_path / "a.csv"), "2020-21": str(tmp_path / "b.csv")})
    rows = {r.season: r for r in got.collect()}
    assert len(rows) == 2 and "Other" not in got.columns
    assert rows["2021-22"].date == datetime.date(2021, 8, 14) and rows["2021-22"].goals_home == 2 and rows["2021-22"].odds_b365_home == "1.9" and rows["2021-22"].referee is None
    assert rows["2020-21"].date == datetime.date(2020, 9, 1) and rows["2020-21"].goals_away == 0 and rows["2020-21"].result == "D"


def test_rating_snapshots_of_two_layouts(spark, tmp_path):
    (tmp_path / "2021-01-01.csv").write_text("Rank,Club,Country,Level,Elo\n1,A,ENG,1,1800.5\n2,B,ESP,1,1900\n3,C,ENG,1,bad\n")
    (tmp_path / "2021-02-01.csv").write_text("Club,Country,Level,Elo\nA,ENG,1,1810\n")
    got = sorted(tuple(r) for r in files.rating_snapshots(spark, str(tmp_path)).collect())
    assert got == [(datetime.date(2021, 1, 1), "A", 1800.5), (datetime.date(2021, 2, 1), "A", 1810.0)]


def test_fixtures_drop_the_mark_and_other_divisions(spark, tmp_path):
    (tmp_path / "f.csv").write_text("\ufeffDiv,Date,HomeTeam,AwayTeam\nE0 ,01/02/2024,A,B\nE1,01/02/2024,C,D\n", encoding="utf-8")
    assert [tuple(r) for r in files.fixtures(spark, str(tmp_path / "f.csv")).collect()] == [(datetime.date(2024, 2, 1), "A", "B")]


def test_nested_documents(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"standings": [{"table": [{"position": 1, "team": {"id": 7, "name": "A"}, "points": 9, "playedGames": 3, "form": "WWW"}, {"position": 2, "team": None}]}, {"table": [{"position": 9}]}]}, indent=2))
    got = files.standings(spark, str(tmp_path / "s.json")).orderBy("position").collect()
    assert [(r.position, r.team, r.team_id, r.points, r.won) for r in got] == [(1, "A", 7, 9, None), (2, None, None, None, None)]
    (tmp_path / "i.json").write_text(json.dumps({"response": [{"player": {"name": "P", "reason": "Knee"}, "team": {"name": "A"}}, {}]}, indent=2))
    assert [(r.player, r.team, r.reason, r.type) for r in files.injuries(spark, str(tmp_path / "i.json")).collect()] == [("P", "A", "Knee", None), (None, None, None, None)]
    assert files.documents(spark, str(tmp_path / "i.json")).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5.0)], "k int, x string, live_y double")
    path = str(tmp_path / "t")
    files.write_table(rows, path)
    assert spark.read.parquet(path).count() == 2
    files.write_table(rows.where("k > 9"), path, drop_empty=True)
    assert not (tmp_path / "t").exists()
    path = str(tmp_path / "j")
    files.update_json(spark, path, rows, "k")
    files.update_json(spark, path, spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "k int, x string, z string"), "k")
    got = {r.k: (r.x, r.live_y, r.z) for r in spark.read.json(path).collect()}
    assert got == {1: ("a", None, None), 2: ("b", 5.0, "n"), 3: ("c", None, "m")}
    assert files.without(rows, "live_").columns == ["k", "x"] and files.shared_columns(rows, rows.select("x", F.lit(1).alias("q"))) == ["x"]


def test_json_after_a_crash_between_renames(spark, tmp_path):
    path = str(tmp_path / "j")
    files.update_json(spark, path, spark.createDataFrame([(1, "a")], "k int, x string"), "k")
    (tmp_path / "j").rename(tmp_path / "j.old")
    files.update_json(spark, path, spark.createDataFrame([(2, "b")], "k int, x string"), "k")
    assert {r.k: r.x for r in spark.read.json(path).collect()} == {1: "a", 2: "b"} and not (tmp_path / "j.old").exists()


def test_staged_tables_are_removed(spark):
    import os

    from terrace.sources import staging

    staging.drop_all()
    a, b = (staging.Staged(spark.range(n), "test") for n in (3, 4))
    assert a.rows.count() == 3 and os.path.isdir(b.path)
    a.drop()
    staging.drop_all()
    assert not os.path.exists(a.path) and not os.path.exists(b.path) and not staging.Staged.made
