"""Histories in small blocks give what one window over a team's matches gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrace.operators import blocks, history, standings
from terrace.plans import steps
from terrace.sources import contest as source

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(history.LOOKS_BACK))
def test_blocks_agree_with_whole_histories(spark, name):
    matches = source.contest(spark, D).withColumns({"xg_home": F.expr("CASE WHEN match_id % 5 > 0 THEN xg_home END")}).cache()
    layers, names = getattr(history, name)()
    extra = blocks.days_before if name == "momentum" else None
    whole = steps.columns(extra(source.sides(matches)) if extra else source.sides(matches), *layers)
    cut = blocks.histories(matches, layers, history.LOOKS_BACK[name], rows=60, extra=extra)
    assert blocks.numbered(matches, 60).select("block").distinct().count() > 5
    final = steps.rounded(["match_id", "team"], names)
    a, b = whole.selectExpr(*final), cut.selectExpr(*final)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_a_block_holds_no_more_than_its_rows(spark):
    """A team's partitions don't grow with its matches: before, one held them all."""
    matches = source.contest(spark, D)
    sides = source.sides(blocks.numbered(matches, 60), "block")
    per = sides.groupBy("team", "block").count().agg(F.max("count")).first()[0]
    assert per <= 70 < sides.groupBy("team").count().agg(F.max("count")).first()[0]
    kinds = history.LOOKS_BACK["momentum"]
    most = blocks.earlier(sides, kinds).groupBy("team", "block").count().agg(F.max("count")).first()[0]
    assert most <= sum(n for _, n in kinds)


def test_league_tables_do_not_multiply_matches(spark):
    """Small blocks give the table of one block; before, each match became a row a team."""
    matches = source.contest(spark, D).cache()
    a, b = standings.table_before(matches, 40), standings.table_before(matches)
    assert a.count() == matches.count() and a.exceptAll(b).isEmpty()
    assert "Window" not in b.select("match_id", "table_pos_home")._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]


def test_placed_form_is_the_windows_form(spark):
    """Form and place of both sides in one pass by block: before, windows by team, then a shuffle
    and two joins by match."""
    from terrace.operators import decisions

    matches = source.contest(spark, D).withColumns({"shots_home": F.expr("CASE WHEN match_id % 3 > 0 THEN shots_home END"), "match_date": F.expr("CASE WHEN match_id % 50 > 0 THEN match_date END")}).cache()
    layers, names = history.rolling_form((5,))
    found = blocks.placed_form(matches, ["match_id", "dn", "match_date", "home_team", "away_team"], rows=60)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan.split("\n:")[0]
    assert set(found.columns) >= {f"{n}_{s}" for n in names for s in ("home", "away")}
    windows = steps.both_sides(steps.columns(source.sides(matches), *layers), names)
    final = steps.rounded(["match_id"], [f"{n}_{s}" for n in names for s in ("home", "away")])
    a, b = windows.selectExpr(*final), found.selectExpr(*final)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    places = [r.match_id for r in found.orderBy("place").collect()]
    assert places == [r.match_id for r in matches.orderBy(F.col("match_date").asc_nulls_first(), "match_id").collect()]
    known = matches.where("match_date is not null")
    by_day = decisions.ordered_place(known).select("match_id", "place", "total")
    assert by_day.exceptAll(blocks.placed_form(known, ["match_id", "match_date", "home_team", "away_team"], rows=60).select("match_id", "place", "total")).isEmpty()
