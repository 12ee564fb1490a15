"""Queries of intake, sketches and small row operators; registered by ``registry``. Their SQL is
written apart from the operators. Documents of the feeds are made by Spark from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import columns, metrics
from terrace.operators import aggregates, meetings, upcoming
from terrace.plans import steps
from terrace.sources import contest as source
from terrace.sources import intake
from terrace.sources.staging import Staged

C = source.CONTEST_SQL
PROBE = ["xg_home", "shots_home", "temperature", "odds_home_open", "goals_home"]
#: Events of S2: the league is a type of event, a season a week.
LEAGUE, WANTED = "click", (1, 2)
SEASON = "CAST(floor((day({}) - 1) / 7) AS INT)"


def weather_documents(spark: SparkSession, d: str) -> DataFrame:
    """(home_team, body): a document for each team and year with parallel daily series. One
    series of even teams ends a day early, one is missing for every fifth team."""
    daily = source.contest(spark, d).groupBy("home_team", "season", "match_date").agg(F.max("temperature").alias("t"), F.max("wind_speed").alias("w"), F.max("precipitation").alias("p"))
    days = daily.groupBy("home_team", "season").agg(F.array_sort(F.collect_list(F.struct("match_date", "t", "w", "p"))).alias("x"))
    short = F.when(F.col("home_team") % 2 == 0, F.slice("x.w", F.lit(1), F.greatest(F.size("x") - 1, F.lit(0)))).otherwise(F.col("x.w"))
    gone = F.when(F.col("home_team") % 5 != 0, F.col("x.p"))
    series = F.struct(F.transform("x.match_date", lambda v: v.cast("string")).alias("time"), F.col("x.t").alias("temperature_2m_mean"), short.alias("wind_speed_10m_max"), gone.alias("precipitation_sum"))
    return days.select("home_team", F.to_json(F.struct(series.alias("daily"))).alias("body"))


WEATHER_SQL = f"""SELECT home_team, match_date AS day, t AS temperature, NULL::DOUBLE AS humidity,
  CASE WHEN home_team % 2 = 0 AND match_date = max(match_date) OVER (PARTITION BY home_team, season) THEN NULL ELSE w END AS wind_speed, CASE WHEN home_team % 5 <> 0 THEN p END AS precipitation
  FROM (SELECT home_team, season, match_date, max(temperature) AS t, max(wind_speed) AS w, max(precipitation) AS p FROM ({C}) GROUP BY ALL)"""


def season_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Events of the wanted weeks inside the id ranges of probes of the league."""
    events = source.read(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.expr(SEASON.format("ts")).alias("season"))
    probes = events.where(f"id % 200 = 1 and event_type = '{LEAGUE}'")
    ranges = intake.id_ranges(probes.where(F.col("season").isin(*WANTED)))
    return intake.in_ranges(events, ranges).where((F.col("event_type") == LEAGUE) & F.col("season").isin(*WANTED))


RANGES_SQL = f"""WITH e AS (SELECT event_id AS id, event_type, {SEASON.format('ts')} AS season FROM events),
r AS (SELECT season, greatest(1, min(id) - 250) AS low, max(id) + 250 AS high FROM e WHERE id % 200 = 1 AND event_type = '{LEAGUE}' AND season IN {WANTED} GROUP BY season)
SELECT id, season FROM e WHERE event_type = '{LEAGUE}' AND season IN {WANTED} AND EXISTS (FROM r WHERE id BETWEEN low AND high)"""


def fixture_feeds(spark: SparkSession, d: str) -> list[DataFrame]:
    """Three sources of fixtures: files without any of the division, a feed of matches by season
    for the last season, and one of responses with all matches."""
    games = source.contest(spark, d).select("season", "match_date", F.col("home_team").cast("string").alias("h"), F.col("away_team").cast("string").alias("a"), F.concat(F.date_format("match_date", "yyyy-MM-dd"), F.lit("T1"), (F.col("match_id") % 10).cast("string"), F.lit(":30:00Z")).alias("utc"), "match_id")
    files = games.where("season < 0").select(F.col("match_date").alias("date"), F.col("h").alias("home_team"), F.col("a").alias("away_team"), F.lit("").alias("time"))
    team = lambda c: F.struct(F.col(c).alias("name"))
    last = F.broadcast(games.agg(F.max("season").alias("now")))
    one = F.struct(F.when(F.col("match_id") % 31 > 0, F.col("utc")).alias("utcDate"), team("h").alias("homeTeam"), F.when(F.col("match_id") % 37 > 0, team("a")).alias("awayTeam"))
    feed = games.join(last, games.season == last.now).groupBy(F.month("match_date").alias("m")).agg(F.to_json(F.struct(F.collect_list(one).alias("matches"))).alias("body"))
    other = F.struct(F.struct(F.col("utc").alias("date"), F.struct(F.lit("NS").alias("short")).alias("status")).alias("fixture"), F.struct(team("h").alias("home"), team("a").alias("away")).alias("teams"))
    rest = games.groupBy(F.month("match_date").alias("m")).agg(F.to_json(F.struct(F.collect_list(other).alias("response"))).alias("body"))
    return [files, intake.scheduled(feed), intake.listed(rest)]


FIXTURES_SQL = f"""SELECT CAST(home_team AS BIGINT) AS home_team, CAST(away_team AS BIGINT) AS away_team, dn, clock FROM (
  SELECT home_team, away_team, CASE WHEN match_id % 31 > 0 THEN dn END AS dn, CASE WHEN match_id % 31 > 0 THEN '1' || (match_id % 10) || ':30' ELSE '' END AS clock FROM ({C}) WHERE season = (SELECT max(season) FROM ({C})) AND match_id % 37 > 0)
  QUALIFY row_number() OVER (PARTITION BY home_team, away_team ORDER BY dn NULLS LAST, clock) = 1"""


#: Features of M23: of sides, of the live season (by team) and of news (by team).
KNOWN = {"goals_scored_l5": "gf", "goals_conceded_l5": "CASE WHEN {t} % 4 = 0 THEN NULL ELSE ga END", "elo": "CASE WHEN {t} % 3 = 0 THEN NULL ELSE 1400 + gap_elo END", "xg_for_l5": "xgf", "xg_overperformance_l5": "gf - xgf", "wind_exposure": "CASE WHEN {t} % 5 = 0 THEN NULL ELSE shots_f END", "upset_tendency": "CASE WHEN {t} % 2 = 0 THEN NULL ELSE ht_gf END"}
LIVE = {"goals_scored_l5": "CASE WHEN {t} % 7 = 0 THEN NULL ELSE ({t} % 6) / CAST(2 AS DOUBLE) END", "goals_conceded_l5": "({t} % 5) / CAST(2 AS DOUBLE)", "wind_exposure": "CAST({t} % 9 AS DOUBLE)"}
NEWS = {"sentiment": "({t} * 7 % 11 - 5) / CAST(10 AS DOUBLE)", "volume": "{t} * 3 % 8"}


def upcoming_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every match turned round and put after the last season, with all that M23 knows of it. The
    matches are written once: what follows reads them several times."""
    games = Staged(source.contest(spark, d).select(*source.OF_SIDES), "matches").rows
    sides = source.sides(games).selectExpr("team", "is_home", "season", "match_date", "match_id", *[f"{e.format(t='team')} AS {n}" for n, e in KNOWN.items()])
    fixtures = games.selectExpr("match_id", "date_add(match_date, 3000) AS match_date", "away_team AS home_team", "home_team AS away_team")
    teams = source.read(spark, d, "nation").withColumnRenamed("n_nationkey", "team")
    live = teams.selectExpr("team", *[f"{e.format(t='team')} AS {n}" for n, e in LIVE.items()])
    news = teams.where("team % 6 <> 1").selectExpr("team", *[f"{e.format(t='team')} AS {n}" for n, e in NEWS.items()])
    return upcoming.prepare(fixtures, sides, list(KNOWN), live, {"xg_for_l5": "goals_scored_l5"}, ["odds_home_close"], teams.where("team % 4 <> 3").select("team"), games, (news, list(NEWS), ["sentiment"]))


def _upcoming_sql() -> str:
    """M23 apart: latest rows by window, meetings by a join of all pairs."""
    always, base = ("goals_scored_l5", "goals_conceded_l5"), {"elo": (1460, 1460), "upset_tendency": (0.3, 0.3), "xg_for_l5": (1.1, 1.0)}
    picks = lambda v: f"row_number() OVER (PARTITION BY team ORDER BY (is_home = {v})::INT DESC, (is_home = {v} AND season = m)::INT DESC, match_date DESC, match_id DESC)"
    cols, shown = [], []
    for t, s, k in (("h", "home", 0), ("a", "away", 1)):
        for n in KNOWN:
            x = f"coalesce({t}v.{n}, {t}x.{n})"
            if n in LIVE:
                y = f"({LIVE[n].format(t=f'{s}_team')})"
                x = f"coalesce({y}, {x})" if n in always else f"coalesce({x}, {y})"
            if n == "xg_overperformance_l5":
                x = "0.0"
            cols.append(f"{x} AS {n}_{s}0")
            y = f"coalesce(0.85 * goals_scored_l5_{s}0 + 0.15 * 1.35, xg_for_l5_{s}0)" if n == "xg_for_l5" else f"{n}_{s}0"
            shown.append((f"CASE WHEN {y} IS NULL AND {s}_team % 4 <> 3 THEN {base[n][k]} ELSE {y} END" if n in base else y) + f" AS {n}_{s}")
    told = ", ".join(f"CASE WHEN {s}_team % 6 <> 1 THEN {e.format(t=f'{s}_team')} ELSE 0 END AS live_{n}_{s}" for n, e in NEWS.items() for s in ("home", "away"))
    d = meetings.DEFAULTS
    return f"""WITH g AS ({C}), sd AS (SELECT team, is_home, season, match_date, match_id, {', '.join(f"{e.format(t='team')} AS {n}" for n, e in KNOWN.items())}, max(season) OVER () AS m FROM ({source.SIDES_SQL})),
    pl AS (SELECT team FROM sd GROUP BY team HAVING bool_or(season = m)), px AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS x, {picks(1)} AS ph, {picks(0)} AS pa FROM sd),
    every AS (SELECT team, {', '.join(f'arg_max_null({n}, (match_date, match_id)) AS {n}' for n in KNOWN)} FROM px GROUP BY team),
    u AS (SELECT match_id, away_team AS home_team, home_team AS away_team FROM g),
    mt AS (SELECT u.match_id, CASE WHEN o.home_team = u.home_team THEN o.goals_home ELSE o.goals_away END AS w, CASE WHEN o.home_team = u.home_team THEN o.goals_away ELSE o.goals_home END AS l, o.home_team = u.home_team AS own_ground,
      row_number() OVER (PARTITION BY u.match_id ORDER BY o.match_date DESC, o.match_id DESC) AS k FROM u JOIN g o ON least(u.home_team, u.away_team) = least(o.home_team, o.away_team) AND greatest(u.home_team, u.away_team) = greatest(o.home_team, o.away_team) QUALIFY k <= 10),
    hh AS (SELECT match_id, count(*) AS n, avg((w > l)::INT) AS hw, avg((w = l)::INT) AS dr, avg(w + l) AS gl, stddev_pop(w + l) AS vol, avg((w > 0 AND l > 0)::INT) AS bt, avg((w + l > 2)::INT) AS o25, avg(w) AS wa, avg(l) AS la, avg((w > l)::INT) FILTER (own_ground) AS vd, avg((w > l)::INT) FILTER (k <= 3) AS l3, avg((l = 0)::INT) AS cs FROM mt GROUP BY match_id),
    r AS (SELECT u.*, {', '.join(cols)} FROM u LEFT JOIN pl ph ON ph.team = home_team LEFT JOIN px hv ON hv.team = ph.team AND hv.ph = 1 AND hv.is_home = 1 LEFT JOIN every hx ON hx.team = ph.team LEFT JOIN pl pa ON pa.team = away_team LEFT JOIN px av ON av.team = pa.team AND av.pa = 1 AND av.is_home = 0 LEFT JOIN every ax ON ax.team = pa.team),
    z AS (SELECT r.*, {', '.join(shown)}, {told} FROM r)
    SELECT z.*, {', '.join(f'{n}_home - {n}_away AS {n}_diff' for n in KNOWN)}, live_sentiment_home - live_sentiment_away AS live_sentiment_diff,
    coalesce(n, 0) AS h2h_matches, coalesce(hw, {d['h2h_home_win_pct']}) AS h2h_home_win_pct, coalesce(dr, {d['h2h_draw_pct']}) AS h2h_draw_pct, coalesce(1 - hw - dr, {d['h2h_away_win_pct']}) AS h2h_away_win_pct, coalesce(gl, {d['h2h_avg_goals']}) AS h2h_avg_goals,
    coalesce(vol, 0) AS h2h_goals_volatility, coalesce(bt, 0.5) AS h2h_btts_rate, coalesce(o25, 0.5) AS h2h_over25_rate, coalesce(wa, 1.5) AS h2h_home_goals_avg, coalesce(la, 1.2) AS h2h_away_goals_avg, coalesce(vd, 0.45) AS h2h_venue_dominance,
    CASE WHEN n >= 4 THEN l3 - hw ELSE 0 END AS h2h_recent_shift, 0 AS h2h_xg_dominance, 0 AS h2h_home_scoring_trend, coalesce(cs, 0.3) AS h2h_clean_sheet_pct, NULL AS odds_home_close FROM z LEFT JOIN hh USING (match_id)"""


def register(queries: dict, oracles: dict) -> None:
    def add(name, query, oracle, final):
        queries[name] = lambda spark, d: query(spark, d).selectExpr(*final)
        if oracle:
            oracles[name] = steps.final_sql(oracle, final)

    dn = f"datediff(day, DATE'{source.DAY_ZERO}') AS dn"
    values = ["temperature", "humidity", "wind_speed", "precipitation"]
    add("s04_weather_batch", lambda s, d: intake.weather(weather_documents(s, d)).selectExpr("home_team", dn, *values),
        f"SELECT home_team, date_diff('day', DATE '{source.DAY_ZERO}', day) AS dn, {', '.join(values)} FROM ({WEATHER_SQL})", steps.rounded(["home_team", "dn"], values))
    add("j02_match_weather", lambda s, d: intake.with_weather(source.contest(s, d), intake.weather(weather_documents(s, d).where("home_team <> 3"))),
        f"SELECT match_id, w.temperature, w.humidity, w.wind_speed, w.precipitation FROM ({C}) c LEFT JOIN ({WEATHER_SQL}) w ON w.home_team = c.home_team AND w.day = c.match_date AND w.home_team <> 3", steps.rounded(["match_id"], values))
    jobs = f"SELECT home_team, season AS year, min(dn) AS first, max(dn) AS last FROM ({C}) GROUP BY ALL"
    add("s04_weather_jobs", lambda s, d: intake.weather_jobs(source.contest(s, d)).selectExpr("home_team", "year", *[f"datediff({c}, DATE'{source.DAY_ZERO}') AS {c}" for c in ("first", "last")]), jobs, steps.rounded(["home_team", "year", "first", "last"], []))
    add("s02_id_ranges", season_ranges, RANGES_SQL, steps.rounded(["id", "season"], []))
    add("s07_fixture_cascade", lambda s, d: intake.cascade(fixture_feeds(s, d)).selectExpr("home_team", "away_team", f"datediff(date, DATE'{source.DAY_ZERO}') AS dn", "time AS clock"), FIXTURES_SQL, steps.rounded(["home_team", "away_team", "dn"], [], ("clock",)))
    long = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS x FROM c" for c in PROBE)
    add("a08_sketch", lambda s, d: aggregates.sketch_quantiles(aggregates.sketches(source.contest(s, d), PROBE), PROBE),
        f"WITH c AS ({C}), l AS ({long}) SELECT name, count(x) AS n, quantile_disc(x, 0.01) AS q01, quantile_disc(x, 0.5) AS q50, quantile_disc(x, 0.99) AS q99 FROM l GROUP BY name", steps.rounded(["n"], ["q01", "q50", "q99"], ("name",)))
    means = lambda s, d: source.contest(s, d).agg(*[F.round(F.avg(c), 2).alias(c) for c in PROBE]).first().asDict()
    add("a18_percentile_rank", lambda s, d: aggregates.sketch_ranks(aggregates.sketches(source.contest(s, d), PROBE), means(s, d)),
        f"WITH c AS ({C}), l AS ({long}), m AS (SELECT name, round(avg(x), 2) AS value FROM l GROUP BY name) SELECT name, value, avg(CASE WHEN x <= value THEN 1.0 ELSE 0 END) FILTER (x IS NOT NULL) AS rank FROM l JOIN m USING (name) GROUP BY ALL",
        steps.rounded([], ["value", "rank"], ("name",)))
    add("a05_season_spans", lambda s, d: aggregates.season_spans(source.contest(s, d), "match_id"), f"SELECT season, min(match_id) AS first_id, max(match_id) AS last_id, count(*) AS n FROM ({C}) GROUP BY season", steps.rounded(["season", "first_id", "last_id", "n"], []))
    add("a06_league_averages", lambda s, d: aggregates.league_averages(source.contest(s, d), PROBE), f"SELECT {', '.join(f'avg({c}) AS {c}' for c in PROBE)} FROM ({C}) WHERE season = (SELECT max(season) FROM ({C}))", steps.rounded([], PROBE))
    order = ["match_date", "match_id"]
    ends = " UNION ALL ".join(f"SELECT '{e}' AS \"end\", match_id, row_number() OVER (ORDER BY match_date, match_id) AS place FROM (SELECT * FROM ({C}) ORDER BY match_date {o}, match_id {o} LIMIT 5)" for e, o in (("head", "ASC"), ("tail", "DESC")))
    add("l02_head_tail", lambda s, d: aggregates.head_and_tail(source.contest(s, d).select("match_date", "match_id"), order, 5).withColumnRenamed("end", "side"), f'SELECT "end" AS side, match_id, place FROM ({ends})', steps.rounded(["match_id", "place"], [], ("side",)))
    cors = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM c" for i, a in enumerate(PROBE) for b in PROBE[i + 1 :])
    add("l06_strongest", lambda s, d: aggregates.largest(aggregates.correlations(source.contest(s, d), PROBE), F.abs("r"), 4, "a", "b"), f"WITH c AS ({C}) SELECT * FROM ({cors}) ORDER BY abs(r) DESC NULLS LAST, a, b LIMIT 4", steps.rounded([], ["r"], ("a", "b")))
    add("p15_finite", lambda s, d: steps.columns(source.contest(s, d), {"ratio": "CASE WHEN goals_away = 0 AND goals_home <> 1 THEN CAST('Infinity' AS DOUBLE) * (goals_home - 1) WHEN goals_away > 0 THEN goals_home / CAST(goals_away AS DOUBLE) END"}, columns.finite(["ratio", "xg_home"])),
        f"SELECT match_id, CASE WHEN goals_away > 0 THEN goals_home / goals_away::DOUBLE END AS ratio_finite, xg_home AS xg_home_finite FROM ({C})", steps.rounded(["match_id"], ["ratio_finite", "xg_home_finite"]))
    chances = {"p_home": "(30 + match_id % 41) / CAST(100 AS DOUBLE)", "p_draw": "(10 + match_id % 17) / CAST(100 AS DOUBLE)", "p_away": "(60 - match_id % 41 - match_id % 17) / CAST(100 AS DOUBLE)", "outcome": "CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END"}
    queries["m19_simulated_rank"] = lambda s, d: metrics.simulated_rank(steps.columns(source.contest(s, d), chances))
    m23 = [*[f"{n}_{x}" for n in KNOWN for x in ("home", "away", "diff")], *[f"live_{n}_{x}" for n in NEWS for x in ("home", "away")], "live_sentiment_diff", *[n for n in meetings.NAMES if n != "h2h_matches"], "odds_home_close"]
    add("m23_full", upcoming_matches, _upcoming_sql(), steps.rounded(["match_id", "h2h_matches"], m23))
