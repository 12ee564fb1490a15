"""The contest view: one row for each match, from the order tables.

An order is a match: its customer's nation plays at home, its first supplier's nation away;
lines returned and accepted are the goals. Columns the tables lack (half-time goals, expected
goals, shots, odds, weather, referee) follow from the keys by ``DERIVED``, whose expressions
are plain SQL, so any engine computes the same values. ``sides`` is the long form with two
rows a match, one from each team's view, on which histories are windows by team.

Order of matches: (match_date, match_id), never date alone, so same-day ties are settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_ZERO = "1990-01-01"
DERIVED = {
    "ht_goals_home": "CASE WHEN match_id % 19 = 0 THEN NULL ELSE CAST(floor(goals_home / 2.0) AS INT) END",
    "ht_goals_away": "CASE WHEN match_id % 19 = 0 THEN NULL ELSE CAST(floor(goals_away / 2.0) AS INT) END",
    "xg_home": "CASE WHEN match_id % 11 = 0 THEN NULL ELSE (goals_home * 8 + match_id % 7) / CAST(10 AS DOUBLE) END",
    "xg_away": "CASE WHEN match_id % 11 = 0 THEN NULL ELSE (goals_away * 8 + match_id % 5) / CAST(10 AS DOUBLE) END",
    "shots_home": "CASE WHEN match_id % 23 = 0 THEN NULL ELSE CAST(goals_home * 2 + match_id % 9 AS DOUBLE) END",
    "shots_away": "CASE WHEN match_id % 23 = 0 THEN NULL ELSE CAST(goals_away * 2 + match_id % 8 AS DOUBLE) END",
    "sot_home": "CAST(goals_home + match_id % 3 AS DOUBLE)",
    "sot_away": "CAST(goals_away + match_id % 2 AS DOUBLE)",
    "fouls": "CASE WHEN match_id % 29 = 0 THEN NULL ELSE CAST(14 + match_id % 13 AS DOUBLE) END",
    "yellows": "CAST(match_id % 6 AS DOUBLE)",
    "referee": "CASE WHEN match_id % 13 = 0 THEN NULL ELSE match_id % 20 END",
    "temperature": "CASE WHEN match_id % 6 = 0 THEN NULL ELSE CAST(match_id % 37 - 5 AS DOUBLE) END",
    "wind_speed": "CASE WHEN match_id % 9 = 0 THEN NULL ELSE CAST(match_id % 41 AS DOUBLE) END",
    "precipitation": "CASE WHEN match_id % 8 = 0 THEN NULL ELSE (match_id % 17) / CAST(10 AS DOUBLE) END",
    "odds_home_open": "CASE WHEN match_id % 17 = 0 THEN NULL ELSE (10 + match_id % 31) / CAST(10 AS DOUBLE) END",
    "odds_draw_open": "(28 + match_id % 12) / CAST(10 AS DOUBLE)",
    "odds_away_open": "(14 + match_id % 43) / CAST(10 AS DOUBLE)",
    "odds_home_close": "CASE WHEN match_id % 17 = 0 THEN NULL ELSE (11 + match_id % 29) / CAST(10 AS DOUBLE) END",
    "odds_draw_close": "(28 + match_id % 11) / CAST(10 AS DOUBLE)",
    "odds_away_close": "(14 + match_id % 37) / CAST(10 AS DOUBLE)",
    "result": "CASE WHEN goals_home > goals_away THEN 'H' WHEN goals_home = goals_away THEN 'D' ELSE 'A' END",
    "home_points": "CASE WHEN goals_home > goals_away THEN 3 WHEN goals_home = goals_away THEN 1 ELSE 0 END",
    "away_points": "CASE WHEN goals_away > goals_home THEN 3 WHEN goals_home = goals_away THEN 1 ELSE 0 END",
    "gap_elo": "CAST((match_id * 37) % 301 - 150 AS DOUBLE)",
}
#: Columns of a side that both views have: name -> (home's, away's).
SIDES = {
    "team": ("home_team", "away_team"), "opponent": ("away_team", "home_team"),
    "gf": ("goals_home", "goals_away"), "ga": ("goals_away", "goals_home"),
    "pts": ("home_points", "away_points"), "ht_gf": ("ht_goals_home", "ht_goals_away"), "ht_ga": ("ht_goals_away", "ht_goals_home"),
    "xgf": ("xg_home", "xg_away"), "xga": ("xg_away", "xg_home"),
    "shots_f": ("shots_home", "shots_away"), "shots_a": ("shots_away", "shots_home"), "sot_f": ("sot_home", "sot_away"),
}
_KEEP = ("match_id", "match_date", "dn", "season", "gap_elo", "result")
#: Columns of matches that ``sides`` reads.
OF_SIDES = tuple(dict.fromkeys([*_KEEP, *[c for both in SIDES.values() for c in both]]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows for work that is heavy for each: dealt anew where the files give fewer tasks than
    there are cores, else as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches. The lines are counted before the joins, so one row an order is shuffled."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("sk"),
        F.least(F.count_if(F.col("l_returnflag") == "R"), F.lit(6)).cast("int").alias("goals_home"),
        F.least(F.count_if(F.col("l_returnflag") == "A"), F.lit(6)).cast("int").alias("goals_away"),
    )
    orders, customer, supplier = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    rows = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(supplier, F.col("sk") == supplier.s_suppkey)
        .where("c_nationkey <> s_nationkey")
    )
    day = F.to_date("o_orderdate")
    base = rows.select(
        F.col("o_orderkey").alias("match_id"), day.alias("match_date"), F.datediff(day, F.lit(DAY_ZERO).cast("date")).alias("dn"),
        F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("home_team"), F.col("s_nationkey").alias("away_team"), "goals_home", "goals_away",
    )
    return base.selectExpr("*", *[f"{e} AS {n}" for n, e in DERIVED.items()])


def competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their league: the unordered pair of the teams' regions, as one number. The
    nations are a fixed, small table."""
    home, away = (read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(f"{s}_team"), F.col("n_regionkey").alias(f"_{s}")) for s in ("home", "away"))
    both = contest(spark, sf_dir).join(F.broadcast(home), "home_team", "left").join(F.broadcast(away), "away_team", "left")
    region = [F.coalesce(f"_{s}", F.lit(-1)) for s in ("home", "away")]
    return both.withColumn("league", 1000 * F.least(*region) + F.greatest(*region)).drop("_home", "_away")


def sides(matches: DataFrame, *more: str) -> DataFrame:
    """Two rows a match, from each team's view, with more columns of it; the match is read once."""
    view = lambda at: F.struct(F.lit(1 - at).alias("is_home"), *[F.col(c[at]).alias(n) for n, c in SIDES.items()])
    return matches.select(*_KEEP, *more, F.explode(F.array(view(0), view(1))).alias("side")).select(*_KEEP, *more, "side.*")


CONTEST_SQL = f"""SELECT *, {', '.join(f'{e} AS {n}' for n, e in DERIVED.items())} FROM (
  SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date,
         CAST(date_diff('day', DATE '{DAY_ZERO}', CAST(o_orderdate AS DATE)) AS INT) AS dn,
         CAST(year(o_orderdate) AS INT) AS season, c_nationkey AS home_team, s_nationkey AS away_team, goals_home, goals_away
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS sk,
         CAST(least(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 6) AS INT) AS goals_home,
         CAST(least(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END), 6) AS INT) AS goals_away
         FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON sk = s_suppkey WHERE c_nationkey <> s_nationkey)"""
COMPETITIONS_SQL = f"""SELECT c.*, 1000 * least(coalesce(h.n_regionkey, -1), coalesce(a.n_regionkey, -1)) + greatest(coalesce(h.n_regionkey, -1), coalesce(a.n_regionkey, -1)) AS league
  FROM ({CONTEST_SQL}) c LEFT JOIN nation h ON h.n_nationkey = home_team LEFT JOIN nation a ON a.n_nationkey = away_team"""
SIDES_SQL = " UNION ALL ".join(
    f"SELECT {', '.join(_KEEP)}, {1 - at} AS is_home, {', '.join(f'{c[at]} AS {n}' for n, c in SIDES.items())} FROM ({CONTEST_SQL})" for at in (0, 1)
)
