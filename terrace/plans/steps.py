"""Operators that add columns by layers of SQL expressions.

A layer maps column names to expressions over the columns before it. ``columns`` applies
layers to a DataFrame; ``sql`` nests the same layers as SELECTs around a query, for the twin
that another engine runs. ``rounded`` is the final projection: whole numbers as BIGINT,
others rounded to 6 places, never as a negative zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def columns(df: DataFrame, *layers: dict[str, str]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in layer.items()])
    return df


def sql(base: str, *layers: dict[str, str]) -> str:
    for layer in layers:
        base = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({base})"
    return base


def rounded(whole: list[str], other: list[str], plain: tuple[str, ...] = ()) -> list[str]:
    return [*plain, *[f"CAST({c} AS BIGINT) AS {c}" for c in whole], *[f"{_six_places(f'CAST({c} AS DOUBLE)')} AS {c}" for c in other]]


def _six_places(x: str) -> str:
    """Halves away from zero, in plain arithmetic: Spark's round() goes through decimals, which
    costs more than the windows that made the values. Large numbers are left to it."""
    return f"CASE WHEN abs({x}) < 1e9 THEN CASE WHEN {x} < 0 THEN 0 - floor(0.5 - {x} * 1e6) / 1e6 ELSE floor({x} * 1e6 + 0.5) / 1e6 END ELSE round({x}, 6) END"


def final_sql(base: str, parts: list[str]) -> str:
    return f"SELECT {', '.join(parts)} FROM ({base})"


def both_sides(rows: DataFrame, names: list[str]) -> DataFrame:
    """match_id and name_home, name_away of two rows a match: one grouped pass with a single
    aggregate for each side, no self-join."""
    from pyspark.sql import functions as F

    side = lambda at: F.first(F.when(F.col("is_home") == at, F.struct(*names)), ignorenulls=True)
    both = rows.groupBy("match_id").agg(side(1).alias("_home"), side(0).alias("_away"))
    return both.select("match_id", *[F.col(f"_{s}.{n}").alias(f"{n}_{s}") for n in names for s in ("home", "away")])


def both_sides_sql(base: str, names: list[str]) -> str:
    cols = ", ".join(f"h.{n} AS {n}_home, a.{n} AS {n}_away" for n in names)
    return f"WITH r AS ({base}) SELECT h.match_id, {cols} FROM r h JOIN r a ON h.match_id = a.match_id WHERE h.is_home = 1 AND a.is_home = 0"
