import math

import numpy as np
from pyspark.sql import functions as F

from terrace.operators import boosting, ranks, training
from terrace.plans import learning


def test_ranks_are_those_of_a_sort(spark, monkeypatch):
    monkeypatch.setattr(ranks, "DISTINCT", 50)
    dice = np.random.default_rng(3)
    values = {"many": dice.normal(0, 1e6, 4000), "few": dice.integers(-2, 3, 4000) / 3, "tiny": dice.normal(0, 1e-300, 4000), "one": np.full(4000, -7.5)}
    rows = [tuple(None if k % 7 == i else float(v[k]) for i, v in enumerate(values.values())) for k in range(4000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in values) + "").repartition(3).withColumn("none", F.lit(None).cast("double"))
    for shares in ([0.5], [0.001, 0.5, 0.999], [i / 64 for i in range(1, 64)]):
        got = ranks.exact(df, {c: F.col(c) for c in [*values, "none"]}, lambda n, _: [math.ceil(q * n) for q in shares])
        for i, c in enumerate(values):
            held = sorted(r[i] for r in rows if r[i] is not None)
            assert got[c] == [held[math.ceil(q * len(held)) - 1] for q in shares]
        assert got["none"] is None


def test_cleaning_cuts_at_ranks_of_filled_values(spark):
    n = 3000
    x = [None if k % 3 else k / 7 for k in range(n)]
    df = spark.createDataFrame([(k, x[k], float(k % 2), 4.0) for k in range(n)], "match_id long, x double, outcome double, same double")
    state = training.clean(df, ["x", "same"], "outcome")
    held = sorted(v for v in x if v is not None)
    median = held[math.ceil(len(held) / 2) - 1]
    filled = sorted(median if v is None else v for v in x)
    assert state.features == ["x"] and state.medians["x"] == median
    assert (state.low["x"], state.high["x"]) == (filled[math.ceil(0.001 * n) - 1], filled[math.ceil(0.999 * n) - 1])


def test_bins_hold_equal_shares_exactly(spark):
    df = spark.range(64_000).select((F.col("id") * 3 + 0.5).alias("x"))
    assert boosting.edges_of(df, ["x"], 64)[0].tolist() == [(1000 * i - 1) * 3 + 0.5 for i in range(1, 64)]


def test_the_feature_table_joins_the_order_tables_once(spark):
    table = learning.feature_table(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in table.inputFiles())
