"""Work that is heavy for each text is dealt to all cores."""

from __future__ import annotations

from terrace.plans import registry


def test_lexicon_scores_use_every_core(spark):
    """A file of one row group was one task's work."""
    got = registry.QUERIES["t01_lexicon_score"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
