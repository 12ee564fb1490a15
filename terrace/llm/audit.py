"""Filter interaction audit by an incidence matrix product.

Five filters; a document fails a set of them, its mask (A is bit 0, E bit 4). All that any
order of the filters does follows from how many documents have each of the 32 masks. So each
part gives three rows of 32 numbers: documents, good ones and toxic ones by mask. The columns
of a 32-by-600 matrix are the 120 orders times 5 steps; an entry is 1 where the mask has the
outcome at that step: kept, removed here, redundant (fails, but was removed earlier) or unique
(fails this filter only). All counts are products of the stacked rows with these matrices, in
64-bit integers, and the Shapley sums a product of the removed with a 600-by-5 matrix.

Masks of A to D are found in place from whole texts; E needs the smallest doc_id of each text
in the whole table: rows are summed to (text digest, part) first, so that a text with very
many copies has one row a part when its least doc_id is sought.

Null texts are empty. Rows without a doc_id never fail E and are nobody's smaller doc_id;
rows that repeat a doc_id don't fail E on its account. Rows of ``labels`` that repeat a doc_id
count if any says 1; null labels say nothing. A null source is the part "". An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import SLICE_ROWS, release, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LEAST_WORDS = 50
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
STEPS = len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: bytes, points: int) -> int:
    """The mask of filters A to D. bytes.split() cuts at just the contract's separators."""
    words = text.split()
    return (
        (len(words) < LEAST_WORDS)
        + 2 * (100 * len(set(words)) < 65 * len(words))
        + 4 * (100 * (len(text) - len(text.translate(None, CAPITALS))) > 5 * points)
        + 8 * (len(text.translate(None, MARKS)) < len(text))
    )


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            texts, points = pc.cast(part.column(2), pa.binary()).to_pylist(), pc.utf8_length(part.column(2)).to_pylist()
            masks = pa.array(map(own_failures, texts, points), pa.int32())
            digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.record_batch([part.column(0), part.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic) of docs (doc_id, source, text) and labels (doc_id,
    quality, toxic), all five filters in the mask."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = plain.mapInArrow(_judged, "doc_id long, part string, mask int, digest binary").join(known, "doc_id", "left")
    sums = [F.sum(c).alias(c) for c in ("docs", "good", "toxic")]
    each = [F.count("*").alias("docs"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))]
    one = rows.groupBy("digest", "part", "mask", "doc_id").agg(*each)
    # Rows of the least doc_id of a text in a part, and of no doc_id, apart from all rows.
    first = F.min(F.expr("CASE WHEN doc_id IS NOT NULL THEN struct(doc_id, docs, good, toxic) END")).alias("first")
    free = [F.sum(F.expr(f"CASE WHEN doc_id IS NULL THEN {c} ELSE 0 END")).alias(f"free_{c}") for c in ("docs", "good", "toxic")]
    texts = one.groupBy("digest", "part", "mask").agg(*sums, first, *free)
    texts = texts.withColumn("leads", F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest")))
    stays = [F.expr(f"free_{c} + CASE WHEN leads THEN first.{c} ELSE 0 END").alias(f"stay_{c}") for c in ("docs", "good", "toxic")]
    both = F.expr("""explode(array(struct(mask, stay_docs AS docs, stay_good AS good, stay_toxic AS toxic),
        struct(mask + 16 AS mask, docs - stay_docs AS docs, good - stay_good AS good, toxic - stay_toxic AS toxic)))""")
    split = texts.select("*", *stays).select("part", both.alias("h")).select("part", "h.*").where("docs > 0")
    return split.groupBy("part", "mask").agg(*sums)


def incidence() -> dict[str, np.ndarray]:
    """The 32-by-600 matrices of outcomes, and the 600-by-5 matrix of each column's filter."""
    bit = np.array([[1 << FILTERS.index(x) for x in order] for order in ORDERS])
    before = np.cumsum(bit, axis=1) - bit
    bit, before, mask = bit.ravel()[None], before.ravel()[None], np.arange(MASKS)[:, None]
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == bit}
    return {k: v.astype(np.int64) for k, v in made.items()} | {"filter": (bit.T == (1 << np.arange(STEPS))[None]).astype(np.int64)}


def products(stacked: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of (parts, 600) from rows (3, parts, 32) of documents, good and toxic ones."""
    m, (docs, good, toxic) = incidence(), stacked
    removed = docs @ m["removed"]
    return dict(zip(COUNTS, (docs @ m["kept"], removed, docs @ m["redundant"], docs @ m["unique"], good @ m["removed"], toxic @ m["removed"], removed @ m["filter"] @ m["filter"].T)))


def _audited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        stacked = np.zeros((3, len(names), MASKS), np.int64)
        for i, row in enumerate(cells):
            for c in row:
                stacked[:, i, c["mask"]] = c["docs"], c["good"], c["toxic"]
        found, n = products(stacked), len(ORDERS) * STEPS
        order, step = [x for x in ORDERS for _ in range(STEPS)] * len(names), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS) * len(names))
        yield pa.record_batch({"part": pa.array([x for x in names for _ in range(n)], pa.string()), "filter_order": pa.array(order, pa.string()), "step": step} | {k: v.ravel() for k, v in found.items()})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, zeros included."""
    cells = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_audited, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
lb AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d LEFT JOIN lb USING (doc_id)),
h AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
             count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(string_split('ABCDE', '')) AS v),
o AS (SELECT p.v || q.v || r.v || s.v || u.v AS filter_order FROM x p, x q, x r, x s, x u
      WHERE len(list_distinct([p.v, q.v, r.v, s.v, u.v])) = 5),
st AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, range(1, 6) g(step)),
r AS (SELECT part, filter_order, step, own, contains(fails, own) AS hit, len(fails) = 1 AS only_one, translate(before, fails, '') <> before AS gone, docs, good, toxic FROM h, st),
k AS (SELECT part, filter_order, step, own,
        coalesce(sum(docs) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(docs) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(docs) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(docs) FILTER (hit AND only_one), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM k
"""
