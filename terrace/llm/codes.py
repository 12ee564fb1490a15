"""Vector code compression: product codes over integer codebooks.

A component x becomes floor(256 x); a vector is cut into 16 equal parts, each coded by the
nearest of at most 64 entries of its part's codebook. Codebooks start as the parts of the 64
smallest vec_ids. In each round every task assigns its Arrow batches (squared distances by norm
expansion, |x|^2 - 2 x c + |c|^2, with exact products of 64-bit integers; the first least
wins) and sends one sum for each entry and place in it, a number fixed by the codebooks; Spark
groups and adds these, and the new entries are floor(sum / count). Entries without a vector stay. The
codebooks, at most 64 x width integers, go with every task; no vector leaves its task in a round.

Vectors that are null or hold null or non-finite components are dropped. Shorter vectors are
filled up with zeros to the longest one, and that to a multiple of 16, so that any lengths are
coded; vectors without components code as zeros. Beyond +-``most(width)`` (over 33 million for
1,024 components) integers are set to that bound, so that no distance overflows.
Seeds of one vec_id stand in the order of their vectors, null vec_ids come last. With under
64 vectors there are as many entries as vectors. Repeated rows are coded each; labels that are
null form one group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.common import release, stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared with the codebooks at once.
STEP_ROWS = 1024


def most(width: int) -> int:
    """The largest integer for which errors of a whole vector stay under 2^62."""
    return isqrt((1 << 60) // max(1, width))


def integers(flat: np.ndarray, width: int) -> np.ndarray:
    bound = most(width)
    return np.clip(np.floor(flat * float(SCALE)), -bound, bound).astype(np.int64)


def quantised(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their integers (kept, width)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    stops = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = column.is_valid().to_numpy(zero_copy_only=False) & (bad[stops] == bad[stops - sizes])
    out, own = np.zeros((int(kept.sum()), width), np.int64), sizes[kept]
    row = np.repeat(np.arange(len(own)), own)
    place = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
    out[row, place] = integers(flat[np.repeat(kept, sizes)], width)
    return kept, out


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (rows, parts) of the nearest entries of books (parts, entries, size), and each
    row's summed squared distance."""
    parts, _, size = books.shape
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for p in range(parts):
        own, entries = x[:, p * size : (p + 1) * size], books[p]
        far = (own * own).sum(1)[:, None] - 2 * (own @ entries.T) + (entries * entries).sum(1)[None]
        codes[:, p] = far.argmin(1)
        errors += far[np.arange(len(x)), codes[:, p]]
    return codes, errors


def _sums(batches: Iterable[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, entry, place, total, n) of a task's vectors, for the entries that have any."""
    release()
    parts, entries, size = books.shape
    totals, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            _, x = quantised(batch.column(0).slice(at, STEP_ROWS), parts * size)
            codes, _ = assign(x, books)
            for p in range(parts):
                np.add.at(totals[p], codes[:, p], x[:, p * size : (p + 1) * size])
                n[p] += np.bincount(codes[:, p], minlength=entries)
    p, e = np.nonzero(n)
    spread = lambda v: np.repeat(v.astype(np.int32), size)
    yield pa.record_batch({"part": spread(p), "entry": spread(e), "place": np.tile(np.arange(size, dtype=np.int32), len(p)), "total": totals[p, e].ravel(), "n": np.repeat(n[p, e], size)})


def _coded(batches: Iterable[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    release()
    parts, _, size = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(at, STEP_ROWS)
            kept, x = quantised(part.column(2), parts * size)
            codes, errors = assign(x, books)
            rows = part.filter(pa.array(kept))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), pa.array(errors)], names=["vec_id", "label", "code", "error"])


def sound() -> F.Column:
    """Vectors that are kept."""
    return F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def seeds(vectors: DataFrame) -> np.ndarray | None:
    """The codebooks at the start, (parts, entries, size); at most 64 vectors reach the driver."""
    kept = vectors.where(sound())
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // PARTS) * PARTS
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    x = np.zeros((len(first), width), np.int64)
    for row, r in zip(x, first):
        row[: len(r.embedding)] = integers(np.array(r.embedding, np.float64), width)
    return np.ascontiguousarray(x.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2))


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more round."""
    sums = vectors.select("embedding").mapInArrow(lambda b: _sums(b, books), "part int, entry int, place int, total long, n long")
    new = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many rows as the codebooks have numbers
        new[r.part, r.entry, r.place] = r.total // r.n
    return new


class Compressed:
    """Codebooks and the table (vec_id, label, code, error), code as one byte a part."""

    def __init__(self, books: np.ndarray | None, rows: DataFrame):
        self.books, self.rows = books, rows

    def digest(self) -> str:
        numbers = [] if self.books is None else self.books.ravel().tolist()
        return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()

    def restored(self) -> DataFrame:
        """(vec_id, integers): the entries that a code stands for."""
        books = self.books

        def run(batches):
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
                x = books[np.arange(PARTS)[None], codes].reshape(len(codes), -1)
                yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "integers"])

        schema = T.StructType([self.rows.schema["vec_id"], *T._parse_datatype_string("integers array<long>").fields])
        return self.rows.select("vec_id", "code").mapInArrow(run, schema)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> Compressed:
    """Codes of vectors (vec_id, label, embedding)."""
    vectors = vectors.select("vec_id", "label", "embedding")
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], *T._parse_datatype_string("code binary, error long").fields])
    books = seeds(vectors)
    if books is None:
        return Compressed(None, vectors.sparkSession.createDataFrame([], schema))
    for _ in range(rounds):
        books = refined(vectors, books)
    return Compressed(books, stage(vectors.mapInArrow(lambda b: _coded(b, books), schema), "vector-codes"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compress(table(spark, sf_dir, "embeddings"))
    rows = done.rows
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    both = rows.join(sums, rows.label.eqNullSafe(sums.of))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(done.digest()).alias("codebooks_sha256"))


def _oracle(width: int = 64) -> str:
    """SQL for vectors of one width: rounds written out."""
    size = width // PARTS
    far = "sum((x.v - c.v) * (x.v - c.v))"
    sql = f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
x AS (SELECT vec_id, i // {size} AS part, i % {size} AS place, floor({SCALE} * embedding[i + 1]::DOUBLE)::BIGINT AS v FROM k, range(0, {width}) g(i)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS (SELECT part, entry, place, v FROM x JOIN s USING (vec_id))"""
    for r in range(ROUNDS + 1):
        sql += f""",
f{r} AS (SELECT x.vec_id, x.part, c.entry, {far} AS far FROM x JOIN b{r} c ON x.part = c.part AND x.place = c.place GROUP BY ALL),
a{r} AS (SELECT vec_id, part, entry, far FROM f{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)"""
        if r < ROUNDS:
            sql += f""",
m{r} AS (SELECT part, entry, place, sum(v) AS t, count(*) AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL),
b{r + 1} AS (SELECT b.part, b.entry, b.place, CASE WHEN n IS NULL THEN b.v ELSE (t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END)::BIGINT END AS v FROM b{r} b LEFT JOIN m{r} USING (part, entry, place))"""
    return sql + f""",
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{ROUNDS}) AS codebooks_sha256
FROM e JOIN k USING (vec_id)
"""


ORACLE = _oracle()
