"""Exact ranks of many columns in a fixed number of passes, with bounded state.

A double is taken as 64 ordered bits. The first pass counts the values of every column; those of
columns with many values by their first bits alone. Three or four more passes over these columns
count the next bits of the values that share the bits already known of a wanted rank. A task's
counts don't grow with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SIGN, _ALL = np.uint64(1 << 63), np.uint64((1 << 64) - 1)
#: Bits of the first pass, and those that a later one adds where columns have up to FEW ranks, or more.
FIRST, NEXT, MANY, FEW = 16, 16, 12, 6
#: Values of a column that are counted one by one.
DISTINCT = 8192
_COUNTS = "i int, k long, n long"


def ordered(x: np.ndarray) -> np.ndarray:
    """Bits of doubles in the order of their values; NaN comes last, -0 is 0."""
    b = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(b >= _SIGN, b ^ _ALL, b ^ _SIGN)


def _value(bits: int) -> float:
    return float(np.array([bits ^ (1 << 63) if bits >> 63 else bits ^ (1 << 64) - 1], np.uint64).view(np.float64)[0])


def numbers(column: pa.Array) -> np.ndarray:
    """The values of a column that are not null."""
    return (column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False)


def exact(df: DataFrame, columns: dict[str, object], wanted: Callable[[int, int], list[int]]) -> dict[str, list[float] | None]:
    """For each named double expression the values at the ranks, from 1, that ``wanted`` gives for
    the number of its values and of rows; ranks beyond its values give the nearest one, no value
    at all None."""
    names = list(columns)
    rows = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    counts, coarse, n = _first(rows, len(names))
    out: dict[str, list[float] | None] = {}
    open_: dict[int, list[tuple[int, int]]] = {}  # of columns with many values: prefix of each rank, rank within it
    for i, found in enumerate(counts):
        total = sum(found.values())
        asked = [(0, min(max(1, r), total)) for r in wanted(total, n)] if total else []
        at = _moved(found, asked, 64)
        if i in coarse:
            open_[i] = at
        else:
            out[names[i]] = [_value(p) for p, _ in at] or None
    depth = FIRST
    while open_ and depth < 64:
        bits = min(NEXT if max(len(set(v)) for v in open_.values()) <= FEW else MANY, 64 - depth)
        found = _counted(rows, {i: sorted({p for p, _ in v}) for i, v in open_.items()}, depth, bits)
        open_ = {i: _moved(found[i], v, bits) for i, v in open_.items()}
        depth += bits
    return out | {names[i]: [_value(p) for p, _ in v] for i, v in open_.items()}


def _moved(found: dict[int, int], asked: list[tuple[int, int]], bits: int) -> list[tuple[int, int]]:
    """The longer prefixes of ranks within prefixes that are ``bits`` shorter."""
    keys = np.array(sorted(found), np.uint64)
    ahead = np.concatenate([[0], np.cumsum([found[int(k)] for k in keys], dtype=np.int64)])
    out = []
    for prefix, rank in asked:
        start = int(np.searchsorted(keys, np.uint64(prefix << bits)))
        at = int(np.searchsorted(ahead, ahead[start] + rank, side="left")) - 1
        out.append((int(keys[at]), int(ahead[start] + rank - ahead[at])))
    return out


def _first(rows: DataFrame, columns: int) -> tuple[list[dict[int, int]], set[int], int]:
    """Of each column the number of values by all their bits; by the FIRST ones where a task or all
    meet over DISTINCT values, with these columns' numbers; and the number of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, int] | np.ndarray] = [{} for _ in range(columns)]
        n = 0
        for batch in batches:
            n += batch.num_rows
            for i, own in enumerate(held):
                key = ordered(numbers(batch.column(i)))
                if isinstance(own, dict):
                    for k, m in zip(*(x.tolist() for x in np.unique(key, return_counts=True))):
                        own[k] = own.get(k, 0) + m
                    if len(own) > DISTINCT:
                        held[i] = np.bincount([k >> 64 - FIRST for k in own], [*own.values()], minlength=1 << FIRST).astype(np.int64)
                else:
                    own += np.bincount((key >> np.uint64(64 - FIRST)).astype(np.int64), minlength=1 << FIRST)
        yield _block(-1, np.zeros(1, np.uint64), np.array([n]), False)
        for i, own in enumerate(held):
            if isinstance(own, dict):
                yield _block(i, np.array([*own], np.uint64), np.array([*own.values()], np.int64), False)
            else:
                at = np.nonzero(own)[0]
                yield _block(i, at.astype(np.uint64), own[at], True)

    sums = rows.mapInArrow(run, _COUNTS + ", coarse boolean").groupBy("i", "k", "coarse").agg(F.sum("n").alias("n"))
    # Tasks that differ may hold many values together: a column over DISTINCT goes by its FIRST bits.
    first = F.shiftrightunsigned("k", 64 - FIRST)
    per = Window.partitionBy("i")
    whole = sums.withColumn("_c", F.max("coarse").over(per) | (F.count("*").over(per) > DISTINCT))
    key = F.when(F.col("_c") & ~F.col("coarse"), first).otherwise(F.col("k"))
    out: list[dict[int, int]] = [{} for _ in range(columns)]
    coarse, n = set(), 0
    for r in whole.groupBy("i", "_c", key.alias("k")).agg(F.sum("n").alias("n")).collect():  # at most 2^FIRST a column
        if r.i < 0:
            n = r.n
            continue
        out[r.i][r.k & (1 << 64) - 1] = r.n
        if r._c:
            coarse.add(r.i)
    return out, coarse, n


def _block(i: int, keys: np.ndarray, n: np.ndarray, coarse: bool | None = None) -> pa.RecordBatch:
    cells = {"i": pa.array(np.full(len(keys), i, np.int32)), "k": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))}
    return pa.record_batch(cells if coarse is None else cells | {"coarse": pa.array(np.full(len(keys), coarse))})


def _counted(rows: DataFrame, known: dict[int, list[int]], depth: int, bits: int) -> dict[int, dict[int, int]]:
    """Of each column the number of values by their first depth + bits bits, under known prefixes."""
    size, prefixes = 1 << bits, {i: np.array(k, np.uint64) for i, k in known.items()}
    down, mask = np.uint64(64 - depth - bits), np.uint64(size - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(len(p) * size, np.int64) for i, p in prefixes.items()}
        for batch in batches:
            for column, (i, p) in zip(batch.columns, prefixes.items()):
                key = ordered(numbers(column)) >> down
                head = key >> np.uint64(bits)
                at = np.minimum(np.searchsorted(p, head), len(p) - 1)
                own = p[at] == head
                total[i] += np.bincount(at[own] * size + (key[own] & mask).astype(np.int64), minlength=len(total[i]))
        for i, t in total.items():
            at = np.nonzero(t)[0]
            yield _block(i, (prefixes[i][at >> bits] << np.uint64(bits)) | (at & (size - 1)).astype(np.uint64), t[at])

    out: dict[int, dict[int, int]] = {i: {} for i in known}
    for r in rows.select(*[f"c{i}" for i in known]).mapInArrow(run, _COUNTS).groupBy("i", "k").agg(F.sum("n").alias("n")).collect():  # at most 2^bits a column and rank
        out[r.i][r.k & (1 << 64) - 1] = r.n
    return out
