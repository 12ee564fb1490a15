"""Fits of successive folds from running sums of moments.

A linear discriminant needs counts and sums by class and one matrix of products. These add up, so
one pass gives them for every fold or season, and the fit before a fold is made of the sums of all
earlier ones: no row is read again, whatever the number of folds. Each task sends one row a
(fold, class); the driver sees folds times classes of them, and a matrix of features squared a fold.

Features must be finite and not null (clean them first); they are shifted by ``centre`` before
they are squared. Null labels are not learned from; a fold before which nothing is known gets
equal chances.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.training import P, clipped

CLASSES = 3
#: Part of the mean variance that is added to every variance.
RIDGE = 1e-3


@dataclass
class Moments:
    """Counts (classes), sums (classes, features) and products (features, features)."""

    n: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    @classmethod
    def none(cls, features: int) -> Moments:
        return cls(np.zeros(CLASSES), np.zeros((CLASSES, features)), np.zeros((features, features)))

    @classmethod
    def of(cls, x: np.ndarray, label: np.ndarray) -> Moments:
        hit = (label[:, None] == np.arange(CLASSES)).astype(float)
        return cls(hit.sum(0), hit.T @ x, x.T @ x)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def pack(self) -> bytes:
        return np.concatenate([self.n, self.sums.ravel(), self.products.ravel()]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, features: int) -> Moments:
        v = np.frombuffer(raw)
        return cls(v[:CLASSES], v[CLASSES : CLASSES * (features + 1)].reshape(CLASSES, features), v[CLASSES * (features + 1) :].reshape(features, features))

    def discriminant(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, offsets) whose softmax are the chances; classes never seen have none."""
        total, features = self.n.sum(), self.products.shape[0]
        if not total:
            return np.zeros((features, CLASSES)), np.zeros(CLASSES)
        means = self.sums / np.maximum(self.n, 1)[:, None]
        within = (self.products - (means.T * self.n) @ means) / max(1.0, total - (self.n > 0).sum())
        within += np.eye(features) * max(1e-9, RIDGE * np.trace(within) / max(1, features))
        weights = np.linalg.solve(within, means.T)
        with np.errstate(divide="ignore"):
            offsets = np.log(self.n / total) - 0.5 * (means * weights.T).sum(1)
        return weights, np.where(self.n > 0, offsets, -np.inf)


def _numbers(column, centre: np.ndarray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(centre)) - centre


def _plain(df: DataFrame, features: list[str], by: str, *more) -> DataFrame:
    return df.select(*more, F.col(by).cast("long").alias("_by"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))


def by_fold(df: DataFrame, features: list[str], by: str, label: str = "outcome", centre: list[float] | None = None) -> dict[int, Moments]:
    """The moments of each value of ``by``."""
    shift, d = np.array(centre or [0.0] * len(features)), len(features)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            if batch.num_rows:
                x, folds, labels = _numbers(batch.column(2), shift), batch.column(1).to_numpy(), batch.column(0).to_numpy()
                for k in np.unique(folds).tolist():
                    own = folds == k
                    held[k] = held.get(k, Moments.none(d)) + Moments.of(x[own], labels[own])
        yield pa.record_batch({"by": pa.array(list(held), pa.int64()), "moments": pa.array([m.pack() for m in held.values()], pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x) for x in group["moments"].to_pylist()), np.zeros(1))
        return pa.table({"by": group["by"][:1], "moments": pa.array([total.tobytes()], pa.binary())})

    known = _plain(df.where(F.col(label).isNotNull() & F.col(by).isNotNull()), features, by, F.col(label).cast("long").alias("_label"))
    found = known.mapInArrow(run, "by long, moments binary").groupBy("by").applyInArrow(added, "by long, moments binary").collect()
    return {r.by: Moments.unpack(bytes(r.moments), d) for r in found}


def successive(found: dict[int, Moments], values: list[int], features: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each value the fit on all smaller ones."""
    out, total, keys = {}, Moments.none(features), sorted(found)
    at = 0
    for v in sorted(values):
        while at < len(keys) and keys[at] < v:
            total, at = total + found[keys[at]], at + 1
        out[v] = total.discriminant()
    return out


def walk_forward(df: DataFrame, features: list[str], by: str, label: str = "outcome", from_: int | None = None, centre: list[float] | None = None) -> DataFrame:
    """match_id, by, label and the clipped chances of every row from the value ``from_`` of
    ``by`` on, each by the fit on all smaller values: one pass for the sums, one for the chances."""
    shift = np.array(centre or [0.0] * len(features))
    found = by_fold(df, features, by, label, centre)
    scored = df.where(F.col(by) >= from_) if from_ is not None else df.where(F.col(by).isNotNull())
    values = [r[0] for r in scored.select(F.col(by).cast("long")).distinct().collect()]
    fits = successive(found, values, len(features))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, folds = _numbers(batch.column(batch.num_columns - 1), shift), batch.column(batch.num_columns - 2).to_numpy()
            p = np.zeros((len(x), CLASSES))
            for k in np.unique(folds).tolist():
                own, (w, b) = folds == k, fits[k]
                z = x[own] @ w + b
                e = np.exp(z - z.max(1, keepdims=True))
                p[own] = e / e.sum(1, keepdims=True)
            yield pa.record_batch([*batch.columns[:-2], *[pa.array(p[:, k]) for k in range(CLASSES)]], names=[*batch.schema.names[:-2], *P])

    kept = scored.select("match_id", by, label)
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(", ".join(f"{c} double" for c in P)).fields])
    return _plain(scored, features, by, "match_id", F.col(by).alias(by), label).mapInArrow(run, schema).select("match_id", by, label, *[x.alias(n) for n, x in zip(P, clipped([F.col(c) for c in P]))])
