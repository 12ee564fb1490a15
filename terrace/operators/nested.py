"""Learners of nested training sets, fitted side by side.

Set j holds the labelled rows before its edge, so later sets hold the earlier ones. Rows are staged
once, in blocks of one step (how many sets they come too late for), and a pass over the blocks
serves the fits of all sets: a step of logistic or network fits, a level of all growing trees.
Each task sends sums of a bounded size.

Learners are those of ``training.learners`` with the same settings, over three classes. Tree features
become up to BINS bins by exact quantiles of the set's own rows. Gradients and weights of trees are
rounded to integers first and bags are drawn by hashes of keys, so trees don't depend on how rows
are dealt. Features must be finite and not null: clean them first.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators import ranks
from terrace.operators.boosting import BLOCK, CLASSES, MOST_WEIGHT, UNIT, Scorer, softmax
from terrace.sources.staging import Staged

#: Settings of the learners.
PENALTY, LOGISTIC_STEPS = 0.01, 20
HIDDEN, NETWORK_STEPS = 16, 60
BINS = 32
TREE_DEPTH = 5
FOREST_TREES, FOREST_DEPTH = 40, 6
ROUNDS, BOOSTED_DEPTH, RATE = 10, 3, 0.1
SEED = 42
#: Rows that a task of a pass takes at least, rows of a staged file at most, and rows that a
#: network sees at once.
ROWS_A_TASK, ROWS_A_FILE, CHUNK = 50_000, 500_000, 2048
TREES = ("tree", "forest", "boosted")


# ---- models -------------------------------------------------------------------------------


@dataclass
class Softmax(Scorer):
    features: list[str]
    weights: np.ndarray
    offsets: np.ndarray

    def chances(self, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.weights + self.offsets)


@dataclass
class Network(Scorer):
    features: list[str]
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    def chances(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return softmax(_sigmoid(x @ w + b) @ v + c)


@dataclass
class Tree:
    """A heap of nodes: node i's children are 2 i + 1 and 2 i + 2. feature -1: a leaf; rows of bins
    up to the cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def new(cls, depth: int, width: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros((n, width)))

    @cached_property
    def _next(self) -> tuple[np.ndarray, np.ndarray]:
        node = np.arange(len(self.feature))[:, None]
        after = np.where(self.feature[:, None] < 0, node, 2 * node + 1 + (np.arange(BINS)[None] > self.cut[:, None]))
        return np.maximum(self.feature, 0).astype(np.int64), after.ravel().astype(np.int64)

    def place(self, bins: np.ndarray, levels: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The node of each row after so many levels; bins lie by feature."""
        n = bins.shape[1]
        rows = np.arange(n) if rows is None else rows
        at, flat = np.zeros(len(rows), np.int64), bins.ravel()
        asked, after = self._next
        for _ in range(levels):
            at = after.take((at << 5) | flat.take(asked.take(at) * n + rows))
        return at


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """How many edges of its feature lie below each value, by feature."""
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x)]).astype(np.uint8 if max(map(len, edges)) < 256 else np.uint16)


@dataclass
class Shares(Scorer):
    """Class shares of leaves, averaged over trees."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    depth: int

    def chances(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x.T, self.edges)
        return sum((t.value[t.place(bins, self.depth)] for t in self.trees), np.zeros((len(x), CLASSES))) / len(self.trees)


@dataclass
class Boosted(Scorer):
    """Boosted trees of each class against the rest."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[list[Tree]]
    counts: np.ndarray

    def alone(self, x: np.ndarray) -> np.ndarray:
        """The chance of each class by its own trees."""
        bins = binned(x.T, self.edges)
        with np.errstate(over="ignore"):
            return np.column_stack([1 / (1 + np.exp(-2 * _margin(own, bins))) for own in self.trees])

    def chances(self, x: np.ndarray) -> np.ndarray:
        p = self.alone(x)
        return p / p.sum(1, keepdims=True)

    def answers(self, x: np.ndarray) -> np.ndarray:
        """``alone``, but certain of classes that the training rows never or always had."""
        return np.where(self.counts == 0, 0.0, np.where(self.counts == self.counts.sum(), 1.0, self.alone(x)))


def _margin(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    total = np.zeros(bins.shape[1])
    for i, t in enumerate(trees):
        total += (RATE if i else 1.0) * t.value[:, 0].take(t.place(bins, BOOSTED_DEPTH))
    return total


# ---- staged blocks ------------------------------------------------------------------------


@dataclass
class Block:
    step: int
    x: np.ndarray
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    key: np.ndarray


_FIELDS = "step int, x binary, label binary, weight binary, key binary"
_BINNED = _FIELDS.replace("x binary", "bins binary")
_KINDS = {"x": np.float64, "label": np.int8, "weight": np.float64, "key": np.uint64}


@dataclass
class Sets:
    """Staged rows of nested sets: the counts of each set by class, and each set's edges of bins."""

    features: list[str]
    counts: np.ndarray
    rows: DataFrame
    binned: DataFrame | None = None
    edges: list[list[np.ndarray]] = field(default_factory=list)

    @cached_property
    def blocks(self):
        """The blocks of features: the many short passes of a descent skip the files' reader. What
        doesn't fit in memory goes to disk."""
        cells = self.rows.select("step", "x", "label", "weight").rdd.map(lambda r: (r[0], bytes(r[1]), bytes(r[2]), bytes(r[3])))
        return cells.persist(StorageLevel.MEMORY_AND_DISK)

    def drop(self) -> None:
        if "blocks" in self.__dict__:
            self.blocks.unpersist()

    @cached_property
    def shared(self) -> list[np.ndarray]:
        """Edges of all sets together, by which rows are staged."""
        return [np.unique(np.concatenate(e)) for e in zip(*self.edges)]

    @cached_property
    def own(self) -> list[list[np.ndarray]]:
        """For each set and feature the set's bin of each shared one."""
        return [[np.concatenate([[0], np.searchsorted(e, u, side="right")]).astype(np.uint8) for e, u in zip(mine, self.shared)] for mine in self.edges]

    def fitted(self) -> list[int]:
        """Sets of two classes at least; the others need no fit."""
        return [j for j, c in enumerate(self.counts) if (c > 0).sum() > 1]


def _read(batches: Iterable[pa.RecordBatch], features: int, bins=np.uint8) -> Iterator[Block]:
    """Blocks of rows of a step and any of x, bins, label, weight and key."""
    kinds = _KINDS | {"bins": bins}
    for batch in batches:
        for i in range(batch.num_rows):
            cells = {n: np.frombuffer(batch.column(k)[i].as_buffer(), kinds[n]) for k, n in enumerate(batch.schema.names) if k}
            cells |= {n: cells[n].reshape(features, -1) for n in ("x", "bins") if n in cells}
            yield Block(batch.column(0)[i].as_py(), **{n: cells.get(n) for n in kinds})


def _packed(step: int, cells: tuple, schema: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array([step], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=[f.split()[0] for f in schema.split(", ")])


def plain_matrix(columns: list[pa.Array]) -> np.ndarray:
    """Features of an Arrow batch as (rows, features)."""
    return np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns])


def _staged(plain: DataFrame, sets: int, tasks: int, matrix: Callable) -> Staged:
    def checked(x, label, weight, key) -> tuple:
        if not np.isfinite(x).all():
            raise ValueError("features must be finite: clean them first")
        return np.ascontiguousarray(x.T), label, weight, key

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in range(sets)]
        for batch in batches:
            step, label, weight, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = matrix(batch.columns[4:])
            for k in np.unique(step).tolist():
                mine = step == k
                held[k].append((x[mine], label[mine].astype(np.int8), weight[mine], key[mine].view(np.uint64)))
                if sum(len(h[1]) for h in held[k]) >= BLOCK:
                    whole = [np.concatenate(c) for c in zip(*held[k])]
                    for at in range(0, len(whole[1]) - BLOCK + 1, BLOCK):
                        yield _packed(k, checked(*[c[at : at + BLOCK] for c in whole]), _FIELDS)
                    held[k] = [tuple(c[len(c) - len(c) % BLOCK :] for c in whole)]
        for k, rest in enumerate(held):
            whole = [np.concatenate(c) for c in zip(*rest)] if rest else []
            if whole and len(whole[1]):
                yield _packed(k, checked(*whole), _FIELDS)

    # Blocks are few: dealing them evenly costs little, and every later pass gains.
    return Staged(plain.mapInArrow(run, _FIELDS).repartition(tasks), "nested")


def _cuts(sets: Sets, plain: DataFrame, matrix: Callable) -> list[list[np.ndarray]]:
    """For each set and feature the upper edges of bins but the last: exact quantiles. Values are
    counted by step; features of over ranks.DISTINCT values in a step go through ``ranks``."""
    d, schema = len(sets.features), "step int, i int, many boolean, values binary, counts binary"
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())

    def table(rows: list[tuple]) -> dict:
        return {n.split()[0]: pa.array([r[c] for r in rows], kind) for c, (n, kind) in enumerate(zip(schema.split(", "), kinds))}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return (values, np.bincount(at, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64)) if len(values) <= ranks.DISTINCT else None

    def packed(step: int, i: int, found) -> tuple:
        return (step, i, True, b"", b"") if found is None else (step, i, False, found[0].tobytes(), found[1].tobytes())

    def run(batches):
        held: dict[tuple[int, int], tuple | None] = {}
        for block in _read(batches, d):
            for i, x in enumerate(block.x):
                own = held.get((block.step, i), ())
                if own is not None:
                    mine = np.unique(x + 0.0, return_counts=True)
                    held[block.step, i] = merged([own, mine] if own else [mine])
        yield pa.record_batch(table([packed(*k, v) for k, v in held.items()]))

    def joined(group: pa.Table) -> pa.Table:
        many = any(group["many"].to_pylist())
        parts = [] if many else [(np.frombuffer(v.as_buffer()), np.frombuffer(n.as_buffer(), np.int64)) for v, n in zip(group["values"], group["counts"])]
        return pa.table(table([packed(group["step"][0].as_py(), group["i"][0].as_py(), None if many else merged(parts))]))

    def cleaned(batches):
        for batch in batches:
            x = matrix(batch.columns[1:])
            yield pa.record_batch([batch.column(0), *[pa.array(x[:, i]) for i in many]], names=["step", *[f"x{i}" for i in many]])

    found = sets.rows.select("step", "x").mapInArrow(run, schema).groupBy("step", "i").applyInArrow(joined, schema).collect()  # a row a step and feature, of a bounded size
    many = sorted({r.i for r in found if r.many})
    rows = plain.select("step", *[f"x{i}" for i in range(d)]).mapInArrow(cleaned, ", ".join(["step int", *[f"x{i} double" for i in many]]))
    masked = {f"{j}_{i}": F.when(F.col("step") <= j, F.col(f"x{i}")) for j in sets.fitted() for i in many}
    exact = ranks.exact(rows, masked, lambda n, _: [-(-k * n // BINS) for k in range(1, BINS)]) if many else {}
    out = []
    for j in range(len(sets.counts)):
        cuts = []
        for i in range(d):
            if i in many:
                cuts.append(np.unique(np.array(exact.get(f"{j}_{i}") or [], np.float64)))
                continue
            parts = [(np.frombuffer(r["values"]), np.frombuffer(r["counts"], np.int64)) for r in found if r.i == i and r.step <= j]
            values, counts = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0), np.zeros(0, np.int64))
            order = np.argsort(values, kind="stable")
            ahead = np.cumsum(counts[order])
            asked = [-(-k * ahead[-1] // BINS) for k in range(1, BINS)] if len(ahead) else []
            cuts.append(np.unique(values[order][np.searchsorted(ahead, asked)]))
        out.append(cuts)
    return out


def _binned(sets: Sets) -> Staged:
    d, shared = len(sets.features), sets.shared

    def run(batches):
        for b in _read(batches, d):
            yield _packed(b.step, (binned(b.x, shared), b.label, b.weight, b.key), _BINNED)

    return Staged(sets.rows.mapInArrow(run, _BINNED), "nested-bins")


def fit(df: DataFrame, names: list[str], features: list[str], edges: list[int] | None = None, label: str = "outcome", weight: str | None = None, key: str = "match_id", matrix: Callable = plain_matrix) -> list[dict[str, object]]:
    """For each set, the rows whose ``place`` is under its edge (all without edges), a model of each
    named learner: a Scorer, the class number where the set has just one, -1 where it has none."""
    inside = [F.lit(True)] if edges is None else [F.col("place") < e for e in edges]
    known = df.where(F.col(label).isNotNull())
    w = F.least(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(MOST_WEIGHT)) if weight else F.lit(1.0)
    step = sum(((~i).cast("int") for i in inside), F.lit(0))
    counted = known.groupBy(step.alias("step"), F.col(label).cast("int").alias("label")).count().collect()
    counts = np.array([[sum(r["count"] for r in counted if r.step <= j and r.label == c) for c in range(CLASSES)] for j in range(len(inside))])
    found: list[dict[str, object]] = [{n: int(c.argmax()) if c.any() else -1 for n in names} for c in counts]
    if not features or not any((c > 0).sum() > 1 for c in counts):
        return [{n: k if (c > 0).sum() == 1 else -1 for n, k in one.items()} for one, c in zip(found, counts)]
    plain = known.where(step < len(inside)).select(step.alias("step"), F.col(label).cast("int").alias("label"), w.alias("weight"), F.xxhash64(key).alias("key"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    rows, cores = int(counts[-1].sum()), df.sparkSession.sparkContext.defaultParallelism
    held = [_staged(plain, len(inside), max(1, min(4 * cores, -(-rows // ROWS_A_TASK)), -(-rows // ROWS_A_FILE)), matrix)]
    sets = Sets(features, counts, held[0].rows)
    try:
        if set(names) & set(TREES):
            sets.edges = _cuts(sets, plain, matrix)
            held.append(_binned(sets))
            sets.binned = held[1].rows
        for name in names:
            for j, model in _LEARNERS[name](sets).items():
                found[j][name] = model
    finally:
        sets.drop()
        for one in held:
            one.drop()
    return found


def forecasts(df: DataFrame, keep: list[str], features: list[str], models: dict[int, dict[str, object]], names: list[str], classes: tuple[str, ...], questions: dict[str, tuple[int, bool]] | None = None, by: str = "fold", matrix: Callable = plain_matrix) -> DataFrame:
    """keep, name_class of every named model and the chance of each question (a class, and whether it
    is asked for or against), for rows whose value of ``by`` has models: one pass for all of them."""
    asked = questions or {}

    def numbers(model, x: np.ndarray) -> np.ndarray:
        if isinstance(model, int):
            return np.broadcast_to([1 / 3 if model < 0 else float(k == model) for k in range(CLASSES)], (len(x), CLASSES))
        return model.chances(x)

    def answers(model, x: np.ndarray) -> np.ndarray:
        if isinstance(model, int):
            p = np.broadcast_to([0.5 if model < 0 else float(k == model) for k in range(CLASSES)], (len(x), CLASSES))
        else:
            p = model.answers(x)
        return np.column_stack([p[:, k] if own else 1 - p[:, k] for k, own in asked.values()])

    made = [*[f"{n}_{c}" for n in names for c in classes], *asked]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, x = batch.column(0).to_numpy(), matrix(batch.columns[1 + len(keep) :])
            p = np.empty((len(x), len(made)))
            for k in np.unique(at).tolist():
                own = at == k
                parts = [numbers(models[k][n], x[own]) for n in names]
                p[own] = np.column_stack([*parts, answers(models[k]["boosted"], x[own])] if asked else parts)
            yield pa.record_batch([*batch.columns[1 : 1 + len(keep)], *[pa.array(c) for c in p.T]], names=[*keep, *made])

    schema = T.StructType([*df.select(*keep).schema.fields, *[T.StructField(c, T.DoubleType()) for c in made]])
    rows = df.where(F.col(by).isin([*models])).select(F.col(by).cast("long").alias("_by"), *keep, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    return rows.mapInArrow(run, schema)


# ---- logistic and network -----------------------------------------------------------------


def lbfgs(x: np.ndarray, steps: int, tolerance: float = 1e-6, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Asks for value and gradient at points; returns the last accepted one."""
    f, g = yield x
    s: list[np.ndarray] = []
    y: list[np.ndarray] = []
    for _ in range(steps):
        if np.linalg.norm(g) <= max(tolerance * abs(f), 1e-8):
            break
        d, parts = -g, []
        for a, b in zip(reversed(s), reversed(y)):
            parts.append(a @ d / (a @ b))
            d = d - parts[-1] * b
        if s:
            d = d * (s[-1] @ y[-1] / (y[-1] @ y[-1]))
        for a, b, k in zip(s, y, reversed(parts)):
            d = d + (k - b @ d / (a @ b)) * a
        slope = d @ g
        if not slope < 0:
            s, y, d, slope = [], [], -g, -(g @ g)
        low, high, t = 0.0, np.inf, 1.0 if s else min(1.0, 1 / np.linalg.norm(g))
        for _ in range(30):
            f1, g1 = yield x + t * d
            if not f1 <= f + 1e-4 * t * slope:
                high = t
            elif g1 @ d < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * low
        else:
            break
        moved, turned = t * d, g1 - g
        if moved @ turned > 0:
            s, y = [*s, moved][-memory:], [*y, turned][-memory:]
        gained, x, f, g = f - f1, x + moved, f1, g1
        if gained <= 1e-9 * abs(f):
            break
    return x


def _evaluated(sets: Sets, loss: Callable, points: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The sums of loss(block, point) over each set's rows: one row a task and set is sent."""
    d = len(sets.features)

    def run(cells):
        total: dict[int, np.ndarray] = {}
        for step, *raw in cells:
            x, label, weight = (np.frombuffer(c, kind) for c, kind in zip(raw, _KINDS.values()))
            block = Block(step, x.reshape(d, -1), None, label, weight, None)
            for j, point in points.items():
                if step <= j:
                    total[j] = total.get(j, 0) + loss(block, point)
        return total.items()

    out: dict[int, np.ndarray] = {}
    for j, sums in sets.blocks.mapPartitions(run).collect():
        out[j] = out.get(j, 0) + sums
    return out


def _scales(sets: Sets) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mean and inverse deviation (0 where there is none) of each feature, and the weights of the
    classes, for each set."""
    d, js = len(sets.features), sets.fitted()
    hot = lambda b: [b.weight[b.label == c].sum() for c in range(CLASSES)]
    first = _evaluated(sets, lambda b, _: np.concatenate([b.x.sum(1), hot(b)]), {j: np.zeros(0) for j in js})
    mean = {j: first[j][:d] / sets.counts[j].sum() for j in js}
    spread = _evaluated(sets, lambda b, m: ((b.x - m[:, None]) ** 2).sum(1), mean)
    out = {}
    for j in js:
        sd = np.sqrt(spread[j] / max(1, sets.counts[j].sum() - 1))
        out[j] = mean[j], np.where(sd > 1e-12 * np.maximum(1, np.abs(mean[j])), 1 / np.where(sd > 0, sd, 1), 0.0), first[j][d:]
    return out


def _lockstep(sets: Sets, searches: dict[int, Generator], evaluate: Callable) -> dict[int, np.ndarray]:
    """Runs searches of all sets together: a pass answers what each of them asks for next."""
    asked, done = {j: next(s) for j, s in searches.items()}, {}
    while asked:
        answers = evaluate(asked)
        for j in list(asked):
            try:
                asked[j] = searches[j].send(answers[j])
            except StopIteration as end:
                done[j] = end.value
                del asked[j]
    return done


def _sigmoid(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-a))


def _errors(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log loss of scores (classes, rows) and its slope."""
    z = z - z.max(0)
    e = np.exp(z)
    total = e.sum(0)
    hit = label == np.arange(CLASSES, dtype=np.int8)[:, None]
    return float(weight @ (np.log(total) - z[label, np.arange(z.shape[1])])), (e / total - hit) * weight


def _plain_loss(block: Block, point: np.ndarray) -> np.ndarray:
    d = len(block.x)
    w = point.reshape(d + 1, CLASSES)
    loss, r = _errors(w[:d].T @ block.x + w[d][:, None], block.label, block.weight)
    return np.concatenate([[loss], (block.x @ r.T).ravel(), r.sum(1)])


def _logistic(sets: Sets) -> dict[int, Softmax]:
    d, scales = len(sets.features), _scales(sets)

    def outer(j: int, point: np.ndarray) -> np.ndarray:
        """Weights of scaled features as those of the features themselves."""
        mean, inverse, _ = scales[j]
        w = point.reshape(d + 1, CLASSES)
        own = w[:d] * inverse[:, None]
        return np.vstack([own, w[d] - mean @ own])

    def evaluate(points):
        out = {}
        for j, v in _evaluated(sets, _plain_loss, {j: outer(j, p).ravel() for j, p in points.items()}).items():
            mean, inverse, weights = scales[j]
            v, w = v / weights.sum(), points[j].reshape(d + 1, CLASSES)[:d]
            g = v[1:].reshape(d + 1, CLASSES)
            g = np.vstack([(g[:d] - np.outer(mean, g[d])) * inverse[:, None] + PENALTY * w, g[d]])
            out[j] = v[0] + PENALTY / 2 * (w * w).sum(), g.ravel()
        return out

    starts = {j: np.vstack([np.zeros((d, CLASSES)), np.log(np.maximum(c / max(c.sum(), 1e-9), 1e-9))]) for j, (_, _, c) in scales.items() if c.sum() > 0}
    found = _lockstep(sets, {j: lbfgs(x.ravel(), LOGISTIC_STEPS) for j, x in starts.items()}, evaluate)
    return {j: Softmax(sets.features, w[:d], w[d]) for j, w in ((j, outer(j, p)) for j, p in found.items())}


def _unpacked(point: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.cumsum([d * HIDDEN, HIDDEN, HIDDEN * CLASSES])
    w, b, v, c = np.split(point, sizes)
    return w.reshape(d, HIDDEN), b, v.reshape(HIDDEN, CLASSES), c


def _network_loss(block: Block, point: np.ndarray) -> np.ndarray:
    w, b, v, c = _unpacked(point, len(block.x))
    total = np.zeros(1 + len(point))
    for at in range(0, block.x.shape[1], CHUNK):
        x = block.x[:, at : at + CHUNK]
        h = w.T @ x
        h += b[:, None]
        h = _sigmoid(h)
        loss, r = _errors(v.T @ h + c[:, None], block.label[at : at + CHUNK], block.weight[at : at + CHUNK])
        back = v @ r
        back *= h
        back *= 1 - h
        total += np.concatenate([[loss], (x @ back.T).ravel(), back.sum(1), (h @ r.T).ravel(), r.sum(1)])
    return total


def _network(sets: Sets) -> dict[int, Network]:
    d, scales = len(sets.features), _scales(sets)

    def outer(j: int, point: np.ndarray) -> np.ndarray:
        mean, inverse, _ = scales[j]
        w, b, v, c = _unpacked(point, d)
        own = w * inverse[:, None]
        return np.concatenate([own.ravel(), b - mean @ own, v.ravel(), c])

    def evaluate(points):
        out = {}
        for j, s in _evaluated(sets, _network_loss, {j: outer(j, p) for j, p in points.items()}).items():
            mean, inverse, weights = scales[j]
            s = s / weights.sum()
            w, b, v, c = _unpacked(s[1:], d)
            out[j] = s[0], np.concatenate([((w - np.outer(mean, b)) * inverse[:, None]).ravel(), b, v.ravel(), c])
        return out

    dice = np.random.default_rng(SEED)
    drawn = lambda n, inputs: (dice.random(n) * 4.8 - 2.4) / np.sqrt(inputs)
    start = np.concatenate([drawn((d + 1) * HIDDEN, d), drawn((HIDDEN + 1) * CLASSES, HIDDEN)])
    found = _lockstep(sets, {j: lbfgs(start, NETWORK_STEPS) for j, (_, _, c) in scales.items() if c.sum() > 0}, evaluate)
    return {j: Network(sets.features, _unpacked(outer(j, p), d)) for j, p in found.items()}


# ---- trees --------------------------------------------------------------------------------


@dataclass
class Growing:
    """A tree of a set with what its sums are taken of: classes, over features drawn for each node
    and rows drawn for each tree (``bag``, 0: all), or what is left of a class after ``done`` trees."""

    set: int
    tree: Tree
    number: int = 0
    bag: int = 0
    slots: int = 0
    target: int = -1
    done: list[Tree] = field(default_factory=list)

    def asked(self, nodes: np.ndarray, features: int) -> np.ndarray:
        """The features (nodes, slots) that a split of each node may use, ascending."""
        if self.slots >= features:
            return np.broadcast_to(np.arange(features), (len(nodes), features))
        return np.stack([np.sort(np.random.default_rng([SEED, self.number, int(n)]).permutation(features)[: self.slots]) for n in nodes])


#: Copies of a row in a bag (Poisson with mean 1) by 16 drawn bits.
_COPIES = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8], dtype=float)), (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


def _mixed(key: np.ndarray) -> np.ndarray:
    z = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(27))


def _copies(mixed: np.ndarray, bag: int) -> np.ndarray:
    z = (mixed + np.uint64(bag * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
    return _COPIES.take(((z ^ (z >> np.uint64(31))) & np.uint64(0xFFFF)).astype(np.int64))


def _class_sums(g: Growing, asked: np.ndarray, bins: np.ndarray, block: Block, copies: np.ndarray | None, level: int, whole: bool) -> np.ndarray:
    """(nodes, slots, bins, classes) of the nodes of a level."""
    d, n = bins.shape
    first, nodes = 2**level - 1, 2**level
    rows = np.arange(n) if copies is None else np.nonzero(copies)[0]
    at = g.tree.place(bins, level, rows) - first
    if level:
        rows, at = rows[at >= 0], at[at >= 0]
    slots = asked.shape[1]
    label = block.label.astype(np.int64)[rows]
    by = None if whole and copies is None else (np.ones(n) if whole else np.rint(block.weight * UNIT))[rows] * (1 if copies is None else copies[rows])
    flat, out = bins.ravel(), np.empty((slots, nodes * BINS * CLASSES))
    base = at * (BINS * CLASSES) + label
    for q in range(slots):
        cell = base + flat.take(asked[:, q].take(at) * n + rows).astype(np.int64) * CLASSES
        out[q] = np.bincount(cell, by, out.shape[1])
    out = out.reshape(slots, nodes, BINS, CLASSES).swapaxes(0, 1)
    return (out * (UNIT if whole else 1)).astype(np.int64)


#: What a row adds to a sum of targets, which are shifted to be positive.
_SHIFT, _ROW = float(4 * UNIT), float(1 << 33)


def _left_over(done: list[Tree], bins: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """What the next boosted tree learns: the sign of a class, then what trees leave of it."""
    y = np.where(hit, 1.0, -1.0)
    if not done:
        return y
    with np.errstate(over="ignore"):
        return 4 * y / (1 + np.exp(2 * y * _margin(done, bins)))


def _boosted_sums(g: Growing, bins: np.ndarray, block: Block, level: int, whole: bool) -> np.ndarray:
    """(nodes, features, bins, weight and target) of the nodes of a level."""
    first, nodes = 2**level - 1, 2**level
    by = np.rint(_left_over(g.done, bins, block.label == g.target) * (UNIT if whole else block.weight * UNIT))
    base = (g.tree.place(bins, level) - first) * BINS
    inside = slice(None) if base.min() >= 0 else np.nonzero(base >= 0)[0]
    base, by = base[inside], by[inside]
    size = nodes * BINS
    out = np.empty((len(bins), size, 2), np.int64)
    if whole:  # rows and targets in one sum: 2^13 rows of under 2^19 each leave it exact
        by = by + (_SHIFT + _ROW)
    else:
        w = np.rint(block.weight * UNIT)[inside]
    for f, b in enumerate(bins):
        cell = base + b[inside]
        total = np.bincount(cell, by, size)
        if whole:
            count = np.floor(total / _ROW)
            out[f, :, 0], out[f, :, 1] = count * UNIT, total - count * (_ROW + _SHIFT)
        else:
            out[f, :, 0], out[f, :, 1] = np.bincount(cell, w, size), total
    return out.reshape(len(bins), nodes, BINS, 2).swapaxes(0, 1)


_SPLIT = "tree int, node int, feature int, cut int, here binary, left binary, right binary"


def _worth(x: np.ndarray, boosted: bool) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        total = x[..., 0] if boosted else x.sum(-1)
        return np.where(total > 0, (x[..., 1] ** 2 if boosted else (x * x).sum(-1)) / total, 0.0)


def _split(sums: np.ndarray, boosted: bool) -> tuple[int, int, np.ndarray]:
    """(slot, cut, sums on the left) of the best split of (slots, bins, sums); slot -1: none."""
    x = sums / UNIT
    left, here = np.cumsum(x, 1)[:, :-1], x[0].sum(0)
    right = here - left
    weight = (lambda a: a[..., 0]) if boosted else (lambda a: a.sum(-1))
    gain = np.where((weight(left) > 0) & (weight(right) > 0), _worth(left, boosted) + _worth(right, boosted) - _worth(here, boosted), 0.0)
    slot, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[slot, cut] <= 1e-9 * weight(here):
        return -1, 0, sums[0].sum(0)
    return int(slot), int(cut), sums[slot, : cut + 1].sum(0)


def _level(sets: Sets, growing: list[Growing], level: int) -> bool:
    """Grows a level of all trees; False where none was split."""
    d, own, kind = len(sets.features), sets.own, np.uint8 if max(map(len, sets.shared)) < 256 else np.uint16
    boosted = growing[0].target >= 0
    asked = [] if boosted else [g.asked(2**level - 1 + np.arange(2**level), d) for g in growing]

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for block in _read(batches, d, kind):
            whole, mixed, bags, mine = bool((block.weight == 1).all()), _mixed(block.key), {}, {}
            for k, g in enumerate(growing):
                if block.step > g.set:
                    continue
                if g.set not in mine:
                    mine[g.set] = np.stack([to.take(b) for to, b in zip(own[g.set], block.bins)])
                if boosted:
                    x = _boosted_sums(g, mine[g.set], block, level, whole)
                else:
                    if g.bag and g.bag not in bags:
                        bags[g.bag] = _copies(mixed, g.bag)
                    x = _class_sums(g, asked[k], mine[g.set], block, bags.get(g.bag), level, whole)
                if k in total:
                    total[k] += x
                else:
                    total[k] = np.ascontiguousarray(x)
        for k, x in total.items():
            yield pa.record_batch({"tree": pa.array([k], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})

    def chosen(group: pa.Table) -> pa.Table:
        k, total = group["tree"][0].as_py(), 0
        for x in group["sums"]:
            total = total + np.frombuffer(x.as_buffer(), np.int64)
        total = total.reshape(2**level, d if boosted else asked[k].shape[1], BINS, -1)
        out = []
        for i, sums in enumerate(total):
            here = sums[0].sum(0)
            if here[0] if boosted else here.any():
                node = 2**level - 1 + i
                slot, cut, left = _split(sums, boosted)
                f = slot if boosted or slot < 0 else int(asked[k][i, slot])
                out.append((k, node, f, cut, here.tobytes(), left.tobytes(), (here - left).tobytes()))
        kinds = (*[pa.int32()] * 4, *[pa.binary()] * 3)
        return pa.table({n.split()[0]: pa.array([o[c] for o in out], kind) for c, (n, kind) in enumerate(zip(_SPLIT.split(", "), kinds))})

    value = lambda raw: (lambda x: x[1:] / x[0] if boosted else x / x.sum())(np.frombuffer(raw, np.int64).astype(np.float64))
    found = sets.binned.mapInArrow(summed, "tree int, sums binary").groupBy("tree").applyInArrow(chosen, _SPLIT).collect()  # a row a node
    for r in found:
        t = growing[r.tree].tree
        if not level:
            t.value[0] = value(r.here)
        if r.feature >= 0:
            t.feature[r.node], t.cut[r.node] = r.feature, r.cut
            t.value[2 * r.node + 1], t.value[2 * r.node + 2] = value(r.left), value(r.right)
    return any(r.feature >= 0 for r in found)


def _grown(sets: Sets, growing: list[Growing], depth: int) -> None:
    for level in range(depth):
        if not _level(sets, growing, level):
            break


def _shares(trees: int, depth: int, bagged: bool) -> Callable[[Sets], dict[int, Shares]]:
    def learn(sets: Sets) -> dict[int, Shares]:
        d = len(sets.features)
        slots = int(np.ceil(np.sqrt(d))) if bagged else d
        growing = [Growing(j, Tree.new(depth, CLASSES), i + 1, i + 1 if bagged else 0, slots) for j in sets.fitted() for i in range(trees)]
        _grown(sets, growing, depth)
        return {j: Shares(sets.features, sets.edges[j], [g.tree for g in growing if g.set == j], depth) for j in sets.fitted()}

    return learn


def _boosted(sets: Sets) -> dict[int, Boosted]:
    done: dict[tuple[int, int], list[Tree]] = {(j, c): [] for j in sets.fitted() for c in range(CLASSES)}
    for _ in range(ROUNDS):
        growing = [Growing(j, Tree.new(BOOSTED_DEPTH, 1), target=c, done=own) for (j, c), own in done.items()]
        _grown(sets, growing, BOOSTED_DEPTH)
        for g in growing:
            done[g.set, g.target].append(g.tree)
    return {j: Boosted(sets.features, sets.edges[j], [done[j, c] for c in range(CLASSES)], sets.counts[j]) for j in sets.fitted()}


_LEARNERS = {"logistic": _logistic, "tree": _shares(1, TREE_DEPTH, False), "forest": _shares(FOREST_TREES, FOREST_DEPTH, True), "boosted": _boosted, "network": _network}
