"""Tree ensembles grown from histograms: boosted, bagged, voted and extra trees.

Features become bins (quantile edges, at most 255; bin 0 is a missing value), one byte each, in
a staged table of blocks of up to BLOCK rows (bins by feature, label, weight, key, margins), so
that a row costs numpy's work alone. A level of all growing trees is one pass:
each task sums integer gradients, curvatures and counts by (tree, node, feature, bin) with
numpy and sends one array a node; arrays are added in executors, in two steps where tasks are
many, and the best split of a node is found where its sum is. The driver sees one row a node.
Gradients are rounded to integers first, so sums, and so trees, are the same however rows are dealt.

A split sends missing values to the side that gains more, also all of them against the rest.
Equal gains go to the first feature, then cut, then missing to the left. Row and column draws
are hashes of keys, trees and nodes, so reruns agree. Null labels are not learned from; labels
that repeat, null features and constant columns need no care. Learning from no row, or from one
class, gives the prior.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators import ranks
from terrace.sources.contest import spread
from terrace.sources.staging import Staged

CLASSES = 3
#: Gradients per integer step, and the largest row weight: sums of 2^40 rows stay in 64 bits.
UNIT, MOST_WEIGHT = 1 << 16, 64.0
#: Rounds after which margins are written anew; arrays that one step adds up.
REFRESH, FAN_IN = 4, 64
#: Rows of a block: its sums are exact in doubles (2^13 rows, 2^22 a gradient, 9 copies).
BLOCK = 8192


@dataclass(frozen=True)
class Settings:
    """groups: ensembles grown side by side and averaged. With ``boost`` each has ``rounds`` trees a
    class on the softmax loss, else one tree on the class shares."""

    rounds: int = 20
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    least_rows: int = 20
    ridge: float = 1.0
    columns: float = 1.0
    rows: float = 1.0
    bootstrap: bool = False
    random_cuts: bool = False
    boost: bool = True
    groups: int = 1
    seed: int = 42


#: Learners by name; a list is a vote of equal weights.
FAMILIES: dict[str, list[Settings]] = {
    "hist_boosted": [Settings()],
    "hist_shallow": [Settings(rounds=40, depth=2, rate=0.12, ridge=1.5)],
    "hist_deep": [Settings(rounds=20, depth=6, rate=0.12, least_rows=15)],
    "hist_sampled": [Settings(rows=0.8, columns=0.7)],
    "hist_bagged": [Settings(rounds=15, groups=5, bootstrap=True, columns=0.85)],
    "hist_voted": [Settings(rounds=20, depth=3, seed=10), Settings(rounds=15, depth=4, ridge=1.5, seed=20), Settings(rounds=12, depth=2, rate=0.25, ridge=2.0, seed=30)],
    "extra_trees": [Settings(boost=False, random_cuts=True, depth=7, groups=20, columns=0.5, ridge=0.0, least_rows=6)],
    "bagged_trees": [Settings(boost=False, bootstrap=True, depth=6, groups=10, ridge=0.0, least_rows=6)],
}


@dataclass
class Tree:
    """A heap of nodes: node i's children are 2 i + 1 and 2 i + 2. feature -1: a leaf."""

    group: int
    classes: list[int]
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def new(cls, group: int, classes: list[int], depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(group, classes, np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros((n, CLASSES)))

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        if not levels or not len(bins):
            return at
        f, node = self.feature[:, None], np.arange(len(self.feature))[:, None]
        b = np.arange(256)[None]
        right = np.where(b == 0, ~self.missing_left[:, None], b > self.cut[:, None])
        after, asked = np.where(f < 0, node, 2 * node + 1 + right).ravel(), np.maximum(self.feature, 0)
        for _ in range(levels):
            at = after[(at << 8) | bins[rows, asked[at]]]
        return at


def _hash(key: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform draws in [0, 1) by key and salt."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64)
        for s in (0, *salt):
            z = z + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


#: Chances of up to 0, 1, ... copies in a bootstrap sample (Poisson with mean 1).
_COPIES = np.cumsum(np.exp(-1.0) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8], dtype=float))


def multiplicity(key: np.ndarray, s: Settings, group: int, round_: int) -> np.ndarray:
    """How often each row counts for a group's trees of a round."""
    if s.bootstrap:
        return np.searchsorted(_COPIES, _hash(key, s.seed, group), side="right").astype(np.int64)
    if s.rows < 1:
        return (_hash(key, s.seed, group, round_) < s.rows).astype(np.int64)
    return np.ones(len(key), np.int64)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def slopes(margins: np.ndarray, label: np.ndarray, weight: np.ndarray, boost: bool) -> tuple[np.ndarray, np.ndarray]:
    """Integer gradients and curvatures (rows, classes)."""
    hit = label[:, None] == np.arange(CLASSES)
    w = (weight * UNIT)[:, None]
    if not boost:
        return np.rint(-(hit * w)).astype(np.int64), np.rint(np.broadcast_to(w, hit.shape)).astype(np.int64)
    p = softmax(margins)
    return np.rint((p - hit) * w).astype(np.int64), np.rint(p * (1 - p) * w).astype(np.int64)


def best_split(hist: np.ndarray, s: Settings, allowed: np.ndarray, only: np.ndarray | None) -> tuple[float, int, int, bool]:
    """(gain, feature, cut, missing to the left) of sums (features, bins, 2 classes' + 1): the
    gradient and the curvature of each class, then rows. allowed: which features may be used;
    only: the sole cut of each. Gain 0: no split."""
    channels = (hist.shape[2] - 1) // 2
    left = np.cumsum(hist[:, 1:], axis=1)
    left = np.concatenate([np.stack([left, left + hist[:, :1]], 2)], 2)  # (features, cuts, missing right or left, sums)
    right = hist.sum(1)[:, None, None] - left

    def worth(x):
        g, h = x[..., 0 : 2 * channels : 2] / UNIT, x[..., 1 : 2 * channels : 2] / UNIT
        return (g * g / np.maximum(h + s.ridge, 1e-12)).sum(-1)

    gain = worth(left) + worth(right) - worth(hist.sum(1))[:, None, None]
    sound = (left[..., -1] >= s.least_rows) & (right[..., -1] >= s.least_rows) & allowed[:, None, None]
    if only is not None:
        sound &= (np.arange(1, hist.shape[1])[None] == only[:, None])[:, :, None]
    gain = np.where(sound & (gain > 1e-9), gain, 0.0)[:, :, ::-1]  # missing to the left first
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[at]), int(at[0]), int(at[1]) + 1, at[2] == 0


def _chosen(hist: np.ndarray, s: Settings, tree: int, node: int, round_: int) -> tuple:
    """The split of a node, with the sums of its two sides or its own."""
    n = len(hist)
    draw = lambda what: _hash(np.arange(n), s.seed, what, tree, node, round_)
    allowed = np.ones(n, bool)
    if s.columns < 1:
        allowed = np.argsort(np.argsort(draw(1), kind="stable"), kind="stable") < max(1, round(s.columns * n))
    only = None
    if s.random_cuts:
        used = hist[:, 1:, -1] > 0
        low, high = used.argmax(1), used.shape[1] - 1 - used[:, ::-1].argmax(1)
        only = 1 + low + np.floor(draw(2) * np.maximum(high - low, 1)).astype(np.int64)
    return best_split(hist, s, allowed, only)


def _margins(s: Settings) -> int:
    """Groups whose margins are kept; those of trees on class shares are never read."""
    return s.groups if s.boost else 1


def _channels(s: Settings) -> int:
    """Sums that a cell of a task holds: gradient, curvature and rows; without boosting weight by class and rows."""
    return 3 if s.boost else CLASSES + 1


def _counted(cell: np.ndarray, by: np.ndarray | None, size: int) -> np.ndarray:
    return np.bincount(cell, by, size).astype(np.int64)  # exact: blocks are small


def _taken(bins, label, weight, key, margins, trees: list[Tree], since: int, level: int, s: Settings, round_: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums of a block by (tree, node); bins lie by feature; trees from ``since`` on grow, the
    others are in margins only after this."""
    margins = margins.copy()
    for t in trees[:since]:
        margins[:, t.group] += t.value[t.place(bins.T, s.depth)]
    out, edges, features = {}, s.bins + 1, len(bins)
    known: dict[int, tuple] = {}
    for k, t in enumerate(trees[since:]):
        if t.group not in known:
            copies = multiplicity(key, s, t.group, round_)
            known[t.group] = (*(slopes(margins[:, t.group], label, weight, True) if s.boost else (None, None)), copies, bool((copies == 1).all()))
        g, h, copies, once = known[t.group]
        at = t.place(bins.T, level)
        first = 2**level - 1
        taken = at >= first if once else (at >= first) & (copies > 0)
        every = bool(taken.all())
        here = slice(None) if every else np.nonzero(taken)[0]
        at = at[here]
        if not len(at):
            continue
        here_nodes = np.bincount(at - first) > 0
        nodes = np.nonzero(here_nodes)[0]
        start = (np.cumsum(here_nodes) - 1)[at - first] * edges
        m = None if once else copies[here].astype(np.float64)
        if s.boost:
            c = t.classes[0]
            by = [x[here, c].astype(np.float64) * (1 if m is None else m) for x in (g, h)]
        else:
            by = np.rint(weight[here] * UNIT) * (1 if m is None else m)
            kind = label[here].astype(np.int64)
        size = len(nodes) * edges
        sums = np.empty((features, size, _channels(s)), np.int64)
        for f in range(features):
            cell = start + bins[f][here]
            sums[f, :, -1] = _counted(cell, m, size)
            if s.boost:
                sums[f, :, 0], sums[f, :, 1] = _counted(cell, by[0], size), _counted(cell, by[1], size)
            else:
                sums[f, :, :CLASSES] = _counted(cell * CLASSES + kind, by, size * CLASSES).reshape(size, CLASSES)
        for i, node in enumerate(nodes):
            out[k, first + int(node)] = sums[:, i * edges : (i + 1) * edges]
    return out


def _whole(sums: np.ndarray, s: Settings) -> np.ndarray:
    """A node's sums with gradient and curvature of each class, as ``best_split`` takes them."""
    if s.boost:
        return sums
    weight = sums[..., :CLASSES].sum(-1)
    return np.stack([x for c in range(CLASSES) for x in (-sums[..., c], weight)] + [sums[..., -1]], -1)


def _blocks(batch: pa.RecordBatch, features: int, groups: int) -> Iterator[tuple]:
    raw = lambda c, i, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
    for i in range(batch.num_rows):
        yield raw(0, i, np.uint8).reshape(features, -1), raw(1, i, np.int32), raw(2, i, np.float64), raw(3, i, np.int64), raw(4, i, np.float64).reshape(-1, groups, CLASSES)


_ROW = "bins binary, label binary, weight binary, key binary, margins binary"


def _summed(batches: Iterable[pa.RecordBatch], trees: list[Tree], since: int, level: int, s: Settings, round_: int, features: int, fan: int) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block in _blocks(batch, features, _margins(s)):
            for key, x in _taken(*block, trees, since, level, s, round_).items():
                if key in total:
                    total[key] += x
                else:
                    total[key] = x.copy()
    lane = TaskContext.get().partitionId() % fan
    for (tree, node), x in total.items():
        yield pa.record_batch({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "lane": pa.array([lane], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})


def _added(group: pa.Table) -> np.ndarray:
    total = None
    for chunk in group["sums"].chunks:
        for x in chunk:
            one = np.frombuffer(x.as_buffer(), np.int64)
            total = one.copy() if total is None else total + one
    return total


def _joined(group: pa.Table) -> pa.Table:
    return group.slice(0, 1).drop_columns("sums").append_column("sums", pa.array([_added(group).tobytes()], pa.binary()))


_SPLIT = "tree int, node int, gain double, feature int, cut int, missing_left boolean, here binary, left binary, right binary"


def _split(group: pa.Table, s: Settings, features: int, round_: int, first: int) -> pa.Table:
    tree, node = group["tree"][0].as_py(), group["node"][0].as_py()
    hist = _whole(_added(group).reshape(features, s.bins + 1, -1), s)
    gain, f, cut, miss = _chosen(hist, s, first + tree, node, round_)
    here = hist[0].sum(0)
    left = hist[f, 1 : cut + 1].sum(0) + (hist[f, 0] if miss else 0)
    cells = (tree, node, gain, f, cut, bool(miss), here.tobytes(), left.tobytes(), (here - left).tobytes())
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n.split()[0]: pa.array([v], k) for n, v, k in zip(_SPLIT.split(", "), cells, kinds)})


def _put(tree: Tree, node: int, sums: bytes, s: Settings) -> None:
    x = np.frombuffer(sums, np.int64)
    for i, c in enumerate(tree.classes):
        tree.value[node, c] = -(s.rate if s.boost else 1.0) * (x[2 * i] / UNIT) / max(x[2 * i + 1] / UNIT + s.ridge, 1e-12)


def _level(rows: DataFrame, trees: list[Tree], since: int, level: int, s: Settings, round_: int, features: int, tasks: int, first: int) -> bool:
    """Grows one level of the trees from ``since`` on; False where nothing was split."""
    fan = -(-tasks // FAN_IN)
    sums = rows.mapInArrow(lambda b: _summed(b, trees, since, level, s, round_, features, fan), "tree int, node int, lane int, sums binary")
    if fan > 1:
        sums = sums.groupBy("tree", "node", "lane").applyInArrow(_joined, "tree int, node int, lane int, sums binary")
    found = sums.groupBy("tree", "node").applyInArrow(lambda t: _split(t, s, features, round_, first), _SPLIT).collect()  # one row a node
    for r in found:
        t = trees[since + r.tree]
        if level == 0:
            _put(t, 0, r.here, s)
        if r.gain > 0:
            t.feature[r.node], t.cut[r.node], t.missing_left[r.node] = r.feature, r.cut, r.missing_left
            _put(t, 2 * r.node + 1, r.left, s)
            _put(t, 2 * r.node + 2, r.right, s)
    return any(r.gain > 0 for r in found)


def edges_of(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of all bins but the last, by exact ranks with bounded state."""
    plain = {c: F.col(f"`{c}`").cast("double") for c in features}
    found = ranks.exact(train, {c: F.when(~F.isnan(x), x) for c, x in plain.items()}, lambda n, _: [-(-i * n // bins) for i in range(1, bins)])
    return [np.unique(np.array(found[c] or [], np.float64)) for c in features]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One byte a feature: 0 for a missing value, k + 1 where k edges lie below the value."""
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(e, x[:, f], side="left"))
    return out


def _numbers(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _features(features: list[str]) -> F.Column:
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in features])


class Scorer:
    """A fitted learner: ``transform`` adds the chances of the classes, an array."""

    features: list[str]

    def chances(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.drop("_chances", "_features")

        def run(batches):
            for batch in batches:
                p = self.chances(_numbers(batch.column(batch.num_columns - 1))) if batch.num_rows else np.zeros((0, CLASSES))
                yield pa.record_batch([*batch.columns[:-1], pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "_chances"])

        schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string("_chances array<double>").fields])
        return kept.withColumn("_features", _features(self.features)).mapInArrow(run, schema)


@dataclass
class Ensemble(Scorer):
    features: list[str]
    parts: list[tuple[Settings, list[np.ndarray], np.ndarray, list[Tree]]] = field(default_factory=list)

    def chances(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), CLASSES))
        for s, edges, prior, trees in self.parts:
            bins = binned(x, edges)
            margins = np.zeros((len(x), s.groups, CLASSES)) + (np.log(np.maximum(prior, 1e-6)) if s.boost else 0.0)
            for t in trees:
                margins[:, t.group] += t.value[t.place(bins, s.depth)]
            share = softmax(margins) if s.boost else margins / np.maximum(margins.sum(-1, keepdims=True), 1e-12)
            total += share.mean(1)
        return total / max(1, len(self.parts))


def _table(train: DataFrame, features: list[str], label: str, weight: str | None, key: str, edges: list[np.ndarray], start: np.ndarray) -> DataFrame:
    w = F.least(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(MOST_WEIGHT)) if weight else F.lit(1.0)
    plain = spread(train.where(F.col(label).isNotNull())).select(_features(features).alias("x"), F.col(label).cast("int").alias("label"), w.alias("weight"), F.xxhash64(key).alias("key"))

    def packed(bins, label, weight, key):
        for at in range(0, len(label), BLOCK):
            own = slice(at, at + BLOCK)
            n = len(label[own])
            cells = (np.ascontiguousarray(bins[own].T), label[own], weight[own], key[own], np.broadcast_to(start, (n, *start.shape)))
            yield pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["bins", "label", "weight", "key", "margins"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((binned(_numbers(batch.column(0)), edges), batch.column(1).to_numpy().astype(np.int32), batch.column(2).to_numpy().astype(np.float64), batch.column(3).to_numpy()))
            n += batch.num_rows
            if n >= BLOCK:
                whole = [np.concatenate(x) for x in zip(*held)]
                cut = n - n % BLOCK
                yield from packed(*[x[:cut] for x in whole])
                held, n = [tuple(x[cut:] for x in whole)], n - cut
        if n:
            yield from packed(*[np.concatenate(x) for x in zip(*held)])

    return plain.mapInArrow(run, _ROW)


def _advanced(rows: DataFrame, trees: list[Tree], s: Settings, features: int) -> DataFrame:
    """rows with the values of finished trees in their margins."""

    def run(batches):
        for batch in batches:
            for i, (bins, _, _, _, margins) in enumerate(_blocks(batch, features, s.groups)):
                margins = margins.copy()
                for t in trees:
                    margins[:, t.group] += t.value[t.place(bins.T, s.depth)]
                yield pa.record_batch([*[c.slice(i, 1) for c in batch.columns[:4]], pa.array([margins.tobytes()], pa.binary())], names=batch.schema.names)

    return rows.mapInArrow(run, _ROW)


def _grown(table: DataFrame, s: Settings, features: int) -> list[Tree]:
    held = Staged(table, "boosting")
    done: list[Tree] = []
    fresh: list[Tree] = []  # finished, but not yet in the staged margins
    try:
        tasks = held.rows.rdd.getNumPartitions()
        for r in range(s.rounds if s.boost else 1):
            new = [Tree.new(g, [c], s.depth) for g in range(s.groups) for c in range(CLASSES)] if s.boost else [Tree.new(g, list(range(CLASSES)), s.depth) for g in range(s.groups)]
            split = False
            for level in range(s.depth):
                if not _level(held.rows, fresh + new, len(fresh), level, s, r, features, tasks, len(done)):
                    break
                split = True
            done += new
            fresh += new
            if not split:
                break
            if s.boost and (r + 1) % REFRESH == 0 and r + 1 < s.rounds:
                old, held = held, Staged(_advanced(held.rows, fresh, s, features), "boosting")
                old.drop()
                fresh = []
    finally:
        held.drop()
    return done


def fit(train: DataFrame, features: list[str], settings: list[Settings] | str = "hist_boosted", label: str = "outcome", weight: str | None = None, key: str = "match_id") -> Ensemble:
    """An ensemble for labels 0 to CLASSES - 1; settings or the name of a family."""
    settings = FAMILIES[settings] if isinstance(settings, str) else settings
    known = train.where(F.col(label).isNotNull())
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    counts = {r[0]: r[1] for r in known.groupBy(F.col(label).cast("int")).agg(F.sum(w)).collect()}
    total = sum(counts.values())
    prior = np.array([counts.get(c, 0.0) / total if total else 1 / CLASSES for c in range(CLASSES)])
    out = Ensemble(features)
    edges: dict[int, list[np.ndarray]] = {}
    for s in settings:
        if total and len(counts) > 1 and features:
            if s.bins not in edges:
                edges[s.bins] = edges_of(known, features, s.bins)
            start = np.zeros((_margins(s), CLASSES)) + (np.log(np.maximum(prior, 1e-6)) if s.boost else 0.0)
            trees = _grown(_table(known, features, label, weight, key, edges[s.bins], start), s, len(features))
            out.parts.append((s, edges[s.bins], prior, trees))
        else:
            out.parts.append((replace(s, boost=True), [np.zeros(0)] * len(features), prior, []))
    return out
