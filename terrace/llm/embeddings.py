"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors of a label are one node with a count. A label's nodes form a cell; a cell with
more than ``MOST`` nodes is split around sampled members, level by level, and each node joins
its ``overlap`` nearest centres. The nearest is its home; only from there it is dealt on to
several, so its copies grow with the levels, not with their power. Centres are the samples that
lie farthest from one another, in turn, until all others are linked to one: so a dense group
gets one centre, while vectors that share a mean direction are told apart by what is left of
them. A cell is dense when at least ``DENSE`` of its sampled pairs are links themselves (or it
is still too large after ``LEVELS``): there the work of comparing all pairs is in proportion to
the links.

In every other cell, now a shard, each node's nearest candidates are pruned by the robust rule
(a candidate goes when a kept one is ``ALPHA`` times nearer to it) and the pruned lists of all
shards are united. Every member is searched for over the united lists: greedily from the
shard's medoid, then by range expansion from itself and from all that is found, to the end.
What is in range is verified by cosine in double precision. Dense cells are compared exactly,
in pairs of blocks.

A link is counted in one cell alone, the first that holds both its ends, so counts are the
same from both ends; no pairs are sent, only counts and a star for each component of a cell.
The audit compares about ``AUDIT`` nodes with all rows in blocks, by links between different
nodes, averaged per node, for small and large groups apart; while either recall is under
``RECALL`` the overlap doubles and the index is built again. Where that is not enough at the
widest overlap, all nodes of a label are compared in pairs of blocks.

Vectors that are null, zero or hold null or non-finite components, and null labels, link with
nothing. Vectors of other lengths are never compared. Repeated rows are links of each other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.common import components, stage, table

COSINE = 0.93
OVERLAP, LEVELS = 3, 8
MOST, HOME, FANOUT, SALT_ROWS = 6144, 700, 64, 20_000
DENSE = 0.25
NEAR, DEGREE, ALPHA, STEP_ROWS = 48, 16, 1.2, 512
AUDIT, RECALL = 256, 0.95
#: Links from which a group counts as large in the audit; nodes of a block compared exactly.
LARGE, BLOCK = 16, 4096
#: What single precision may miss of a cosine; what it finds is verified in double.
SLACK = 1e-5
_LINKS = "a string, b string, n_links long, n_nodes long"
_ROW = "node string, vec binary, copies long, cell string, home boolean, dense boolean"
_GRAPH = "cell string, node string, vec binary, copies long, near array<string>"


def _kind(vectors: DataFrame) -> str:
    """Bytes of a stored component: single only where the input is."""
    element = vectors.schema["embedding"].dataType.elementType
    return "<f4" if isinstance(element, T.FloatType) else "<f8"


def _read(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, node, vec): sound vectors as bytes with a digest of label and vector."""
    width = np.dtype(kind).itemsize
    for batch in batches:
        column, labels = batch.column(2), batch.column(1).to_pylist()
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # no -0.0
        ends = np.cumsum(sizes)
        upto = lambda mask, ends=ends, sizes=sizes: np.concatenate([[0], np.cumsum(mask)])[[ends, ends - sizes]]
        (bad, bad0), (some, some0) = upto(~np.isfinite(flat)), upto(flat != 0)
        sound, raw = (bad == bad0) & (some > some0), flat.astype(kind).tobytes()
        vecs = [raw[(e - n) * width : e * width] if ok and label is not None else None for e, n, ok, label in zip(ends.tolist(), sizes.tolist(), sound.tolist(), labels)]
        nodes = [None if v is None else hashlib.md5(f"{label}:".encode() + v).hexdigest() for v, label in zip(vecs, labels)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.string()), pa.array(vecs, pa.binary())], names=["vec_id", "label", "node", "vec"])


def _unit(column, kind: str) -> np.ndarray:
    """Unit rows in double precision, of stored vectors of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)  # first to a scale whose squares are finite
    x = x / np.where(top > 0, top, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread_out(sims: np.ndarray, cosine: float) -> list[int]:
    """Rows that lie farthest from those before them, from cosines of all pairs; ends when
    every other row is within the cosine of one."""
    kept, near = [0], sims[0].copy()
    while True:
        at = int(near.argmin())
        if near[at] >= cosine - SLACK:
            return kept
        kept.append(at)
        near = np.maximum(near, sims[at])
        near[at] = 2.0


def _assign(rows: pa.Table, centres: pa.Table, overlap: int, kind: str, cosine: float) -> pa.Table:
    """rows dealt to their nearest centres: a home row to several, any other to one."""
    if not len(rows) or not len(centres):
        return rows.select(["node", "vec", "copies", "cell", "home", "dense"])
    centres = centres.sort_by("part")
    c = _unit(centres["vec"], kind)
    sims = c @ c.T
    linked = (sims[np.triu_indices(len(c), 1)] >= cosine).mean() if len(c) > 1 else 1.0
    if linked >= DENSE:
        return rows.select(["node", "vec", "copies", "cell", "home"]).append_column("dense", pa.array(np.ones(len(rows), bool)))
    c = c[spread_out(sims, cosine)]
    near = np.argsort(-(_unit(rows["vec"], kind) @ c.T), axis=1, kind="stable")[:, :overlap]
    home = rows["home"].to_numpy(zero_copy_only=False)
    who, rank = np.nonzero(home[:, None] | (np.arange(near.shape[1]) == 0))
    cell = np.array(rows["cell"].to_pylist(), object)[who] + "/" + near[who, rank].astype(str).astype(object)
    taken = rows.select(["node", "vec", "copies"]).take(pa.array(who))
    return pa.table({**{n: taken[n] for n in taken.column_names}, "cell": pa.array(cell, pa.string()), "home": pa.array(home[who] & (rank == 0)), "dense": pa.array(np.zeros(len(who), bool))})


def cells(classes: DataFrame, overlap: int, kind: str, most: int = MOST, home: int = HOME, cosine: float = COSINE) -> tuple[DataFrame, bool]:
    """(node, vec, copies, cell, home, dense): the members of every cell, and whether any cell
    was split."""
    now = classes.select("node", "vec", "copies", F.concat_ws(":", "label", F.octet_length("vec")).alias("cell"), F.lit(True).alias("home"), F.lit(False).alias("dense"))
    done, split = None, False
    for level in range(LEVELS):
        sizes = now.where("not dense").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most).withColumn("b", F.greatest(F.lit(2 * overlap), F.least(F.lit(FANOUT), F.ceil(F.col("n") / home))))
        open_ = stage(sizes, "flat-open")
        if open_.isEmpty():
            break
        split = True
        small = now.join(open_, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        big = now.where("not dense").join(open_, "cell").withColumn("h", F.xxhash64("node", F.lit(level)))
        drawn = big.where(F.pmod("h", "n") < 4 * F.col("b")).withColumn("part", F.row_number().over(Window.partitionBy("cell").orderBy("h", "node"))).where("part <= b")
        salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
        centres = stage(drawn.select("cell", "part", "vec", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), "flat-centres")
        dealt = big.select("node", "vec", "copies", "cell", "home", "dense", F.pmod(F.xxhash64("node", F.lit(-1 - level)), salts).cast("int").alias("salt"))
        moved = dealt.groupBy("cell", "salt").cogroup(centres.groupBy("cell", "salt")).applyInArrow(lambda a, b: _assign(a, b, overlap, kind, cosine), _ROW)
        now = stage(moved, "flat-cells")
    else:
        sizes = now.groupBy("cell").agg(F.count("*").alias("n"))
        now = now.join(sizes, "cell").withColumn("dense", F.col("dense") | (F.col("n") > most)).select("node", "vec", "copies", "cell", "home", "dense")
    return (now if done is None else stage(done.unionByName(now), "flat-shards")), split


def robust_edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pruned neighbours of each row of unit vectors, with their reverses: (from, to), sorted."""
    n, x = len(x), x.astype(np.float32)
    k = min(NEAR, n - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads, tails = [], []
    for at in range(0, n, 256):
        sims = x[at : at + 256] @ x.T
        own = np.arange(len(sims))
        sims[own, own + at] = -np.inf
        cand = np.argpartition(sims, n - k, axis=1)[:, n - k :]
        near = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)
        alive, rows = np.ones(cand.shape, bool), np.arange(len(cand))
        among = x[cand]
        among = among @ among.transpose(0, 2, 1)  # cosines between the candidates of a row
        kept = np.zeros(cand.shape, bool)
        for _ in range(min(DEGREE, k)):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[rows[some], pick[some]] = True
            alive[rows, pick] = False
            alive &= ALPHA * (1 - among[rows, pick]) > 1 - near
        r, c = np.nonzero(kept)
        heads.append(r + at)
        tails.append(cand[r, c])
    a, b = np.concatenate(heads), np.concatenate(tails)
    code = np.unique(np.concatenate([a * n + b, b * n + a]))
    return code // n, code % n


class Shard:
    """A shard with its lists as compressed rows."""

    def __init__(self, x: np.ndarray, heads: np.ndarray, tails: np.ndarray):
        self.x, self.low = x, x.astype(np.float32)
        self.first = np.searchsorted(heads, np.arange(len(x) + 1))
        self.tails = tails

    def _visit(self, q: np.ndarray, node: np.ndarray, own: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, neighbour of its node) not seen yet, with their cosines."""
        n = self.first[node + 1] - self.first[node]
        at = np.repeat(self.first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        q, near = np.repeat(q, n), self.tails[at]
        new = ~seen[q, near]
        code = np.unique(q[new] * len(self.x) + near[new])
        q, near = code // len(self.x), code % len(self.x)
        seen[q, near] = True
        return q, near, np.einsum("ij,ij->i", self.low[own[q]], self.low[near])

    def in_range(self, own: np.ndarray, medoid: int, cosine: float) -> np.ndarray:
        """Which rows are in range of the rows ``own``, as (own, rows) booleans: a greedy walk
        of all from the medoid in step, then expansion over what is in range."""
        m = np.arange(len(own))
        seen, inside = np.zeros((len(own), len(self.x)), bool), np.zeros((len(own), len(self.x)), bool)
        seen[m, own] = True
        walks, at = m, np.full(len(own), medoid)
        seen[m, at] = True
        best = np.einsum("ij,ij->i", self.low[own], self.low[at])
        inside[m, at] |= best >= cosine - SLACK
        while len(walks):
            q, near, s = self._visit(walks, at[walks], own, seen)
            inside[q, near] = s >= cosine - SLACK
            before = best.copy()
            np.maximum.at(best, q, s)
            won = (s == best[q]) & (s > before[q])
            at[q[won]] = near[won]
            walks = np.unique(q[won])
        q, node = np.nonzero(inside)
        q, node = np.concatenate([m, q]), np.concatenate([own, node])
        while len(q):
            q, near, s = self._visit(q, node, own, seen)
            hit = s >= cosine - SLACK
            q, node = q[hit], near[hit]
            inside[q, node] = True
        inside[m, own] = False
        q, node = np.nonzero(inside)
        for i in range(0, len(q), 1 << 18):
            a, b = q[i : i + (1 << 18)], node[i : i + (1 << 18)]
            inside[a, b] = np.einsum("ij,ij->i", self.x[own[a]], self.x[b]) >= cosine
        return inside


class _Forest:
    """Components of a cell's rows, grown by rows of a boolean matrix."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, own: np.ndarray, to: np.ndarray, hits: np.ndarray) -> None:
        for i in np.nonzero(hits.any(1))[0].tolist():
            met = np.unique(self.root[[own[i], *to[hits[i]]]])
            if len(met) > 1:
                self.root[np.isin(self.root, met)] = met[0]

    def star(self, names: np.ndarray) -> list[tuple]:
        """(name, least name of its component) of rows that are not the least themselves."""
        order = np.argsort(names, kind="stable")
        _, first, back = np.unique(self.root[order], return_index=True, return_inverse=True)
        least = np.empty(len(names), object)
        least[order] = names[order][first][back]
        return [(a, b, None, None) for a, b in zip(names, least) if a != b]


def _shared_before(group: pa.Table) -> list[np.ndarray]:
    """Rows of the group that meet in an earlier cell, one array a cell: their links are
    counted there."""
    if "cells" not in group.column_names:
        return []
    here = group["cell"][0].as_py()
    rows: dict[str, list[int]] = {}
    for i, cells_ in enumerate(group["cells"].to_pylist()):
        for c in cells_:
            if c < here:
                rows.setdefault(c, []).append(i)
    return [np.array(v) for v in rows.values() if len(v) > 1]


def _counted(hits: np.ndarray, own: np.ndarray, to: np.ndarray, before: list[np.ndarray], n: int) -> np.ndarray:
    """hits without the pairs that an earlier cell counts."""
    hits = hits.copy() if before else hits
    left, right = np.full(n, -1), np.full(n, -1)
    left[own], right[to] = np.arange(len(own)), np.arange(len(to))
    for rows in before:
        a, b = left[rows], right[rows]
        hits[np.ix_(a[a >= 0], b[b >= 0])] = False
    return hits


def _links(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("a", "b", "n_links", "n_nodes"), cols, kinds)})


def _build(shard: pa.Table, kind: str) -> pa.Table:
    names = np.array(shard["node"].to_pylist(), object)
    heads, tails = robust_edges(_unit(shard["vec"], kind))
    stops = np.searchsorted(heads, np.arange(len(names) + 1)).tolist()
    near = [names[tails[a:b]].tolist() for a, b in zip(stops, stops[1:])]
    return pa.table({n: shard[n] for n in ("cell", "node", "vec", "copies")} | {"near": pa.array(near, pa.list_(pa.string()))})


def _searched(group: pa.Table, x: np.ndarray, heads: np.ndarray, tails: np.ndarray, cosine: float) -> pa.Table:
    names, copies = np.array(group["node"].to_pylist(), object), group["copies"].to_numpy()
    shard, forest, every = Shard(x, heads, tails), _Forest(len(x)), np.arange(len(x))
    medoid, before = int((x @ x.mean(0)).argmax()), _shared_before(group)
    links, nodes = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), STEP_ROWS):
        own = every[at : at + STEP_ROWS]
        hits = shard.in_range(own, medoid, cosine)
        forest.join(own, every, hits)
        hits = _counted(hits, own, every, before, len(x))
        links[own], nodes[own] = hits @ copies, hits.sum(1)
    return _links([*((n, None, k, m) for n, k, m in zip(names, links.tolist(), nodes.tolist())), *forest.star(names)])


def _build_and_search(shard: pa.Table, cosine: float, kind: str) -> pa.Table:
    """A shard that shares no node with another: its lists are united already."""
    x = _unit(shard["vec"], kind)
    return _searched(shard, x, *robust_edges(x), cosine)


def _search(shard: pa.Table, cosine: float, kind: str) -> pa.Table:
    place = {name: i for i, name in enumerate(shard["node"].to_pylist())}
    lists = [np.array(sorted({place[v] for v in near if v in place}), np.int64) for near in shard["near"].to_pylist()]
    heads = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    return _searched(shard, _unit(shard["vec"], kind), heads, np.concatenate(lists), cosine)


def _compare(pair: pa.Table, cosine: float, kind: str) -> pa.Table:
    """One pair of blocks, or a block with itself: counts of its nodes and stars."""
    x, names, copies = _unit(pair["vec"], kind), np.array(pair["node"].to_pylist(), object), pair["copies"].to_numpy()
    block, low = pair["block"].to_numpy(), pair["lo"][0].as_py()
    one = low == pair["hi"][0].as_py()
    left = np.arange(len(x)) if one else np.nonzero(block == low)[0]
    right = left if one else np.nonzero(block != low)[0]
    links, nodes, forest, before = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), _Forest(len(x)), _shared_before(pair)
    for at in range(0, len(left), STEP_ROWS):
        own = left[at : at + STEP_ROWS]
        hits = (x[own] @ x[right].T >= cosine) & (own[:, None] != right[None, :])
        forest.join(own, right, hits)
        hits = _counted(hits, own, right, before, len(x))
        links[own] += hits @ copies[right]
        nodes[own] += hits.sum(1)
        if not one:
            links[right] += copies[own] @ hits
            nodes[right] += hits.sum(0)
    return _links([*((n, None, k, m) for n, k, m in zip(names, links.tolist(), nodes.tolist())), *forest.star(names)])


def exact(members: DataFrame, cosine: float, kind: str, block: int = BLOCK) -> DataFrame:
    """Counts and stars by comparison of all nodes of a cell. A node goes to as many tasks as
    its cell has blocks, so work and rows sent are quadratic."""
    blocks = members.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    dealt = members.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit("exact"), "node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("blocks", "other")
    return pairs.groupBy("cell", "lo", "hi").applyInArrow(lambda t: _compare(t, cosine, kind), _LINKS)


def search(classes: DataFrame, overlap: int, cosine: float, kind: str, most: int = MOST, home: int = HOME) -> DataFrame:
    """(a, null, n_links, n_nodes) for each node of a cell, to be summed, and (a, b, null, null)
    for each edge of a star; n_nodes counts other nodes, n_links their copies."""
    members, split = cells(classes, overlap, kind, most, home, cosine)
    members = members.select("node", "vec", "copies", "cell", "dense")
    if not split:
        return stage(members.drop("dense").groupBy("cell").applyInArrow(lambda t: _build_and_search(t, cosine, kind), _LINKS), "flat-links")
    built = stage(members.where("not dense").drop("dense").groupBy("cell").applyInArrow(lambda t: _build(t, kind), _GRAPH), "flat-graph")
    every = members.groupBy("node").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    shards = built.drop("near").join(united, "node").join(every, "node")
    found = shards.groupBy("cell").applyInArrow(lambda t: _search(t, cosine, kind), _LINKS)
    dense = exact(members.where("dense").drop("dense").join(every, "node"), cosine, kind)
    return stage(found.unionByName(dense), "flat-links")


def audit(classes: DataFrame, found: DataFrame, cosine: float, kind: str = "<f4", sample: int = AUDIT) -> float:
    """Recall of links between different nodes, averaged per node: the lesser of small and
    large groups. Sampled nodes are compared with all rows in blocks. Nodes found with no, few
    and many links are drawn apart and weigh as many as they stand for; the sample is bounded,
    so it is sent with the task."""
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n_nodes").alias("n_nodes"))
    known = stage(classes.select("node").join(counts, "node").select("node", "n_nodes", F.when(F.col("n_nodes") == 0, 0).when(F.col("n_nodes") < LARGE, 1).otherwise(2).alias("kind")), "flat-known")
    total = {r.kind: r.n for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not total:
        return 1.0
    share = F.create_map(*[F.lit(v) for k, n in total.items() for v in (k, sample / n)])
    place = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(place < F.element_at(share, F.col("kind"))).join(classes.select("node", "label", "vec"), "node").limit(6 * sample).collect()
    each = -(-sample // 3)
    drawn = [r for k in sorted(total) for r in sorted((r for r in drawn if r.kind == k), key=lambda r: r.node)[:each]]
    asked: dict[int, list[int]] = {}
    for j, r in enumerate(drawn):
        asked.setdefault(len(r.vec), []).append(j)
    queries = {size: (_unit(pa.array([drawn[j].vec for j in js], pa.binary()), kind), np.array([drawn[j].label for j in js], object)) for size, js in asked.items()}

    def block(batches):
        hits = np.zeros(len(drawn), np.int64)
        for batch in batches:
            sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for size, (q, labels) in queries.items():
                rows = batch.filter(pa.array(sizes == size))
                for at in range(0, rows.num_rows, 2048):
                    part = rows.slice(at, 2048)
                    hit = (q @ _unit(part.column(0), kind).T >= cosine) & (labels[:, None] == np.array(part.column(1).to_pylist(), object)[None, :])
                    hits[asked[size]] += hit.sum(1)
        yield pa.record_batch({"j": pa.array(range(len(drawn)), pa.int32()), "n": pa.array(hits)})

    true = {r.j: r.n for r in classes.select("vec", "label").mapInArrow(block, "j int, n long").groupBy("j").agg(F.sum("n").alias("n")).collect()}
    drawn_of = {k: sum(r.kind == k for r in drawn) for k in total}
    recalls = []
    for large in (False, True):
        part = [(total[r.kind] / drawn_of[r.kind], min(1.0, r.n_nodes / (true[j] - 1))) for j, r in enumerate(drawn) if true[j] > 1 and (true[j] > LARGE) == large]
        if part:
            recalls.append(sum(w * x for w, x in part) / sum(w for w, _ in part))
    return min(recalls, default=1.0)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, most: int = MOST, home: int = HOME) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).
    Components of vectors in double precision are compared as such."""
    kind, key = _kind(vectors), vectors.schema["vec_id"].dataType
    plain = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    schema = T.StructType([T.StructField("vec_id", key), *T._parse_datatype_string("label string, node string, vec binary").fields])
    rows = stage(plain.mapInArrow(lambda b: _read(b, kind), schema), "flat-rows")
    classes = stage(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "flat-classes")
    while True:
        found = search(classes, overlap, cosine, kind, most, home)
        if audit(classes, found, cosine, kind) >= RECALL:
            break
        if overlap >= FANOUT // 2:
            whole = classes.select("node", "vec", "copies", F.concat_ws(":", "label", F.octet_length("vec")).alias("cell"))
            found = stage(exact(whole, cosine, kind), "flat-links")
            break
        overlap *= 2
    roots = components(found.where("b is not null").select("a", "b")).groupBy("node").agg(F.min("root").alias("root"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_links"))
    placed = stage(
        classes.select("node", "least", (F.col("copies") - 1).alias("own")).join(roots, "node", "left").join(counts, "node", "left")
        .select("node", "least", F.coalesce("root", "node").alias("root"), (F.col("own") + F.coalesce("n_links", F.lit(0))).alias("n_links")), "flat-placed",
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(named, "root").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CASE WHEN list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
