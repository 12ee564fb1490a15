"""Line dedup over a sharded minimal perfect hash.

A line's key is the line without ``SPACES`` at both ends, A-Z lower-cased; keys of at least
``LEAST_POINTS`` code points count. Each row of documents is hashed once: 128 bits for each
distinct key of it, staged. Counts are summed by task first, then by Spark, to one row a
distinct key: how many rows hold it, and its keeper, the largest doc_id of these.

Index: distinct keys fall into shards of about ``SHARD_KEYS`` by their hash. A shard is a
minimal perfect hash in levels (a key whose bit no other key of the level wants stays there,
the others go on; a key's slot is the rank of its bit) over arrays of fingerprints, counts
and keepers. Documents send the hashes of their keys to the shards that hold them and get back
those that go; lines are never joined or sorted as text.

Hot keys: those with over total / ``HEAD`` of all probes are at most ``HEAD`` in number, so
they make one small shard that goes with every task and is probed in place. No other key can
have more than that share, so neither a shard's probes nor a task's grow with one line.

A document is a row: rows that repeat a doc_id count each, and all rows of the keeper's doc_id
keep the line. Null doc_ids are smaller than all others; where only they hold a key they keep
it. Null and empty texts are one empty line. An empty table gives an empty result. Other
columns pass through, but for those with the names of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrace.llm.common import SLICE_ROWS, release, stage, table

SPACES = b" \t\n\x0b\x0c\r"
LEAST_POINTS, LEAST_ROWS = 20, 3
SHARD_KEYS, HEAD = 1 << 16, 1 << 16
#: Places of a level for each of its keys; levels before the rest is kept as a sorted list.
ROOM, LEVELS = 2, 40
#: Entries that a task sums up before it sends them.
SUMMED = 500_000
NO_ID = -(1 << 63)


def key_of(line: bytes) -> bytes | None:
    """The key of a line, none where it is too short to count."""
    key = line.strip(SPACES).lower()
    if len(key) < LEAST_POINTS or not key.isascii() and len(key.decode("utf-8", "replace")) < LEAST_POINTS:
        return None
    return key


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def hashes_of(text: str | None) -> bytes:
    """16 bytes for each distinct key, in the order of the keys' first lines."""
    keys = map(key_of, (text or "").encode().split(b"\n"))
    return b"".join(map(_digest, dict.fromkeys(k for k in keys if k is not None)))


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """64 bits from rows of two, another value at each level."""
    with np.errstate(over="ignore"):
        z = h[:, 0] + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + h[:, 1]
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 of n distinct rows of two uint64."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.first = np.cumsum(sizes) - sizes
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        for level in range(LEVELS):
            if not len(h):
                break
            size = ROOM * len(h)
            at = (_mixed(h, level) % np.uint64(size)).astype(np.int64)
            wanted = np.bincount(at, minlength=size)
            sizes.append(size)
            levels.append(wanted == 1)
            h = h[wanted[at] > 1]
        rest = h[np.lexsort((h[:, 1], h[:, 0]))]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *levels]), rest)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Each row's slot; a row that was not built in gets another's, or -1."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (size, first) in enumerate(zip(self.sizes.tolist(), self.first.tolist())):
            at = first + (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        known = {tuple(x): i for i, x in enumerate(self.rest.tolist())}
        if known:
            held = int(self.bits.sum())
            out[left] = [held + known[k] if (k := tuple(x)) in known else -1 for x in h[left].tolist()]
        return out

    def pack(self) -> tuple[bytes, bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes(), self.rest.tobytes()

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes, rest: bytes) -> PerfectHash:
        n = np.frombuffer(sizes, np.int64)
        return cls(n, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n.sum())).astype(bool), np.frombuffer(rest, np.uint64).reshape(-1, 2))


class Shard:
    """Arrays over a perfect hash."""

    def __init__(self, perfect: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.perfect, self.prints, self.counts, self.keepers = perfect, prints, counts, keepers

    @classmethod
    def build(cls, h: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        perfect = PerfectHash.build(h)
        at = perfect.slots(h)
        arrays = np.zeros(len(h), np.uint32), np.zeros(len(h), np.uint32), np.zeros(len(h), np.int64)
        for a, v in zip(arrays, (_print(h), np.minimum(counts, 0xFFFFFFFF), keepers)):
            a[at] = v
        return cls(perfect, *arrays)

    def goes(self, h: np.ndarray, doc_ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held here, and which of them go from these documents."""
        if not len(self.prints):
            return np.zeros(len(h), bool), np.zeros(len(h), bool)
        at = self.perfect.slots(h)
        held = (at >= 0) & (self.prints[at] == _print(h))
        return held, held & (self.counts[at] >= least) & (self.keepers[at] != doc_ids)

    def pack(self) -> list[bytes]:
        return [*self.perfect.pack(), self.prints.tobytes(), self.counts.tobytes(), self.keepers.tobytes()]

    @classmethod
    def unpack(cls, *parts: bytes) -> Shard:
        return cls(PerfectHash.unpack(*parts[:3]), *(np.frombuffer(x, k) for x, k in zip(parts[3:], (np.uint32, np.uint32, np.int64))))


def _print(h: np.ndarray) -> np.ndarray:
    return (h[:, 1] >> np.uint64(32)).astype(np.uint32)


_PACKED = "sizes binary, bits binary, rest binary, prints binary, counts binary, keepers binary"
_PARTS = [x.split()[0] for x in _PACKED.split(", ")]


def _rows(column) -> np.ndarray:
    """Rows of two uint64 of all values of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(map(hashes_of, part.column(2).to_pylist()), pa.binary())], names=["doc", "sig", "hashes"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a batch of staged rows, each with its row and its place in it."""
    h, n = _rows(batch.column("hashes")), np.array([len(x) // 16 for x in batch.column("hashes").to_pylist()], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return h, row, np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, n, keeper): keys summed up over many documents of a task."""

    def summed(held: list) -> tuple:
        h, n, doc = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((h[:, 1], h[:, 0]))
        h, n, doc = h[order], n[order], doc[order]
        new = np.nonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(1)]))[0] if len(h) else np.zeros(0, np.int64)
        return (h[new], np.add.reduceat(n, new), np.maximum.reduceat(doc, new)) if len(h) else (h, n, doc)

    def packed(h, n, doc) -> pa.RecordBatch:
        return pa.record_batch({"h1": _signed(h[:, 0]), "h2": _signed(h[:, 1]), "n": pa.array(n), "keeper": pa.array(doc)})

    held, size = [], 0
    for batch in batches:
        h, row, _ = _flat(batch)
        doc = batch.column("doc").to_numpy(zero_copy_only=False)[row]
        held.append((h, np.ones(len(h), np.int64), doc))
        size += len(h)
        if size >= SUMMED:
            one = summed(held)
            held, size = [one], len(one[0])
            if size >= SUMMED // 2:  # mostly distinct: there is nothing to gain by waiting
                yield packed(*one)
                held, size = [], 0
    if size:
        yield packed(*summed(held))


def _pair(group: pa.Table) -> np.ndarray:
    return np.stack([group[c].to_numpy().view(np.uint64) for c in ("h1", "h2")], 1)


def _build(group: pa.Table) -> pa.Table:
    built = Shard.build(_pair(group), group["n"].to_numpy(), group["keeper"].to_numpy())
    return pa.table({"shard": group["shard"][:1]} | {n: pa.array([x], pa.binary()) for n, x in zip(_PARTS, built.pack())})


class Index:
    """``shards``: a table of packed shards; ``head``: the packed shard of the hot keys."""

    def __init__(self, shards: DataFrame, n_shards: int, head: list[bytes], least: int):
        self.shards, self.n_shards, self.head, self.least = shards, n_shards, head, least


def build(hashed: DataFrame, least: int = LEAST_ROWS, shard_keys: int = SHARD_KEYS, head: int = HEAD) -> Index:
    """The index of hashed rows (doc, sig, hashes). At most ``head`` hot keys reach the driver."""
    counts = hashed.mapInArrow(_counted, "h1 long, h2 long, n long, keeper long").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    counts = stage(counts, "line-counts")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = F.col("n") > total // head
    rows = counts.where(hot).toArrow() if distinct else None  # sum of n over these: more than total / head each, so no more than head
    top = Shard.build(_pair(rows), rows["n"].to_numpy(), rows["keeper"].to_numpy()) if rows is not None and len(rows) else Shard.build(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n_shards = max(1, -(-distinct // shard_keys))
    dealt = counts.where(~hot).withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    return Index(stage(dealt.groupBy("shard").applyInArrow(_build, f"shard int, {_PACKED}"), "line-index"), n_shards, top.pack(), least)


def _probes(batches: Iterable[pa.RecordBatch], index: tuple) -> Iterator[pa.RecordBatch]:
    """Keys that are not in the head, to be sent to their shards."""
    n_shards, head, least = index
    top = Shard.unpack(*head)
    for batch in batches:
        h, row, place = _flat(batch)
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        cold = ~top.goes(h, doc[row], least)[0]
        h, row, place = h[cold], row[cold], place[cold]
        shard = np.mod(np.ascontiguousarray(h[:, 0]).view(np.int64), n_shards).astype(np.int32)
        yield pa.record_batch({"shard": shard, "h1": _signed(h[:, 0]), "h2": _signed(h[:, 1]), "doc": doc[row], "sig": batch.column("sig").to_numpy(zero_copy_only=False)[row], "place": place.astype(np.int32)})


def _answer(probes: pa.Table, shard: pa.Table, least: int) -> pa.Table:
    """(doc, sig, place) of keys that go."""
    if not len(shard) or not len(probes):
        return probes.select(["doc", "sig", "place"]).slice(0, 0)
    held = Shard.unpack(*(shard[n][0].as_py() for n in _PARTS))
    _, goes = held.goes(_pair(probes), probes["doc"].to_numpy(), least)
    return probes.select(["doc", "sig", "place"]).filter(pa.array(goes))


def probe(hashed: DataFrame, index: Index) -> DataFrame:
    """(doc, sig, places): the keys outside the head that go from each document."""
    asked = (index.n_shards, index.head, index.least)
    probes = hashed.mapInArrow(lambda b: _probes(b, asked), "shard int, h1 long, h2 long, doc long, sig long, place int")
    least = index.least
    gone = probes.groupBy("shard").cogroup(index.shards.groupBy("shard")).applyInArrow(lambda p, s: _answer(p, s, least), "doc long, sig long, place int")
    return gone.groupBy("doc", "sig").agg(F.collect_set("place").alias("places"))


def cleaned(texts: list, docs: list[int], places: list, head: Shard, least: int) -> list[tuple[int, int, str]]:
    """Lines before, lines dropped and the text that stays, of each document."""
    lines = [(t or "").encode().split(b"\n") for t in texts]
    keys = [[key_of(x) for x in own] for own in lines]
    distinct = [list(dict.fromkeys(k for k in own if k is not None)) for own in keys]
    n = np.array([len(x) for x in distinct], np.int64)
    h = np.frombuffer(b"".join(_digest(k) for own in distinct for k in own), ">u8").astype(np.uint64).reshape(-1, 2)
    hot, stops, out = head.goes(h, np.repeat(np.array(docs, np.int64), n), least)[1], np.cumsum(n).tolist(), []
    for own, named, found, told, stop in zip(lines, keys, distinct, places, stops):
        gone = {found[i] for i in [*(told or ()), *np.nonzero(hot[stop - len(found) : stop])[0].tolist()]}
        kept = [x for x, k in zip(own, named) if k is None or k not in gone]
        out.append((len(own), len(own) - len(kept), b"\n".join(kept).decode()))
    return out


def dedup(docs: DataFrame, least: int = LEAST_ROWS, shard_keys: int = SHARD_KEYS, head: int = HEAD) -> DataFrame:
    """docs (doc_id, text and any others) with n_lines, n_dropped and kept, the text that stays."""
    fields = T._parse_datatype_string("n_lines long, n_dropped long, kept string")
    docs = docs.drop(*fields.names)
    doc, sig = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.col("text").cast("string"))
    hashed = stage(docs.select(doc.alias("doc"), sig.alias("sig"), F.col("text").cast("string").alias("text")).mapInArrow(_hashed, "doc long, sig long, hashes binary"), "line-hashes")
    index = build(hashed, least, shard_keys, head)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc.alias("doc"), sig.alias("sig"))
    joined = packed.join(probe(hashed, index), ["doc", "sig"], "left").select("row", "doc", "places", F.col("row.text").cast("string").alias("text")).select("row.*", F.struct("doc", "places", "text").alias("_line"))
    top = index.head

    def run(batches):
        release()
        held, kinds = Shard.unpack(*top), to_arrow_schema(fields)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                asked = part.column(part.num_columns - 1)
                found = cleaned(*(asked.field(n).to_pylist() for n in ("text", "doc", "places")), held, least)
                columns = [pa.array(x, f.type) for x, f in zip(zip(*found), kinds)] if found else [pa.array([], f.type) for f in kinds]
                yield pa.record_batch([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *kinds.names])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *fields.fields]))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
n AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
s AS (SELECT k.*, n.key IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN n USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM s GROUP BY r, doc_id
"""
