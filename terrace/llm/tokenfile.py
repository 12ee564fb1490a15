"""Token-id shard files with a minimal perfect hash index.

``write`` deals documents by doc_id ranges, encodes each partition in ascending doc_id
order and writes rows of the ``shards`` table: a shard block holds at most ``BLOCK_BYTES`` of
raw little-endian ids (or one longer document), with the keys and lengths of its documents.
The ``index`` table holds hash blocks of about ``INDEX_KEYS`` keys: a displacement array, and
in slot order (fingerprint, part, seq, offset, length). A key's hash names its block, its
displacement names its slot, the stored fingerprint tells a foreign key: constant time.

A key is (doc_id, occ): occ counts the rows that repeat a doc_id, in order of their ids. Null
doc_ids come first and are keyed like others. Null texts are empty: the end id alone. An
empty table gives empty files. Extra columns are ignored.

Encoding: the vocabulary's normaliser and splitter never join across a space or line feed
and drop both, and never join a Latin letter with an ASCII mark other than the apostrophe. So
texts are cut into such units by Arrow kernels, a slice of documents at a time; each distinct
unit of a slice is encoded by the tokenizers library once, and ids are put together with numpy.
A worker remembers at most ``CACHE_UNITS`` units between slices.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import held, stage, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
INDEX_KEYS = 4096
ROWS_A_PART, MOST_PARTS = 4096, 20_000
#: Bytes of text that are encoded in one step (or one longer document).
SLICE_BYTES = 8 << 20
CACHE_UNITS, KEPT_UNITS = 800_000, 400_000
MAX_TRIES = 1_000_000
_FIELDS = np.dtype([("fingerprint", "<i4"), ("part", "<i4"), ("seq", "<i4"), ("offset", "<i8"), ("n", "<i4")])
_BLOCKS = "part int, seq int, n_ids long, width int, doc_ids array<long>, occs array<int>, lengths array<int>, payload binary"
#: Precomposed Latin letters, and ASCII marks other than the apostrophe.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~"
#: Units that are one word to the splitter: their ids end at the first that ends a word.
_ONE_WORD = re.compile("[a-zß-öø-ÿ]+")
_WORDS_A_CALL = 2000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts, 2 or 4 bytes for each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.last_of_word = np.zeros(size, bool)
        self.last_of_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, self.kind), np.zeros(1, np.int64)  # ids of unit k: pool[ends[k]:ends[k + 1]]

    def _learn(self, units: list[str]) -> None:
        """ids of new units. Words are encoded many in one text, which saves most of a call's
        cost, and told apart by the ids that end a word."""
        whole, other = [u for u in units if _ONE_WORD.fullmatch(u)], [u for u in units if not _ONE_WORD.fullmatch(u)]
        texts = [" ".join(whole[i : i + _WORDS_A_CALL]) for i in range(0, len(whole), _WORDS_A_CALL)]
        joined = np.concatenate([np.zeros(0, np.int64), *(np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        stops = np.nonzero(self.last_of_word[joined])[0] + 1
        if len(stops) != len(whole):
            raise ValueError("words and their ends differ")
        single = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        sizes = np.concatenate([np.diff(stops, prepend=0), np.array([len(x) for x in single], np.int64)])
        self.known.update(zip([*whole, *other], range(len(self.known), len(self.known) + len(units))))
        self.pool = np.concatenate([self.pool, joined.astype(self.kind), *(x.astype(self.kind) for x in single)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _forget(self) -> None:
        if len(self.known) > CACHE_UNITS:  # the first ones stay: mostly frequent
            self.known = dict(islice(self.known.items(), KEPT_UNITS))
            self.ends = self.ends[: KEPT_UNITS + 1]
            self.pool = self.pool[: self.ends[-1]]

    def encode_many(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in turn, and how many each has (with its end id). Texts that may
        hold the string of a special token, which units would cut, are encoded whole."""
        lowered = pc.ascii_lower(pc.fill_null(texts, ""))
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(lowered, token).to_numpy(zero_copy_only=False)
        out, at = [], 0
        for i in [*np.nonzero(whole)[0].tolist(), len(texts)]:
            if i > at:
                out.append(self._by_units(lowered.slice(at, i - at)))
            if i < len(texts):
                ids = self.tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0].ids
                out.append((np.array(ids, self.kind), np.array([len(ids)])))
            at = i + 1
        ids, counts = (np.concatenate(x) for x in zip(*out)) if out else (self.pool[:0], np.zeros(0, np.int64))
        return (ids, counts) if end_id is None else (np.insert(ids, np.cumsum(counts), end_id), counts + 1)

    def _by_units(self, lowered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self._forget()
        plain = pc.replace_substring(lowered, "\n", " ")
        plain = pc.replace_substring_regex(plain, f"([{_LETTERS}])([{_MARKS}])", r"\1 \2")
        plain = pc.replace_substring_regex(plain, f"([{_MARKS}])([{_LETTERS}])", r"\1 \2")
        parts = pc.split_pattern(plain, " ")
        units = parts.flatten().dictionary_encode()
        distinct = units.dictionary.to_pylist()
        if missing := [u for u in distinct if u not in self.known]:
            self._learn(missing)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[units.indices.to_numpy()]
        first, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])])

    def encode(self, text: str | None, end_id: int | None = END_ID) -> bytes:
        return self.encode_many(pa.array([text], pa.string()), end_id)[0].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(upto, most + (upto[at - 1] if at else 0), side="right")))
        yield at, stop
        at = stop


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    return held("tokens", path, lambda: Encoder(path))


_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("occs", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def _blocks(batches: Iterable[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    coder, part = encoder(path), TaskContext.get().partitionId()
    ids: list = []
    occs: list[int] = []
    lengths: list[int] = []
    body: list[np.ndarray] = []
    most, size, seq, run, last = BLOCK_BYTES // coder.width, 0, 0, 0, object()

    def block() -> pa.RecordBatch:
        row = {"part": part, "seq": seq, "n_ids": size, "width": coder.width, "doc_ids": ids, "occs": occs, "lengths": lengths, "payload": b"".join(x.tobytes() for x in body)}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for a, b in slices(batch.column(1)):
            coded, counts = coder.encode_many(batch.column(1).slice(a, b - a), end_id)
            begun = at = 0
            for doc_id, n in zip(keys[a:b], counts.tolist()):
                if ids and (size + n > most or len(ids) >= BLOCK_DOCS):
                    body.append(coded[begun:at])
                    yield block()
                    ids, occs, lengths, body, size, seq, begun = [], [], [], [], 0, seq + 1, at
                run = run + 1 if doc_id == last else 0
                last = doc_id
                ids.append(doc_id)
                occs.append(run)
                lengths.append(n)
                size, at = size + n, at + n
            body.append(coded[begun:at])
    if ids:
        yield block()


def _mixed(h: np.ndarray, d) -> np.ndarray:
    """splitmix64 of h moved by displacement d."""
    with np.errstate(over="ignore"):
        z = h + np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def perfect_hash(h: np.ndarray) -> np.ndarray:
    """Displacements of distinct uint64 hashes: one for each of len(h) buckets, >= 0: a seed,
    < 0: -1 - slot. Larger buckets are placed first, those of one key take what is free."""
    n = len(h)
    shifts = np.zeros(n, np.int32)
    bucket = (_mixed(h, 0) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    free = np.ones(n, bool)
    cuts = [0, *(np.nonzero(np.diff(bucket[order]))[0] + 1).tolist(), n]
    runs = sorted((order[a:b] for a, b in pairwise(cuts)), key=len, reverse=True) if n else []
    single = []
    for run in runs:
        if len(run) == 1:
            single.append(bucket[run[0]])
            continue
        for d in range(1, MAX_TRIES):
            slots = (_mixed(h[run], d) % np.uint64(n)).astype(np.int64)
            if free[slots].all() and len(set(slots.tolist())) == len(run):
                break
        else:
            raise ValueError("no displacement found: equal hashes")
        free[slots] = False
        shifts[bucket[run[0]]] = d
    for b, slot in zip(single, np.nonzero(free)[0].tolist()):
        shifts[b] = -1 - slot
    return shifts


def slots_of(h: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    n = np.uint64(len(shifts))
    d = shifts[(_mixed(h, 0) % n).astype(np.int64)].astype(np.int64)
    return np.where(d < 0, -1 - d, (_mixed(h, np.maximum(d, 0)) % n).astype(np.int64))


def _build(entries: pa.Table) -> pa.Table:
    h = entries["h"].to_numpy().view(np.uint64)
    shifts = perfect_hash(h)
    rows = np.zeros(len(h), _FIELDS)
    at = slots_of(h, shifts)
    for name in _FIELDS.names:
        rows[name][at] = entries[name].to_numpy()
    return pa.table({"block": entries["block"][:1], "shifts": pa.array([shifts.tobytes()], pa.binary()), "slots": pa.array([rows.tobytes()], pa.binary())})


def _look_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    kept = keys.select(["doc_id", "occ"])
    if not len(index):
        kept = kept.slice(0, 0)
        return pa.table({"doc_id": kept["doc_id"], "occ": kept["occ"]} | {f: pa.array([], t) for f, t in (("part", pa.int32()), ("seq", pa.int32()), ("offset", pa.int64()), ("n", pa.int32()))})
    rows = np.frombuffer(index["slots"][0].as_py(), _FIELDS)
    rows = rows[slots_of(keys["h"].to_numpy().view(np.uint64), np.frombuffer(index["shifts"][0].as_py(), np.int32))]
    right = rows["fingerprint"] == keys["fingerprint"].to_numpy()
    rows, kept = rows[right], kept.filter(pa.array(right))
    return pa.table({"doc_id": kept["doc_id"], "occ": kept["occ"]} | {f: pa.array(rows[f].copy()) for f in ("part", "seq", "offset", "n")})


def _hashed(keys: DataFrame, blocks: int) -> DataFrame:
    h = F.xxhash64("doc_id", "occ")
    return keys.withColumns({"h": h, "fingerprint": F.hash("doc_id", "occ"), "block": F.pmod(h, F.lit(blocks)).cast("int")})


class Store:
    """The two tables of a written corpus. ``carried`` holds, for parts that go on with the
    doc_id of the part before, this doc_id and the rows it has in earlier parts."""

    def __init__(self, shards: DataFrame, index: DataFrame, blocks: int, carried: dict[int, tuple]):
        self.shards, self.index, self.blocks, self.carried = shards, index, blocks, carried

    def keys(self) -> DataFrame:
        """(doc_id, occ) of every document."""
        return _placed(self.shards, self.carried).select("doc_id", "occ")

    def places(self, keys: DataFrame) -> DataFrame:
        """(doc_id, occ, part, seq, offset, n) of the keys (doc_id, occ) that are held."""
        asked = _hashed(keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("occ").cast("int").alias("occ")), self.blocks)
        return asked.groupBy("block").cogroup(self.index.groupBy("block")).applyInArrow(_look_up, "doc_id long, occ int, part int, seq int, offset long, n int")

    def starts(self) -> DataFrame:
        """(part, seq, base): ids before each block, from sums per part and inside it."""
        sizes = self.shards.select("part", "seq", "n_ids")
        upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(upto(Window.orderBy("part"))), F.lit(0)).alias("before"))
        inside = F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
        return sizes.select("part", "seq", inside.alias("inside")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))

    def fetch(self, keys: DataFrame) -> DataFrame:
        """(doc_id, occ, width, ids): the raw ids of some keys."""
        cut = F.expr("substring(payload, cast(offset * width + 1 as int), n * width)")
        return self.places(keys).join(self.shards.select("part", "seq", "width", "payload"), ["part", "seq"]).select("doc_id", "occ", "width", cut.alias("ids"))


def _carried(shards: DataFrame) -> dict[int, tuple]:
    """Rows of a part's first doc_id in the parts before it. One row a part reaches the
    driver, of at most ``MOST_PARTS``."""
    ends = shards.select("part", "seq", F.element_at("doc_ids", 1).alias("first"), F.struct(F.element_at("doc_ids", -1).alias("id"), F.element_at("occs", -1).alias("occ")).alias("last"))
    rows = ends.groupBy("part").agg(F.min_by(F.struct("first"), "seq").alias("first"), F.max_by("last", "seq").alias("last")).collect()
    out: dict[int, tuple] = {}
    last, count = object(), 0
    for r in sorted(rows, key=lambda r: r.part):
        before = count if r.first.first == last else 0
        if before:
            out[r.part] = (r.first.first, before)
        last, count = r.last.id, r.last.occ + 1 + (before if r.last.id == r.first.first else 0)
    return out


def _placed(shards: DataFrame, carried: dict[int, tuple]) -> DataFrame:
    return shards.select("part", "seq", "doc_ids", "occs", "lengths").mapInArrow(lambda batches: _entries(batches, carried), "part int, seq int, doc_id long, occ int, offset long, n int")


def write(docs: DataFrame, path: str, end_id: int | None = END_ID) -> Store:
    """Shards and index of docs (doc_id, text) in the shared folder. Rows are dealt by ranges
    of (doc_id, hash of the text), so that rows of one doc_id, or without one, may spread."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.count()
    parts = min(MOST_PARTS, max(8, -(-total // ROWS_A_PART)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    shards = stage(dealt.mapInArrow(lambda batches: _blocks(batches, path, end_id), _BLOCKS), "token-shards")
    blocks, carried = max(1, -(-total // INDEX_KEYS)), _carried(shards)
    index = stage(_hashed(_placed(shards, carried), blocks).groupBy("block").applyInArrow(_build, "block int, shifts binary, slots binary"), "token-index")
    return Store(shards, index, blocks, carried)


def _entries(batches: Iterable[pa.RecordBatch], carried: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n, occs = np.array(row["lengths"], np.int32), np.array(row["occs"], np.int32)
            if row["part"] in carried:
                doc_id, before = carried[row["part"]]
                occs = occs + np.array([before * (x == doc_id) for x in row["doc_ids"]], np.int32)
            yield pa.record_batch({"part": np.full(len(n), row["part"], np.int32), "seq": np.full(len(n), row["seq"], np.int32), "doc_id": pa.array(row["doc_ids"], pa.int64()), "occ": occs, "offset": np.cumsum(n, dtype=np.int64) - n, "n": n})


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """crc32 of the ids at each offset of the payload, as little-endian 32-bit integers."""
    for batch in batches:
        for row in batch.to_pylist():
            n = np.array(row["lengths"], np.int64)
            ids = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4").astype("<u4")
            stops = np.cumsum(n)
            crcs = [zlib.crc32(ids[a:b].data) for a, b in zip((stops - n).tolist(), stops.tolist())]
            yield pa.record_batch({"part": np.full(len(n), row["part"], np.int32), "seq": np.full(len(n), row["seq"], np.int32), "offset": stops - n, "n_tokens": n, "ids_crc32": pa.array(crcs, pa.int64())})


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place by its key, and what the files hold there."""
    docs = table(spark, sf_dir, "documents")
    store = write(docs, vocabulary_path())
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).select("doc_id", F.explode(F.expr("sequence(0, cast(rows as int) - 1)")).alias("occ"))
    place = ["part", "seq", "offset"]
    held = store.shards.select("part", "seq", "width", "lengths", "payload").mapInArrow(_digests, "part int, seq int, offset long, n_tokens long, ids_crc32 long")
    found = store.places(keys).join(held, place).join(store.starts(), ["part", "seq"])
    return found.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
