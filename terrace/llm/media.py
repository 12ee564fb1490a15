"""Media columns: content-defined chunks, stored once by digest, and ordered chunk lists.

A text's payload is its UTF-8 bytes with bytes 0 up to a positive multiple of ``PAD``. A
rolling gear hash over the last 32 bytes cuts it where its top ``CUT_BITS`` bits are 0, within
``LEAST`` and ``MOST`` bytes. A medium is known by the SHA-256 of its text; its recipe lists
its chunk digests in order.

Which digests belong to more than one row is found by a grouped count and a semi-join of
digests alone; no payload moves for it. Media without such a digest keep their chunks
together in ``packs``, written where they were read. All others give their chunks to
``chunks``, one row a digest. The writer tells both kinds apart by a bit set over hashed media
ids, of ``BITS_A_MEDIUM`` bits for each one that shares, up to ``MOST_BITS`` (64 MB, the most
that is broadcast). A false hit sends a medium to ``chunks``, which is right as well; beyond
some ten million sharing media ever more go there, at the cost of a shuffle. Reading back joins recipes with chunks by digest and verifies the text's hash.

Null texts are empty ones: 64 bytes 0. Equal texts are one medium; null and repeated doc_ids
are kept as rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import SLICE_ROWS, stage, table

PAD = 64
CUT_BITS, LEAST, MOST = 10, 256, 8192
BITS_A_MEDIUM, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 29
MAGIC = b"TCM1"
#: Gear values of the 256 bytes, by rule.
GEAR = np.array([struct.unpack("<I", hashlib.sha256(b"gear %d" % b).digest()[:4])[0] for b in range(256)], np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % PAD if raw else PAD), len(raw)


def cut_points(payload: bytes) -> list[int]:
    """Ends of the chunks. The 32 steps of the rolling hash are summed by doubling."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    out, start = [], 0
    for end in (np.nonzero(h >> np.uint32(32 - CUT_BITS) == 0)[0] + 1).tolist():
        while end - start > MOST:
            start += MOST
            out.append(start)
        if end - start >= LEAST:
            out.append(end)
            start = end
    while len(payload) - start > MOST:
        start += MOST
        out.append(start)
    if start < len(payload):
        out.append(len(payload))
    return out


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    out, start = [], 0
    for end in cut_points(payload):
        part = payload[start:end]
        out.append((hashlib.sha256(part).digest()[:16], part))
        start = end
    return out


def _recipes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            sizes, lists = [], []
            for text in part.column(2):
                payload, n = payload_of(text.as_py())
                sizes.append(n)
                lists.append([d for d, _ in chunks_of(payload)])
            yield pa.record_batch([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "media", "n_bytes", "digests"])


_PACK = pa.schema([("media", pa.binary()), ("n_bytes", pa.int64()), ("parts", pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary()), ("data", pa.binary())])))])
_CHUNK = pa.schema([("digest", pa.binary()), ("data", pa.binary())])


def _stored(batches: Iterable[pa.RecordBatch], bits: bytes, alone: bool) -> Iterator[pa.RecordBatch]:
    """Packs of media outside the bit set, or chunks of those inside."""
    held = np.frombuffer(bits, np.uint8)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            media, texts, places = part.column(0), part.column(1), part.column(2).to_numpy()
            rows = np.nonzero((held[places >> 3] >> (places & 7) & 1).astype(bool) != alone)[0].tolist()
            cut = ((media[i].as_py(), *payload_of(texts[i].as_py())) for i in rows)
            if alone:
                found = []
                for key, payload, n in cut:
                    seen: set[bytes] = set()
                    parts = []
                    for pos, (digest, data) in enumerate(chunks_of(payload)):
                        parts.append({"pos": pos, "digest": digest, "data": None if digest in seen else data})
                        seen.add(digest)
                    found.append({"media": key, "n_bytes": n, "parts": parts})
                yield pa.RecordBatch.from_pylist(found, schema=_PACK)
            else:
                unique = dict(x for _, payload, _ in cut for x in chunks_of(payload))
                yield pa.record_batch([pa.array(list(unique), pa.binary()), pa.array(list(unique.values()), pa.binary())], schema=_CHUNK)


def stored_form(payload: bytes, n_bytes: int, chunks: list[tuple[bytes, bytes]]) -> bytes:
    """Recipe and chunks as one object: magic, sizes, (length, digest) of each, their bytes."""
    head = MAGIC + struct.pack("<QI", n_bytes, len(chunks))
    return head + b"".join(struct.pack("<I", len(c)) + d for d, c in chunks) + payload


def feature(payload: bytes, n_chunks: int) -> str:
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
    values = np.arange(256)
    mean = float(counts @ values)
    spread = float(np.sqrt(max(0.0, counts @ (values - mean) ** 2)))
    some = counts[counts > 0]
    return f"chunks={n_chunks};mean={mean:.4f};std={spread:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f}"


def _read(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Payloads put together from (media, n_bytes, parts), verified; or their digests."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            rows = []
            for row in batch.slice(at, SLICE_ROWS).to_pylist():
                data = {p["digest"]: p["data"] for p in row["parts"] if p["data"] is not None}
                chunks = [(p["digest"], data[p["digest"]]) for p in sorted(row["parts"], key=lambda p: p["pos"])]
                payload = b"".join(c for _, c in chunks)
                if hashlib.sha256(payload[: row["n_bytes"]]).digest() != row["media"]:
                    raise ValueError(f"medium {row['media'].hex()} does not read back")
                out = {"media": row["media"], "n_bytes": row["n_bytes"]}
                if whole:
                    out["payload"] = payload
                else:
                    form = stored_form(payload, row["n_bytes"], chunks)
                    out |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-PAD:]), "media_bytes": len(form), "media_sha256": hashlib.sha256(form).hexdigest(), "feature": feature(payload, len(chunks))}
                rows.append(out)
            kinds = {"media": pa.binary(), "n_bytes": pa.int64(), "payload": pa.binary()} if whole else {"media": pa.binary(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))


class MediaStore:
    """rows (doc_id, media, n_bytes, digests), packs (media, n_bytes, parts) and chunks (digest, data)."""

    def __init__(self, rows: DataFrame, packs: DataFrame, chunks: DataFrame):
        self.rows, self.packs, self.chunks = rows, packs, chunks

    def _parts(self) -> DataFrame:
        """(media, n_bytes, parts) of every medium that is not in a pack."""
        recipes = self.rows.groupBy("media").agg(F.first("n_bytes").alias("n_bytes"), F.first("digests").alias("digests"))
        shared = stage(recipes.join(self.packs.select("media"), "media", "left_anti"), "media-shared")
        places = shared.select("media", "n_bytes", F.posexplode("digests").alias("pos", "digest"))
        part = F.struct("pos", "digest", "data")
        return places.join(self.chunks, "digest").groupBy("media").agg(F.first("n_bytes").alias("n_bytes"), F.collect_list(part).alias("parts")).select("media", "n_bytes", "parts")

    def _from_both(self, whole: bool, schema: str) -> DataFrame:
        read = lambda df: df.mapInArrow(lambda batches: _read(batches, whole), schema)
        return read(self.packs.select("media", "n_bytes", "parts")).unionByName(read(self._parts()))

    def payloads(self) -> DataFrame:
        """(media, n_bytes, payload), one row a medium."""
        return self._from_both(True, "media binary, n_bytes long, payload binary")

    def digests(self) -> DataFrame:
        """What is computed from each payload as read back, one row a medium."""
        return self._from_both(False, "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store(docs: DataFrame) -> MediaStore:
    """docs (doc_id, text) as recipes, packs and deduplicated chunks in the shared folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("media"), text.alias("text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stage(named.mapInArrow(_recipes, "doc_id long, media binary, n_bytes long, digests array<binary>"), "media-recipes")
    each = rows.select("media", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    hit = stage(each.join(shared, "digest", "left_semi").select("media").distinct(), "media-sharing")
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_MEDIUM * hit.count()).bit_length()))
    place = F.pmod(F.xxhash64("media"), F.lit(size))
    maps = hit.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    by_bucket = {r.k: bytes(r.bits) for r in maps}
    bits = b"".join(by_bucket.get(k, bytes(4096)) for k in range(1, size // 32768 + 1))
    held = docs.sparkSession.sparkContext.broadcast(bits)
    source = named.select("media", "text", place.alias("place"))
    packs = stage(source.mapInArrow(lambda b: _stored(b, held.value, True), "media binary, n_bytes long, parts array<struct<pos: int, digest: binary, data: binary>>"), "media-packs")
    loose = source.mapInArrow(lambda b: _stored(b, held.value, False), "digest binary, data binary")
    chunks = stage(loose.groupBy("digest").agg(F.first("data").alias("data")), "media-chunks")
    return MediaStore(rows, packs, chunks)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store(table(spark, sf_dir, "documents"))
    read = stage(kept.digests().drop("n_bytes"), "media-read")
    return kept.rows.select("doc_id", "media", "n_bytes").join(read, "media").drop("media")
