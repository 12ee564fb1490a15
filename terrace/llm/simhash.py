"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most ``max_bits`` = 2 bits differ in at most 2 of
their 8 bytes, so they share at least 6 positional bytes, and of the four byte pairs at
least 2 whole pairs. The lists of single positional bytes are too long to pair up (1 of 256
fingerprints each at best), so the index is kept inside 6 frames: two of the four byte pairs,
with their values. Every pair that reaches the minimum meets in a frame, and what
meets there shares its 4 bytes. Inside a frame each fingerprint is listed under each of its 4
other positional bytes; pairs that meet in a list are tallied, those with fewer than 2 (with
the frame's, 6) go, and the bit distance of the rest is verified.

A frame with more than ``max_posting`` fingerprints isn't expanded into pairs. Its members
agree in 4 bytes, so linked ones differ in 2 of 32 bits at most and share a middle point at
one bit from each (or one is the other's): joining every member to its 33 middle points
keeps exactly the same components with a number of edges that grows with the members.

Equal fingerprints are one node. Components come from ``common.components``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import components, release, stage, table

MAX_BITS = 2
MIN_SHARED_BYTES = 8 - MAX_BITS
MAX_POSTING = 32
SHINGLE_WORDS = 3
SEED = 42
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_PLAIN_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The 6 frames: shifts of two byte pairs.
_KEYS = list(combinations((0, 16, 32, 48), 2))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is set if it is in over half the shingle hashes; no word: 0."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN_LOWER))
    if not words:
        return 0
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[shingle_words - 1 :].tolist() if len(words) >= shingle_words else [len(flat)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "sig"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, sig): fp is the fingerprint as a signed long, sig a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sig")).mapInArrow(_fingerprints, "doc_id long, fp long, sig long")


def _key(a: int, b: int):
    half = lambda s: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))
    return F.struct(F.lit(a * 64 + b).alias("place"), half(a).cast("int").alias("x"), half(b).cast("int").alias("y"))


#: Shifts of the 4 bytes outside each frame.
_OTHERS = ", ".join(f"{a * 64 + b}, array({', '.join(str(s) for s in range(0, 64, 8) if s - s % 16 not in (a, b))})" for a, b in _KEYS)


def tallied(framed: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs of framed (fp, place, x, y) that share a frame and at least
    ``MIN_SHARED_BYTES`` positional bytes, by counting the lists in which they meet."""
    frame = ["place", "x", "y"]
    listed = framed.select("fp", *frame, F.explode(F.expr(f"transform(element_at(map({_OTHERS}), place), s -> struct(s AS pos, shiftrightunsigned(fp, s) & 255 AS byte))")).alias("e")).select("fp", *frame, "e.pos", "e.byte")
    left, right = listed.withColumnRenamed("fp", "a"), listed.withColumnRenamed("fp", "b")
    met = left.join(right, [*frame, "pos", "byte"]).where("a < b")
    return met.groupBy("place", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SHARED_BYTES - 4).select("a", "b").distinct()


def links(fps: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprints within 2 bits. fps: (fp),
    distinct. Ends may be middle points that no document has."""
    postings = fps.select("fp", F.explode(F.array(*[_key(a, b) for a, b in _KEYS])).alias("k")).select("fp", "k.*")
    sizes = postings.groupBy("place", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    filled = stage(postings.join(sizes, ["place", "x", "y"]), "simhash-postings")
    small = filled.where(F.col("n") <= max_posting)
    pairs = tallied(small).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    # bits outside the two byte pairs of the key, as single-bit masks
    free = F.create_map(*[x for a, b in _KEYS for x in (F.lit(a * 64 + b), F.array(*[F.lit(_signed(1 << (s + i))) for s in (0, 16, 32, 48) if s not in (a, b) for i in range(16)]))])
    large = filled.where(F.col("n") > max_posting)
    middle = large.select(F.col("fp").alias("a"), F.explode(F.element_at(free, F.col("place"))).alias("bit")).select("a", F.col("a").bitwiseXOR(F.col("bit")).alias("b"))
    # a middle point that one fingerprint reaches joins nothing, unless it is one itself
    middle = middle.distinct()
    met = middle.groupBy("b").agg(F.count("*").alias("n"))
    real = fps.select(F.col("fp").alias("b"), F.lit(1).alias("one"))
    useful = met.join(real, "b", "left").where("n > 1 or one = 1").select("b")
    return pairs.unionByName(middle.join(useful, "b").select("a", "b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and text_hash (xxhash64) for every
    row of docs.

    Nulls count as empty texts, and texts without a word share fingerprint 0. Null doc_ids
    stay as rows but never name a component (null if a component has no other). Repeated
    rows fall together. An empty table gives an empty result; other columns are ignored."""
    marked = stage(fingerprints(docs), "simhash-fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = links(nodes.select("fp"), max_posting)
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = stage(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("sig").alias("text_hash"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
