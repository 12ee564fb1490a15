"""A training corpus in five stages: language ID, SimHash near-dedup, secret scans, mixing
and SentencePiece. Each stage takes (spark, docs, sf_dir), docs with the columns of
documents, and all but the last return those columns.

Nulls: a null text has no language and leaves in the first stage; a null doc_id can't be
named in a group and stays; a null source is a source of its own. Repeated rows of a doc_id
become one in the second stage. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm import language, mixing, pieces, secrets, simhash
from terrace.llm.common import stage, table

#: No SQL: the stages hash shingles, train networks and walk automata.
ORACLE_SQL = None


def _as(docs: DataFrame, text) -> list:
    """docs' columns with another text and its length."""
    return [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is found; a missing lang is filled in."""
    learned = language.learn(docs.where(~language.held_out()))
    found = language.identify(docs, learned, "_lang string, _score double").where(F.col("_lang") != language.UNKNOWN)
    return found.select(*[F.coalesce("lang", "_lang").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group. Where rows repeat a doc_id, one
    that is in that group stays, the same in every run."""
    groups = simhash.near_duplicates(docs).where(F.col("doc_id") == F.col("component_id"))
    kept = groups.groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("row.source", "row.lang"))
    named = rows.where("doc_id is not null").join(kept, ["doc_id", "text_hash"], "left_semi").withColumn("place", place).where("place = 1")
    return named.select("row.*").unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each found span of its text replaced."""
    hide = lambda texts, found: [[secrets.redacted(t, s) for t, s in zip(texts, found)]]
    return secrets.scan(docs, secrets.train(docs), hide, "_clean string").select(*_as(docs, F.col("_clean")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, cut where its last block ends."""
    return mixing.apply_mix(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids (little-endian 32-bit integers) of every row."""
    return pieces.encode(docs).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", keep_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
