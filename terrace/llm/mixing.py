"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-word blocks.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all
words; no target passes twice its source's words, the excess goes to the others by weight.
A source's documents, in seeded order, form one stream of words cut into blocks of
``block_words``. Seats, one for each block of the mix, go to the highest quotients
target / (2 j - 1), and runs of consecutive seats are the shards; a source with q seats and n
blocks walks its seeded stream of blocks round and round, q blocks in all: its quota of the
first shard, then of the second, and so on. So it takes its whole stream q div n times and the
first q mod n blocks once more, and a document's ``shard`` is the one that takes it first.

Only prefix sums are needed, never one row per block: bucket sums per (source, hash bucket),
a running sum over these, and a window inside each bucket. The hot source is thus spread
over ``BUCKETS`` groups. Everything is built from DataFrame functions.

Null texts have size 0 and take nothing; repeated rows count each; null doc_ids are placed
like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import SPACE, WORD, stage, table

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 16
SHARDS = 40
#: Hash buckets of a source, as hex digits of the seeded hash.
BUCKET_DIGITS = 3
#: Widths of the search for a house's divisor; the last holds any.
WIDTHS = (1, 4, 16, 64, 256, 4096, 1 << 20, 1 << 40)


def targets(sources: DataFrame) -> DataFrame:
    """sources (skey, source_size) with weight and target: water-filling under the cap.

    With sources ordered by cap / weight, the level that holds when all earlier ones are
    capped is greatest at the first uncapped one, so the level is a maximum over rows. The
    table has one row for each source."""
    order = Window.orderBy("skey")
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    pick = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sources.withColumn("weight", pick.cast("long")).withColumn("cap", 2 * F.col("source_size"))
    level = (
        (3 * F.sum("source_size").over(whole) - 2 * F.coalesce(F.sum("cap").over(fill), F.lit(0)))
        / (2 * (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))).cast("double")
    )
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(whole))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
        .select("skey", "source_size", "weight", "target")
    )


def quotas(goals: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(skey, shard, quota): seats by highest quotient, shard s the s-th run of them.

    The seats of the first s shards are an apportionment of their own, and house monotony
    makes their difference the shard's quota. The seats above a quotient are target / divisor,
    rounded; the divisor that fills the house lies between two that are one part in
    ``2 upto / (w k)`` off its plain share, for k sources and a small width w (1, but for places
    that run out: the least of ``WIDTHS`` that holds the house is taken). Only seats between
    these two are compared: w + 3 a source on average, so work grows with the sources."""
    whole = Window.partitionBy()
    n_blocks = F.ceil(F.col("source_size") / F.lit(block_words))
    base = (
        goals.withColumn("k", F.count("*").over(whole))
        .withColumn("words", F.sum("source_size").over(whole))
        .withColumn("seats", F.expr(f"(3 * words + {block_words}) div {2 * block_words}"))
        .withColumn("places", 2 * n_blocks)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("upto", F.expr(f"seats * (shard + 1) div {shards}"))
        .withColumn("share", F.expr("coalesce(try_divide(target * upto, 1.5D * words), 0D)"))
        .withColumn("step", F.expr("coalesce(try_divide(k, 2D * upto), 0D)"))
    )
    at = lambda factor: f"least(places, cast(floor(share * greatest(0D, {factor}) + 0.5D) as bigint))"
    sums = [F.sum(F.expr(at(f"1D {sign} {w} * step"))).alias(f"{n}{w}") for w in WIDTHS for n, sign in (("low", "-"), ("high", "+"))]
    fits = " ".join(f"WHEN low{w} <= upto AND high{w} >= upto THEN {w}" for w in WIDTHS)
    widths = base.groupBy("shard", "upto").agg(*sums).select("shard", F.expr(f"CASE {fits} ELSE {WIDTHS[-1]} END").alias("width"))
    open_ = (
        base.join(widths, "shard")
        .withColumn("sure", F.expr(f"greatest(0, {at('1D - width * step')} - 1)"))
        .withColumn("open", F.expr(f"least(places, {at('1D + width * step')} + 1) - sure"))
    )
    order = Window.partitionBy("shard").orderBy(F.desc("quotient"), "skey")
    left = F.col("upto") - F.col("sure_all")
    won = (
        open_.withColumn("sure_all", F.sum("sure").over(Window.partitionBy("shard")))
        .where("open > 0")
        .withColumn("seat", F.explode(F.expr("sequence(sure + 1, sure + open)")))
        .withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= left)
        .groupBy("skey", "shard").agg(F.count("*").alias("won"))
    )
    step = Window.partitionBy("skey").orderBy("shard")
    upto = open_.join(won, ["skey", "shard"], "left").withColumn("upto_shard", F.col("sure") + F.coalesce("won", F.lit(0)))
    return upto.select("skey", "shard", (F.col("upto_shard") - F.lag("upto_shard", 1, 0).over(step)).alias("quota"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard for every row of docs (doc_id, text,
    source); shard is null where nothing is taken."""
    return _mixed(docs, block_words, shards, seed).drop("skey", "sig")


def _mixed(docs: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    sized = stage(
        docs.select(
            "doc_id",
            _source_key().alias("skey"),
            F.xxhash64("text").alias("sig"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit(""))))))), 1, 16).alias("h"),
        ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)),
        "mix-sizes",
    )
    buckets = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    goals = targets(buckets.groupBy("skey").agg(F.sum("words").alias("source_size")))
    by_shard = quotas(goals, block_words, shards)
    upto = F.sum("quota").over(Window.partitionBy("skey").orderBy("shard"))
    ends = by_shard.select("skey", "shard", "quota", upto.alias("upto")).groupBy("skey").agg(F.sum("quota").alias("quota"), F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("ends"))
    plan = goals.join(ends, "skey").select(
        "skey", "source_size", "target", F.col("ends.upto").alias("ends"),
        F.expr(f"coalesce(try_divide(quota, ceil(source_size / {block_words}D)), 0)").cast("long").alias("whole_passes"),
        F.expr(f"coalesce(try_mod(quota, ceil(source_size / {block_words}D)), 0) * {block_words}").cast("long").alias("more_words"),
    )
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).join(plan, "skey").drop("words")
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["skey", "bucket"])
    taken = placed.withColumn("taken", F.expr("whole_passes * size + greatest(0, least(size, more_words - start - within))"))
    shard = F.expr(f"CASE WHEN taken > 0 THEN size(filter(ends, x -> x <= (start + within) div {block_words})) END")
    return taken.select("skey", "sig", "doc_id", "size", "source_size", "target", "taken", shard.alias("shard"))


def _source_key():
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~"))


def apply_mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mixed corpus, with the columns of docs: a row for each whole pass over a document
    and one with its first words, as they stand in the text, where the last block of the mix
    ends inside it. Rows of the same doc_id, source and text share their largest count.
    Documents without a taken word leave."""
    key = [F.col("doc_id"), _source_key(), F.xxhash64("text")]
    kept = _mixed(docs, block_words, shards, seed).groupBy("doc_id", "skey", "sig").agg(F.max("taken").alias("n"), F.max("size").alias("size")).where("n > 0")
    plan = kept.select(F.struct("doc_id", "skey", "sig").alias("k"), "n", "size")
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.struct(key[0].alias("doc_id"), key[1].alias("skey"), key[2].alias("sig")).alias("k"))
    rows = packed.join(plan, packed.k.eqNullSafe(plan.k)).select("row", "n", "size", F.explode(F.expr("sequence(1L, cast(ceil(n / double(size)) as bigint))")).alias("part"))
    left = F.col("n") - (F.col("part") - 1) * F.col("size")
    text = F.when(left >= F.col("size"), F.col("row.text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({SPACE}*{WORD})")), F.lit(1), F.greatest(left, F.lit(1)).cast("int")), "")
    )
    cut = rows.select("row", text.alias("cut"))
    return cut.select(*[F.col("cut").alias("text") if c == "text" else F.length("cut").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, '~') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))))[:16] AS h
  FROM documents),
src AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
wt AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY skey) - 1) % 3) + 1] AS weight,
       2 * source_size AS cap FROM src),
lv AS (SELECT *, (3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER f, 0))::DOUBLE
       / (2 * (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)))::DOUBLE AS lvl FROM wt
       WINDOW f AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT skey, source_size, least(cap::DOUBLE, weight * max(lvl) OVER ()) AS target,
         ceil(source_size / {BLOCK_WORDS}.0)::BIGINT AS n FROM lv),
seat AS (SELECT skey, target / (2 * j - 1) AS q
         FROM (SELECT skey, target, unnest(range(1, 2 * n + 1)) AS j FROM goal)),
ranked AS (SELECT skey, q, row_number() OVER (ORDER BY q DESC, skey) AS place, (SELECT (3 * sum(source_size) + {BLOCK_WORDS}) // {2 * BLOCK_WORDS} FROM src) AS seats FROM seat),
dealt AS (SELECT skey, row_number() OVER (PARTITION BY skey ORDER BY q DESC) - 1 AS block,
          (SELECT min(s) FROM range(0, {SHARDS}) g(s) WHERE place <= seats * (s + 1) // {SHARDS})::INT AS shard FROM ranked WHERE place <= seats),
won AS (SELECT skey, count(*) AS quota FROM dealt GROUP BY 1),
pos AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM sized),
res AS (SELECT skey, p, doc_id, size, source_size, target,
       CASE WHEN n = 0 THEN 0 ELSE (coalesce(quota, 0) // n) * size
         + greatest(0, least(size, (coalesce(quota, 0) % n) * {BLOCK_WORDS} - p)) END::BIGINT AS taken
FROM pos JOIN goal USING (skey) LEFT JOIN won USING (skey))
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN shard END AS shard
FROM res LEFT JOIN dealt ON dealt.skey = res.skey AND block = p // {BLOCK_WORDS}
"""
