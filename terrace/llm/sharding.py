"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts form one atomic group; groups are ordered by the MD5 of their text. The
smallest capacity that lets a greedy walk place every group in ``n_shards`` runs is found by
binary search, then the order is cut there: each cut is put as near as that capacity allows
to an equal share of what is left, so that no shard stays empty beside a full one.

The walk needs prefix sums only. The driver holds sums per digest prefix, a few thousand to
begin with; a prefix whose inside a cut of the last walk depends on is split by one more
grouped scan (two hex digits each), until none is. The result is exact, and what is gathered
is bounded by shards, not by groups.

Law: ``bytes``. A null text counts as the empty one (size 16, crc 0). Repeated rows are
copies like others; a null doc_id is kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import stage, table

SHARDS = 40
ROW_BYTES = 16
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Cells of a shard for the slots: a group of copies is spread over so many.
SUB_CELLS = 64
#: Above every hex digit: the place of a cut with nothing behind it.
END = "~"


class _Line:
    """Ordered blocks (prefix, bytes, groups) as a partly known prefix-sum function."""

    def __init__(self, blocks: dict[str, tuple[int, int]]):
        self.keys = sorted(blocks)
        self.groups = [blocks[k][1] for k in self.keys]
        self.sums = [0, *accumulate(blocks[k][0] for k in self.keys)]
        self.total = self.sums[-1]
        self.unsure: set[str] = set()

    def _inside(self, block: int) -> None:
        if self.groups[block] > 1:
            self.unsure.add(self.keys[block])

    def below(self, x: int) -> int:
        """The last boundary at or before x."""
        i = bisect_right(self.sums, x) - 1
        if self.sums[i] != x and i < len(self.keys):
            self._inside(i)
        return self.sums[i]

    def above(self, x: int) -> int:
        """The first boundary at or after x."""
        i = bisect_left(self.sums, x)
        if i and self.sums[i] != x:
            self._inside(i - 1)
        return self.sums[i]

    def feasible(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            reached = self.below(min(at + capacity, self.total))
            if reached >= self.total:
                return True
            if reached == at:
                return False
            at = reached
        return False

    def cuts(self, capacity: int, shards: int) -> list[int]:
        first = [self.total]  # the earliest start of each last run that still fits
        for _ in range(shards - 1):
            first.append(self.above(max(0, first[-1] - capacity)))
        at, out = 0, []
        for left in range(shards, 1, -1):
            share = at + (self.total - at) // left
            a, b = self.below(share), self.above(share)
            near = a if share - a <= b - share else b
            at = max(first[left - 1], at, min(near, self.below(min(at + capacity, self.total))))
            out.append(at)
        return out

    def prefix(self, at: int) -> str:
        i = bisect_left(self.sums, at)
        while i < len(self.keys) and self.sums[i + 1] == at:  # blocks of size 0
            i += 1
        return self.keys[i] if i < len(self.keys) else END


def partition(groups: DataFrame, n_shards: int = SHARDS) -> tuple[int, list[str]]:
    """The smallest capacity and the n_shards - 1 digests at which later shards start, for
    groups (g: hex digest, bytes: size of the group, over 0)."""

    def sums(rows: DataFrame, digits: int) -> dict[str, tuple[int, int]]:
        key = F.substring("g", 1, digits).alias("k")
        return {r.k: (r.s, r.n) for r in rows.groupBy(key).agg(F.sum("bytes").alias("s"), F.count("*").alias("n")).collect()}

    largest = groups.agg(F.max("bytes")).first()[0]
    if largest is None:
        return 0, [END] * (n_shards - 1)
    blocks = sums(groups, FIRST_DIGITS)
    while True:
        line = _Line(blocks)
        low = max(largest, -(-line.total // n_shards))
        high = -(-line.total // n_shards) + largest
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if line.feasible(mid, n_shards) else (mid + 1, high)
        line.unsure.clear()
        line.feasible(low, n_shards), low > max(largest, -(-line.total // n_shards)) and line.feasible(low - 1, n_shards)
        places = line.cuts(low, n_shards)
        if not line.unsure:
            return low, [line.prefix(at) for at in places]
        for digits in {len(k) for k in line.unsure}:
            some = [k for k in line.unsure if len(k) == digits]
            blocks = {k: v for k, v in blocks.items() if k not in set(some)}
            blocks |= sums(groups.where(F.substring("g", 1, digits).isin(some)), digits + MORE_DIGITS)


def shard(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = stage(
        docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("g")),
        "shard-rows",
    )
    groups = stage(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, starts = partition(groups, n_shards)
    cells = [F.substring("g", 1, 2).alias("b"), F.pmod(F.xxhash64("doc_id"), F.lit(SUB_CELLS)).alias("sub")]
    at = sum((F.col("g") >= s).cast("int") for s in starts) if starts else F.lit(0)
    placed = rows.withColumn("shard", at).select("*", *cells)
    key = ["shard", "b", "sub"]
    before = Window.partitionBy("shard").orderBy("b", "sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key).orderBy("g", "doc_id")
    return (
        placed.withColumn("within", F.row_number().over(inside)).join(bases, key)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order inside each of its files."""
    sharded.repartition(F.col("shard"), (F.col("slot") / 1_000_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
