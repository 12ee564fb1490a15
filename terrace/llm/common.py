"""Reading, staging and graph components shared by the training-data operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Used only where the session names no folder and runs on one machine, as in tests.
OWN_DIR = "/tmp/checkpoints"
#: Rows of an Arrow batch that a Python operator takes at once.
SLICE_ROWS = 2000
#: Separators of the word definition that the contracts share.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    return named or OWN_DIR


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as written to a table of the shared folder and reread: lineage ends there, and
    what is derived twice from it is computed once. A lost executor costs a rerun of its
    own tasks only. ``drop_staged`` removes these tables once results have been written."""
    path = f"{shared_dir(df.sparkSession)}/terrace-{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_staged: list[str] = []


def drop_staged(spark: SparkSession) -> None:
    """Removes what ``stage`` wrote in this process; what is read from it must be done."""
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the smallest node reached.

    Alternates large-star and small-star steps; each is a minimum per node and a join, so
    no component is ever gathered in one task; a hub's rows are two node ids each, and Spark
    splits such a join key (spark.sql.adaptive.skewJoin). Self-loops and null ends are
    ignored. Nodes without an edge do not appear. The loop ends when all edges are stars: no
    node has two parents, and no parent has one.
    """
    ends = edges.select("a", "b").where("a <> b")
    now = stage(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        kin = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if kin.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


_held: dict = {}


def held(kind: str, key, make):
    """What make() gives, kept by this Python worker for later tasks. A worker keeps the
    state of one operator at a time, since it may run many operators in turn."""
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = make()
    return _held[kind, key]


def release() -> None:
    """Frees what other operators left in this worker; for operators that keep nothing."""
    _held.clear()


def append(df: DataFrame, compute, fields: str, column: str = "text") -> DataFrame:
    """df with the columns of ``fields`` after its own. compute takes a list of values of
    ``column`` and returns one sequence for each field; it runs on Arrow batches in slices
    of bounded size. df's own columns pass through as they are, but for those that have a
    new field's name, which are replaced; ``column`` itself can't be."""
    added = T._parse_datatype_string(fields)
    df = df.drop(*added.names)
    at = df.columns.index(column)

    def run(batches):
        kinds = to_arrow_schema(added)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = compute(part.column(at).to_pylist())
                yield pa.record_batch([*part.columns, *(pa.array(x, f.type) for x, f in zip(found, kinds))], names=[*part.schema.names, *kinds.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))
