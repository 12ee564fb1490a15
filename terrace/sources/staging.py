"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
OWN_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    return named or OWN_DIR


class Staged:
    """df as a written table: lineage ends there, and a lost executor costs its own tasks only.
    ``drop`` removes the files once nothing reads them any more, ``drop_all`` those of all
    tables of this process."""

    made: list[Staged] = []

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, f"{shared_dir(df.sparkSession)}/terrace-{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)
        Staged.made.append(self)

    def drop(self) -> None:
        Staged.made.remove(self)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_all() -> None:
    """Removes every table that is still staged; results that read them must be written."""
    for held in [*Staged.made]:
        held.drop()
