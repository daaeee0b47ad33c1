"""Written intermediate tables in the folder that the whole cluster shares.

Every operator that reads an intermediate more than once writes it with
:func:`materialise`.  The files live under ``spark.checkpoint.dir``, so a lost
executor costs a re-read and not a re-computation, and no task ever depends on
the disk of another machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a new one on a single machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stored:
    """A written table: ``df`` reads it, ``drop`` deletes the files."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> Stored:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    ``batch_rows`` bounds the Arrow batches of this write, for rows that are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    try:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, batch_rows)
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return Stored(spark, path, df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
