"""Event-time windows, batch and streaming, with the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.files import shared_folder
from tessera.streaming.keyed import keyed_table


def timed(events: DataFrame) -> DataFrame:
    """``ts`` as a timestamp with a zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def file_stream(spark, path: str, schema: StructType, files: int = 4) -> DataFrame:
    """A stream over a Parquet table, a single file or a folder of parts, ``files`` of them at a time."""
    name = path.rstrip("/").rpartition("/")[2]
    first = spark.read.schema(schema).parquet(path).select("_metadata.file_name").first()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if first is not None and first.file_name == name:  # a stream reads folders: this one's other files are left out
        return reader.option("pathGlobFilter", name).parquet(path.rstrip("/").rpartition("/")[0])
    return reader.parquet(path)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into Parquet in the shared folder, and read the result.

    ``complete`` and ``update`` results are kept by batch, the last of which holds.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, f"stream-{name}")
    at = shared_folder(spark, f"stream-{name}-state")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    else:
        put = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        stream.writeStream.foreachBatch(put).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upsert_stream(stream: DataFrame, keys: list[str], order: str, name: str, at: str | None = None) -> DataFrame:
    """The newest row of each key, merged batch by batch into a keyed table.

    Late rows lose against newer ones.  A batch writes its own rows, in the buckets of
    its keys; one that is run again writes nothing.  ``at`` is the folder of table
    and checkpoint: with the same one, a later call goes on where the one before stopped.
    """
    table = keyed_table(stream.sparkSession, stream.schema, keys, order, f"upsert-{name}", at, whole=True)
    table.follow(stream)
    return table.rows()
