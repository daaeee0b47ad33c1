"""Sources and sinks: JSON, JSON lines, text, Parquet, schema evolution, partial rewrites."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset, a new local one, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: for what a plan reads more than once."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bucketed(rows: DataFrame, name: str, key: str, *order: str) -> DataFrame:
    """The rows as a table in buckets of ``key``, sorted inside each: joins and groups by the key need no shuffle of it."""
    spark = rows.sparkSession
    path, n = shared_folder(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rpartition("/")[2].replace("-", "_")
    rows.repartition(n, key).write.bucketBy(n, key).sortBy(*order).option("path", path).saveAsTable(table)
    return spark.table(table)


def json_documents(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The elements of an array at ``field`` of each JSON file."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("row")).select("row.*")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def ranked_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, rank``: a word list from the most frequent word on, plain or gzip; a word that comes again keeps its first rank (from 0)."""
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return spark.read.text(path, wholetext=True).select(F.posexplode(words).alias("rank", "word")).where("word <> ''").groupBy("word").agg(F.min("rank").alias("rank"))


def markdown_row(lines: DataFrame, label: str) -> DataFrame:
    """``cells`` of the table rows whose first cell starts with ``label``."""
    cells = F.transform(F.split(F.trim("line"), r"\|"), lambda c: F.trim(c))
    inner = F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0)))
    return lines.where(F.col("line").startswith("|")).select(inner.alias("cells")).where(F.element_at("cells", 1).startswith(label))


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under one schema; a column that one of them lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True)


def coerced(rows: DataFrame, column: str) -> DataFrame:
    """``title, content`` from a column of JSON that holds a string, an object, a list or null."""
    v = F.try_parse_json(column)
    whole = F.try_variant_get(v, "$", "string")
    listed = F.array_join(F.try_variant_get(v, "$", "array<string>"), "\n")
    title, content = F.try_variant_get(v, "$.title", "string"), F.try_variant_get(v, "$.content", "string")
    kind = F.schema_of_variant(v)
    return rows.select(
        "*", F.coalesce(title, F.lit("")).alias("title"),
        F.when(kind == "STRING", whole).when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), F.coalesce(content, F.lit(""))).otherwise(F.lit("")).alias("content"),
    )


def rewrite(path: str, rows: DataFrame, key: str, out: str) -> None:
    """Write JSON lines again with the rows of ``rows`` in place of those with the same key."""
    old = rows.sparkSession.read.schema(rows.schema).json(path)
    old.join(rows.select(key), key, "left_anti").unionByName(rows).orderBy(key).write.mode("overwrite").json(out)


def event_frames(events: DataFrame, name: str, *columns: str) -> DataFrame:
    """``frame``: rows as server-sent events."""
    return events.select(F.concat(F.lit("event: "), F.col(name), F.lit("\ndata: "), F.to_json(F.struct(*columns)), F.lit("\n\n")).alias("frame"))


def parsed_frames(frames: DataFrame, schema: str) -> DataFrame:
    """``event`` and the fields of its data from frames."""
    line = lambda start: F.element_at(F.filter(F.split("frame", "\n"), lambda x: x.startswith(start)), 1)
    data = F.from_json(F.substr(line("data: "), F.lit(7)), schema)
    return frames.select(F.substr(line("event: "), F.lit(8)).alias("event"), data.alias("d")).select("event", "d.*")


def cached_entries(spark: SparkSession, path: str, plan: str, texts: str = "array<string>") -> DataFrame:
    """The answer cache from a Parquet table: ``plan`` and ``query_texts`` are JSON columns and are parsed.

    A plan that doesn't parse is null; a missing ``hits`` column counts as 0.
    """
    rows = spark.read.parquet(path)
    hits = F.coalesce(F.col("hits"), F.lit(0)) if "hits" in rows.columns else F.lit(0)
    return rows.withColumn("plan", F.from_json("plan", plan)).withColumn("query_texts", F.from_json("query_texts", texts)).withColumn("hits", hits.cast("long"))


def truncate(spark: SparkSession, path: str) -> None:
    """Leave a Parquet table with its columns and no rows."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def vector_snapshot(vectors: DataFrame, path: str, key: str, vector: str) -> None:
    """Ids and vectors as a Parquet table, in place of an older one."""
    vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def graph_snapshot(nodes: DataFrame, extras: DataFrame, path: str) -> None:
    """Nodes and their further entries as two nested Parquet tables beside each other."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    extras.write.mode("overwrite").parquet(f"{path}/extras")


def log_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """``line``: one compact JSON object for each row; nulls are left out."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("line"))


def markdown_table(rows: DataFrame, order: list[str], digits: int = 2) -> DataFrame:
    """``line``: a small table as markdown, its header and rule first; numbers with a fraction are rounded."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.coalesce((F.round(c, digits) if kinds[c] in ("double", "float") else F.col(c)).cast("string"), F.lit("-"))
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    n = F.row_number().over(Window.orderBy(*order))  # of a report, not of data
    body = rows.select((n + 1).alias("no"), bar([cell(c) for c in rows.columns]).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))], "no int, line string")
    return head.unionByName(body)
