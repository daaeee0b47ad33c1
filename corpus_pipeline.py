"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it again for the next one.
Stages set the session's Arrow batch size, see ``TEXTS_AT_ONCE``.
All stages but the last keep the columns of ``documents``, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, decontamination, jaccard_join, pii, toxicity
from tessera.llm.queries import vocabulary
from tessera.llm.removal import without
from tessera.llm.storage import BATCH_ROWS, materialise, table


#: Rows of an Arrow batch while the stages run: with 10,000, as Spark has it, a batch of long texts is too much memory.
TEXTS_AT_ONCE = 1024


def _bounded(spark: SparkSession) -> None:
    spark.conf.set(BATCH_ROWS, TEXTS_AT_ONCE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below 0.7; nulls and empty texts are scored like any other, long ones as a whole."""
    _bounded(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least ``doc_id``.

    Of several rows that bear this id one stays.  Texts without words, and rows
    with a null id, all stay.
    """
    _bounded(spark)
    groups = materialise(jaccard_join.classes_of(docs).where("doc_id IS NOT NULL AND n_shingles > 0"), "groups").df
    ids = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("rows"))
    kept = without(docs, F.col("doc_id"), ids.where(~F.col("first")).select(F.col("doc_id").alias("key")))
    repeated = ids.where(F.col("first") & (F.col("rows") > 1)).select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return without(kept, F.col("doc_id"), repeated.select(F.col("doc_id").alias("key"))).unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark; rows with a null id are judged by their text alike, rows without text stay."""
    _bounded(spark)
    row = F.xxhash64("doc_id", "text")
    leaks = decontamination.find_leaks(docs.withColumn("doc_id", row), table(spark, sf_dir, "benchmark"))
    return without(docs, row, leaks.select(F.col("doc_id").alias("key")))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the texts replaced by its kind; null texts stay null."""
    _bounded(spark)
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; a null text counts as empty."""
    _bounded(spark)
    return bpe_codec.round_trip(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("private_data", mask_private),
    ("bpe", encode),
]

#: No stage but the masking could be put in SQL, so the pipeline is tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        after = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return docs
