"""BPE encoding and decoding of whole texts (operator 4).

Encoding streams each text through the machines of :mod:`tessera.llm.bpe`: the
sufficient lookahead is the longest token of the merge list, a piece that it
covers is merged at its end, and a longer one emits its tokens as soon as no
continuation can change them.  Decoding is an incremental byte-to-text machine
that keeps at most the three bytes of an unfinished character.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.bpe import TEXT_BYTES, Vocabulary


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens``: the ids of every text as binary, unsigned 32-bit little-endian.

    A null or empty text has no ids.  Ids of rows are passed on as they are,
    nulls and repeats included; an empty table gives an empty result.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        machine = spec.value.tokenizer()
        for part in slices(batches, "text", TEXT_BYTES):
            ids = machine.encode_batch(part.column("text").to_pylist())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), n], ["doc_id", "ids", "n_tokens"])

    return only.mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, decoded``: the text of every row's ``ids`` (null ids: an empty text)."""
    with open(vocabulary, "rb") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))
    only = encoded.select("doc_id", F.coalesce(F.col("ids"), F.lit(b"")).alias("ids"))

    def run(batches):
        machine = spec.value.tokenizer()
        for part in slices(batches, "ids"):
            texts = [machine.decode(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return only.mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and digest both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Both directions run in one pass, so that ids don't travel between processes.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        machine = spec.value.tokenizer()
        for part in slices(batches, "text", TEXT_BYTES):
            ids = machine.encode_batch(part.column("text").to_pylist())
            rows = [
                part.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(machine.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
