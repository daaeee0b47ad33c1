"""Token counts by a compiled finite-state tokenizer (operator 3).

The vocabulary file is compiled into the machines of :mod:`tessera.llm.bpe`.
A text is read in chunks; each chunk's state map (12 states in, 12 states out)
is computed for all chunks of a slice at once, the maps are composed by a
parallel prefix scan, and every piece then runs through the counting transducer,
whose transitions carry the change in the number of tokens: counts are summed
along the path and no token is ever made.  The state carried between chunks is one
small integer, and a piece needs the states of its last ``lookahead`` bytes only,
so a text of any length is counted in bounded memory.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.bpe import TEXT_BYTES, Vocabulary


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    A null text counts as empty: 0 bytes, 0 tokens.  Ids are passed on as they
    are, nulls and repeats included; other columns are left out; an empty table
    gives an empty result.  ``vocabulary`` is the path of a tokenizer file on the
    driver; its content (under 2 MB) goes to the workers as a broadcast.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        machine = spec.value.tokenizer()
        for part in slices(batches, "text", TEXT_BYTES):
            n = machine.count_batch(part.column("text").to_pylist())
            size = pc.cast(pc.binary_length(part.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = only.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
