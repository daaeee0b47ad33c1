"""What Python workers keep from one stage to the next."""

from __future__ import annotations

import pyarrow as pa

from tessera.llm import bpe, bpe_codec, token_counts, toxicity
from tessera.llm.queries import vocabulary


def _held(spark, kind: str) -> int:
    """The most objects of a class of ``tessera.llm.bpe`` that a worker of a later job still has."""

    def count(batches):
        import gc

        for _ in batches:
            pass
        found = getattr(bpe, kind)
        yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, found) for x in gc.get_objects())], pa.int64())], ["n"])

    return max(r.n for r in spark.range(0, 64, 1, 8).mapInArrow(count, "n long").collect())


def test_no_tokenizer_stays_in_a_worker(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(64)], "doc_id long, text string").repartition(8)
    assert bpe_codec.round_trip(docs, vocabulary()).count() == 64
    assert token_counts.count_tokens(docs, vocabulary()).where("n_tokens > 0").count() == 64
    assert _held(spark, "Tokenizer") == 0


def test_remembered_scores_need_few_bytes():
    model = toxicity.Model(["aa", "bb"], [1.0, 2.0], [((0, 1),), ((1, 1),)], [1.0, 0.0], [0.0, 1.0], 0.5, 0.5)
    for text in ("aa cc", "bb", "aa aa bb", ""):
        assert model.score(text) == model.score(text)
    assert len(model._known) == 3 and all(isinstance(k, bytes) for k in model._known)
    assert model.score("aa")[0] > model.score("bb")[0]
