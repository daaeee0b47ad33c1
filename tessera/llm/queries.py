"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe_codec import round_trip
from tessera.llm.decontamination import find_leaks
from tessera.llm.filter_audit import audit
from tessera.llm.hamming_search import search, sign_code
from tessera.llm.jaccard_join import classes_of
from tessera.llm.lm_scoring import score as lm_score
from tessera.llm.pii import digest, find
from tessera.llm.ranked_search import search as ranked_search
from tessera.llm.secret_scan import digest as secret_digest
from tessera.llm.secret_scan import find as find_secrets
from tessera.llm.sharding import shard_by_bytes
from tessera.llm.storage import table
from tessera.llm.token_counts import count_tokens
from tessera.llm.toxicity import fit, score
from tessera.llm.url_filter import LISTED, filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "neighbours")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(table(spark, sf_dir, "documents"))


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return search(codes, codes.where(F.col("vec_id") % 100 == 0), bits=vectors.agg(F.max(F.size("embedding"))).first()[0])


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(table(spark, sf_dir, "documents")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_hamming_search": op8_hamming_search,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_url_filter": op10_url_filter,
    "op11_secret_scan": op11_secret_scan,
    "op12_ranked_search": op12_ranked_search,
    "op13_filter_audit": op13_filter_audit,
}

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

ORACLE_SQL: dict[str, str] = {
    "op8_hamming_search": """
        WITH d AS (
          SELECT a.vec_id AS query_id, b.vec_id,
                 CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
          FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10""",
    "op10_url_filter": rf"""
        WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        k AS (
          SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^(www|m|blog)\.', '') AS bare,
                 regexp_replace(path, '(\.html?)?/*$', '') AS page
          FROM p
        ),
        r AS (
          SELECT *,
            CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
            bare || '/' IN ({", ".join(f"'{x}'" for x in LISTED)})
              OR bare || CASE WHEN page = '' THEN '/' ELSE page END IN ({", ".join(f"'{x}'" for x in LISTED)}) AS listed
          FROM k
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
               listed
        FROM r""",
    "op12_ranked_search": r"""
        WITH t AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents
        ),
        s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM t WHERE len(terms) > 0),
        p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM t),
        f AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM d, s),
        q AS (
          SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark
        ),
        a AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        r AS (
          SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
          FROM a JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
        ),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
        SELECT * FROM k WHERE rank <= 20""",
    "op13_filter_audit": r"""
        WITH w AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                  'D': regexp_matches(t, '[#$%&*|]'), 'E': w.doc_id > min(w.doc_id) OVER (PARTITION BY t)} AS bad
          FROM w LEFT JOIN l ON w.doc_id = l.doc_id
        ),
        f AS (
          SELECT part, good, toxic, (CASE WHEN bad.A THEN 'A' ELSE '' END) || (CASE WHEN bad.B THEN 'B' ELSE '' END) || (CASE WHEN bad.C THEN 'C' ELSE '' END)
                 || (CASE WHEN bad.D THEN 'D' ELSE '' END) || (CASE WHEN bad.E THEN 'E' ELSE '' END) AS fails FROM m
        ),
        h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails),
        o AS (
          SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
          FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(l),
               (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(l)
          WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
        ),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) r(step)),
        j AS (SELECT part, filter_order, step, own, fails, n, g, x, contains(fails, own) AS hit, fails <> '' AND earlier <> '' AND regexp_matches(earlier, '[' || CASE WHEN fails = '' THEN '-' ELSE fails END || ']') AS gone FROM h, s),
        c AS (
          SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
                 CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
                 CAST(coalesce(sum(g) FILTER (NOT gone AND hit), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (NOT gone AND hit), 0) AS BIGINT) AS toxic_lost
          FROM j GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
