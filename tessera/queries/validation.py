"""Validators of evaluation sets: a conversation's first question is the kit row, its other turns are the sets made from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import validation as V
from tessera.queries.registry import query

_SETS = """kit AS (SELECT conv_id AS row_id, min(turn) AS turn, arg_min(coalesce(text, ''), turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
  para AS (SELECT c.conv_id || '.' || c.turn AS id, c.conv_id AS row_id, text AS query, role AS register FROM conversations c LEFT JOIN kit ON row_id = conv_id WHERE role <> 'assistant' AND (kit.turn IS NULL OR kit.turn <> c.turn)),
  near AS (SELECT conv_id || '.' || turn AS id, conv_id AS row_id, text AS query, role AS register FROM conversations WHERE role = 'assistant')"""


def _sets(t):
    c = t.conversations
    kit = c.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("kit_turn"), F.min_by(F.coalesce("text", F.lit("")), "turn").alias("query")).withColumnRenamed("conv_id", "row_id")
    made = lambda rows: rows.select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("row_id"), F.col("text").alias("query"), F.col("role").alias("register"))
    others = c.where("role <> 'assistant'").join(kit.select(F.col("row_id").alias("conv_id"), "kit_turn"), "conv_id", "left").where("kit_turn IS NULL OR kit_turn <> turn")
    return kit.select("row_id", "query"), {"paraphrases": made(others), "near_miss": made(c.where("role = 'assistant'"))}


def _set_sql(name: str, table: str, want: int) -> str:
    return f"""SELECT '{name}' AS set_name, 'empty_query' AS "check", 'fail' AS severity, id AS place, '' AS detail FROM {table} WHERE trim(coalesce(query, '')) = '' UNION ALL
  SELECT '{name}', 'unknown_row', 'fail', id, CAST(row_id AS VARCHAR) FROM {table} WHERE row_id NOT IN (SELECT row_id FROM kit) UNION ALL
  SELECT '{name}', 'not_held_out', 'fail', id, '' FROM {table} t JOIN kit USING (row_id) WHERE lower(trim(t.query)) = lower(trim(kit.query)) UNION ALL
  SELECT '{name}', 'repeated_id', 'fail', id, CAST(count(*) AS VARCHAR) FROM {table} GROUP BY id HAVING count(*) > 1 UNION ALL
  SELECT '{name}', 'repeated_query', 'fail', min(id), CAST(count(*) AS VARCHAR) FROM {table} WHERE query IS NOT NULL GROUP BY lower(trim(query)) HAVING count(*) > 1 UNION ALL
  SELECT '{name}', 'row_count', 'fail', CAST(row_id AS VARCHAR), CAST(count(id) AS VARCHAR) FROM kit LEFT JOIN {table} USING (row_id) GROUP BY row_id HAVING count(id) <> {want}"""


@query(f"""WITH {_SETS} {_set_sql("paraphrases", "para", 2)} UNION ALL {_set_sql("near_miss", "near", 2)} UNION ALL
  SELECT 'paraphrases', 'unknown_register', 'fail', id, register FROM para WHERE register NOT IN ('tool', 'user') UNION ALL
  SELECT 'paraphrases', 'missing_register', 'warn', CAST(row_id AS VARCHAR), CASE WHEN bool_or(register = 'user') THEN 'tool' WHEN bool_or(register = 'tool') THEN 'user' ELSE 'tool,user' END
    FROM para SEMI JOIN kit USING (row_id) GROUP BY row_id HAVING NOT (bool_or(register = 'user') AND bool_or(register = 'tool'))""")
def set_findings(t):
    """Every problem of the two sets: empty, unknown, repeated and not held-out queries, counts, registers."""
    kit, sets = _sets(t)
    return V.validate(sets, kit, {"paraphrases": 2, "near_miss": 2}, {"paraphrases": ["tool", "user"]})


@query(f"""WITH {_SETS}, a AS (SELECT 'paraphrases' AS set_name, * FROM para UNION ALL SELECT 'near_miss', * FROM near),
  w AS (SELECT set_name, row_id, list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+')) AS w FROM a), k AS (SELECT row_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS k FROM kit),
  m AS (SELECT set_name, count(*) AS n, round(avg(CASE WHEN k IS NULL OR len(list_distinct(w || k)) = 0 THEN 0.0 ELSE CAST(len(list_intersect(w, k)) AS DOUBLE) / len(list_distinct(w || k)) END), 6) AS overlap FROM w LEFT JOIN k USING (row_id) GROUP BY set_name)
  SELECT *, (SELECT overlap FROM m WHERE set_name = 'near_miss') > (SELECT overlap FROM m WHERE set_name = 'paraphrases') AS trap FROM m""")
def set_closeness(t):
    """How close either set's queries are to their kit row's, and whether the near misses are the closer ones."""
    kit, sets = _sets(t)
    return V.closeness(sets, kit, lambda c: F.array_distinct(T.words(c)), "paraphrases", "near_miss")
