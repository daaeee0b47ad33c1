"""Windows over ``events``: in batch with SQL, and as streams that run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import stages as G
from tessera.streaming import windows as W
from tessera.streaming.keyed import keyed_table
from tessera.queries.registry import query


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(t):
    """Hourly windows by type."""
    return W.tumbling(t.events, "1 hour", "event_type")


@query("""SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT value, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE, time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) AS start FROM events) GROUP BY start""")
def sliding(t):
    """Windows of an hour every twenty minutes."""
    return W.sliding(t.events, "60 minutes", "20 minutes")


@query("""
  WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM f)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no""")
def session(t):
    """Sessions of each user with less than thirty minutes between events."""
    return W.sessions(t.events, "30 minutes", "user_id")


def _stream(t):
    rows = t.events
    return W.timed(W.file_stream(t.spark, f"{t.sf_dir}/events.parquet", rows.schema))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_stream(t):
    """The hourly windows as a stream in complete mode."""
    out = W.run_to_end(W.tumbling(_stream(t).withWatermark("ts", "2 days"), "1 hour", "event_type"), "tumbling", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def upsert_stream(t):
    """The newest event of each key, merged batch by batch."""
    return W.upsert_stream(_stream(t).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", "events")


@query("SELECT count(DISTINCT (user_id, event_type, date_trunc('day', ts))) AS n FROM events")
def dedupe_stream(t):
    """One event of each user, type and day, repeats dropped within the watermark."""
    rows = _stream(t).withColumn("day", F.date_trunc("day", "ts")).withWatermark("ts", "2 days").dropDuplicates(["user_id", "event_type", "day"])
    return W.run_to_end(rows.select("user_id", "event_type", "day"), "dedupe").agg(F.count("*").alias("n"))


@query("""
  WITH p AS (SELECT user_id, date_trunc('day', ts) AS day, arg_max(value, event_id) AS bought, max(event_id) AS a FROM events WHERE event_type = 'purchase' GROUP BY ALL),
  c AS (SELECT user_id, date_trunc('day', ts) AS day, arg_max(props, event_id) AS clicked, max(event_id) AS b FROM events WHERE event_type = 'click' GROUP BY ALL)
  SELECT user_id, day, bought, clicked, greatest(coalesce(a, b), coalesce(b, a)) AS event_id FROM p FULL JOIN c USING (user_id, day)""")
def late_enrichment(t):
    """Each user's last purchase of a day, and what was clicked last: the clicks come later, as a stream of their own, and join the rows that are there."""
    rows = _stream(t).withColumn("day", F.date_trunc("day", "ts"))
    kind = rows.select("user_id", "day", F.col("value").alias("bought"), F.col("props").alias("clicked"), "event_id").schema
    table = keyed_table(t.spark, kind, ["user_id", "day"], "event_id", "enriched")
    of = lambda name, bought, clicked: rows.where(F.col("event_type") == name).select("user_id", "day", bought.alias("bought"), clicked.alias("clicked"), "event_id")
    table.follow(of("purchase", F.col("value"), F.lit(None).cast("string")), "purchases")
    table.follow(of("click", F.lit(None).cast("double"), F.col("props")), "clicks")
    return table.rows().withColumn("day", F.col("day").cast("timestamp_ntz"))


_RULES = G.Rules(("purchase", "error"), ("signup",), 12 * 3600, 3600)
_STAGES = """
  WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) AS fresh, event_type = 'signup' AS late, event_type IN ('purchase', 'error') AS ends FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spell FROM e),
  n AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY user_id, spell ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nth,
          max(ts) OVER (PARTITION BY user_id, spell) AS until, max(spell) OVER (PARTITION BY user_id) AS spells, max(ts) OVER () AS newest FROM s),
  o AS (SELECT *, CASE WHEN NOT late OR count(*) FILTER (NOT late) OVER (PARTITION BY user_id, spell, nth ORDER BY ts, event_id) > 0 THEN nth ELSE nth - 1 END AS own FROM n),
  p AS (SELECT *, max(CASE WHEN ends THEN event_id END) OVER q AS end_id, max(CASE WHEN ends THEN event_type END) OVER q AS how, max(event_id) OVER q AS last_id
        FROM o WHERE own >= 0 WINDOW q AS (PARTITION BY user_id, spell, own)),
  v AS (SELECT *, 1 + count(*) FILTER (late AND own < nth) OVER r AS version, min(ts) OVER r AS first, max(ts) OVER r AS last, count(*) FILTER (NOT late) OVER r AS stages, sum(value) OVER r AS total, dense_rank() OVER (PARTITION BY user_id ORDER BY spell, own) AS request
        FROM p WINDOW r AS (PARTITION BY user_id, spell, own ORDER BY ts, event_id))
  SELECT user_id, CAST(request AS INTEGER) AS request, CAST(version AS INTEGER) AS version, first, last, CAST(stages AS INTEGER) AS stages, round(total, 4) AS total, coalesce(how, 'idle') AS ended FROM v
  WHERE (event_id = end_id OR (how IS NULL AND event_id = last_id) OR (late AND own < nth)) AND (how IS NOT NULL OR spell < spells OR newest - until >= INTERVAL 13 HOUR)"""


def _ntz(rows):
    return rows.withColumn("first", F.col("first").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query(_STAGES)
def request_stages(t):
    """Requests in each user's events: ended by a purchase, an error or idle time; sign-ups that come later make further versions."""
    return _ntz(G.staged(W.timed(t.events), "user_id", _RULES))


@query(_STAGES)
def request_stages_stream(t):
    """The same from a stream with keyed state and timers."""
    return _ntz(W.run_to_end(G.staged_stream(_stream(t), "user_id", _RULES), "stages"))


@query("""SELECT event_type AS event, CAST(event_id AS BIGINT) AS event_id, round(value, 6) AS value FROM events""")
def sse_frames(t):
    """Events written as server-sent frames and read back."""
    frames = files.event_frames(t.events, "event_type", "event_id", "value")
    return files.parsed_frames(frames, "event_id long, value double").withColumn("value", F.round("value", 6))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS title, CASE WHEN turn % 3 = 2 THEN role || chr(10) || text ELSE text END AS content FROM conversations""")
def lenient_input(t):
    """Articles given as objects, strings or lists, brought to one shape."""
    shape = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("role").alias("title"), F.col("text").alias("content")))).when(F.col("turn") % 3 == 1, F.to_json(F.array("text"))).otherwise(F.to_json(F.array("role", "text")))
    return files.coerced(t.conversations.select("conv_id", "turn", shape.alias("raw")), "raw").drop("raw")
