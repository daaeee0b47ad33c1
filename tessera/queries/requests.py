"""Request metrics over ``events``: event_type is the tier, value the latency, user_id the key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import requests as Q
from tessera.queries.registry import query

_HIT = "event_type IN ('click', 'view')"


def hit():
    return F.col("event_type").isin("click", "view")


@query("""SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def latency_percentiles(t):
    """Nearest-rank percentiles of each tier."""
    p = lambda f: F.round(F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY value)"), 6)
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""SELECT user_id, count(*) AS n, round(avg(CASE WHEN {_HIT} THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(quantile_disc(value, 0.95) FILTER (WHERE {_HIT}), 6) AS p95_hit,
  round(quantile_disc(value, 0.95) FILTER (WHERE NOT ({_HIT})), 6) AS p95_cold, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS cost, count(*) FILTER (WHERE event_type = 'error') AS fallbacks, count(*) >= 30 AS enough FROM events GROUP BY user_id""")
def metrics_snapshot(t):
    """Counts, hit rate, percentiles of hits and misses, cost and fallbacks of each user."""
    p95 = lambda c: F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE {c})"), 6)
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg(hit().cast("double")), 6).alias("hit_rate"), p95(_HIT).alias("p95_hit"), p95(f"NOT ({_HIT})").alias("p95_cold"),
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("cost"), F.count_if(F.col("event_type") == "error").alias("fallbacks"), (F.count("*") >= 30).alias("enough"),
    )


@query(f"""SELECT event_id, count(*) OVER w AS n, round(avg(CASE WHEN {_HIT} THEN 1.0 ELSE 0 END) OVER w, 6) AS hit_rate, round(avg(value) OVER w, 6) AS mean
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_metrics(t):
    """Rolling counts and means over each user's last hundred requests."""
    return Q.rolling(t.events, ["user_id"], ["ts", "event_id"], "value", hit(), 100).select("event_id", "n", "hit_rate", "mean")


@query("""WITH s AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id)
  SELECT user_id, round(v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INTEGER) + 1], 1) AS p50, round(v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1], 1) AS p95 FROM s""")
def rolling_percentiles(t):
    """Percentiles by the index that rounds halves to even, over each user's last thousand requests."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = t.events.withColumn("rn", F.row_number().over(w)).where("rn <= 1000")
    v = kept.groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return v.select("user_id", Q.rolling_percentile(F.col("v"), 0.5).alias("p50"), Q.rolling_percentile(F.col("v"), 0.95).alias("p95"))


@query("""SELECT event_id, count(*) OVER w AS requests, CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT) AS tokens_used, count(*) OVER w >= 3 AS refused
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW)""")
def request_ledger_60s(t):
    """Requests and tokens of each user in the last 60 seconds (less than, strictly), and admission."""
    rows = t.events.withColumn("tokens", F.floor("value").cast("long"))
    return Q.ledger(rows, "user_id", 60, "tokens").select("event_id", "requests", "tokens_used", (F.col("requests") >= 3).alias("refused"))


@query("""
  WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN ts + to_seconds(CAST(least(greatest(floor(value), 20), 60) AS INTEGER)) END AS until FROM events),
  c AS (SELECT *, last_value(until IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cool FROM e)
  SELECT event_id, coalesce(ts < cool, false) AS cooling FROM c""")
def cooldown_replay(t):
    """Whether a request falls into the pause that the user's last error began (20 to 60 seconds)."""
    until = F.when(F.col("event_type") == "error", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.least(F.greatest(F.floor("value"), F.lit(20)), F.lit(60)) * 1_000_000))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t.events.withColumn("until", until)
    return e.withColumn("cool", F.last("until", ignorenulls=True).over(w)).select("event_id", F.coalesce(F.col("ts").cast("timestamp") < F.col("cool"), F.lit(False)).alias("cooling"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, NOT (event_type = 'error' AND epoch(now) - epoch(ts) > 864000) AS usable FROM events, m""")
def ttl_filter(t):
    """Degraded entries older than ten days (strictly) are not usable; others are."""
    now = t.events.agg(F.max("ts").alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.crossJoin(F.broadcast(now)).select("event_id", (~((F.col("event_type") == "error") & (age > 864_000_000_000))).alias("usable"))


@query("""SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, user_id LIMIT 50""")
def lru_keep(t):
    """The fifty users that a memory of fifty keeps."""
    return Q.kept_in_memory(t.events, "user_id", "ts", 50)


@query("""
  WITH c AS (SELECT epoch_us(ts) AS moment, 1 AS d FROM events UNION ALL SELECT epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT), -1 FROM events),
  g AS (SELECT moment, sum(d) AS d FROM c GROUP BY moment), r AS (SELECT moment, sum(d) OVER (ORDER BY moment) AS running FROM g)
  SELECT CAST(running AS BIGINT) AS running, count(*) AS times FROM r GROUP BY running""")
def concurrency_replay(t):
    """How often so many requests were open at once, if value is seconds."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    r = Q.concurrency(t.events, start, start + F.floor(F.col("value") * 1_000_000).cast("long"))
    return r.groupBy("running").agg(F.count("*").alias("times"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn, round(sum(value) OVER (PARTITION BY user_id ORDER BY rn), 4) AS total FROM r WHERE rn <= 10""")
def recent_traces(t):
    """The ten newest events of each user and their running sum."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = t.events.withColumn("rn", F.row_number().over(w)).where("rn <= 10")
    return top.select("user_id", "event_id", "rn", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("rn")), 4).alias("total"))


@query("""SELECT event_type, count(*) AS n, round(sum(value * p_in + CAST(json_extract(props, '$.k') AS DOUBLE) * p_out) / 1e6, 6) AS cost
  FROM (SELECT e.*, coalesce(p_in, 0) AS p_in, coalesce(p_out, 0) AS p_out FROM events e LEFT JOIN (VALUES ('click', 0.4, 2.0), ('purchase', 3.0, 15.0)) p(m, p_in, p_out) ON m = event_type) GROUP BY event_type""")
def token_cost(t):
    """Cost by a broadcast price list; types without a price cost nothing."""
    prices = F.broadcast(t.events.sparkSession.createDataFrame([("click", 0.4, 2.0), ("purchase", 3.0, 15.0)], "event_type string, p_in double, p_out double"))
    cost = F.col("value") * F.coalesce("p_in", F.lit(0.0)) + F.get_json_object("props", "$.k").cast("double") * F.coalesce("p_out", F.lit(0.0))
    return t.events.join(prices, "event_type", "left").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(cost) / 1e6, 6).alias("cost"))


@query("""
  WITH r AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
  SELECT user_id, count(before) AS n, count(*) FILTER (WHERE abs(value - before) > 50) AS changed FROM r GROUP BY user_id""")
def repeat_check(t):
    """Repeats of a request whose answer changed."""
    before = F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    r = t.events.select("user_id", "value", before.alias("before"))
    return r.groupBy("user_id").agg(F.count("before").alias("n"), F.count_if(F.abs(F.col("value") - F.col("before")) > 50).alias("changed"))
