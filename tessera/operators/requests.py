"""Request logs: percentiles, rolling windows, ledgers, expiry and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import running


def rolling_percentile(sorted_values: Column, f: float) -> Column:
    """The value at index round(f * (n - 1)), halves to even, of a sorted array."""
    at = F.bround(F.lit(f) * (F.size(sorted_values) - 1), 0).cast("int")
    return F.round(F.element_at(sorted_values, at + 1), 1)


def rolling(rows: DataFrame, keys: list[str], order: list[str], value: str, hit: Column, last: int) -> DataFrame:
    """The rows with ``n, hit_rate, mean`` over the last ``last`` rows of each key, this one included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), 0)
    return rows.select("*", F.count("*").over(w).alias("n"), F.round(F.avg(hit.cast("double")).over(w), 6).alias("hit_rate"), F.round(F.avg(value).over(w), 6).alias("mean"))


def ledger(rows: DataFrame, key: str, seconds: int, tokens: str) -> DataFrame:
    """The rows with the ``requests`` and ``tokens_used`` of their key in the last ``seconds`` (strictly less), this row included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("micros").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    timed = rows.withColumn("micros", micros)
    return timed.select("*", F.count("*").over(w).alias("requests"), F.sum(tokens).over(w).alias("tokens_used")).drop("micros")


def kept_in_memory(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """``key, last_seen``: the ``most`` keys that were used last, as an LRU memory keeps them."""
    seen = rows.groupBy(key).agg(F.max(order).alias("last_seen"))
    return seen.orderBy(F.desc("last_seen"), key).limit(most)


def concurrency(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """``at, running``: how many intervals are open after each change; ends count before starts at one time.

    Changes are summed by time, and the running sum goes range by range.
    """
    change = rows.select(F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))).alias("c")).groupBy("c.at").agg(F.sum("c.d").alias("d"))
    return running(change, "at", F.col("d"), "running").select("at", "running")


def admission(rows: DataFrame, requests: Column, tokens: Column, most_requests: int, most_tokens: int, left: Column) -> DataFrame:
    """The rows with ``refused_by``: the first limit that a request runs into (null: none).

    ``requests, tokens``: used in the last minute, this request included;
    ``left``: what the provider's newest header says is left (null: unknown).
    """
    why = F.when(requests > most_requests, "requests").when(tokens > most_tokens, "tokens").when(left <= 0, "header")
    return rows.withColumn("refused_by", why)


def quota_status(rows: DataFrame, key: str, now: Column, seconds: int = 60) -> DataFrame:
    """``key, requests, tokens, cooling`` at ``now``: used in the last ``seconds`` (strictly), and whether a pause is on.

    ``rows``: key, ts, tokens, until (end of a pause, or null).
    """
    age = F.unix_micros(now) - F.unix_micros(F.col("ts"))
    recent = (age >= 0) & (age < seconds * 1_000_000)
    return rows.groupBy(key).agg(F.count_if(recent).alias("requests"), F.coalesce(F.sum(F.when(recent, F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.max("until") > F.max(now), F.lit(False)).alias("cooling"))


def race(first_ms: Column, first_ok: Column, second_ms: Column, second_ok: Column, prefer_ms: float) -> Column:
    """Who wins of two models that answer at once: the first if it is usable by ``prefer_ms``, else whoever is usable first; null if neither is."""
    soon = first_ok & (first_ms <= prefer_ms)
    return F.when(soon, "first").when(first_ok & second_ok, F.when(first_ms <= F.greatest(second_ms, F.lit(prefer_ms)), "first").otherwise("second")).when(first_ok, "first").when(second_ok, "second")


def single_flight(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The rows with ``leader``: whether a request computes the answer, or waits for an equal one that came first."""
    return rows.withColumn("leader", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)
