"""Requests as keyed state over an event log: stages, early ends, late enrichment, idle keys.

A key's events make up one request after another.  A request goes through stages
until one of them ends it (a hit, an error) or it has been idle for too long; what
comes for it afterwards is enrichment and makes a further version of the ended
request.  Everything is decided by event time, so a stream gives the same rows
however its input is cut into files, and the same as the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Rules:
    """Event types by what they do to a request; other types are stages."""

    ends: tuple[str, ...]
    enriches: tuple[str, ...]
    idle_s: int = 1800
    delay_s: int = 0  # how far the watermark is behind the newest event


_STATE = "request int, version int, first long, last long, stages int, total double, ended string"
_COLUMNS = ["request", "version", "first", "last", "stages", "total", "ended"]


def staged(events: DataFrame, key: str, rules: Rules) -> DataFrame:
    """``key, request, version, first, last, stages, total, ended``: the batch form, by windows.

    ``events``: key, event_id, ts, event_type, value.  Version 1 is a request as it
    ended (``ended``: the event type, or idle), later ones add an enrichment each, while
    the request is the key's last one and not idle.  Enrichments with no request to go to are left out.  A
    request is only there once it has ended: by an event, or because its key's
    next event, or the watermark (``delay_s`` before the last event of all), is ``idle_s`` later or more.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    idle = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= rules.idle_s * 1_000_000, F.lit(True))
    ends, enriches = F.col("event_type").isin(*rules.ends), F.col("event_type").isin(*rules.enriches)
    rows = events.withColumn("_idle", idle).withColumn("_stage", ~enriches).withColumn("_ends", ends)
    # a spell is a run of events without an idle gap; a stage after an end in the same spell begins the next request
    rows = rows.withColumn("_spell", F.sum(F.col("_idle").cast("int")).over(up_to))
    rows = rows.withColumn("_spell_end", F.max("ts").over(Window.partitionBy(key, "_spell"))).withColumn("_last_spell", F.max("_spell").over(Window.partitionBy(key)) == F.col("_spell"))
    in_spell = Window.partitionBy(key, "_spell").orderBy("ts", "event_id")
    rows = rows.withColumn("_nth", F.coalesce(F.sum(F.col("_ends").cast("int")).over(in_spell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # enrichments belong to the request that is open, or else to the one that ended last in the spell
    stages = F.sum(F.col("_stage").cast("int")).over(Window.partitionBy(key, "_spell", "_nth").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_open", stages > 0)
    rows = rows.withColumn("_own", F.when(F.col("_open") | F.col("_stage"), F.col("_nth")).otherwise(F.col("_nth") - 1)).where("_own >= 0")
    part = Window.partitionBy(key, "_spell", "_own")
    in_part = part.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    late = ~F.col("_stage") & (F.col("_own") < F.col("_nth"))
    rows = rows.withColumn("_late", late).withColumn("_version", 1 + F.sum(late.cast("int")).over(in_part)).withColumn("_end", F.max(F.when(F.col("_ends"), F.col("event_type"))).over(part))
    # an ended request's first version is known at its end; an idle one's at its last event
    rows = rows.withColumn("_at_end", F.when(F.col("_end").isNotNull(), F.col("_ends")).otherwise(F.row_number().over(part.orderBy(F.desc("ts"), F.desc("event_id"))) == 1))
    so_far = {"first": F.min("ts"), "last": F.max("ts"), "stages": F.sum(F.col("_stage").cast("int")), "total": F.sum("value")}
    for name, of in so_far.items():
        rows = rows.withColumn(f"_{name}", of.over(in_part))
    newest = events.agg(F.max("ts").alias("_newest"))
    rows = rows.join(F.broadcast(newest))  # one row
    timed_out = ~F.col("_last_spell") | (F.unix_micros("_newest") - F.unix_micros("_spell_end") >= (rules.idle_s + rules.delay_s) * 1_000_000)
    shown = rows.where((F.col("_at_end") | F.col("_late")) & (F.col("_end").isNotNull() | timed_out))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("_spell", "_own"))
    return shown.select(
        key, number.cast("int").alias("request"), F.col("_version").cast("int").alias("version"), F.col("_first").alias("first"), F.col("_last").alias("last"), F.col("_stages").cast("int").alias("stages"),
        F.round("_total", 6).alias("total"), F.coalesce("_end", F.lit("idle")).alias("ended"),
    )


def staged_stream(events: DataFrame, key: str, rules: Rules) -> DataFrame:
    """:func:`staged` as a stream with keyed state: a row for each version, when it is known.

    State holds one request for each key: what it has so far, and how it ended, if it did.
    A timer on event time ends what is idle.  Events more than ``delay_s`` behind the
    newest of earlier input are late and dropped, as everywhere with watermarks.
    """
    idle = rules.idle_s * 1_000_000
    kind = dict(events.dtypes)[key]

    def advance(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, version, first, last, stages, total, ended = state.get if state.exists else (0, 0, 0, 0, 0, 0.0, None)
        rows: list[tuple] = []
        show = lambda: rows.append((*k, number, version, first, last, stages, round(total, 6), ended))
        if state.hasTimedOut:
            if ended is None:
                ended = "idle"
                show()
            stages = 0  # nothing is there to enrich; the number goes on
        else:
            given = pd.concat(list(frames)).sort_values(["us", "event_id"])
            for us, name, value in given[["us", "event_type", "value"]].itertuples(index=False):
                if stages and us - last >= idle:
                    if ended is None:
                        ended = "idle"
                        show()
                    stages = 0
                if name in rules.enriches:
                    if stages:
                        last, total = us, total + value
                        if ended is not None:
                            version += 1
                            show()
                    continue
                if not stages or ended is not None:
                    number, version, first, stages, total, ended = number + 1, 1, us, 0, 0.0, None
                last, stages, total = us, stages + 1, total + value
                if name in rules.ends:
                    ended = name
                    show()
        state.update((number, version, first, last, stages, total, ended))
        if stages:
            state.setTimeoutTimestamp((last + idle) // 1000)
        yield pd.DataFrame(rows, columns=[key, *_COLUMNS])

    timed = events.withWatermark("ts", f"{rules.delay_s} seconds").select(key, "event_id", "ts", F.unix_micros("ts").alias("us"), "event_type", "value")
    out = timed.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, {_STATE}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("first", F.timestamp_micros("first")).withColumn("last", F.timestamp_micros("last"))
