"""Flow items as streams (S-01 to S-04)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sync_range(state: DataFrame, as_of: Column) -> DataFrame:
    """S-01: source_name, since, until: from a day before the last success, else three days back."""
    last = F.col("last_success_to")
    since = F.coalesce(last - F.expr("INTERVAL 24 HOURS"), as_of - F.expr("INTERVAL 3 DAYS"))
    return state.select("source_name", since.alias("since"), as_of.alias("until"))


def stream_flow(items: DataFrame) -> DataFrame:
    """S-02: items with repeats of source_uid inside the 24-hour overlap dropped; state is bounded by the watermark."""
    return items.withWatermark("event_datetime", "24 hours").dropDuplicatesWithinWatermark(["source_uid"])


def stream_event_counts(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """S-03: events of each type and day; a day closes when the watermark has passed it, later rows are dropped."""
    days = events.withWatermark("event_datetime", late).groupBy(F.window("event_datetime", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.col("w.start").alias("day"), "event_type", "n")


def sync_state(state: DataFrame, runs: DataFrame) -> DataFrame:
    """S-01: ``state`` (source_name, last_success_to, status, message) after ``runs`` (source_name, until, status, message): a success moves last_success_to on."""
    c = F.col
    last = runs.groupBy("source_name").agg(F.max_by(F.struct("status", "message"), "until").alias("_r"), F.max(F.when(c("status") == "success", c("until"))).alias("_to"))
    j = state.select("source_name", "last_success_to", c("status").alias("_s"), c("message").alias("_m")).join(last, "source_name", "full_outer")
    return j.select("source_name", F.greatest("last_success_to", "_to").alias("last_success_to"), F.coalesce("_r.status", "_s").alias("status"), F.when(c("_r").isNotNull(), c("_r.message")).otherwise(c("_m")).alias("message"))


#: S-03: the windows that are counted, in days.
WINDOWS, DAY_MS = (7, 14, 30), 86_400_000


def stream_window_counts(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """S-03: day, zone_label, event_type, events_7d, events_14d, events_30d: events up to and with each day that has one, for each zone and type.

    One stateful operator: an event is counted once, in its day, and a zone and type hold the counts of their open days and of the thirty before, so nothing
    is copied into overlapping windows. A day closes when the watermark, ``late`` behind the newest event, has passed its end; rows of closed days are
    dropped. Events without a zone or type are those of a null one; those without a time are not counted. Days are those of UTC, which the session keeps.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, counts, done = state.get if state.exists else ([], [], 0)
        held = dict(zip(days, counts, strict=True))
        closed = state.getCurrentWatermarkMs() // DAY_MS  # days before this one have ended
        if not state.hasTimedOut:
            for pdf in frames:
                for day, n in (pd.to_datetime(pdf["event_datetime"]).astype("datetime64[ms]").astype("int64") // DAY_MS).value_counts().items():
                    if day >= max(closed, done):
                        held[day] = held.get(day, 0) + int(n)
        rows = [(dt.date(1970, 1, 1) + dt.timedelta(days=day), *key, *[sum(n for d, n in held.items() if day - w < d <= day) for w in WINDOWS]) for day in sorted(held) if done <= day < closed]
        done = max(done, closed)
        held = {d: n for d, n in held.items() if d > done - WINDOWS[-1]}
        if held:
            state.update((list(held), list(held.values()), done))
            state.setTimeoutTimestamp((max(closed, min((d for d in held if d >= done), default=min(held) + WINDOWS[-1])) + 1) * DAY_MS)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["day", "zone_label", "event_type", *[f"events_{w}d" for w in WINDOWS]])

    out = "day date, zone_label string, event_type string, " + ", ".join(f"events_{w}d long" for w in WINDOWS)
    timed = events.withWatermark("event_datetime", late).where("event_datetime is not null").select("event_datetime", "zone_label", "event_type")
    return timed.groupBy("zone_label", "event_type").applyInPandasWithState(count, out, "days array<int>, counts array<long>, done int", "append", GroupStateTimeout.EventTimeTimeout)


def stream_reconcile(items: DataFrame, listings: DataFrame, path: str, checkpoint: str) -> None:
    """S-04: every batch of a stream of flow items against fixed listings (``matching.listing_keys``); the decisions are written to ``path`` under their batch.

    A batch that is run again after a failure writes the same folder again.
    """
    from plotline.operators import matching

    def batch(df: DataFrame, number: int) -> None:
        keys = matching.item_keys(df)
        decided = matching.decide_matches(keys, matching.best_matches(keys, listings))
        decided.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, appended to ``path`` as Parquet."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
