"""The same operators on arriving rows; each equals a batch operator on the same input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP = 3


def guard_stream(pages: DataFrame, held_out: DataFrame, key: str = "page_id") -> DataFrame:
    """Arriving pages that are not held out."""
    return pages.join(held_out.select(key), key, "left_anti")


def slice_stream(readings: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Running tally per slice and event-time window; late rows past the delay are dropped."""
    return (
        readings.withWatermark("at", delay)
        .groupBy(F.window("at", window).alias("span"), "slice")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit")).alias("hits"))
    )


def gap_sessions(rows: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Sessions closed by a gap in event time; in append mode each comes once, and its state goes."""
    return (
        rows.withWatermark("at", delay)
        .groupBy(key, F.session_window("at", gap).alias("span"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def latest_keys_stream(touches: DataFrame) -> DataFrame:
    """Per user the keys touched last, newest first; the state is at most KEEP keys.

    Rows carry ``user_id, at_us, event_id, page``. Each batch emits the users it touched.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        for frame in frames:
            newest = frame.sort_values(["at_us", "event_id"]).drop_duplicates("page", keep="last")
            for page, at, event in zip(newest["page"], newest["at_us"], newest["event_id"]):
                kept[int(page)] = max(kept.get(int(page), (-1, -1)), (int(at), int(event)))
            kept = dict(sorted(kept.items(), key=lambda item: item[1], reverse=True)[:KEEP])
        pages = list(kept)
        state.update((pages, [kept[p][0] for p in pages], [kept[p][1] for p in pages]))
        yield pd.DataFrame({"user_id": key[0], "page": pages, "place": range(1, len(pages) + 1)})

    return touches.groupBy("user_id").applyInPandasWithState(
        step, "user_id LONG, page LONG, place INT", "pages ARRAY<LONG>, at ARRAY<LONG>, event ARRAY<LONG>",
        "update", GroupStateTimeout.NoTimeout,
    )


def settled_stream(rows: DataFrame, key: str, delay: str) -> DataFrame:
    """Rows given out once the watermark has passed their millisecond, so a batch's rows are all later than those of the batches before.

    Native windows of a millisecond hold them; no group calls Python, and the
    state is the rows of the last ``delay``. Rows that are there twice stay two.
    """
    return (
        rows.withWatermark("at", delay).groupBy(key, F.window("at", "1 millisecond").alias("_span"))
        .agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in (key, "at")))).alias("_rows"))
        .select(key, F.inline("_rows"))
    )


def request_lifecycle(messages: DataFrame, delay: str, patience_ms: int) -> DataFrame:
    """Each request's end: result or error, or abandoned when nothing came for long enough.

    Messages carry ``request_id, at, type`` (progress, result, error). A silence
    of more than ``patience_ms`` closes a request, and a later message of its id
    opens another; what comes after an end within it is ignored. Sessions of the
    native window hold the messages until the watermark has passed the silence,
    so that the row of a request is the same however its messages arrive, and no
    request calls Python. Of one instant, progress comes before an end.
    """
    # Times are whole milliseconds and windows that touch are one: half of one more parts what is later than the patience, and only that.
    ms = F.unix_millis("at")
    timed = messages.select("request_id", "type", ms.alias("ms"), F.timestamp_millis(ms).alias("at")).withWatermark("at", delay)
    progress = F.col("type") == "progress"
    runs = timed.groupBy("request_id", F.session_window("at", f"{patience_ms * 1000 + 500} microseconds").alias("span")).agg(
        F.min("ms").alias("opened_ms"), F.min(F.when(~progress, F.struct("ms", "type"))).alias("end"), F.collect_list(F.when(progress, F.col("ms"))).alias("steps"))
    return runs.select(
        "request_id", "opened_ms", F.coalesce("end.type", F.lit("abandoned")).alias("status"),
        F.size(F.filter("steps", lambda m: F.col("end").isNull() | (m <= F.col("end.ms")))).cast("long").alias("progress"))
