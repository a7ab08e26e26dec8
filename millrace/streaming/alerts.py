"""Structured Streaming: windows with watermarks, alert suppression and a keyed ledger with expiry."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events) per window; rows later than the watermark are left out."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return windows.select(F.col("w.start").alias("start"), "event_type", "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def request_rate(events: DataFrame, width: str = "60 seconds", slide: str = "10 seconds", most: int = 120) -> DataFrame:
    """Users above ``most`` requests in a sliding window."""
    rate = events.withWatermark("ts", "1 minute").groupBy("user_id", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("requests"))
    return rate.where(F.col("requests") > most).select("user_id", F.col("w.start").alias("start"), "requests")


def latest_stage(progress: DataFrame) -> DataFrame:
    """The last stage seen of each job; update mode. progress: job, stage, ts."""
    return progress.groupBy("job").agg(F.max_by("stage", "ts").alias("stage"), F.max("ts").alias("ts"))


def kept_alerts(alerts: DataFrame, window_seconds: int = 3600, late: str = "2 hours") -> DataFrame:
    """Alerts not within the window after the last kept one of their key.

    Within a batch alerts are taken in time order. An alert may come up to ``late`` after the
    newest alert of any key in earlier batches; Spark leaves out what is older, whatever its
    key, before it is seen here (from the second batch after that newest alert on). What has been given out cannot be taken back: a late alert
    is suppressed also within the window before one already kept, where the batch form would
    keep the late one instead; without late alerts of the same key both forms agree.
    The state of a key is the times of the kept alerts that can still matter, at least a window
    apart; it expires once the watermark has passed the window of the last one.
    """
    window = window_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames), ignore_index=True).sort_values(["at", "id"])
        kept: list[int] = json.loads(state.get[0]) if state.exists else []
        chosen = []
        for at in frame["at"]:
            micros = int(at.value // 1000)
            k = bisect_left(kept, micros)
            fresh = (k == 0 or micros - kept[k - 1] >= window) and (k == len(kept) or kept[k] - micros >= window)
            chosen.append(fresh)
            if fresh:
                kept.insert(k, micros)
        watermark = state.getCurrentWatermarkMs()
        kept = [t for t in kept if t + window > watermark * 1000]
        if kept:
            state.update((json.dumps(kept),))
            end = (kept[-1] + window) // 1000
            if end > watermark:
                state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield frame.loc[chosen, ["key", "at", "id"]]

    rows = alerts.select("key", "at", "id").withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, id long", "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def gap_ledger(gaps: DataFrame, days: int = 90, most: int = 64) -> DataFrame:
    """Open gaps per machine, kept ``days`` after they were last seen, the newest ``most`` of a machine.

    gaps: tag, gap_id, status, at. A gap with status 'compliant' leaves the ledger. The limit
    bounds the state of one key. Emits a machine's open gaps whenever they change.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = json.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            frame = pd.concat(list(frames), ignore_index=True).sort_values("at")
            for gap, status, at in frame[["gap_id", "status", "at"]].itertuples(index=False):
                if status == "compliant":
                    held.pop(gap, None)
                else:
                    held[gap] = max(held.get(gap, 0), int(at.value // 1_000_000))
        now = max([state.getCurrentWatermarkMs(), *held.values()])
        horizon = days * 86_400_000
        held = dict(sorted(((g, t) for g, t in held.items() if t + horizon > now), key=lambda x: (-x[1], x[0]))[:most])
        if held:
            state.update((json.dumps(held),))
            expiry = min(held.values()) + horizon
            if expiry > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(expiry)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"tag": [key[0]], "open": [len(held)], "gaps": [",".join(sorted(held))]})

    rows = gaps.select("tag", "gap_id", "status", "at").withWatermark("at", "1 day")
    return rows.groupBy("tag").applyInPandasWithState(step, "tag string, open int, gaps string", "held string", "update", GroupStateTimeout.EventTimeTimeout)


def rescan(events: DataFrame, scan, checkpoint: str):
    """Runs ``scan(spark, tags)`` for the machines of each batch, once per batch of events with a tag."""

    def each(batch: DataFrame, _: int) -> None:
        scan(batch.sparkSession, batch.select("tag").where("tag IS NOT NULL").distinct())

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
