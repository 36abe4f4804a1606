"""The trailing-window cap on a stream, with state that expires."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from joblode.operators.ratecap import admit

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE = 10_000


class TrailingCap(StatefulProcessor):
    """Keeps the last `limit` admitted times of a key in a list, until a timer behind the window clears them."""

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        keys, times, ids = [], [], []
        for frame in rows:
            in_time = (frame["at"].notna() & (frame["at"].fillna(watermark) >= watermark)).to_numpy()
            if not in_time.all():
                yield self._out(frame["key"][~in_time], frame["at"][~in_time], frame["event_id"][~in_time], False)
            keys = frame["key"].iloc[:1]
            times.append(frame["at"].to_numpy()[in_time].astype(np.int64))
            ids.append(frame["event_id"].to_numpy()[in_time])
        at, event = np.concatenate(times), np.concatenate(ids)
        if not len(at):
            return
        order = np.lexsort((event, at))
        at, event = at[order], event[order]
        recent = deque(sorted(row[0] for row in self.recent.get()))
        for start in range(0, len(at), SLICE):
            part = slice(start, start + SLICE)
            passed = admit(at[part], recent, self.limit, self.window)
            yield self._out(keys.repeat(len(passed)), at[part], event[part], passed)
        if recent:
            self.recent.put([(int(time),) for time in recent])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # once the watermark is here, every event in time is a window behind the newest one that counts
            self.handle.registerTimer(max(recent) // 1000 + self.window // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _out(key: Any, at: Any, event: Any, accepted: Any) -> pd.DataFrame:
        out = pd.DataFrame({"key": np.asarray(key), "at": pd.array(np.asarray(at, dtype=object), "Int64"), "event_id": np.asarray(event)})
        return out.assign(accepted=accepted)


def rate_cap_stream(
    events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_seconds: float, lateness: str
) -> DataFrame:
    """Streaming form of rate_cap(): one row per event, with `accepted`.

    The watermark is the newest time of earlier triggers less `lateness`. An event behind it, or without a time, comes
    out as not accepted; the column with the watermark is left behind before the stateful step, so that Spark does not
    drop those. The events of one trigger are put in time order per key. The state of a key is its last `limit` admitted
    times; a timer clears it when the watermark has passed the last of them by a window. Times and ids of one trigger's
    events of a key are in memory together: bound a trigger at the source (maxFilesPerTrigger, maxOffsetsPerTrigger).

    List state and timers need the RocksDB state store; the session is set to it.
    """
    if limit < 1 or window_seconds <= 0:
        raise ValueError("limit and window_seconds must be positive")
    events.sparkSession.conf.set(STATE_STORE, ROCKS)
    moment = F.col(ts).cast("timestamp")
    timed = events.withColumn("_moment", moment).withWatermark("_moment", lateness)
    stamps = timed.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(key).isNull().alias("nameless"),
        F.col(key).alias("key"), F.unix_micros("_moment").alias("at"), F.col(event_id).alias("event_id"),
    )
    types = {field.name: field.dataType.simpleString() for field in stamps.schema.fields}
    schema = f"key {types['key']}, at bigint, event_id {types['event_id']}, accepted boolean"
    capped = stamps.groupBy("name", "nameless").transformWithStateInPandas(
        TrailingCap(limit, int(round(window_seconds * 1_000_000))), schema, "append", "EventTime"
    )
    return capped.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("event_id").alias(event_id), "accepted")
