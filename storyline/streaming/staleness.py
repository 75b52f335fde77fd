"""Stories that turn stale as a stream's clock moves on: a timer per story in keyed state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "story_id long, state string, at timestamp"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _us(value) -> int:
    stamp = pd.Timestamp(value)
    return (stamp if stamp.tzinfo is None else stamp.tz_convert("UTC").tz_localize(None)).value // 1000


class _Staleness(StatefulProcessor):
    """One story: its last update and its state. A timer stands at the last update plus the age; an update moves it."""

    def __init__(self, after_hours: int):
        self.after_us = after_hours * 3600 * 10**6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_us long, state string")

    def _due_ms(self, last_us: int) -> int:
        return -(-(last_us + self.after_us) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        updates = pd.concat(list(rows))
        updates = sorted(((_us(t), s) for t, s in zip(updates["updated_at"], updates["state"])), key=lambda u: (u[0], u[1] or ""))
        last, state = self.seen.get() if self.seen.exists() else (None, None)
        if last is not None:
            self.handle.deleteTimer(self._due_ms(last))
        out = []
        for at, given in updates:
            if last is not None and at < last:
                continue  # late: it changes neither the clock of the story nor its state
            if state not in (None, "stale", "merged") and at >= last + self.after_us and last is not None:
                out.append((key[0], "stale", last + self.after_us))  # the gap lay between two updates of one batch
                state = "stale"
            if state != "merged" and (state != given):
                out.append((key[0], given, at))
                state = given
            last = at
        self.seen.update((last, state))
        if state not in ("stale", "merged"):
            self.handle.registerTimer(self._due_ms(last))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, state = self.seen.get()
        if state in ("stale", "merged") or self._due_ms(last) > expiredTimerInfo.getExpiryTimeInMs():
            yield self._frame([])
        else:
            self.seen.update((last, "stale"))
            yield self._frame([(key[0], "stale", last + self.after_us)])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        ids, states, at = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"story_id": pd.Series(ids, dtype="int64"), "state": pd.Series(states, dtype="object"), "at": pd.to_datetime(pd.Series(at, dtype="int64") * 1000)})


def staleness_changes(updates: DataFrame, after_hours: int = 96, lateness: str = "1 day") -> DataFrame:
    """A stream of state changes (story_id, state, at) from a stream of updates (story_id, state, updated_at).

    A story takes the state of each update; it turns stale, once, when the stream's watermark passes its last update by
    ``after_hours``, unless an update before that moment moves the timer. A later update wakes it. Merged stories stay merged.
    The watermark is ``lateness`` behind the newest update; updates older than a story's last one change nothing.
    Updates without a story or a time are left out. State is one small row per story, spread by story.
    """
    given = updates.filter("story_id is not null and updated_at is not null").select(
        F.col("story_id").cast("long").alias("story_id"), F.coalesce("state", F.lit("updated")).alias("state"), "updated_at"
    )
    return given.withWatermark("updated_at", lateness).groupBy("story_id").transformWithStateInPandas(
        _Staleness(after_hours), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )


#: State store that keyed timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
