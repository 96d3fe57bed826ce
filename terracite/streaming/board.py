"""Live board of sources: latest status, counts and alarms, by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BOARD = "source_id long, status string, ts timestamp, n_events long, n_statuses long, alarm string"
FINISHED = ("COMPLETED", "FAILED")
#: The state store that keeps several variables and timers for each key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Board(StatefulProcessor):
    """Latest status, number of events and events of each status of one source, with a timer.

    The watermark's passing ``stuck_after`` beyond the last event raises an alarm for a source that is not finished; its passing
    ``forget_after`` beyond it clears all state of one that is, or that stayed stuck.
    """

    def __init__(self, stuck_after: str, forget_after: str) -> None:
        self.stuck, self.forget = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (stuck_after, forget_after))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "status string, micros long, stuck boolean")
        self.total = handle.getValueState("total", "n long")
        self.by_status = handle.getMapState("by_status", "status string", "n long")

    def _row(self, key: tuple, alarm: str | None) -> pd.DataFrame:
        status, micros, _ = self.latest.get()
        kinds = sum(1 for _ in self.by_status.keys())
        return pd.DataFrame({"source_id": [key[0]], "status": [status], "ts": [pd.Timestamp(micros, unit="us")], "n_events": [self.total.get()[0]], "n_statuses": [kinds], "alarm": [alarm]})

    def _set_timer(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, micros, _ = self.latest.get() if self.latest.exists() else (None, -1, False)
        n = self.total.get()[0] if self.total.exists() else 0
        for frame in rows:
            n += len(frame)
            for row in frame.sort_values(["ts", "event_id"]).itertuples():
                at = int(row.ts.value // 1000)
                if at >= micros:
                    status, micros = row.status, at
                had = self.by_status.getValue((row.status,))[0] if self.by_status.containsKey((row.status,)) else 0
                self.by_status.updateValue((row.status,), (had + 1,))
        self.latest.update((status, micros, False))
        self.total.update((n,))
        self._set_timer(micros // 1000 + (self.forget if status in FINISHED else self.stuck))
        yield self._row(key, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, micros, stuck = self.latest.get()
        if status in FINISHED or stuck:
            yield self._row(key, "forgotten")
            for state in (self.latest, self.total, self.by_status):
                state.clear()
        else:
            self.latest.update((status, micros, True))
            self._set_timer(micros // 1000 + self.stuck + self.forget)
            yield self._row(key, "stuck")

    def close(self) -> None:
        pass


def live_board(events: DataFrame, stuck_after: str = "1 hour", forget_after: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """A row of BOARD whenever a source's events come or one of its timers goes off; update mode. events: event_id, source_id, status, ts.

    Sets the session's state store to STORE, which its timers and variables need. Events that are later than the watermark are dropped.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.select("event_id", "source_id", "status", "ts").withWatermark("ts", watermark)
    return rows.groupBy("source_id").transformWithStateInPandas(Board(stuck_after, forget_after), BOARD, "update", "eventTime")
