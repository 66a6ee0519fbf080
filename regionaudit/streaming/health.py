"""Live response monitor: a sliding count window of flags kept in state, with a latched alarm."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import degenerate
from ..operators.integrity import LEAST_SAMPLES, MAX_RATE, WINDOW


class HealthMonitor(StatefulProcessor):
    def __init__(self, window: int = WINDOW, max_rate: float = MAX_RATE, least: int = LEAST_SAMPLES):
        self.window, self.max_rate, self.least = window, max_rate, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "calls long, degenerate long, tripped boolean, recent string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, bad, tripped, recent = self.totals.get() if self.totals.exists() else (0, 0, False, "")
        out = []
        for batch in rows:
            for event, flag in sorted(zip(batch.event_id.tolist(), batch.degenerate.tolist(), strict=True)):
                calls, bad = calls + 1, bad + flag
                recent = (recent + "01"[flag])[-self.window :]
                tripped = tripped or (len(recent) >= self.least and recent.count("1") >= self.max_rate * len(recent))
                out.append((key[0], event, calls, bad, recent.count("1"), tripped))
        self.totals.update((calls, bad, tripped, recent))
        yield pd.DataFrame(out, columns=["monitor", "event_id", "calls", "degenerate", "window_bad", "tripped"])

    def close(self) -> None:
        pass


def monitored(stream: DataFrame, key: str = "monitor", **limits) -> DataFrame:
    """Alarm state after each answer of a stream (key, event_id, raw); needs the RocksDB state store."""
    flagged = stream.select(key, "event_id", degenerate(stream["raw"]).alias("degenerate"))
    return flagged.groupBy(key).transformWithStateInPandas(HealthMonitor(**limits), "monitor string, event_id long, calls long, degenerate long, window_bad long, tripped boolean", "Append", "None")
