"""Source health as a stream: the same steps as the batch fold, state kept by source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from jobscope import vocab

OUTPUT = "source string, failures int, health string, reason string, last_success timestamp"


def _row(source: str, failures: int, health: str, reason: str | None, last) -> pd.DataFrame:  # noqa: ANN001
    return pd.DataFrame({"source": [source], "failures": [failures], "health": [health], "reason": [reason], "last_success": pd.Series([last], dtype="datetime64[ns]")})


class HealthProcessor(StatefulProcessor):
    """Steps each source's state by its events; events of a micro-batch are taken in order of time and sequence."""

    def __init__(self, thresholds: dict[str, int] | None = None) -> None:
        self.thresholds = thresholds or vocab.FAILURE_THRESHOLDS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "failures int, health string, reason string, last_success timestamp")

    def _held(self) -> tuple:
        held = self.state.get() if self.state.exists() else None
        return held if held else (0, "ok", None, None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        failures, health, reason, last = self._held()
        events = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for ts, kind in zip(events["ts"], events["kind"], strict=True):
            if kind == "probe_success" or (kind == "success" and health != "quarantined"):
                failures, health, reason, last = 0, "ok", None, ts.to_pydatetime()
            elif health != "quarantined" and kind in self.thresholds:
                failures, reason = failures + 1, kind
                health = "quarantined" if failures >= self.thresholds[kind] else "degraded"
        self.state.update((failures, health, reason, last))
        yield _row(key[0], failures, health, reason, last)

    def close(self) -> None:
        pass


def stream_health(events: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Updated states of the sources in each micro-batch of ``events`` (source, ts, seq, kind)."""
    return events.groupBy("source").transformWithStateInPandas(HealthProcessor(thresholds), OUTPUT, outputMode="Update", timeMode="None")


class ProbeProcessor(HealthProcessor):
    """Health, and for each quarantined source a row with ``probe_due`` every ``every_ms`` of processing time until it recovers."""

    def __init__(self, every_ms: int, thresholds: dict[str, int] | None = None) -> None:
        super().__init__(thresholds)
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for out in super().handleInputRows(key, rows, timerValues):
            timers = list(self.handle.listTimers())
            if out["health"][0] != "quarantined":
                for timer in timers:
                    self.handle.deleteTimer(timer)
            elif not timers:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
            yield out.assign(probe_due=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held[1] == "quarantined":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
            yield _row(key[0], *held).assign(probe_due=True)


def stream_probes(events: DataFrame, every_ms: int = vocab.PROBE_EVERY_MS, thresholds: dict[str, int] | None = None) -> DataFrame:
    """``stream_health`` with ``probe_due``: false in updates, true in a quarantined source's row for each time that it is due to be probed."""
    return events.groupBy("source").transformWithStateInPandas(ProbeProcessor(every_ms, thresholds), f"{OUTPUT}, probe_due boolean", outputMode="Update", timeMode="ProcessingTime")
