"""Keyed state of streams: a month's call budget, and the comments of the newest thread."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from jobscope import vocab
from jobscope.functions.text import local_month


class BudgetProcessor(StatefulProcessor):
    """Admits the first ``cap`` calls of a month; its count is dropped when the watermark has passed the month's end in the zone."""

    def __init__(self, cap: int, zone: str) -> None:
        self.cap, self.zone = cap, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "used int")

    def _ends(self, month: str) -> int:
        year, number = map(int, month.split("-"))
        return int(datetime(year + number // 12, number % 12 + 1, 1, tzinfo=ZoneInfo(self.zone)).timestamp() * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        if not self.used.exists():
            self.handle.registerTimer(self._ends(key[0]))
        first: list[tuple] = []  # never more than the calls that are left
        for part in rows:
            first = heapq.nsmallest(self.cap - used, [*first, *zip(part["ts"], part["call_id"], strict=True)])
        self.used.update((used + len(first),))
        if first:
            ts, ids = zip(*first, strict=True)
            yield pd.DataFrame({"month": key[0], "ts": pd.Series(ts, dtype="datetime64[ns]"), "call_id": ids})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_admissions(calls: DataFrame, cap: int, late: str = "1 hour", zone: str = vocab.BUDGET_ZONE) -> DataFrame:
    """The admitted calls (month, ts, call_id) of a stream of calls (ts, call_id): the first ``cap`` of each month in the zone, in order of arrival by micro-batch, then of time and id.

    Calls ``late`` behind the newest are dropped, never admitted, so a month's count can go with its end.
    """
    dated = calls.withWatermark("ts", late).withColumn("month", local_month(F.col("ts"), zone)).select("month", "ts", "call_id")
    return dated.groupBy("month").transformWithStateInPandas(BudgetProcessor(cap, zone), "month string, ts timestamp, call_id long", outputMode="Append", timeMode="EventTime")


class KidsProcessor(StatefulProcessor):
    """Comments of the newest thread that weren't there before; a newer thread starts anew, and older ones are done with."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.thread = handle.getValueState("thread", "thread long")
        self.seen = handle.getMapState("seen", "id long", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        parts = list(rows)  # thread and comment ids of one feed's micro-batch
        newest = max(int(p["thread_id"].max()) for p in parts)
        known = self.thread.get()[0] if self.thread.exists() else None
        if known is None or newest > known:
            self.seen.clear()
            self.thread.update((newest,))
            known = newest
        new = []
        for p in parts:
            for kid in map(int, p.loc[p["thread_id"] == known, "id"]):
                if not self.seen.containsKey((kid,)):
                    self.seen.updateValue((kid,), (True,))
                    new.append(kid)
        if new:
            yield pd.DataFrame({"feed": key[0], "thread_id": known, "id": new})

    def close(self) -> None:
        pass


def stream_unseen_kids(threads: DataFrame) -> DataFrame:
    """``feed``, ``thread_id`` and ``id`` of each comment once, from a stream of threads as they are read (feed, thread_id, kids)."""
    kids = threads.select("feed", "thread_id", F.explode("kids").alias("id"))
    return kids.groupBy("feed").transformWithStateInPandas(KidsProcessor(), "feed string, thread_id long, id long", outputMode="Append", timeMode="None")
