"""Stateful processors with event-time timers: pending turns (W2) and the unit ledger (V9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memlake.operators.curation import BACKOFF_HOURS, MAX_ATTEMPTS

HOUR, DAY = 3_600_000, 86_400_000
OPEN, ENDS = ("pending", "deferred"), ("completed", "permanently_rejected", "skipped_disabled")


def run_stateful(events: DataFrame, key: str, processor: StatefulProcessor, shape: str) -> DataFrame:
    """The output of a processor for each key of a stream with a watermark; its state lies in RocksDB, which timers need."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy(key).transformWithStateInPandas(processor, shape, "append", "eventTime")


def _millis(times: pd.Series) -> list[int]:
    return [int(t.timestamp() * 1000) for t in times]


class PendingTurns(StatefulProcessor):
    """One open turn per key: a value of its start, and a timer for its end of life."""

    columns = ["key", "opened", "closed", "status"]

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "opened long")

    def _begin(self, at: int) -> None:
        self.open.update((at,))
        self.handle.registerTimer(at + self.life)

    def _out(self, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.columns).astype({"opened": "Int64", "closed": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        opened = self.open.get()[0] if self.open.exists() else None
        for at, opens, closes in sorted((t, bool(o), bool(c)) for df in rows for t, o, c in zip(_millis(df["ts"]), df["opens"], df["closes"])):
            if opened is not None and at - opened > self.life:
                out.append((key[0], opened, None, "expired"))
                opened = None
                self._end()
            if opens and opened is None:
                opened = at
                self._begin(at)
            elif closes and opened is not None:
                out.append((key[0], opened, at, "complete"))
                opened = None
                self._end()
        yield from self._out(out)

    def _end(self) -> None:
        self.handle.deleteTimer(self.open.get()[0] + self.life)
        self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists() and self.open.get()[0] + self.life <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], self.open.get()[0], None, "expired"))
            self.open.clear()
        yield from self._out(out)

    def close(self) -> None:
        pass


class UnitLedger(StatefulProcessor):
    """V9 for a bucket of units: a value with the standing of each, and one timer, at the first next try or end of life among them."""

    columns = ["unit", "at", "status", "attempts", "retry_after"]
    standing = "unit array<string>, status array<string>, attempts array<int>, retry_after array<long>, expires_at array<long>, told array<boolean>"

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("units", self.standing)

    def _out(self, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.columns).astype({"at": "Int64", "attempts": "Int64", "retry_after": "Int64"})

    def _load(self) -> dict:
        """Of each unit: status, attempts, next try, end of life, and whether it has been reported due since its last try."""
        held = self.value.get()
        return {unit: tuple(rest) for unit, *rest in zip(*held)} if held else {}

    @staticmethod
    def _waits(standing: tuple) -> bool:
        status, _, retry, expires, told = standing
        return status == "deferred" and not told and retry is not None and retry < expires

    def _first(self, units: dict) -> int | None:
        return min((s[2] if self._waits(s) else s[3] for s in units.values()), default=None)

    def _save(self, units: dict, timer: int | None, spent: bool = False) -> None:
        """Keep the units and move the bucket's timer; ``spent``: it has just gone off, and Spark takes it away."""
        if units:
            self.value.update(tuple(map(list, zip(*((unit, *s) for unit, s in units.items())))))
        else:
            self.value.clear()
        first = self._first(units)
        if first != timer:
            if timer is not None and not spent:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, units = [], self._load()
        timer = self._first(units)
        events = [x for df in rows for x in zip(df["at"].tolist(), df["outcome"].where(df["outcome"].notna(), ""), df["unit"].where(df["unit"].notna(), None).tolist())]
        for at, outcome, unit in sorted(events, key=lambda x: x[:2]):
            if not isinstance(unit, str):
                unit = None
            if unit not in units:
                units[unit] = ("pending", 0, None, at + self.life, False)
                out.append((unit, at, "pending", 0, None))
            status, attempts, retry, expires, _ = units[unit]
            if status not in OPEN:
                continue
            tried = status == "pending" or retry is None or at >= retry
            if at >= expires:
                units[unit] = ("expired_visible", attempts, None, expires, False)
            elif tried and outcome in ENDS:
                units[unit] = (outcome, attempts, None, expires, False)
            elif tried and outcome == "deferred":
                attempts += 1
                if attempts >= MAX_ATTEMPTS:
                    units[unit] = ("expired_visible", attempts, None, expires, False)
                else:
                    units[unit] = ("deferred", attempts, at + BACKOFF_HOURS[min(attempts, len(BACKOFF_HOURS)) - 1] * HOUR, expires, False)
            else:
                continue
            out.append((unit, at, *units[unit][:3]))
        self._save(units, timer)
        yield from self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, units = [], self._load()
        timer, gone, seen = self._first(units), expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        over = lambda t: t <= gone or t < seen
        for unit, standing in list(units.items()):
            status, attempts, retry, expires, _ = standing
            if self._waits(standing) and over(retry):
                out.append((unit, retry, "due", attempts, retry))
                units[unit] = (status, attempts, retry, expires, True)
            if over(expires):
                if status in OPEN:
                    out.append((unit, expires, "expired_visible", attempts, None))
                del units[unit]  # nothing asks for it any more
        self._save(units, timer, spent=timer == gone)
        yield from self._out(out)

    def close(self) -> None:
        pass


def unit_ledger(events: DataFrame, key: str, life_days: int = 14, delay: str = "48 hours", buckets: int = 1024) -> DataFrame:
    """V9 as a stream: ``(unit, at, status, attempts, retry_after)``, times in milliseconds, one row per change of a unit.

    ``events`` has the key, ``ts`` and ``outcome``: the first event of a unit
    observes it (once), an outcome tells how a try went.  A deferred unit waits
    1, 6, then 24 hours: outcomes in that time do not count, and a timer reports
    it ``due``.  Used-up attempts and the end of its life make it
    ``expired_visible``, the latter by a timer.  An ended unit is remembered
    until its life is over.

    State is kept by ``buckets`` of units, since a call of the processor costs
    far more than a unit.  A batch reads and writes the buckets that it touches
    whole, so a stream of many living units wants more of them; their number
    holds as long as a checkpoint does.
    """
    unit = F.col(key).cast("string")
    rows = events.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64(unit), F.lit(buckets)).alias("bucket"), unit.alias("unit"), "ts", F.unix_millis("ts").alias("at"), F.col("outcome").cast("string").alias("outcome"))
    return run_stateful(rows, "bucket", UnitLedger(life_days * DAY), "unit string, at long, status string, attempts long, retry_after long")
