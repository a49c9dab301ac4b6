"""Running state per owner over streams: budgets and cooldowns.  The batch forms are in operators/analytics.py.

Each owner's number is value state.  With ``late``, the longest delay of an event, timers in the events' time bound it: a budget is forgotten ``ttl_ms`` after its
owner's last event, and a cooldown that ends frees its owner, which a row says, and leaves nothing behind, as owners without failures keep no state.
Expiry goes by the events' time and not by the clock's, as with the latter a run over all that is there (trigger availableNow) would never end: time that may
yet expire something is always another batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fixed import COOLDOWNS

#: How long a budget outlives its owner's last event.
TTL_MS = 7 * 86_400_000


class _Owner(StatefulProcessor):
    """One number an owner, with one timer at most."""

    columns: list[str] = []

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "number long")

    def held(self) -> int:
        return self.number.get()[0] if self.number.exists() else 0

    def keep(self, value: int, until: int | None) -> None:
        """The owner's number, and when it ends; None lets the timer be."""
        self.number.update((value,))
        if self.timed and until is not None:
            self.stop()
            self.handle.registerTimer(until)

    def stop(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def close(self) -> None:
        pass


def _millis(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


class Budget(_Owner):
    """Adds up what an owner spends."""

    columns = ["user_id", "event_id", "spent", "level"]

    def __init__(self, cap: int, timed: bool, ttl_ms: int):
        super().__init__(timed)
        self.cap, self.ttl_ms = cap, ttl_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        total = self.held() + events["tokens"].cumsum()
        self.keep(int(total.iloc[-1]), _millis(events["ts"].iloc[-1]) + self.ttl_ms)
        level = pd.cut(total / self.cap, [-float("inf"), 0.8, 0.95, float("inf")], labels=["ok", "warning", "critical"], right=False)
        yield pd.DataFrame({"user_id": key[0], "event_id": events["event_id"], "spent": total, "level": level.astype(str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.number.clear()
        yield pd.DataFrame([], columns=self.columns)


class Cooldown(_Owner):
    """Counts an owner's unbroken failures, and frees it when the cooldown of the last one has passed."""

    columns = ["user_id", "event_id", "failures", "cooldown", "free"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, out, until = self.held(), [], None
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            if r.outcome == "ok":
                failures = 0
            elif r.outcome == "failed":
                failures += 1
                pause = COOLDOWNS[min(failures, len(COOLDOWNS)) - 1]
                until = _millis(r.ts) + 1000 * pause
                out.append((key[0], r.event_id, failures, pause, False))
        if failures:
            self.keep(failures, until)
        elif self.number.exists():
            self.number.clear()
            if self.timed:
                self.stop()
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.number.clear()
        yield pd.DataFrame([(key[0], -1, 0, 0, True)], columns=self.columns)


def _with_state(events: DataFrame, processor: _Owner, schema: str, late: str | None) -> DataFrame:
    rows = events if late is None else events.withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, schema, "append", "none" if late is None else "eventTime")


def running_budget(events: DataFrame, cap: int, late: str | None = None, ttl_ms: int = TTL_MS) -> DataFrame:
    """Events (user_id, event_id, ts, tokens) with the owner's spend so far and a warning level at 80 and 95 percent of the cap.

    A trigger's events are taken in time order; what arrives in a later trigger is added after it.  With ``late``, an owner without events for
    ``ttl_ms`` begins again at 0."""
    return _with_state(events, Budget(cap, late is not None, ttl_ms), "user_id long, event_id long, spent long, level string", late)


def cooldowns(outcomes: DataFrame, late: str | None = None) -> DataFrame:
    """Failed events (user_id, event_id, ts, outcome) with the length of the unbroken run of failures and its cooldown seconds.
    "ok" ends a run, "empty" neither ends nor lengthens it.

    With ``late``, cooldowns end: once the stream's time has passed one, a row (event_id -1) says that the owner is ``free``, and its failures count from 0 again."""
    return _with_state(outcomes, Cooldown(late is not None), "user_id long, event_id long, failures long, cooldown long, free boolean", late)
