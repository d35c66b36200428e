"""Stateful streams: alerts (STM-03, STM-04), failure runs (STM-05), limiters (STM-06), memberships (STM-09), idempotence (STM-08).

Every step is a plain function over rows in order and a state, which the batch operators use as well. On a stream the
state lies in typed variables of a stateful processor: a map by rule with a time to live, values with a time to live, or
values that an event-time timer clears. Such processors need the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping, Sequence
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import STATE_TTL, send, sent_frame, sent_schema

FAILURE_TTL = 7 * 86400


def use_state_store(spark: SparkSession) -> None:
    """The state store that stateful processors need, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Rules(MutableMapping):
    """A map state as the dictionary that `send` updates: rule id to (active, until, seen)."""

    def __init__(self, held):
        self.held = held

    def __getitem__(self, rule: str) -> tuple:
        found = self.held.getValue((rule,))
        if found is None:
            raise KeyError(rule)
        return tuple(found)

    def __setitem__(self, rule: str, value: tuple[bool, float, float]) -> None:
        self.held.updateValue((rule,), value)

    def __delitem__(self, rule: str) -> None:
        self.held.removeKey((rule,))

    def __iter__(self) -> Iterator[str]:
        return (k[0] for k in self.held.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self.held.keys())


class AlertProcessor(StatefulProcessor):
    """A product's rules, each with its own state and time to live."""

    def __init__(self, event: Sequence[str], ttl: int):
        self.event, self.ttl = event, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rules = _Rules(handle.getMapState("rules", "rule_id string", "active boolean, until double, seen double", self.ttl))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", *self.event, "rule_no", "rule_id"])
        events = groupby(batch.itertuples(index=False), key=attrgetter("at", *self.event))
        yield sent_frame([r for _, g in events for r in send(list(g), self.rules)], self.event)

    def close(self) -> None:
        pass


def alerts_stream(evaluated: DataFrame, event: Sequence[str] = ("event_no",), ttl: int = STATE_TTL * 1000) -> DataFrame:
    """Alerts that go out, of a stream of (product_id, *event, at, rule_no, rule_id, rule_type, fired, cooldown_minutes); a rule is forgotten `ttl` ms after its last look."""
    return evaluated.groupBy("product_id").transformWithStateInPandas(AlertProcessor(event, ttl), sent_schema(event), "Append", "ProcessingTime")


def fold_failures(rows: pd.DataFrame, run: int, last: float, length: int) -> tuple[list, int, float]:
    """STM-05: the rows at which failures in a row reach `length`; a pause of FAILURE_TTL ends a run."""
    out = []
    for r in rows.sort_values(["at", "event_id"]).itertuples():
        run = 0 if not r.failed else 1 if r.at - last >= FAILURE_TTL else run + 1
        last = float(r.at)
        if run == length:
            out.append((r.event_id, r.at))
    return out, run, last


class FailureProcessor(StatefulProcessor):
    """A key's run of failures and when it last moved."""

    def __init__(self, length: int, ttl: int):
        self.length, self.ttl = length, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "run int, last double", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.run.get() if self.run.exists() else (0, float("-inf"))
        out, run, last = fold_failures(pd.concat(list(rows)), *held, self.length)
        self.run.update((run, last))
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="int64"), "event_id": pd.Series([e for e, _ in out], dtype="int64"), "at": pd.Series([a for _, a in out], dtype="float64")})

    def close(self) -> None:
        pass


def failure_alerts(attempts: DataFrame, length: int = 5, ttl: int = FAILURE_TTL * 1000) -> DataFrame:
    """ALR-10, WIN-09 on a stream of (key, event_id, at seconds, failed)."""
    return attempts.groupBy("key").transformWithStateInPandas(FailureProcessor(length, ttl), "key long, event_id long, at double", "Append", "ProcessingTime")


def fold_window(rows: pd.DataFrame, start: float, count: int, most: int, seconds: float) -> tuple[list, float, int]:
    """STM-06: whether each hit is admitted; the first hit after a window starts the next, rejected hits count."""
    out = []
    for r in rows.sort_values(["at", "event_id"]).itertuples():
        if r.at >= start + seconds:
            start, count = float(r.at), 0
        count += 1
        out.append((r.event_id, count <= most, max(0, most - count)))
    return out, start, count


def fixed_window(hits: DataFrame, most: int, seconds: int) -> DataFrame:
    """STM-06 in batch, of (key, event_id, at): a group is one key's hits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold_window(pdf, float("-inf"), 0, most, seconds)[0], columns=["event_id", "admitted", "remaining"])

    return hits.groupBy("key").applyInPandas(run, "event_id long, admitted boolean, remaining long")


class WindowProcessor(StatefulProcessor):
    """A key's current window; a timer clears it when the watermark has passed its end."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start double, count int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.window.get() if self.window.exists() else (float("-inf"), 0)
        out, start, count = fold_window(pd.concat(list(rows)), *before, self.most, self.seconds)
        if start != before[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((start + self.seconds) * 1000))
        self.window.update((start, count))
        yield pd.DataFrame({"event_id": pd.Series([e for e, _, _ in out], dtype="int64"), "admitted": pd.Series([bool(a) for _, a, _ in out], dtype="bool"), "remaining": pd.Series([r for _, _, r in out], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def fixed_window_stream(hits: DataFrame, most: int, seconds: int, delay: str = "1 hour") -> DataFrame:
    """STM-06 on a stream of (key, event_id, ts, at seconds): windows end by event time, hits later than `delay` are dropped."""
    return hits.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(WindowProcessor(most, seconds), "event_id long, admitted boolean, remaining long", "Append", "EventTime")


def memberships(events: DataFrame) -> DataFrame:
    """STM-09 in batch, of (user_id, event_id, membership, kind, expires): the plan's end and whether it is still held.

    An end of a membership that has been replaced is ignored; an expiry never moves back. Two aggregates, no fold.
    """
    newest = F.max_by("membership", F.struct("event_id")).alias("current")
    now = events.where("kind <> 'end'").groupBy("user_id").agg(newest)
    mine = events.join(now, "user_id").where("membership = current")
    last = F.max_by("kind", "event_id")
    return mine.groupBy("user_id", "current").agg(F.max("expires").alias("expires"), (last != "end").alias("held")).withColumnRenamed("current", "membership")


class OnceProcessor(StatefulProcessor):
    """The first row of an event id; a repeated one within the time to live is dropped."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = next(iter(rows))
        if not self.seen.exists():
            self.seen.update((True,))
            yield batch.head(1)

    def close(self) -> None:
        pass


def once_per_event(events: DataFrame, ttl: int = 86_400_000) -> DataFrame:
    """STM-08: each event id once within `ttl` ms."""
    return events.groupBy("event_id").transformWithStateInPandas(OnceProcessor(ttl), events.schema, "Append", "ProcessingTime")


def once(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """STM-08 in batch: of the rows of one event id the first in `order`, by a minimum with a map side."""
    rest = [c for c in events.columns if c != "event_id"]
    return events.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("event_id", "r.*")
