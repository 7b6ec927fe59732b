"""Approval lifecycle as a stream: keyed state, event-time timers, one terminal event per request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

HOUR = 3_600_000
KEEP_MS = 7 * 24 * HOUR  # a decision waits that long for its request
TICK = ""  # rows of this id only move the watermark
FEED = "approval_id string, kind string, at timestamp, actor string, reason string, hours int"
BUCKETS = 1024  # keys of the state; a checkpoint keeps the number it was begun with
WAITING = "approval_id: string, at_us: long, action: string, actor: string, reason: string"
REQUEST = "approval_id: string, expires_us: long, sweep_ms: long, closed: boolean, at_us: long, action: string, actor: string, reason: string"
TERMINAL = "approval_id string, status string, decided_by string, decided_us long, rejection_reason string"


def feed(requests: DataFrame, events: DataFrame, *, hours: int = 48) -> DataFrame:
    """Requests and decisions as one feed of events, by the time they happened."""
    none = F.lit(None).cast("string")
    asked = requests.select("approval_id", F.lit("submit").alias("kind"), F.col("created_at").alias("at"), none.alias("actor"), none.alias("reason"), F.lit(hours).alias("hours"))
    return asked.unionByName(events.select("approval_id", F.col("action").alias("kind"), "at", "actor", "reason", F.lit(None).cast("int").alias("hours")))


class Lifecycle(StatefulProcessor):
    """Per bucket of approvals, for each: its request, the first effective decision so far, and decisions that came before the request.

    An approval needs an unexpired request, a rejection one that the hourly
    sweep has not closed. A decision becomes final when the watermark reaches
    its time, as no earlier one can come then; at the sweep an undecided
    request expires and the state goes. A bucket is read and written once a
    batch and has one timer, for whatever of it comes due first: calls to the
    state store go with the buckets, not with the approvals.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"due_ms long, requests array<struct<{REQUEST}>>, waiting array<struct<{WAITING}>>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from ()
        asked, decided = {}, {}
        for b in rows:
            columns = [b[c].astype(object).where(b[c].notna(), None) for c in ("approval_id", "at_us", "kind", "actor", "reason", "hours")]
            for i, at, kind, actor, reason, hours in zip(*columns):
                if i == TICK:
                    continue
                if kind in ("approve", "reject"):
                    decided.setdefault(i, []).append((int(at), kind, actor, reason))
                elif kind == "submit":
                    asked[i] = min(asked.get(i, (int(at), int(hours))), (int(at), int(hours)))
        if not asked and not decided:
            return
        due, requests, waiting = self._load()
        for i in asked.keys() | decided.keys():
            now, decisions = requests.get(i), decided.get(i, [])
            if now is None and i not in asked:
                waiting.setdefault(i, []).extend(decisions)
                continue
            if now is None:
                expires = asked[i][0] + asked[i][1] * HOUR * 1000
                now = (expires, (expires // (HOUR * 1000) + 1) * HOUR, False, None, None, None, None)
                decisions = decisions + waiting.pop(i, [])
            elif now[2]:
                continue
            expires, sweep, _, *first = now
            effective = [e for e in decisions if (e[1] == "approve" and e[0] < expires) or (e[1] == "reject" and e[0] < sweep * 1000)]
            best = min(effective + ([tuple(first)] if first[0] is not None else []), key=_order, default=first)
            requests[i] = (expires, sweep, False, *best)
        self._store(due, requests, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        due, requests, waiting = self._load()
        if due is None or due > mark:
            return
        ended = []
        for i, (expires, sweep, closed, *first) in list(requests.items()):
            at, action, actor, reason = first
            if not closed and at is not None and -(-at // 1000) <= mark:
                rejected = action == "reject"
                ended.append((i, "rejected" if rejected else "approved", actor, at, reason if rejected else None))
                requests[i] = (expires, sweep, True, *first)
            elif not closed and sweep <= mark:
                ended.append((i, "expired", None, None, None))
            if sweep <= mark:
                del requests[i]
        waiting = {i: left for i, events in waiting.items() if (left := [e for e in events if e[0] // 1000 + KEEP_MS > mark])}  # a request that never came
        self._store(None, requests, waiting)
        if ended:
            yield _terminal(ended)

    def _load(self) -> tuple[int | None, dict[str, tuple], dict[str, list[tuple]]]:
        due, requests, waiting = self.held.get() or (None, [], [])
        early = {}
        for i, *event in waiting:
            early.setdefault(i, []).append(tuple(event))
        return due, {i: tuple(rest) for i, *rest in requests}, early

    def _store(self, due: int | None, requests: dict[str, tuple], waiting: dict[str, list[tuple]]) -> None:
        """Keep the bucket; ``due`` is the time that already has a timer."""
        times = [sweep if closed or at is None else -(-at // 1000) for _, sweep, closed, at, *_ in requests.values()]
        first = min(times + [e[0] // 1000 + KEEP_MS for events in waiting.values() for e in events], default=None)
        if first is None:
            self.held.clear()
            return
        if due is None or first < due:
            self.handle.registerTimer(first)
        self.held.update((first, [(i, *r) for i, r in requests.items()], [(i, *e) for i, events in waiting.items() for e in events]))


def _order(event: tuple) -> tuple:
    return tuple((x is not None, x if x is not None else "") for x in event)


def _terminal(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["approval_id", "status", "decided_by", "decided_us", "rejection_reason"])
    return out.astype({"decided_us": "Int64"})


def terminal_events(events: DataFrame, watermark: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """One row per request that is approved, rejected or expired, from a stream of ``feed`` rows.

    Rows without an id, or of another kind, change nothing.
    """
    rows = events.where("approval_id is not null").withWatermark("at", watermark)
    rows = rows.select(F.pmod(F.xxhash64("approval_id"), F.lit(buckets)).alias("bucket"), "approval_id", "kind", "at", F.unix_micros("at").alias("at_us"), "actor", "reason", "hours")
    out = rows.groupBy("bucket").transformWithStateInPandas(Lifecycle(), TERMINAL, outputMode="Append", timeMode="EventTime")
    return out.select("approval_id", "status", "decided_by", F.timestamp_micros("decided_us").alias("decided_at"), "rejection_reason")


def start_approvals(events: DataFrame, path: str, checkpoint: str, watermark: str = "2 hours") -> StreamingQuery:
    """Append terminal events to ``path``; a restart on the same checkpoint goes on with the stored state."""
    return (terminal_events(events, watermark).writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))
