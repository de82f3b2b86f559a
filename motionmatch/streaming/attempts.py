"""Live frames to one terminal result per attempt."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from motionmatch.operators.sessions import FRAMES_KEPT, IDLE_SECONDS, admission_reason

RETAIN_SECONDS = 86_400      # an ended attempt is remembered for so long after its final frame
WINDOW = 4096                # rows judged at once
PACKED = 1024                # rows given out in one list
# A frame of few columns: turning each one to Arrow costs a key more than its rows do.
OUTPUT = ("attempt_id string, rows array<struct<kind string, target string, event_id long, us long, "
          "position int, frames int, landmarks array<double>>>")
FIELDS = ("kind", "target", "event_id", "us", "position", "frames", "landmarks")
FRAME_STATE = "event_id long, us long, landmarks array<double>"
HEAD_STATE = "target string, last_us long, last_event long, seen int, held int, terminal long, timer_ms long"
LONG_AGO = -(1 << 62)


@dataclass(frozen=True)
class Head:
    """What is known of an attempt between micro-batches. Times are microseconds."""
    target: str | None = None
    last_us: int = LONG_AGO
    last_event: int | None = None
    seen: int = 0
    held: int = 0                # rows in the list of frames
    terminal: int | None = None
    timer_ms: int | None = None

    def row(self) -> tuple:
        return (self.target, self.last_us, self.last_event, self.seen, self.held, self.terminal, self.timer_ms)


@dataclass
class Judged:
    """Kinds of turned-away rows ('' for the others), closed sessions, and the open session's own rows."""
    head: Head
    kinds: np.ndarray
    expired: list[Head]
    own: np.ndarray              # rows of the session that is open or has ended here, in order
    stored: bool                 # whether the stored frames belong to that session
    ended: bool


def judged(head: Head, target: np.ndarray, us: np.ndarray, event: np.ndarray, final: np.ndarray, idle_us: int) -> Judged:
    """Rows in time order against the head, by masks: one step for each session that starts.

    Rows further apart than the limit are in two sessions whatever their targets. A stretch between such
    gaps with one target and no final frame is a session as it stands; runs of these are taken in one step.
    """
    n, i = len(us), 0
    edges = np.concatenate([[0], np.flatnonzero(us[1:] - us[:-1] > idle_us) + 1, [n]]) if n else np.zeros(1, int)
    mixed = final.astype(bool)
    mixed[1:] |= np.asarray(target[1:] != target[:-1], bool)
    mixed[edges[:-1]] = final[edges[:-1]] | np.equal(target[edges[:-1]], None).astype(bool)
    plain = ~np.logical_or.reduceat(mixed, edges[:-1]) if n else np.zeros(0, bool)
    odd = np.append(np.flatnonzero(~plain), len(plain))
    kinds = np.full(n, "", object)
    own_rows: list[np.ndarray] = []
    expired, stored, ended = [], True, False
    while i < n:
        if head.terminal is not None:
            own = target[i:] == head.target
            kinds[i:] = np.where(~own, "conflict", np.where(final[i:], "repeat", "late"))
            break
        if head.target is None or us[i] - head.last_us > idle_us:
            if head.target is not None:
                expired.append(head)
            k = int(np.searchsorted(edges, i))
            if edges[k] == i and plain[k]:
                stop = int(odd[np.searchsorted(odd, k)])
                held, timer_ms = head.held, head.timer_ms
                for a, b, name, last, at in zip(edges[k:stop].tolist(), edges[k + 1:stop + 1].tolist(), target[edges[k:stop]],
                                                us[edges[k + 1:stop + 1] - 1].tolist(), event[edges[k + 1:stop + 1] - 1].tolist()):
                    head = Head(name, int(last), int(at), b - a, held, None, timer_ms)
                    expired.append(head)
                expired.pop()                            # the last one is still open
                own_rows, stored, i = [np.arange(a, b)], False, b
                continue
            head = replace(head, target=target[i], last_us=int(us[i]), seen=0)
            own_rows, stored = [], False
        stop = min(n, i + WINDOW)
        own = target[i:stop] == head.target
        before = np.maximum.accumulate(np.concatenate([[head.last_us], np.where(own, us[i:stop], LONG_AGO)]))
        quiet = np.flatnonzero(us[i:stop] - before[:-1] > idle_us)
        length = int(quiet[0]) if len(quiet) else stop - i
        finals = np.flatnonzero(own[:length] & final[i:i + length])
        if len(finals):
            length = int(finals[0]) + 1
        mine = i + np.flatnonzero(own[:length])
        kinds[i:i + length][~own[:length]] = "conflict"
        own_rows.append(mine)
        if len(mine):
            head = replace(head, last_us=max(head.last_us, int(us[mine[-1]])), last_event=int(event[mine[-1]]), seen=head.seen + len(mine))
        if len(finals):
            head, ended = replace(head, terminal=int(event[mine[-1]])), True
        i += length
    return Judged(head, kinds, expired, np.concatenate(own_rows) if own_rows else np.zeros(0, int), stored, ended)


class AttemptProcessor(StatefulProcessor):
    """Keeps the newest frames of an attempt until its final frame arrives.

    Kinds of output: ``frame`` (the kept frames of a finished attempt, in order), ``conflict``
    (another target), ``late`` (ordinary frame after the end), ``repeat`` (final frame after the end;
    the stored result stands) and ``expired`` (a session that went idle, with its last frame and how
    many it had; it has no result). Frames count in the order of the micro-batches, and within one by
    time and event id. An attempt idle for longer than the limit starts afresh, whichever target comes
    next; an ended attempt does not reopen while it is remembered.

    A frame is written once, when it arrives; the list is cut to the newest when it has twice as many.
    With event time an attempt has one timer: idle sessions are closed and ended attempts forgotten
    when the watermark has passed them, so state does not grow with the attempts that ever were.
    """

    def __init__(self, keep: int = FRAMES_KEPT, idle_seconds: float = IDLE_SECONDS, timers: bool = True,
                 retain_seconds: float = RETAIN_SECONDS):
        self.keep, self.idle_us, self.timers = keep, int(idle_seconds * 1_000_000), timers
        self.retain_us = int(retain_seconds * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", FRAME_STATE)
        self.head = handle.getValueState("head", HEAD_STATE)

    def due_ms(self, head: Head) -> int:
        """First millisecond after the session is idle for too long, or the ended attempt is forgotten."""
        return (head.last_us + (self.idle_us if head.terminal is None else self.retain_us)) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        # A key's rows of a micro-batch come in the order of the shuffle.
        chunks = [c for c in rows if len(c)]
        if not chunks:
            return
        chunk = chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)
        order = np.lexsort((chunk["event_id"].to_numpy(), chunk["us"].to_numpy()))
        target, us, event, final = (chunk[c].to_numpy()[order] for c in ("target", "us", "event_id", "final"))
        marks = chunk["landmarks"].to_numpy()[order]
        known = self.head.get()
        old = Head(*known) if known else Head()
        done = judged(old, target, us, event, final, self.idle_us)
        head = done.head
        own = done.own[-self.keep:]
        if done.ended:
            kept = [(int(event[k]), int(us[k]), marks[k]) for k in own]
            if done.stored and old.held and len(kept) < self.keep:
                kept = [tuple(f) for f in self.frames.get()][len(kept) - self.keep:] + kept
        if head.terminal is not None or not done.stored:
            if old.held:
                self.frames.clear()
            head = replace(head, held=0)
        if head.terminal is None and len(own):
            new = [(int(event[k]), int(us[k]), None if marks[k] is None else list(map(float, marks[k]))) for k in own]
            if head.held + len(new) > 2 * self.keep:
                new = ([tuple(f) for f in self.frames.get()] + new)[-self.keep:]
                self.frames.put(new)
                head = replace(head, held=len(new))
            else:
                self.frames.appendList(new)
                head = replace(head, held=head.held + len(new))
        if self.timers and head.timer_ms is None and head.target is not None:
            head = replace(head, timer_ms=self.due_ms(head))
            self.handle.registerTimer(head.timer_ms)
        if head != old:
            self.head.update(head.row())
        away = np.flatnonzero(done.kinds != "")
        if len(away) or done.expired or done.ended:
            yield self.output(key[0], done, away, target, us, event, kept if done.ended else [])

    def output(self, name, done: Judged, away, target, us, event, kept) -> pd.DataFrame:
        def whole(value):
            return None if value != value else int(value)

        def plain(marks):
            return None if marks is None else [None if x != x else x for x in map(float, marks)]

        rows = [(done.kinds[k], target[k], whole(event[k]), whole(us[k]), None, None, None) for k in away.tolist()]
        rows += [("expired", h.target, h.last_event, h.last_us, None, h.seen, None) for h in done.expired]
        rows += [("frame", done.head.target, at, time, position, len(kept), plain(marks))
                 for position, (at, time, marks) in enumerate(kept)]
        rows = [dict(zip(FIELDS, r)) for r in rows]
        lists = [rows[k:k + PACKED] for k in range(0, len(rows), PACKED)]
        return pd.DataFrame({"attempt_id": [name] * len(lists), "rows": lists})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Closes a session that stayed idle, forgets an ended attempt; otherwise waits on."""
        known = self.head.get()
        if not known:
            return
        head, now = Head(*known), expiredTimerInfo.getExpiryTimeInMs()
        if now < self.due_ms(head):
            head = replace(head, timer_ms=self.due_ms(head))
            self.handle.registerTimer(head.timer_ms)
            self.head.update(head.row())
            return
        self.frames.clear()
        self.head.clear()
        if head.terminal is None:
            none = np.zeros(0, int)
            yield self.output(key[0], Judged(head, np.zeros(0, object), [head], none, False, False), none, none, none, none, [])

    def close(self) -> None:
        pass


def admit(frames: DataFrame, targets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejects with reason). Bad rows never fail the query."""
    known = F.lit(True) if targets is None else F.col("target").isin(*targets)
    payload = F.col("payload") if "payload" in frames.columns else F.lit(bytes([0xFF, 0xD8]))
    judged = frames.withColumn("reason", admission_reason(known, payload))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def attempts(frames: DataFrame, *, keep: int = FRAMES_KEPT, idle_seconds: float = IDLE_SECONDS, timers: bool = True,
             delay: str = "10 seconds", retain_seconds: float = RETAIN_SECONDS) -> DataFrame:
    """Stream (attempt_id, target, ts, event_id, final, landmarks) to (attempt_id, kind, target, event_id, ts,
    position, frames, landmarks) rows.

    With ``timers`` sessions go by event time with a watermark of ``delay``: idle ones are closed and ended
    attempts forgotten after ``retain_seconds``. Frames later than the watermark are not used; ``late_rows``
    counts them. Without timers idleness shows when the next frame arrives, and nothing is ever late.
    """
    rows = frames.select(
        F.col("attempt_id").cast("string").alias("attempt_id"), "target",
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"),
        F.coalesce("final", F.lit(False)).alias("final"),
        (F.col("landmarks") if "landmarks" in frames.columns
         else F.lit(None)).cast("array<double>").alias("landmarks"))
    if timers:
        rows = rows.withWatermark("ts", delay)
    folded = rows.withColumn("us", F.unix_micros("ts")).groupBy("attempt_id").transformWithStateInPandas(
        statefulProcessor=AttemptProcessor(keep, idle_seconds, timers, retain_seconds), outputStructType=OUTPUT,
        outputMode="append", timeMode="eventTime" if timers else "none")
    folded = folded.select("attempt_id", F.inline("rows"))
    return folded.withColumn("ts", F.timestamp_micros("us")).select(
        "attempt_id", "kind", "target", "event_id", "ts", "position", "frames", "landmarks")


def _state(query: StreamingQuery, name: str) -> list[int]:
    """A figure of the stateful step after every reported micro-batch."""
    reports = (json.loads(p.json if isinstance(p.json, str) else p.json()) if not isinstance(p, dict) else p for p in query.recentProgress)
    return [r["stateOperators"][0][name] for r in reports if r.get("stateOperators")]


def late_rows(query: StreamingQuery) -> int:
    """Frames dropped as later than the watermark, by the query's recent progress."""
    return sum(_state(query, "numRowsDroppedByWatermark"))


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after every recent micro-batch."""
    return _state(query, "numRowsTotal")
