"""Streaming twins of batch operators. Event times are timestamps; watermarks are stated where state must end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchlake.operators import entities
from watchlake.operators import logs as L
from watchlake.operators import ops as O
from watchlake.params import MatchParams, TrustParams
from watchlake.sources.store import LiveDayStore


def motion_sessions(frames: DataFrame, gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """(video, start, end, frames) of sessions; a session ends when the watermark passes it, later frames are dropped.

    ``end`` is the last frame's time. Frames exactly one gap apart belong together.
    """
    rows = frames.withWatermark("ts", late)
    got = rows.groupBy("video", F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("end"), F.count("*").alias("frames"))
    return got.select("video", F.col("w.start").alias("start"), "end", "frames")


def live_video_summary(lines: DataFrame) -> DataFrame:
    """The per-video summary over a stream of (n, day, line), in update or complete mode."""
    return L.video_summary(L.with_metrics(L.parse_lines(lines)))


def live_state(points: DataFrame) -> DataFrame:
    """(day, state, at_minute, events) by event time, in update or complete mode."""
    at = F.struct("minute", "ts", "n")
    return points.groupBy("day").agg(F.max_by("type", at).alias("state"), F.max("minute").alias("at_minute"), F.count("*").alias("events"))


def once(rows: DataFrame, *key: str, late: str = "1 hour") -> DataFrame:
    """Rows without exact repeats of a key that come within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def ledger_updates(updates: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """(path, status, extras) after each batch of ledger updates (path, seq, status, extras), update mode.

    ``ops.ledger_state`` as a streaming aggregation: a path's state is what decides its status, and its fields' last values,
    each with its place, so rows may come in any order. Extras are numbers; one keeps its last value that isn't null.
    """
    return O.ledger_state(updates.select("path", "seq", "status", *(F.col(c).cast("double").alias(c) for c in extras)), extras)


class _Waiting(StatefulProcessor):
    """Rows of a key that wait until the watermark has passed them, and then go on in their order.

    A timer at the last row of each batch lets go what the watermark covers by then. ``columns`` are the names and types of
    what a row keeps, time in milliseconds first. The rows of a chunk lie in the state as one record array, so that a
    chunk is one call, however many rows it has.
    """

    columns = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kind = np.dtype([(c.split()[0], {"bigint": "<i8", "double": "<f8"}[c.split()[1]]) for c in self.columns.split(", ")])
        self.names = list(self.kind.names)

    def _packed(self, pdf: pd.DataFrame) -> tuple[bytes]:
        rows = np.empty(len(pdf), self.kind)
        for c in self.names:
            rows[c] = pdf[c].to_numpy()
        return (rows.tobytes(),)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, chunks = None, []
        for pdf in rows:
            chunks.append(self._packed(pdf))
            latest = max(latest or 0, int(pdf[self.names[0]].max()))
        if latest is not None:
            self.waiting.appendList(chunks)
            self.handle.registerTimer(latest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = np.concatenate([np.empty(0, self.kind), *(np.frombuffer(r[0], self.kind) for r in self.waiting.get())])
        rows = pd.DataFrame({c: rows[c] for c in self.names})
        late = rows[self.names[0]] > passed
        if late.any():
            self.waiting.put([self._packed(rows[late])])
        else:
            self.waiting.clear()
        if len(rows) and not late.all():
            yield from self.go_on(key, rows[~late], not late.any(), passed)

    def go_on(self, key, rows: pd.DataFrame, all_: bool, passed: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def passing(at: np.ndarray, cooldown: int, last: int | None, held: int) -> tuple[list[tuple[int, int]], int | None, int]:
    """(place, rows held before it) of the sorted times that pass, then the last that did and how many were held since.

    From one that passes the next is looked up, so the steps are as many as pass.
    """
    out, i, n = [], 0 if last is None else int(np.searchsorted(at, last + cooldown)), len(at)
    if i >= n:
        return [], last, held + n
    out.append((i, held + i))
    while (j := max(i + 1, int(np.searchsorted(at, at[i] + cooldown)))) < n:
        out.append((j, j - i - 1))
        i = j
    return out, int(at[i]), n - i - 1


class _Throttle(_Waiting):
    """When a key last passed, and how many rows were held since."""

    columns = "ms bigint, at bigint, n bigint"

    def __init__(self, cooldown: int):
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.passed = handle.getValueState("passed", "last bigint, held bigint")

    def go_on(self, key, rows: pd.DataFrame, all_: bool, passed: int) -> Iterator[pd.DataFrame]:
        last, held = self.passed.get() if self.passed.exists() else (None, 0)
        at, n = rows["at"].to_numpy(), rows["n"].to_numpy()
        order = np.lexsort((n, at))
        out, last, held = passing(at[order], self.cooldown, last, held)
        self.passed.update((last, held))
        n = n[order]
        yield pd.DataFrame([(key[0], int(n[i]), h) for i, h in out], columns=["key", "n", "suppressed"])


def throttled_stream(rows: DataFrame, cooldown: int, late: str = "10 minutes") -> DataFrame:
    """(key, n, suppressed) of rows (key, ts, at, n) that pass, append mode.

    Rows may come in any order within ``late`` of event time; they are decided by (at, n) once the watermark has passed
    their ts. What comes later than that is dropped.
    """
    timed = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("key").transformWithStateInPandas(_Throttle(cooldown), "key string, n long, suppressed long", "Append", "EventTime")


class _Entities(_Waiting):
    """The resolver of one event, whose entities and tracks lie in list states between batches."""

    columns = "ms bigint, frame bigint, track_id bigint, conf double, x1 double, y1 double, x2 double, y2 double"

    def __init__(self, *settings, idle_ms: int):
        self.settings, self.idle_ms = settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entities = handle.getListState("entities", "id bigint, x1 double, y1 double, x2 double, y2 double, frame bigint, x double, y double, far double, total double, n bigint, state string")
        self.tracks = handle.getListState("tracks", "track bigint, entity bigint")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        mine = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.exists() and not any(t > mine for t in self.handle.listTimers()):  # quiet for as long as an event may pause
            self.entities.clear()
            self.tracks.clear()

    def go_on(self, key, rows: pd.DataFrame, all_: bool, passed: int) -> Iterator[pd.DataFrame]:
        state = entities.Resolver(*self.settings)
        state.load(map(tuple, self.entities.get()), map(tuple, self.tracks.get()))
        out = entities.followed(state, rows)
        found, tracks = state.dump()
        self.entities.put(found)
        self.tracks.put(tracks)
        if all_:
            self.handle.registerTimer(passed + self.idle_ms)
        yield out.assign(video=key[0], clip_index=key[1])[["video", "clip_index", *out.columns]]


def resolved_stream(
    people: DataFrame, fps: float, stride: int = 1, line_y: float = 810.0, p: MatchParams = MatchParams(), trust: TrustParams = TrustParams(), late: str = "10 seconds", idle: float = 600.0
) -> DataFrame:
    """``entities.resolve`` over a stream of people's detections with their time ts, append mode.

    Detections of an event (video, clip_index) may come in any order within ``late``; they go through the resolver by frame
    once the watermark has passed them. Its entities and tracks are kept as list states until the event has been quiet
    for ``idle`` seconds of event time. (A watermark starts at 1970; times until then are late.)
    """
    timed = people.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    state = _Entities(fps, stride, line_y, p, trust, idle_ms=int(idle * 1000))
    return timed.groupBy("video", "clip_index").transformWithStateInPandas(state, entities.RESOLVED, "Append", "EventTime")


def day_store_sink(store: LiveDayStore):
    """For ``foreachBatch`` over (n, day, line): add the states of a batch's lines to the store, reading nothing else."""

    def sink(batch: DataFrame, number: int) -> None:
        store.add(L.with_metrics(L.parse_lines(batch)), number)

    return sink


__all__ = ["day_store_sink", "ledger_updates", "live_state", "live_video_summary", "motion_sessions", "once", "resolved_stream", "throttled_stream"]
