"""Stitching tracker ids to physical persons: sequential by nature, one group per event.

Detections of an event go through in order of frame and falling confidence. A detection close to one that was
already accepted in its frame is dropped as a duplicate. Otherwise it continues its track's entity, else the
best overlapping recent entity, else one that plausibly passed the line, else it starts a new entity. Entities are
on probation until they move or stay confident; those that do neither are suppressed for good. Only detections of
trusted entities are accepted and can make others duplicates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchlake.operators.tracks import entity_crossings
from watchlake.params import CrossingParams, MatchParams, TrustParams


def _iou(a: tuple, b: tuple) -> float:
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / (_area(a) + _area(b) - w * h)


def _area(a: tuple) -> float:
    return max(1.0, max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]))


def _diagonal(a: tuple) -> float:
    return (max(0.0, a[2] - a[0]) ** 2 + max(0.0, a[3] - a[1]) ** 2) ** 0.5


def _apart(a: tuple, b: tuple) -> float:
    return (((a[0] + a[2] - b[0] - b[2]) / 2) ** 2 + ((a[1] + a[3] - b[1] - b[3]) / 2) ** 2) ** 0.5


class Trust:
    """Whether an entity is on probation, trusted or suppressed, from how far it moved and how confident it was."""

    def __init__(self, x: float, y: float):
        self.x, self.y, self.far, self.total, self.n, self.state = x, y, 0.0, 0.0, 0, "probation"

    def update(self, x: float, y: float, conf: float, p: TrustParams) -> str:
        if self.state == "suppressed":
            return self.state
        self.far = max(self.far, ((x - self.x) ** 2 + (y - self.y) ** 2) ** 0.5)
        self.total += conf
        self.n += 1
        sure = self.total / self.n >= p.confidence
        if self.n >= p.updates and self.far <= p.drift_px and not sure:
            self.state = "suppressed"
        elif self.far > p.drift_px or (self.n >= p.updates and sure):
            self.state = "trusted"
        return self.state


class Resolver:
    """State of one event; small: an entity is its last box and frame, and its trust."""

    def __init__(self, fps: float, stride: int, line_y: float, p: MatchParams = MatchParams(), trust: TrustParams = TrustParams()):
        self.p, self.trusts, self.line_y, self.most_gap = p, trust, line_y, int(p.gap_s * fps * stride)
        self.boxes: list[tuple] = []
        self.sizes: list[tuple[float, bool]] = []  # of each box: its diagonal, 1 at least, and whether it is above the line
        self.frames: list[int] = []
        self.trust: list[Trust] = []
        self.of_track: dict[int, int] = {}

    def dump(self) -> tuple[list[tuple], list[tuple[int, int]]]:
        """The state as rows: one an entity, one a track."""
        trust = [(t.x, t.y, t.far, t.total, t.n, t.state) for t in self.trust]
        return [(e, *map(float, b), f, *t) for e, (b, f, t) in enumerate(zip(self.boxes, self.frames, trust))], list(self.of_track.items())

    def load(self, entities: Iterable[tuple], tracks: Iterable[tuple[int, int]]) -> None:
        """Take over what ``dump`` gave."""
        for _, x1, y1, x2, y2, frame, x, y, far, total, n, state in sorted(entities):
            self.boxes.append((x1, y1, x2, y2))
            self.sizes.append(self._size(self.boxes[-1]))
            self.frames.append(frame)
            t = Trust(x, y)
            t.far, t.total, t.n, t.state = far, total, n, state
            self.trust.append(t)
        self.of_track = dict(tracks)

    def _size(self, box: tuple) -> tuple[float, bool]:
        return max(1.0, _diagonal(box)), self._above(box)

    def _share(self, gap: int) -> float:
        """A gap's share of the largest."""
        return min(1.0, max(0.0, gap / max(1.0, self.most_gap)))

    def _overlapping(self, frame: int, box: tuple) -> int | None:
        """Of the entities seen within the largest gap, the first that overlaps most, if it does so enough."""
        x1, y1, x2, y2 = box
        oldest, e, over = frame - self.most_gap, None, -1.0
        for k, (last, (u1, v1, u2, v2)) in enumerate(zip(self.frames, self.boxes)):
            if last >= oldest:
                got = _iou(box, (u1, v1, u2, v2)) if x1 < u2 and u1 < x2 and y1 < v2 and v1 < y2 else 0.0
                if got > over:
                    e, over = k, got
        if e is None:
            return None
        g, other = self._share(frame - self.frames[e]), self.boxes[e]
        if over >= min(0.9, self.p.iou + 0.2 * g):
            return e
        if over >= min(0.8, self.p.iou_near + 0.2 * g):
            ratio = max(_area(box), _area(other)) / min(_area(box), _area(other))
            near = _apart(box, other) <= max(0.15, self.p.distance * (1 - 0.5 * g)) * max(1.0, _diagonal(other))
            if near and ratio <= max(1.3, self.p.size_ratio - 0.3 * g):
                return e
        return None

    def _above(self, box: tuple) -> bool:
        return int((box[1] + box[3]) / 2) < self.line_y

    def _across(self, frame: int, box: tuple) -> int | None:
        """The first of the entities seen within the largest gap that is near on the other side of the line, or nearer on this one."""
        oldest, above = frame - self.most_gap, self._above(box)
        for e, (last, (allowed, side)) in enumerate(zip(self.frames, self.sizes)):
            if last < oldest:
                continue
            other, most = self.boxes[e], 0.61 * allowed  # nothing further away than that counts
            if abs(box[0] + box[2] - other[0] - other[2]) > 2 * most or abs(box[1] + box[3] - other[1] - other[3]) > 2 * most:
                continue
            g, gone = self._share(frame - last), _apart(box, other)
            if above != side:
                if gone <= 0.6 * (1 - 0.5 * g) * allowed:
                    return e
            elif g <= 0.3 and gone <= 0.4 * allowed:
                return e
        return None

    def _repeats(self, box: tuple, accepted: list[tuple]) -> bool:
        for b in accepted:
            size = max(_diagonal(box), _diagonal(b))
            if _iou(box, b) >= self.p.duplicate_iou or size > 0 and _apart(box, b) / size <= self.p.duplicate_distance:
                return True
        return False

    def frame(self, frame: int, people: list[tuple[int, float, tuple]]) -> list[tuple[int, str] | None]:
        """(entity, state) of each (track, confidence, box), most confident first; None for duplicates."""
        out: list[tuple[int, str] | None] = []
        accepted: list[tuple] = []
        used: set[int] = set()
        for track, conf, box in people:
            if self._repeats(box, accepted):
                out.append(None)
                continue
            e = self.of_track.get(track)
            refresh = True
            if e is None or e in used or frame - self.frames[e] > self.most_gap:
                e = self._overlapping(frame, box)
                if e is None or e in used:
                    e, refresh = self._across(frame, box), False  # a bridged entity keeps its last box
                if e is None or e in used:
                    e, refresh = len(self.boxes), True
                    self.boxes.append(box)
                    self.sizes.append(self._size(box))
                    self.frames.append(frame)
                    self.trust.append(Trust((box[0] + box[2]) * 0.5, (box[1] + box[3]) * 0.5))
            if refresh:
                self.boxes[e], self.frames[e], self.sizes[e] = box, frame, self._size(box)
            self.of_track[track] = e
            used.add(e)
            state = self.trust[e].update((box[0] + box[2]) * 0.5, (box[1] + box[3]) * 0.5, conf, self.trusts)
            if state == "trusted":
                accepted.append(box)
            out.append((e, state))
        return out


def _go_through(state: Resolver, frame: int, people: list[tuple[int, float, tuple]]) -> Iterator[tuple]:
    """What the resolver makes of a frame: (frame, track, entity, state, middle) of those that aren't duplicates."""
    for (t, _, b), got in zip(people, state.frame(frame, people)):
        if got:
            yield frame, t, *got, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def followed(state: Resolver, pdf: pd.DataFrame) -> pd.DataFrame:
    """What the resolver makes of some detections, which it goes through by frame and falling confidence."""
    pdf, rows = pdf.sort_values(["frame", "conf", "track_id", "x1", "y1", "x2", "y2"], ascending=[True, False, True, True, True, True, True]), []
    columns = (pdf[c].tolist() for c in ["frame", "track_id", "conf", "x1", "y1", "x2", "y2"])
    for frame, part in groupby(zip(*columns), key=lambda r: r[0]):
        rows += _go_through(state, int(frame), [(int(t), float(c), tuple(map(float, b))) for _, t, c, *b in part])
    return pd.DataFrame(rows, columns=["frame", "track_id", "entity_id", "state", "cx", "cy"])


RESOLVED = "video long, clip_index long, frame long, track_id long, entity_id long, state string, cx double, cy double"


def resolve(
    people: DataFrame, fps: float, stride: int = 1, line_y: float = 810.0, p: MatchParams = MatchParams(), trust: TrustParams = TrustParams()
) -> DataFrame:
    """The columns of ``RESOLVED`` of people's detections that aren't duplicates; needs conf and x1, y1, x2, y2.

    Entities are numbered from 0 in each event. Equal confidences go by track id, then by box. Events go to different tasks,
    sorted; a task goes through its rows as they come and holds the state of one event.
    """
    kind = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for c, t in (x.split() for x in RESOLVED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for event, mine in groupby(rows, key=lambda r: r[:2]):
            state = Resolver(fps, stride, line_y, p, trust)
            for frame, part in groupby(mine, key=lambda r: r[2]):
                out += ((*event, *r) for r in _go_through(state, frame, [(t, c, tuple(b)) for _, _, _, t, c, *b in part]))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    event, boxes = ["video", "clip_index"], ["x1", "y1", "x2", "y2"]
    rows = people.select(*event, "frame", "track_id", *(F.col(c).cast("double").alias(c) for c in ["conf", *boxes]))
    rows = rows.repartition(*event).sortWithinPartitions(*event, "frame", F.desc("conf"), "track_id", *boxes)
    return rows.mapInArrow(run, RESOLVED)


def suppressed_tracks(resolved: DataFrame) -> DataFrame:
    """(video, clip_index, track_id): all tracks that were ever part of an entity that ended suppressed."""
    gone = resolved.where("state = 'suppressed'").select("video", "clip_index", "entity_id").distinct()
    return resolved.join(gone, ["video", "clip_index", "entity_id"], "left_semi").select("video", "clip_index", "track_id").distinct()


def entity_states(resolved: DataFrame, fps: float, p: CrossingParams = CrossingParams()) -> DataFrame:
    """(video, clip_index, entity_id, first_frame, last_frame, up, down): trusted entities with their net crossings.

    An entity's crossings are told from its samples since it is trusted, as ``tracks.entity_crossings`` does.
    """
    seen = resolved.where("state = 'trusted'").withColumn("event", F.struct("video", "clip_index"))
    spans = seen.groupBy("event", "entity_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    moves = entity_crossings(seen.drop("video").withColumnRenamed("event", "video"), fps, p).withColumnRenamed("video", "event")
    return spans.join(moves, ["event", "entity_id"]).select("event.video", "event.clip_index", "entity_id", "first_frame", "last_frame", "up", "down")
