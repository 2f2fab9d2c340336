"""Rules at their boundaries, and sequential operators against plain folds."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from watchlake.functions import columns as C
from watchlake.functions.ranks import numbered
from watchlake.operators import entities, logs, ops, presence, reid, tracks
from watchlake.operators.graph import connected
from watchlake.params import CrossingParams, MatchParams, ReidParams, TrapParams, TrustParams
from watchlake.sources import configs, store
from watchlake.sources import logs as log_files

DAY = "2024-05-06"


def entries(spark, texts, video="Cam1_00_20240506101112.mp4"):
    rows = [(k, datetime(2024, 5, 6).date(), t if t.startswith("raw:") else f"{DAY} 10:00:{k:02d} - {lv} - {f'[{v}] ' if v else ''}{t}") for k, (t, lv, v) in enumerate(
        (x if isinstance(x, tuple) else (x, "INFO", video)) for x in texts)]
    return logs.with_metrics(logs.parse_lines(spark.createDataFrame(rows, "n long, day date, line string")))


@pytest.mark.parametrize(
    ("lines", "status", "error"),
    [
        (["Status: error", "Motion detection complete. Status: no_person"], "no_person", False),
        (["Motion detection complete. Status: no_person", "Status: error"], "no_person", True),
        (["Status: no_motion", "Status: gate_crossing"], "gate_crossing", False),
        ([("anything", "CRITICAL", "a.mp4")], "error", False),
        ([("Status: no_person", "ERROR", "a.mp4")], "no_person", True),
        (["nothing"], None, False),
    ],
)
def test_status_fold(spark, lines, status, error):
    r = logs.video_summary(entries(spark, lines, "a.mp4")).first()
    assert (r["status"], r["pipeline_error"]) == (status, error)


def test_parsing_quirks(spark):
    day = datetime(2024, 5, 6).date()
    lines = [f"{DAY} 10:00:00 - INFO - [W] no bracket", f"[W] {DAY} 10:00:00 - INFO - x", "2024-05-07 10:00:00 - INFO - other day", "junk",
             f"{DAY} 25:00:00 - INFO - bad time", f"{DAY} 10:00:00 - INFO - [v] [W] c"]
    got = logs.parse_lines(spark.createDataFrame([(k, day, x) for k, x in enumerate(lines)], "n long, day date, line string")).orderBy("n").collect()
    assert [(r["n"], r["video"], r["content"], r["worker"]) for r in got] == [(0, "W", "no bracket", False), (1, None, "x", True), (5, "v", "c", True)]


def test_counts_and_caps(spark):
    m = entries(spark, ["Full processing took 900 seconds", ("Motion detection took 400 seconds", "INFO", None), ("Motion detection took 100 seconds", "INFO", "b"),
                        "Gate crossing detected! Direction: both", ("Gate crossing detected! Direction: up", "INFO", None)])
    r = logs.day_statistics(m).first()
    assert (r["videos_total"], r["full_avg"], r["full_max"], r["md_avg"], r["up"], r["down"]) == (1, 300, 900, 200, 2, 1)


AWAY, BACK, GONE = "Reaction detected: object went away.", "Reaction detected: object came back.", "Reaction removed."


def name(hh, mm, cam=1):
    return f"Cam{cam}_00_20240506{hh:02d}{mm:02d}00.mp4"


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([(AWAY, 8, 0), (BACK, 9, 14)], [("08:00", "09:14", "1h14m")]),
        ([(BACK, 7, 0), (AWAY, 8, 0)], [(None, "07:00", None), ("08:00", None, None)]),
        ([(AWAY, 8, 0), (AWAY, 8, 5), (BACK, 9, 5), (BACK, 10, 0)], [("08:00", "10:00", "2h"), ("08:05", "09:05", "1h")]),
        ([(AWAY, 8, 0), (GONE, 8, 0)], []),
        ([(AWAY, 8, 0), (BACK, 8, 0, 2)], [("08:00", None, None)]),  # a back that isn't later is lost
    ],
)
def test_intervals(spark, events, want):
    m = entries(spark, [(t, "INFO", name(h, mi, *c)) for t, h, mi, *c in events])
    got = presence.intervals(presence.interval_events(m)).orderBy("pos").collect()
    assert [(r["start"], r["end"], r["dur"]) for r in got] == want


def test_name_times(spark):
    ts = F.lit("2024-05-06 10:20:30").cast("timestamp")
    of = lambda v: spark.range(1).select(C.hhmm(F.lit(v), ts), C.hhmmss(F.lit(v), ts), C.mm_ss(F.lit(v), ts)).first()
    assert tuple(of("06M45S_1.mp4")) == ("10:06", "10:20:30", "06M45S")
    assert tuple(of("9999_x.mp4")) == ("10:99", "10:20:30", "99M99S")
    assert tuple(of(name(7, 8))) == ("07:08", "07:08:00", "08M00S")
    assert tuple(of("plain.mp4")) == ("10:20", "10:20:30", "20M30S")


@pytest.mark.parametrize(("frames", "events"), [([0, 75], [(0, 75)]), ([0, 76], [(0, 0), (76, 76)]), ([5], [(5, 5)]), ([1, 60, 130, 300, 301], [(1, 130), (300, 301)])])
def test_motion_gap(spark, frames, events):
    df = spark.createDataFrame([(1, f) for f in frames + frames], "video long, frame long")
    got = tracks.motion_events(df, 25.0).orderBy("clip_index").collect()
    assert [(r["start_frame"], r["end_frame"]) for r in got] == events


def test_motion_events_equal_a_fold(spark):
    rng = random.Random(2)
    rows = [(v, rng.randrange(0, 6000)) for v in range(5) for _ in range(80)]
    want = []
    for v in range(5):
        fs = sorted({f for x, f in rows if x == v})
        runs = [[fs[0], fs[0]]]
        for f in fs[1:]:
            if f - runs[-1][1] > 75:
                runs.append([f, f])
            runs[-1][1] = f
        want += [(v, k, a, b) for k, (a, b) in enumerate(runs)]
    got = tracks.motion_events(spark.createDataFrame(rows, "video long, frame long"), 25.0).collect()
    assert sorted((r["video"], r["clip_index"], r["start_frame"], r["end_frame"]) for r in got) == want


@pytest.mark.parametrize(("seconds", "kind"), [(0.8, "significant"), (0.79, "insignificant"), (0.2, "insignificant"), (0.19, "noise")])
def test_event_classes(spark, seconds, kind):
    assert tracks.classify_events(spark.createDataFrame([(seconds,)], "duration_s double")).first()["class"] == kind


def track(spark, ys, xs=None, confs=None):
    return spark.createDataFrame([(1, k, 7, "person", (confs or [0.9] * 99)[k], float((xs or ys)[k]), float(y)) for k, y in enumerate(ys)], "video long, frame long, track_id long, cls string, conf double, cx double, cy double")


def test_crossings(spark):
    df = track(spark, [800, 810, 811, 810, 800])
    assert [(r["frame"], r["direction"]) for r in tracks.plain_crossings(df, 810).orderBy("frame").collect()] == [(1, "down"), (3, "up")]
    slow = track(spark, [790] * 5 + [830] * 60)
    assert [(r["frame"], r["direction"]) for r in tracks.confirmed_crossings(slow, 25.0).collect()] == [(5, "down")]
    back = track(spark, [790] * 5 + [830] * 10 + [790] * 5)
    assert [r["direction"] for r in tracks.confirmed_crossings(back, 25.0).orderBy("frame").collect()] == ["up"]
    flicker = track(spark, [790, 830, 790, 830, 812])
    assert tracks.band_crossings(flicker, CrossingParams()).count() == 3
    assert tracks.net_directions(back, tracks.plain_crossings(back, 810), 810).select("up", "down").first() == (1, 1)


def test_trust_is_sticky_and_suppression_final(spark):
    still = track(spark, [800] * 25, [100] * 25, [0.5] * 25)
    states = [r["state"] for r in tracks.trust(still, TrustParams()).orderBy("frame").collect()]
    assert states == ["probation"] * 19 + ["suppressed"] * 6
    moves = track(spark, [800] * 25, [100] * 3 + [120] * 22, [0.5] * 25)
    assert [r["state"] for r in tracks.trust(moves, TrustParams()).orderBy("frame").collect()] == ["probation"] * 3 + ["trusted"] * 22


def test_speed_trap_equals_a_fold(spark):
    rng = random.Random(6)
    xs = [rng.choice([500, 600, 900, 1300, 1500]) for _ in range(99)]
    want, start = [], None
    for k in range(1, 99):
        a, b = xs[k - 1], xs[k]
        if a == b:
            continue
        hits = sorted((x, n) for n, x in ((1, 600), (2, 1300)) if (a - x) * (b - x) <= 0)
        for _, n in hits if b > a else hits[::-1]:
            if start and start[0] != n and k > start[1]:
                kmh = 5.0 / ((k - start[1]) / 25.0) * 3.6
                if kmh <= 100:
                    want.append((k, "->" if start[0] == 1 else "<-"))
            start = (n, k)
    got = tracks.speed_trap(track(spark, [800] * 99, xs, [0.9] * 99).withColumn("clip_index", F.lit(0)), 25.0, TrapParams(x1=600, x2=1300)).orderBy("frame").collect()
    assert [(r["frame"], r["direction"]) for r in got] == want


def test_polygon_edges(spark):
    p = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in [(0, 0), (10, 0), (10, 10), (0, 10)]))
    at = lambda x, y: spark.range(1).select(C.in_polygon(F.lit(x), F.lit(y), p)).first()[0]
    assert all(at(*q) for q in [(0, 0), (5, 0), (10, 5), (5, 5)]) and not any(at(*q) for q in [(-1, 5), (11, 10), (5, 11)])


def test_entities(spark):
    box = lambda x, y: (x - 20.0, y - 60.0, x + 20.0, y + 60.0)
    ids = lambda r, f, people: [got and got[0] for got in r.frame(f, [(t, 0.9, b) for t, b in people])]
    at_once = TrustParams(drift_px=-1.0)
    r = entities.Resolver(25.0, 1, 810.0, trust=at_once)
    assert ids(r, 1, [(1, box(100, 700)), (2, box(500, 700))]) == [0, 1]
    assert ids(r, 2, [(1, box(102, 700)), (9, box(101, 700))]) == [0, None]  # a duplicate of an accepted one
    assert ids(r, 3, [(9, box(104, 700))]) == [0]  # a new track over the old box
    assert ids(r, 200, [(1, box(104, 700))]) == [2]  # too long ago
    assert ids(r, 201, [(5, box(104, 700)), (6, box(106, 760))]) == [2, 3]
    assert entities.Resolver(25.0, 1, 810.0, MatchParams()).frame(0, []) == []
    on_probation = entities.Resolver(25.0, 1, 810.0)
    assert ids(on_probation, 1, [(1, box(100, 700)), (9, box(101, 700))]) == [0, 1]  # only trusted ones make duplicates


def test_entity_sizes_are_those_of_the_box_before():
    r = entities.Resolver(25.0, 1, 1000.0, trust=TrustParams(drift_px=-1.0))
    r.frame(1, [(1, 0.9, (0.0, 0.0, 10.0, 10.0))])
    assert r.frame(2, [(2, 0.9, (-80.0, -80.0, 110.0, 110.0))])[0][0] == 1  # centres 14 apart: far for the small box, near for the large one
    r = entities.Resolver(25.0, 1, 1000.0, trust=TrustParams(drift_px=-1.0))
    r.frame(1, [(1, 0.9, (-80.0, -80.0, 110.0, 110.0))])
    assert r.frame(2, [(2, 0.9, (0.0, 0.0, 10.0, 10.0))])[0][0] == 0


def people(rng, n=240):
    rows = []
    for k in range(n):
        x, y = rng.uniform(0, 260), rng.uniform(740, 880)
        rows.append((1, k // 120, k // 4, rng.randrange(5), rng.choice([0.4, 0.6, 0.95]), x, y, x + rng.uniform(20, 60), y + rng.uniform(60, 140)))
    return rows


PEOPLE = "video long, clip_index long, frame long, track_id long, conf double, x1 double, y1 double, x2 double, y2 double"


def fold_entities(rows, fps=25.0, line=810.0, drift=30.0, updates=6, sure=0.7):
    """The stitching rules once more, as one plain loop over one event."""
    import math

    area = lambda b: max(1.0, (b[2] - b[0]) * (b[3] - b[1]))
    diag = lambda b: math.hypot(b[2] - b[0], b[3] - b[1])
    mid = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    gap_most, ents, tracks_, out = int(2 * fps), [], {}, []

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0.0

    for frame in sorted({r[2] for r in rows}):
        taken, accepted = set(), []
        for _, _, _, track, conf, *b in sorted((r for r in rows if r[2] == frame), key=lambda r: (-r[4], *r[3:4], *r[5:])):
            if any(overlap(b, o) >= 0.7 or math.dist(mid(b), mid(o)) / max(diag(b), diag(o)) <= 0.25 for o in accepted):
                continue
            live = [e for e in ents if frame - e["last"] <= gap_most]
            ratio = lambda e: (frame - e["last"]) / gap_most
            hit = tracks_.get(track)
            kind = "own"
            if hit is None or hit["id"] in taken or hit not in live:
                hit = max((e for e in live if overlap(b, e["box"]) > 0), key=lambda e: (overlap(b, e["box"]), -e["id"]), default=None)
                kind = "over"
                if hit:
                    o, g = hit["box"], ratio(hit)
                    iou_, sizes = overlap(b, o), max(area(b), area(o)) / min(area(b), area(o))
                    near = math.dist(mid(b), mid(o)) <= max(0.15, 0.35 * (1 - 0.5 * g)) * max(1.0, diag(o))
                    strong = iou_ >= min(0.9, 0.5 + 0.2 * g)
                    if hit["id"] in taken or not (strong or (iou_ >= min(0.8, 0.3 + 0.2 * g) and near and sizes <= max(1.3, 1.6 - 0.3 * g))):
                        hit = None
            if hit is None:
                kind = "bridge"
                for e in live:
                    d, size, g = math.dist(mid(b), mid(e["box"])), max(1.0, diag(e["box"])), ratio(e)
                    other_side = (int(mid(b)[1]) < line) != (int(mid(e["box"])[1]) < line)
                    if (other_side and d <= 0.6 * (1 - 0.5 * g) * size) or (not other_side and g <= 0.3 and d <= 0.4 * size):
                        hit = e
                        break
                if hit is None or hit["id"] in taken:
                    hit = {"id": len(ents), "box": b, "last": frame, "from": mid(b), "far": 0.0, "sum": 0.0, "n": 0, "state": "probation"}
                    ents.append(hit)
            if kind != "bridge":
                hit["box"], hit["last"] = b, frame
            taken.add(hit["id"])
            tracks_[track] = hit
            if hit["state"] != "suppressed":
                hit["far"], hit["sum"], hit["n"] = max(hit["far"], math.dist(mid(b), hit["from"])), hit["sum"] + conf, hit["n"] + 1
                mean = hit["sum"] / hit["n"]
                if hit["n"] >= updates and hit["far"] <= drift and mean < sure:
                    hit["state"] = "suppressed"
                elif hit["far"] > drift or (hit["n"] >= updates and mean >= sure):
                    hit["state"] = "trusted"
            if hit["state"] == "trusted":
                accepted.append(b)
            out.append((frame, track, hit["id"], hit["state"]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_entities_equal_a_fold(spark, seed):
    rows = people(random.Random(seed))
    got = entities.resolve(spark.createDataFrame(rows, PEOPLE), 25.0, trust=TrustParams(drift_px=30.0, updates=6, confidence=0.7)).collect()
    want = [(c, *x) for c in {r[1] for r in rows} for x in fold_entities([r for r in rows if r[1] == c])]
    assert sorted((r["clip_index"], r["frame"], r["track_id"], r["entity_id"], r["state"]) for r in got) == sorted(want)


def test_entities_do_not_hang_on_row_order(spark):
    rng = random.Random(3)
    rows = people(rng)
    run = lambda rs: sorted(map(tuple, entities.resolve(spark.createDataFrame(rs, PEOPLE), 25.0).collect()))
    assert run(rows) == run(rng.sample(rows, len(rows)))


def test_entity_states(spark):
    walk = [(1, 0, f, 1 if f < 30 else 2, 0.9, 80.0, 640.0 + 4 * f, 120.0, 760.0 + 4 * f) for f in range(60)]
    still = [(1, 0, f, 5, 0.5, 900.0, 640.0, 940.0, 760.0) for f in range(60)]
    resolved = entities.resolve(spark.createDataFrame(walk + still, PEOPLE), 25.0)
    got = entities.entity_states(resolved, 25.0, CrossingParams(dwell_s=0.2)).collect()
    assert [(r["entity_id"], r["up"], r["down"]) for r in got] == [(0, 0, 1)]
    assert [r["track_id"] for r in entities.suppressed_tracks(resolved).collect()] == [5]


def test_sides_at_the_edges(spark):
    p = CrossingParams(line_y=100, tolerance=6, dwell_s=0.08)
    row = lambda ys: [(r["band"], r["streak"], r["side"]) for r in tracks.stable_sides(track(spark, ys), p).orderBy("frame").collect()]
    assert row([94, 94, 94, 95, 106]) == [(True, 0, None), (True, 1, None), (True, 2, "above"), (True, 0, "above"), (True, 1, "above")]
    assert row([80, 80, 120, 120]) == [(False, 0, None), (False, 1, None), (False, 2, "below"), (False, 3, "below")]  # streaks go on across the line
    ways = lambda ys: [r["direction"] for r in tracks.band_crossings(track(spark, ys), p).orderBy("frame").collect()]
    assert ways([94, 106]) == ["down"] and ways([106, 94]) == ["up"] and ways([95, 106]) == [] and ways([94, 100, 106]) == []
    lit = lambda ys: [r["frame"] for r in tracks.highlights(track(spark, ys), p).orderBy("frame").collect()]
    assert lit([100, 80, 80]) == [0]  # the first sample opens no window
    assert lit([80, 106, 120, 120, 120, 120, 120, 120]) == [1, 2, 3, 4, 5, 6]
    assert lit([100, 100, 80]) == [0, 1, 2]


def test_reacquired_on_the_other_side(spark):
    rows = [(1, f, 7, e, float(y)) for f, e, y in [(0, 1, 90), (1, 1, 95), (2, 2, 120), (3, 2, 125), (4, 3, 130)]]
    df = spark.createDataFrame(rows, "video long, frame long, track_id long, entity_id long, cy double").withColumn("cx", F.lit(0.0))
    got = tracks.reacquired(df, 100).collect()
    assert [(r["entity_id"], r["frame"], r["start_side"], r["direction"]) for r in got] == [(2, 2, "above", "down")]
    net = {r["entity_id"]: (r["up"], r["down"]) for r in tracks.entity_crossings(df, 25.0, CrossingParams(line_y=100)).collect()}
    assert net == {1: (0, 0), 2: (0, 1), 3: (0, 0)}


@pytest.mark.parametrize(
    ("path", "stamp"),
    [("a/Cam_00_20240102030405.mp4", "03H04M"), ("2024010217/09M27S_1.mp4", "17H09M"), ("x17/0927.mp4", "17H09M"), ("xy/name.mp4", "00H00M"), ("name.mp4", "00H00M")],
)
def test_button_stamp(spark, path, stamp):
    assert spark.range(1).select(C.button_stamp(F.lit(path))).first()[0] == stamp


def test_diverse_choice_rules():
    rng = np.random.default_rng(4)
    p = ReidParams()
    for _ in range(100):
        n = int(rng.integers(1, 20))
        v = rng.normal(size=(n, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        got = reid.pick_diverse([1.0] * n, v, [None if x == 0 else int(x) for x in rng.integers(0, 4, n)], bool(rng.integers(2)), p)
        places = [i for i, _ in got]
        assert len(places) == len(set(places)) <= p.top and sum(m for _, m in got) <= p.top
        own = [i for i, m in got if m]
        assert all(1 - v[a] @ v[b] >= p.diversity - 1e-9 for k, a in enumerate(own) for b in own[:k])


def test_components_equal_a_fold(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, x) for x in range(5001, 5200)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = connected(spark.createDataFrame(pairs, "i long, j long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}
    assert connected(spark.createDataFrame([], "i long, j long")).count() == 0


@pytest.mark.parametrize(
    ("updates", "status"),
    [("queued started queued", "started"), ("completed queued failed", "completed"), ("failed queued", "queued"), ("started failed", "failed"), ("queued", "queued")],
)
def test_ledger(spark, updates, status):
    rows = [(1, k, s, None if k else 5.0) for k, s in enumerate(updates.split())]
    r = ops.ledger_state(spark.createDataFrame(rows, "path long, seq long, status string, start_ts double"), ("start_ts",)).first()
    assert (r["status"], r["start_ts"]) == (status, 5.0)


def test_backlog_marks(spark):
    steps = [1] * 9 + [-1] * 5 + [-1] * 9
    got = ops.backlog(spark.createDataFrame([("d", k, s) for k, s in enumerate(steps)], "day string, n long, step int")).orderBy("n").collect()
    assert [r["fast"] for r in got].index(True) == 8 and got[11]["fast"] and not got[12]["fast"] and got[-1]["depth"] == 0


def test_small_sources(spark, tmp_path):
    (tmp_path / "video_processor_2024-05-05.log").write_text("2024-05-05 01:00:00 - INFO - a\nx\n")
    (tmp_path / "video_processor.log").write_text("junk\n2024-05-06 01:00:00 - INFO - b\n")
    lines = log_files.daily_lines(log_files.read_lines(spark, f"file://{tmp_path}"), "video_processor")
    assert sorted((str(r["day"]), r["content"]) for r in logs.parse_lines(lines).collect()) == [("2024-05-05", "a"), ("2024-05-06", "b")]
    roi = configs.parse_roi(spark.createDataFrame([('{"line_y": 5}',), ("[[1,2]]",), ("no",), (None,)], "value string")).collect()
    assert [r["line_y"] for r in roi] == [5, None, None, None] and roi[1]["motion_roi"] == [[1, 2]]
    store.save_ledger(spark.createDataFrame([("a", "queued", None), ("b", "completed", 2.5)], "path string, status string, end_ts double"), f"file://{tmp_path}/ledger")
    led = store.load_ledger(spark, f"file://{tmp_path}/ledger").orderBy("path").collect()
    assert [(r["path"], r["status"], r["end_ts"], r["start_ts"]) for r in led] == [("a", "queued", None, None), ("b", "completed", 2.5, None)]


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(500), 500)], "k long").repartition(5)
    assert numbered(df, "pos", F.col("k")).where("pos <> k + 1").count() == 0


def test_similar_pairs_is_exact_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.8}
    monkeypatch.setattr(reid, "BLOCK", 16)
    for block, cells in ((4096, 256), (16, 256), (7, 2)):
        got = [(r["i"], r["j"]) for r in reid.similar_pairs(df, 0.8, axes=2, block=block, cells=cells, sample=40).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    probes, gallery = df.where("id < 20"), df.where("id >= 20")
    best = {r["id"]: r["best_id"] for r in reid.best_match(probes, gallery).collect()}
    assert all(best[i] == (20 + int(s[i, 20:].argmax()) if s[i, 20:].max() > 0 else None) for i in range(20))


def test_day_averages_leave_out_videos_without_a_time(spark):
    m = entries(spark, [("Motion detection took 100 seconds", "INFO", "a"), ("Status: no_person", "INFO", "b"), ("Full processing took 400 seconds", "INFO", "c")])
    r = logs.day_entries(logs.video_summary(m)).first()
    assert (r["videos_total"], r["md_avg"], r["full_avg"], r["status_counts"]) == (2, 100, 300, {"no_person": 1, "unknown": 1})


def test_lines_that_look_like_marks(spark):
    day = datetime(2024, 5, 6).date()
    lines = [f"{DAY} 10:00:00 - INFO - [v] a\x01\x02b", f"\x01\x02{DAY} 10:00:00 - INFO - x", "a\x01\x02b\x01\x02c\x01\x02d", f"{DAY} 10:00:00 - INFO - ", None, ""]
    got = logs.parse_lines(spark.createDataFrame([(k, day, x) for k, x in enumerate(lines)], "n long, day date, line string")).orderBy("n").collect()
    assert [(r["n"], r["video"], r["content"]) for r in got] == [(0, "v", "a\x01\x02b"), (3, None, "")]


def test_lines_of_several_splits_keep_their_order(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "a.log").write_text("\n".join(f"line {k:05d}" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = log_files.read_lines(spark, f"file://{tmp_path}").orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["line"] for r in rows] == [f"line {k:05d}" for k in range(3000)] and len({r["n"]["start"] for r in rows}) > 3


@pytest.mark.parametrize(
    ("size", "want"),
    [((3840, 2160), ("4k", None, 1600, 7200, 60)), ((1920, 1080), ("1080p", None, 810, 1800, 30)), ((640, 360), ("low", None, 810, 100, 10)), ((896, 512), ("low", None, 810, 199, 14)),
     ((896, 504), ("unsupported", "no_motion", None, None, None))],
)
def test_clip_profiles(spark, size, want):
    r = configs.clip_profile(spark.createDataFrame([(*size, True)], "width int, height int, fast boolean")).first()
    assert (r["profile"], r["status"], r["line_y"], r["least_area"], r["padding"]) == want and r["stride"] == 3


def test_contours_and_crops(spark):
    c = spark.createDataFrame([(1, 2000.0, 2500.0), (2, 2000.0, 2501.0), (3, 1999.0, 1999.0), (4, 5000.0, 0.0)], "id long, area double, hull_area double")
    assert [r["id"] for r in tracks.solid_contours(c).collect()] == [1] and tracks.moving_contours(c, 8000, 0.5).count() == 1
    b = spark.createDataFrame([(1, -5.9, 10.9, 30.0, 50.0), (2, 0.0, 0.0, 10.0, 60.0), (3, 200.0, 0.0, 210.0, 10.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = tracks.crop_rectangles(b, 5, 100, 100, lowest=50).collect()
    assert [tuple(r) for r in got] == [(1, 0, 5, 35, 55)]
