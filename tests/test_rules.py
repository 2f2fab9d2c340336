"""Rules of media, reactions, recovery, ids and paths, and operators whose work was spread, against plain loops."""

import random
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from watchlake.operators import logs, media, ops, reid, tracks
from watchlake.params import SpeedParams
from watchlake.plans import q_logs, q_streams
from watchlake.sources import logs as log_files
from watchlake.sources import tree
from watchlake.sources.store import LiveDayStore

SF = "/root/testdata/sf0.001"


# ---- spread operators


@pytest.mark.parametrize("alpha", [0.25, 0.02, 1.0])
def test_smoothing_of_long_tracks(spark, alpha):
    rng = random.Random(1)
    rows = [(1, c, t, f, rng.random() * 90) for c, t, n in ((0, 1, 700), (0, 2, 64), (1, 1, 3)) for f in sorted(rng.sample(range(9000), n))]
    got = {tuple(r)[:4]: r["speed"] for r in tracks.smoothed(spark.createDataFrame(rows, "video long, clip_index long, track_id long, frame long, median double"), SpeedParams(alpha=alpha)).collect()}
    last = {}
    for v, c, t, f, m in rows:
        last[v, c, t] = m if (v, c, t) not in last else alpha * m + (1 - alpha) * last[v, c, t]
        assert got[v, c, t, f] == pytest.approx(last[v, c, t], rel=1e-12)
    assert len(got) == len(rows)


def test_throttle_equals_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(3000), rng.randrange(200), 777]), n) for n in range(900)] + [("one", 5, 1), ("far", 0, 1), ("far", 10**9, 2)]
    for cooldown in (0, 1, 7, 100, 5000):
        want, last, held = [], {}, {}
        for k, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
            if k not in last or at - last[k] >= cooldown:
                want.append((k, at, n, held.get(k, 0)))
                last[k], held[k] = at, 0
            else:
                held[k] += 1
        got = ops.throttled(spark.createDataFrame(rows, "key string, at long, n long"), cooldown, "key").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str), cooldown
    assert ops.throttled(spark.createDataFrame([], "key string, at long, n long"), 5, "key").count() == 0


def test_frames_in_many_windows(spark):
    rng = random.Random(2)
    frames = [(1, rng.randrange(-50, 9000)) for _ in range(800)]
    windows = [(1, k, a, a + rng.choice([0, 1, 30, 5000]), 1, 1) for k in range(60) for a in [rng.randrange(9000)]]
    got = tracks.in_windows(spark.createDataFrame(frames, "video long, frame long"), spark.createDataFrame(windows, "video long, clip_index int, padded_start long, padded_end long, tracker_stride int, output_stride int"), bucket=64)
    want = sorted((f, k) for _, f in frames for _, k, a, b, *_ in windows if a <= f < b)
    assert sorted((r["frame"], r["clip_index"]) for r in got.collect()) == want and "_bucket" not in got.columns


def test_few_pairs_are_compared_in_full():
    e = duckdb.sql("select embedding from '/root/testdata/sf0.01/embeddings.parquet/*.parquet'" if __import__("os").path.isdir("/root/testdata/sf0.01/embeddings.parquet") else "select embedding from '/root/testdata/sf0.01/embeddings.parquet'").fetchnumpy()["embedding"]
    x = np.stack([np.asarray(v, float) for v in e])
    x = np.vstack([x, x[::5] + 0.003])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space, radius = reid.Space(x[:200], 16, 8), float(np.sqrt(0.1)) + 1e-9
    a, b, s, compared = reid.close_pairs(x, x @ space.axes, x, x @ space.axes, 0.95, radius)
    full = x @ x.T
    assert set(zip(a.tolist(), b.tolist())) == set(map(tuple, np.argwhere(full >= 0.95).tolist())) and np.allclose(s, full[a, b])
    assert compared < 0.05 * len(x) ** 2
    cell = space.cell(x @ space.axes)
    near = set(space.near(radius))
    assert all((min(cell[i], cell[j]), max(cell[i], cell[j])) in near for i, j in zip(a, b))


def test_cells_and_zero_vectors(spark):
    rows = [(k, [float(k % 3), float(k % 2), 0.0]) for k in range(12)] + [(12, [0.0, 0.0, 0.0])]
    got = {(r["i"], r["j"]) for r in reid.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>"), 0.99, block=3).collect()}
    unit = [np.array(v) / (np.linalg.norm(v) or 1) for _, v in rows]
    assert got == {(i, j) for i in range(13) for j in range(i + 1, 13) if unit[i] @ unit[j] >= 0.99}
    assert reid.similar_pairs(spark.createDataFrame([], "id long, v array<double>"), 0.9).count() == 0


# ---- states that merge


def test_summaries_merge_in_any_order(spark):
    m = q_logs.metrics(spark, SF)
    parts = [logs.video_states(m.where(F.pmod(F.col("n") * 7, F.lit(3)) == k)) for k in (2, 0, 1)]
    merged = logs.merged_videos(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    whole = logs.video_summary(m)
    text = lambda df: sorted(map(str, df.select(*sorted(whole.columns)).collect()))
    assert text(merged) == text(whole)


def test_store_replaces_a_batch_that_is_tried_again(spark):
    m, store = q_logs.metrics(spark, SF), LiveDayStore.temporary(spark)
    for batch, k in ((0, 0), (1, 1), (1, 1), (0, 0)):
        store.add(m.where(F.col("n") % 2 == k), batch)
    plain = sorted(map(str, logs.day_entries(logs.video_summary(m)).collect()))
    assert sorted(map(str, store.entries().select("day", "videos_total", "status_counts", "md_avg", "full_avg").collect())) == plain
    store.close(F.lit("2100-01-01").cast("date"))
    assert store.entries().count() == len(plain)


def test_streaming_resolver_equals_the_batch_one(spark):
    batch = q_streams.st04(spark, SF)
    got = q_streams.st04x(spark, SF).select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


# ---- folders, files, recovery


def test_trees_and_empty_folders(spark, tmp_path):
    for d in ("a/b/c", "a/d", "e", "f/g", "h"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("a/d/x.mp4", "h/y.txt", "z.mp4"):
        (tmp_path / f).write_text("123")
    root = f"file://{tmp_path}"
    found = tree.list_tree(spark, root)
    rel = lambda df: sorted(r["path"][len(root) + 1 :] for r in df.collect())
    assert rel(tree.files(found)) == ["a/d/x.mp4", "h/y.txt", "z.mp4"] and rel(tree.folders(found)) == ["a", "a/b", "a/b/c", "a/d", "e", "f", "f/g", "h"]
    assert found.where("NOT is_dir AND length <> 3").count() == 0 and found.where("mtime IS NULL").count() == 0
    assert rel(ops.empty_folders(tree.folders(found), tree.files(found))) == ["a/b/c", "e", "f/g"]
    assert rel(ops.fileless_folders(tree.folders(found), tree.files(found))) == ["a/b", "a/b/c", "e", "f", "f/g"]
    (tmp_path / "none").mkdir()
    assert tree.list_tree(spark, f"{root}/none").count() == 0


@pytest.mark.parametrize(("days", "want"), [(["r/2024/05/06"], []), (["r/2024/05/01"], ["r/9/late.mp4"]), ([], ["r/9/late.mp4"])])
def test_the_fallback_needs_a_layout_without_day_folders(spark, days, want):
    at = datetime(2024, 5, 6, 9)
    rows = [("r/9/late.mp4", False, at), ("r/9/8/7/6/deep.mp4", False, at), ("r/9/note.txt", False, at), ("r/9/old.mp4", False, datetime(2024, 5, 1)), *((d, True, at) for d in days)]
    found = spark.createDataFrame(rows, "path string, is_dir boolean, mtime timestamp")
    ledger = spark.createDataFrame([], "path string, status string, at timestamp")
    since, now = (F.lit(x).cast("timestamp") for x in ("2024-05-06 08:00:00", "2024-05-06 10:00:00"))
    assert [r["path"] for r in ops.recovery_candidates(*ops.recovery_sources(found, "r", ledger, since, now)).collect()] == want


def test_a_day_opens_its_own_file(spark, tmp_path):
    for k in range(1, 9):
        (tmp_path / f"cam_2024-05-0{k}.log").write_text(f"2024-05-0{k} 01:00:00 - INFO - x\n" * k)
    (tmp_path / "cam.log").write_text("junk\n2024-05-09 01:00:00 - INFO - b\n")
    (tmp_path / "other.log").write_text("2024-05-03 01:00:00 - INFO - b\n")
    files = log_files.log_files(spark, f"file://{tmp_path}", "cam")
    assert sorted(r["day"] for r in files.collect()) == [f"2024-05-0{k}" for k in range(1, 10)]
    for day, name, n in (("2024-05-03", "cam_2024-05-03.log", 3), ("2024-05-09", "cam.log", 2)):
        lines = log_files.day_lines(spark, files, day)
        assert [f.rsplit("/", 1)[1] for f in lines.inputFiles()] == [name] and lines.count() == n
    assert log_files.day_lines(spark, files, "2024-06-01").count() == 0


# ---- reactions, ids, media, paths


@pytest.mark.parametrize(
    ("new", "old", "today", "kinds"),
    [
        ([ops.UP], [], False, []), ([ops.UP], [], True, ["away"]), ([ops.SHRUG + "\u200d\u2640"], [], False, ["negative"]), ([ops.THINKING], [ops.UP], False, ["further"]),
        ([], [ops.UP, ops.DOWN, ops.SHRUG], True, ["remove"]), ([], [ops.UP, ops.SHRUG], False, ["remove"]), ([ops.DOWN], [ops.UP], True, ["back", "remove"]), (["\u2764"], None, None, []),
    ],
)
def test_reactions(spark, new, old, today, kinds):
    rows = spark.createDataFrame([(1, new, old, today)], "message_id long, new array<string>, old array<string>, same_day boolean")
    assert sorted(r["kind"] for r in ops.reaction_events(rows).collect()) == kinds


def test_a_track_has_one_number(spark):
    det = spark.createDataFrame([(1, 0, 7, "person", 0.9), (1, 1, 7, "car", 0.9), (1, 2, 8, "car", 0.5), (1, 2, 9, "car", 0.8), (1, 3, 10, "person", 0.8)], "video long, frame long, track_id long, cls string, conf double")
    assert {(r["track_id"], r["cls"], r["local_id"]) for r in tracks.local_ids(det).collect()} == {(7, "person", 1), (9, "car", 1), (8, "car", 2), (10, "person", 2)}


def test_display_ids_go_on_from_the_first_kept_event(spark):
    rows = [  # clip, frame, entity, local
        (0, 0, 5, 1), (0, 1, 6, 2), (1, 10, 0, 3), (1, 11, 1, 4), (1, 12, 1, 3), (2, 20, 0, 4), (2, 21, 1, 9), (3, 30, 0, 1), (3, 31, 0, 3), (3, 32, 2, 9),
    ]
    people = spark.createDataFrame([(1, c, f, 0.9, e, k) for c, f, e, k in rows], "video long, clip_index long, frame long, conf double, entity_id long, local_id long")
    got = lambda kept: [r["display_id"] for r in tracks.display_ids(people, spark.createDataFrame([(1, c) for c in kept], "video long, clip_index long")).orderBy("frame").collect()]
    # event 1 is the first kept one: local 3 is 1 and local 4 is 2 from then on; 9 and 1 are new
    assert got([1, 3]) == [1, 2, 1, 2, 2, 2, 3, 4, 1, 3]
    assert got([]) == [1, 2, 1, 2, 2, 1, 2, 1, 1, 2]


def test_media_names(spark):
    names = ["20240102/A_reid_best0_m.jpg", "20240101/A_reid_best0_m.jpg", "20240101/07HA_insignificant_3.JPEG", "20240101/A_no_person_1.png", "20240101/A_pose_2.mp4", "20240101/A.MP4", "x/A_reid_best1.jpg", "20240101/s/A_reid_best1.jpg"]
    got = media.media_index(spark.createDataFrame([(f"t/{n}",) for n in names], "path string")).collect()
    assert {(r["kind"], r["stem"], r["path"], r["files"]) for r in got} == {
        ("crop", "A", "t/20240102/A_reid_best0_m.jpg", 2), ("frame", "A", "t/20240101/07HA_insignificant_3.JPEG", 1), ("image", None, "t/20240101/A_no_person_1.png", 1),
        ("pose", "A", "t/20240101/A_pose_2.mp4", 1), ("highlight", "A", "t/20240101/A.MP4", 1),
    }


@pytest.mark.parametrize(
    ("path", "there", "back"),
    [("c:\\nas\\a\\b", "/mnt/nas/a/b", "C:\\NAS\\a\\b"), ("D:\\x\\y", "D:/x/y", "D:/x/y"), ("C:\\NAS2\\a", "C:/NAS2/a", "C:/NAS2/a"), ("/MNT/NAS/a", "/MNT/NAS/a", "/MNT/NAS/a")],
)
def test_paths(spark, path, there, back):
    df = spark.createDataFrame([(path,)], "p string").select(ops.to_worker_path(F.col("p"), "C:\\NAS", "/mnt/nas").alias("w"))
    r = df.select("w", ops.to_master_path(F.col("w"), "C:\\NAS", "/mnt/nas").alias("m")).first()
    assert (r["w"], r["m"]) == (there, back)


@pytest.mark.parametrize(("score", "matched", "text"), [(0.001, True, "P1 C0 0%"), (0.001, False, "P1 C0"), (0.005, False, "P1 C0"), (0.015, False, "P1 C0 2%"), (None, True, "P1 C0 0%"), (0.9, None, "P1 C0")])
def test_summary_percent(spark, score, matched, text):
    df = spark.createDataFrame([(score, matched)], "s double, m boolean")
    assert df.select(ops.summary_text(F.lit(1), F.lit(0), F.lit(None).cast("string"), F.lit(0), F.lit(0), F.col("s"), F.col("m"), F.lit(None).cast("string"))).first()[0] == text
