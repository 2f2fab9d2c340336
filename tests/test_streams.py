"""Streams: batches don't depend on how many files a chunk has, and states that take few calls."""

import random

import numpy as np
import pandas as pd
from watchlake.operators import entities
from watchlake.plans import fixtures, q_streams
from watchlake.streaming import streams

SF = "/root/testdata/sf0.001"


def test_the_files_of_a_chunk_are_one_batch(spark):
    """Several files a chunk: rows of one must not be late because of another."""
    text = lambda df: sorted(map(str, df.collect()))
    want = text(q_streams.st03(spark, SF))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert text(q_streams.st03(spark, SF)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ledger_state_is_an_aggregation(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "queued", None)], "path long, seq long, status string, end_ts double")
    rows.write.parquet(f"file://{tmp_path}/in")
    live = streams.ledger_updates(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), ("end_ts",))
    plan = live._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


def test_events_of_a_task_go_through_one_after_the_other(spark):
    """No call an event; and where events change within a task, nothing of the one before is left."""
    people = q_streams._people(spark, SF).select("video", "clip_index", "frame", "track_id", "conf", "x1", "y1", "x2", "y2")
    got = entities.resolve(people, 25.0, trust=q_streams._TRUST)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want = []
    for (video, clip), pdf in people.toPandas().groupby(["video", "clip_index"]):
        rows = entities.followed(entities.Resolver(25.0, 1, 810.0, trust=q_streams._TRUST), pdf)
        want += [(video, clip, *r) for r in rows.itertuples(index=False)]
    assert sorted(map(tuple, got.coalesce(1).collect())) == sorted(want)


def test_passing_goes_on_from_what_passed_last():
    rng = random.Random(2)
    for cooldown in (0, 1, 7, 400):
        last, held, rows, state = None, 0, sorted(rng.randrange(900) for _ in range(300)), (None, 0)
        for part in (rows[:90], rows[90:91], rows[91:]):
            want = []
            for i, at in enumerate(part):
                if last is None or at - last >= cooldown:
                    want.append((i, held))
                    last, held = at, 0
                else:
                    held += 1
            out, *state = streams.passing(np.array(part), cooldown, *state)
            assert out == want and tuple(state) == (last, held)


def test_a_chunk_of_waiting_rows_is_one_entry():
    class Handle:
        def getListState(self, name, schema):
            self.waiting = Lists()
            return self.waiting

        def getValueState(self, name, schema):
            return None

        def registerTimer(self, at):
            self.timer = at

    class Lists(list):
        appendList = list.extend

    handle, state = Handle(), streams._Throttle(1)
    state.init(handle)
    list(state.handleInputRows(("k",), iter([pd.DataFrame({"ms": [5, 9], "at": [1, 2], "n": [3, 4]})]), None))
    assert len(handle.waiting) == 1 and handle.timer == 9


def test_files_of_tasks(spark, tmp_path):
    """Written by tasks under their names where the folder is mounted, and staged and moved elsewhere; no folder is left out."""
    df = spark.createDataFrame([(f"cam_{k}.mp4", "x" * k) for k in range(30)], "name string, value string")
    fixtures.write_files(spark, df, f"file://{tmp_path}/in")
    want = {f"cam_{k}.mp4": "x" * k + "\n" for k in range(30)}
    assert {f.name: f.read_text() for f in (tmp_path / "in").iterdir() if not f.name.startswith(".")} == want
    df.where("name < 'cam_12'").repartition("name").write.partitionBy("name").text(f"file://{tmp_path}/staged")
    fixtures.place_files(spark, f"file://{tmp_path}/staged", f"file://{tmp_path}/moved", lambda name: "new_" + name)
    assert {f.name: f.read_text() for f in (tmp_path / "moved").iterdir() if not f.name.startswith(".")} == {"new_" + k: v for k, v in want.items() if k < "cam_12"}
