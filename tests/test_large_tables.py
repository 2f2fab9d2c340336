"""What only large tables have: ids that repeat, ties of means, times within one second."""

import duckdb
import numpy as np
import pytest
from watchlake.operators import reid, tracks
from watchlake.plans import all_queries

from tests.test_queries import rows

SF = "/root/testdata/sf0.001"


def held_against_sql(spark, folder, name):
    c = duckdb.connect()
    for f in folder.iterdir():
        c.execute(f"create view {f.name.split('.')[0]} as select * from '{f}'")
    got = all_queries.QUERIES[name](spark, str(folder)).toPandas()
    assert len(got) and rows(got) == rows(c.execute(all_queries.ORACLES[name]).df())


@pytest.fixture(scope="module")
def repeated_ids(tmp_path_factory):
    """Copies whose ids reach those of the noisy ones, with the same labels and with others."""
    folder = tmp_path_factory.mktemp("ids")
    duckdb.sql(f"""copy (select vec_id + 50000 * k + 5 * (k // 3) as vec_id, embedding, label from '{SF}/embeddings.parquet', range(4) t(k)
      where vec_id < 200 and not (k = 3 and vec_id < 100)) to '{folder}/embeddings.parquet'""")
    return folder


@pytest.mark.parametrize("name", ["J07_probe_gallery_match", "A29_clip_decision", "J09_matched_direction", "T04_diverse_crops"])
def test_ids_that_repeat(spark, repeated_ids, name):
    held_against_sql(spark, repeated_ids, name)


def test_times_to_the_nearest_second(spark, tmp_path):
    duckdb.sql(f"""copy (select event_id, timestamp '2024-01-01' + interval (event_id * 101) millisecond as ts, event_id % 3 as user_id, event_type, value, props
      from '{SF}/events.parquet') to '{tmp_path}/events.parquet'""")
    held_against_sql(spark, tmp_path, "J11_as_of_reading")


def test_means_at_the_limit_in_any_order(spark):
    conf = [0.35, 0.94, 0.51, 0.62, 0.77, 0.63, 0.66, 0.55, 0.73]
    seen = list(enumerate(conf))
    total = 0.0
    for c in conf:
        total += c
    mean = total / len(conf)
    for order in (seen, seen[::-1], sorted(seen, key=lambda x: x[1]), seen[4:] + seen[:4]):
        df = spark.createDataFrame([(1, 0, 7, f, c) for f, c in order], "video long, clip_index long, track_id long, frame long, conf double").coalesce(1)
        assert tracks.low_confidence(df, mean).count() == 0
        assert tracks.low_confidence(df, np.nextafter(mean, 1)).count() == 1


def test_blocks_grow_with_the_table():
    """Rows are sent to as many blocks whatever the table's size, up to a limit of a task's rows."""
    for total in (10, 4096, 100_000, 144_000, 700_000):
        assert -(-total // reid.grown_block(total, 4096)) <= reid.BLOCKS
    assert reid.grown_block(10**9, 4096) == reid.GROWN * 4096
