"""Streaming storms: brute force, ties at the gap, dirt, empty input."""

import random

from pyspark.sql import functions as F

from pluvion.operators.storms import p2_found, p2_storm_lengths
from pluvion.streaming.storms import replay_sessions, sessions

SCHEMA = "run_id int, cell_id int, t_i int, ts timestamp, pr float, loaded_at timestamp, from_i int"


def put(folder, rows, data):
    return folder(pr_hourly=rows([(r, c, t, None, p, None, 7) for r, c, t, p in data], SCHEMA))


def test_gap_of_24_hours_stays_together_and_dirt_is_dry(spark, rows, folder):
    nan = float("nan")
    d = put(folder, rows, [(1, 1, 0, 0.1), (1, 1, 24, 5.0), (1, 1, 49, 1.0), (1, 1, 30, nan), (1, 1, 31, None), (1, 1, 32, 0.05), (None, 1, 3, 9.0), (1, 2, 7, 1e20), (1, 2, 7, 1e20)])
    assert sorted(map(tuple, p2_found(spark, d).collect())) == [(1, 1, 0, 24), (1, 1, 49, 49), (1, 2, 7, 7)]


def test_against_brute_force_in_blocks(spark, rows, folder):
    rng = random.Random(5)
    data = [(1, c, t, rng.choice([0.0, 0.5])) for c in range(4) for t in rng.sample(range(4000), 300)]
    d = put(folder, rows, data + data[:50])
    want = set()
    for c in range(4):
        wet = sorted(t for _, k, t, p in data if k == c and p >= 0.1)
        start = prev = wet[0]
        for t in wet[1:] + [10**9]:
            if t - prev > 24:
                want.add((1, c, start, prev))
                start = t
            prev = t
    for slice_rows in (10**6, 400, 90):
        got = replay_sessions(spark.read.parquet(f"{d}/pr_hourly.parquet"), F.col("pr") >= 0.1, ["run_id", "cell_id"], "t_i", slice_rows=slice_rows).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
        assert sum(r["n_active"] for r in got) == len({(c, t) for _, c, t, p in data if p >= 0.1})


def test_same_sessions_however_the_feed_is_cut(spark, rows, tmp_path):
    """The same rows in any order as 1, 3 and 10 micro-batches, repeated rows in different ones, with a delay that no row exceeds."""
    rng = random.Random(8)
    data = [(k, t) for k in range(3) for t in rng.sample(range(1500), 120)]
    data += rng.sample(data, 90)
    rng.shuffle(data)
    stamp = F.timestamp_seconds((F.col("h") + 1) * 3600)
    found = []
    for cuts in (1, 3, 10):
        path = f"{tmp_path}/{cuts}"
        for i in range(cuts):
            rows(data[i::cuts], "k int, h int").withColumn("event_ts", stamp).coalesce(1).write.mode("append").parquet(path)
        end = rows([(None, None)], "k int, h int").withColumn("event_ts", F.lit("2262-01-01").cast("timestamp"))
        end.coalesce(1).write.mode("append").parquet(path)
        events = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = sessions(events, ["k"], "h", 24, "2000 hours", 4)
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start(f"{path}-out").awaitTermination()
        found.append(sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{path}-out").collect())))
    assert found[1] == found[0] and found[2] == found[0] and sum(r[3] for r in found[0]) == len(set(data))


def test_empty_table(spark, rows, folder):
    assert p2_found(spark, put(folder, rows, [])).count() == 0


def test_cleared_tables_are_gone(spark, rows):
    from pluvion.scratch import cleared, written

    df = written(rows([(1,)], "k int"), "some")
    path = df.inputFiles()[0]
    assert df.count() == 1 and cleared(spark) >= 1 and cleared(spark) == 0
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_lengths_with_events_without_storms(spark, rows, folder):
    d = put(folder, rows, [(1, 1, 5, 1.0), (1, 1, 8, 1.0)])
    rows([(1, 1, 5), (1, 1, 99), (1, 1, None)], "run_id int, cell_id int, oe_i int").write.parquet(f"{d}/ordinary_event.parquet")
    rows([(1, 1, 8, 4.0), (1, 1, 8, None)], "run_id int, cell_id int, oe_i int, storm_len_h float").write.parquet(f"{d}/tail_metric.parquet")
    r = p2_storm_lengths(spark, d).collect()
    assert [(x["length_h"], x["n_wet_hours"], x["n_event_peaks"], x["n_tail_peaks"], x["storm_len_h"]) for x in r] == [(4, 2, 1, 1, 4.0)]
