"""Streams over several files: state between batches, repeated keys and rows that come too late."""

from __future__ import annotations

import datetime as dt

from tracelab.streaming import streams

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def files(spark, folder, batches):
    """One file a batch; their order of arrival is that of their names and times."""
    import os
    import time

    for n, rows in enumerate(batches):
        spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=h), u, k, v, "{}") for i, h, u, k, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/tmp{n}")
        (part,) = (f for f in os.listdir(f"{folder}/tmp{n}") if f.endswith(".parquet"))
        os.rename(f"{folder}/tmp{n}/{part}", f"{folder}/events{n}.parquet")
        os.utime(f"{folder}/events{n}.parquet", (time.time() - 1000 + n, time.time() - 1000 + n))
    return str(folder)


def test_bars_over_batches_drop_late_rows(spark, tmp_path):
    where = files(spark, tmp_path, [[(1, 1, 1, "a", 5.0), (2, 2, 1, "a", 9.0)], [(3, 20, 1, "a", 2.0)], [(4, 30, 1, "a", 7.0)], [(5, 31, 1, "a", 8.0)], [(6, 3, 1, "a", 99.0)]])  # the watermark that rows are late by lags a batch
    got = sorted((str(r["d"]), r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in streams.tumbling_bars(spark, where).collect())
    assert got == [("2026-01-01", 5.0, 9.0, 2.0, 2.0, 3), ("2026-01-02", 7.0, 8.0, 7.0, 8.0, 2)]


def test_resumed_keys_come_once(spark, tmp_path):
    where = files(spark, tmp_path, [[(1, 1, 1, "a", 1.0), (2, 1, 1, "a", 1.0)], [(3, 900, 1, "a", 1.0), (4, 900, 2, "a", 1.0)], [(5, 1, 2, "a", 1.0)]])
    assert sorted(map(tuple, streams.resumed(spark, where).collect())) == [(1, "a"), (2, "a")]


def test_crosses_remember_the_last_batch(spark, tmp_path):
    where = files(spark, tmp_path, [[(1, 1, 1, "a", 40.0)], [(2, 2, 1, "a", 60.0), (3, 3, 1, "b", 60.0)], [(4, 4, 1, "a", 50.0), (5, 5, 1, "a", 51.0)]])
    assert sorted(map(tuple, streams.stateful_cross(spark, where).collect())) == [("a", 2), ("b", 0)]
