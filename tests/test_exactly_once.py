"""Streams that are stopped half-way, and sessions that close."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from tests.test_streams import files
from tracelab.streaming import ledger, sessions, streams


def keys(spark, root):
    return sorted(map(tuple, ledger.read(spark, root, "user_id long, symbol string, day date").collect()))


BATCHES = [[(1, 1, 1, "a", 1.0), (2, 2, 1, "a", 1.0)], [(3, 3, 1, "a", 1.0), (4, 5, 2, "b", 1.0)], [(5, 30, 1, "a", 1.0), (6, 4, 2, "b", 1.0)]]
D = dt.date(2026, 1, 1)
WANT = [(1, "a", D), (1, "a", D + dt.timedelta(days=1)), (2, "b", D)]


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_that_dies_leaves_no_double(spark, tmp_path, monkeypatch, when):
    """before: after the batch's rows are written, before they are committed; after: committed, before the stream notes it."""
    (tmp_path / "in").mkdir()
    where, root = files(spark, tmp_path / "in", BATCHES), f"file://{tmp_path}/out"
    real, calls = ledger.commit, []

    def dies(s, staged, target):
        calls.append(target)
        if len(calls) == 2:
            if when == "after":
                real(s, staged, target)
            raise RuntimeError("the machine is gone")
        real(s, staged, target)

    monkeypatch.setattr(ledger, "commit", dies)
    with pytest.raises(StreamingQueryException):
        ledger.run(ledger.once_a_day(streams.events(spark, where)), root)
    assert len(calls) == 2 and len(list((tmp_path / "out/lane").iterdir())) == (1 if when == "before" else 2)
    ledger.run(ledger.once_a_day(streams.events(spark, where)), root)
    assert keys(spark, root) == WANT
    ledger.run(ledger.once_a_day(streams.events(spark, where)), root)  # nothing new
    assert keys(spark, root) == WANT
    staged = list((tmp_path / "out/staged").iterdir())
    assert len(staged) == (1 if when == "before" else 0)  # what died stays outside the lane


def test_blank_lines_of_a_lane_vanish(spark, tmp_path):
    (tmp_path / "lane/batch=0").mkdir(parents=True)
    (tmp_path / "lane/batch=0/part.json").write_text('\n{"user_id": 1, "symbol": "a", "day": "2026-01-01"}\n\n  \n')
    rows = ledger.read(spark, str(tmp_path), "user_id long, symbol string, day date").collect()
    assert len(rows) == 1


def closed(spark, where):
    return sorted((r["session"], r["started"].hour + 24 * (r["started"].day - 1), r["ended"].hour + 24 * (r["ended"].day - 1), r["n_turns"], r["best"], r["closed"]) for r in sessions.trajectories(spark, where).collect())


ROWS = [
    (1, 0, 1, "view", 9.0),  # before any start
    (2, 1, 1, "signup", 1.0), (3, 2, 1, "view", 5.0), (4, 3, 1, "click", 7.0), (5, 4, 1, "purchase", 2.0), (6, 5, 1, "view", 50.0),  # the last is an orphan
    (7, 6, 1, "signup", 1.0), (8, 7, 1, "signup", 1.0), (9, 8, 1, "view", 3.0),  # a restart, then 12 hours without a row
    (10, 30, 1, "view", 4.0), (11, 31, 1, "purchase", 4.0),  # orphans, since the session has expired
    (12, 32, 2, "signup", 1.0), (13, 33, 2, "purchase", 6.0),
    (14, 34, 3, "signup", 0.0),  # expires by its timer
    (15, 60, 4, "signup", 0.0),  # still open at the end
]
CLOSED = [(1, 1, 4, 3, 7.0, "complete"), (1, 6, 6, 0, None, "restart"), (1, 7, 8, 1, 3.0, "expired"), (2, 32, 33, 1, 6.0, "complete"), (3, 34, 34, 0, None, "expired")]


@pytest.mark.parametrize("cuts", [(), (4, 9), (1, 3, 8, 10, 13)])
def test_batches_dont_change_sessions(spark, tmp_path, cuts):
    edges = [0, *cuts, len(ROWS)]
    where = files(spark, tmp_path, [ROWS[a:b] for a, b in zip(edges, edges[1:], strict=False)])
    assert closed(spark, where) == CLOSED


def test_late_rows_are_dropped_and_state_is_freed(spark, tmp_path):
    """A row behind the watermark neither reopens nor lengthens a session."""
    where = files(spark, tmp_path, [[(1, 1, 1, "signup", 1.0), (2, 2, 1, "view", 2.0)], [(3, 40, 2, "signup", 1.0)], [(4, 41, 2, "view", 1.0)], [(5, 3, 1, "purchase", 99.0), (6, 3, 1, "signup", 1.0), (7, 60, 3, "view", 1.0)], [(8, 100, 3, "view", 1.0)]])
    assert closed(spark, where) == [(1, 1, 2, 1, 2.0, "expired"), (2, 40, 41, 1, 1.0, "expired")]


def test_sessions_of_one_bucket_keep_apart(spark, tmp_path, monkeypatch):
    """Many keys in one bucket give what each gives alone; rewards that are missing don't hide later ones."""
    rows = [(1000 * k + i, h, k, kind, v) for k in range(40) for i, h, kind, v in ((0, 1 + k % 3, "signup", 1.0), (1, 4, "view", float("nan")), (2, 5, "view", 2.0 + k), (3, 6 + 30 * (k % 2), "purchase", 1.0))]
    rows += [(99000, 50, 99, "view", 1.0), (99001, 52, 99, "view", 1.0)]
    want = [(k, 1 + k % 3, 5, 2, 2.0 + k, "expired") if k % 2 else (k, 1 + k % 3, 6, 3, 2.0 + k, "complete") for k in range(40)]
    whole = sessions.closed_sessions
    monkeypatch.setattr(sessions, "closed_sessions", lambda stream: whole(stream, buckets=1))
    assert closed(spark, files(spark, tmp_path, [rows[:80], rows[80:160], rows[160:]])) == want
