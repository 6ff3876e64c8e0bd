"""Sessions that a start event opens and a complete event closes, as a stateful stream.

The state of a session key is one row, its open session, and is deleted when the session closes: by its complete event, by
the next start ('restart'), or by `idle` without events ('expired'), whichever comes first in event time. An expiry is seen
when the next event comes, or by a timer once the watermark has passed it, so the batches that rows arrive in don't change
the result as long as rows aren't late. Events outside a session (orphans) make no row; rows later than the watermark are
dropped. Sessions that are still open at the end stay in the state. Null rewards and NaN are left out of `best`.

Session keys are dealt by hash into `buckets`, which are the keys of the stream: a bucket's open sessions are read, written
and timed together, since each call from Python to the state costs as much as many rows. A task holds the rows that one
bucket has in a micro-batch, and its open sessions.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN = "session long, started long, last long, n_turns long, best double"
CLOSED = "session long, started long, ended long, n_turns long, best double, closed string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionProcessor(StatefulProcessor):
    """Rows (bucket, session, micros, kind, reward, seq); kind is start, turn or complete. Times are microseconds."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def _load(self) -> dict[int, tuple]:
        return {r[0]: tuple(r[1:]) for r in self.open.get()}

    def _store(self, now: dict[int, tuple]) -> None:
        """The open sessions of the bucket, and a timer for the first that expires."""
        if not now:
            self.open.clear()
            return
        self.open.put([(session, *x) for session, x in now.items()])
        self.handle.registerTimer(min(self._expiry(x) for x in now.values()))

    def _expiry(self, session: tuple) -> int:
        return session[1] // 1000 + self.idle_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions, out, idle = self._load(), [], 1000 * self.idle_ms
        if sessions:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        frame = pd.concat(list(rows)).sort_values(["session", "micros", "seq"], kind="stable")
        for session, at, kind, reward in zip(*(frame[c].tolist() for c in ("session", "micros", "kind", "reward")), strict=True):
            now = sessions.get(session)
            if now is not None and at > now[1] + idle:
                out.append((session, *now, "expired"))
                del sessions[session]
                now = None
            if kind == "start":
                if now is not None:
                    out.append((session, *now, "restart"))
                sessions[session] = (at, at, 0, None)
            elif now is not None:
                known = reward is not None and reward == reward
                now = (now[0], at, now[2] + 1, reward if known and (now[3] is None or reward > now[3]) else now[3])
                sessions[session] = now
                if kind == "complete":
                    out.append((session, *now, "complete"))
                    del sessions[session]
        self._store(sessions)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, this = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        sessions = self._load()
        gone = [s for s, x in sessions.items() if self._expiry(x) < mark or self._expiry(x) <= this]
        out = [(s, *sessions.pop(s), "expired") for s in gone]
        self._store(sessions)
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["session", "started", "ended", "n_turns", "best", "closed"]
        return pd.DataFrame(rows, columns=names).astype({"best": "float64"})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB for the streams that start inside; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def closed_sessions(stream: DataFrame, idle: str = "12 hours", late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """stream: session long, at timestamp, kind, reward double, seq long."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    bucket = F.pmod(F.xxhash64("session"), F.lit(buckets)).alias("bucket")
    rows = stream.withWatermark("at", late).select(bucket, "at", "session", F.unix_micros("at").alias("micros"), "kind", "reward", "seq")
    closed = rows.groupBy("bucket").transformWithStateInPandas(SessionProcessor(idle_ms), CLOSED, "append", "eventTime")
    times = {c: F.timestamp_micros(c) for c in ("started", "ended")}
    return closed.withColumns(times | {"best": F.nanvl("best", F.lit(None).cast("double"))})


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Closed sessions of the users of `events`: a signup opens one, a purchase completes it, all else are turns."""
    from . import streams

    kind = F.when(F.col("symbol") == "signup", "start").when(F.col("symbol") == "purchase", "complete").otherwise("turn")
    rows = streams.events(spark, sf).select(F.col("user_id").alias("session"), F.col("ts").alias("at"), kind.alias("kind"), F.col("value").alias("reward"), F.col("event_id").alias("seq"))
    with rocksdb(spark):
        return streams.finished(closed_sessions(rows), "append")
