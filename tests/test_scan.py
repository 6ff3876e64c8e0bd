"""Linear recurrences in chunks, and what is ranked instead of gathered."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.operators import indicators, scan, stats


@pytest.mark.parametrize("chunk", [3, 7, 4096])
def test_scan_of_a_hot_series(spark, chunk):
    """One series of 400 rows beside short ones; with chunks of 3, five levels of chunks."""
    rng = np.random.default_rng(1)
    rows = [("hot", i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1, 1, (400, 2)))] + [("a", 0, 0.5, 2.0), ("b", 0, 1.0, 1.0), ("b", 1, 1.0, 1.0), (None, 0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double").repartition(5)
    got = {(r["g"], r["i"]): (r["y"], r["z"]) for r in scan.scanned(df, ["g"], "i", {"y": (F.col("a"), F.col("b")), "z": (F.lit(1.0), F.col("b"))}, 399, chunk).collect()}
    y, z, last = 0.0, 0.0, object()
    for g, i, a, b in rows:
        y, z = (y, z) if g == last else (0.0, 0.0)
        y, z, last = a * y + b, z + b, g
        assert np.allclose(got[g, i], (y, z))
    assert len(got) == len(rows)


def test_recursive_indicators_in_small_chunks(spark):
    rng = np.random.default_rng(2)
    close = np.round(100 + rng.normal(0, 1, 120).cumsum(), 2)
    rows = [(s, i, float(c + 1), float(c - 1), float(c)) for s, x in (("hot", close), ("few", close[:4]), ("one", close[:1])) for i, c in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, i int, high double, low double, close double").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), "i"))
    got = {n: {} for n in indicators.RECURSIVE}
    for n in got:
        for r in indicators.recursive(df, (n,), chunk=5).orderBy("symbol", "d").collect():
            got[n].setdefault(r["symbol"], []).append(r[n])
    for s, x in (("hot", close), ("few", close[:4]), ("one", close[:1])):
        e = f = g = x[0]
        sig = 0.0
        up = down = atr = None
        for i in range(len(x)):
            if i:
                e, f, g = e + 2 / 6 * (x[i] - e), f + 2 / 13 * (x[i] - f), g + 2 / 27 * (x[i] - g)
                sig += 0.2 * (f - g - sig)
            gains = [max(x[j] - x[j - 1], 0) for j in range(1, i + 1)]
            losses = [max(x[j - 1] - x[j], 0) for j in range(1, i + 1)]
            true = [2.0] + [max(x[j] + 1, x[j - 1]) - min(x[j] - 1, x[j - 1]) for j in range(1, i + 1)]
            up, down = (np.mean(gains), np.mean(losses)) if i == 5 else ((up * 4 + gains[-1]) / 5, (down * 4 + losses[-1]) / 5) if i > 5 else (None, None)
            atr = np.mean(true) if i == 4 else (atr * 4 + true[-1]) / 5 if i > 4 else None
            want = {"ema": e if i >= 5 else None, "macd": f - g, "macd_signal": sig, "rsi": None if up is None else 100 if down == 0 else 100 - 100 / (1 + up / down), "atr": atr}
            for n, v in want.items():
                assert (got[n][s][i] is None) == (v is None) and (v is None or abs(got[n][s][i] - v) < 2e-6), (n, s, i)


def hot(spark):
    rows = [("hot", float(i * 37 % 101), i) for i in range(500)] + [("two", 5.0, 1), ("two", 7.0, 2), ("nulls", None, 1), ("one", 3.0, 1), ("some", None, 1), ("some", 2.0, 2)]
    return spark.createDataFrame(rows, "g string, x double, id int").repartition(3), rows


def test_upper_median_without_gathering(spark):
    df, rows = hot(spark)
    for g, med in ((r["g"], r["med"]) for r in stats.upper_medians(df, ["g"], "x").collect()):
        own = sorted(x for h, x, _ in rows if h == g and x is not None)
        assert med == (own[len(own) // 2] if own else 0.0)


def test_digests_of_hot_groups(spark):
    df, rows = hot(spark)
    hashed = df.select("g", "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    tree = {r["g"]: r["digest"] for r in stats.tree_hash(hashed, ["g"], ["id"], "h", fan=7).collect()}
    first = {r["g"]: r["digest"] for r in stats.prefix_hash(hashed, ["g"], ["id"], "h", 15).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for g in ("hot", "two", "nulls", "one"):
        level = [sha(str(i)) for i in sorted(i for h, _, i in rows if h == g)]
        assert first[g] == sha("".join(level[:15]))
        while True:
            level = [sha("".join(level[i : i + 7])) for i in range(0, len(level), 7)]
            if len(level) == 1:
                break
        assert tree[g] == level[0]
