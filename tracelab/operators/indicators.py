"""Indicators over bars (symbol, d, open, high, low, close). Finite-memory ones are window frames; first-seed EMA and
Wilder averages, whose memory is unbounded, are linear recurrences, scanned in chunks of a symbol.

Signals compare values rounded to SCALE digits, so that the order of floating sums can't flip them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settle
from .ranks import ranked
from .scan import CHUNK, composed, scanned

SCALE = 6


def by_day() -> "Window":
    return Window.partitionBy("symbol").orderBy("d")


def last(n: int) -> "Window":
    return by_day().rowsBetween(-(n - 1), 0)


def ready(value: Column, n: int) -> Column:
    """value once n bars are there, else null."""
    return F.when(F.row_number().over(by_day()) >= n, value)


def sma(n: int, close: str = "close") -> Column:
    return ready(F.round(F.avg(close).over(last(n)), SCALE), n)


def wma(n: int, close: str = "close") -> Column:
    """Weights 1 (oldest) to n."""
    terms = [F.lag(close, n - i).over(by_day()) * i for i in range(1, n + 1)]
    return ready(F.round(sum(terms[1:], terms[0]) / (n * (n + 1) / 2), SCALE), n)


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, dev = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    return {"bb_mid": ready(F.round(mid, SCALE), n), "bb_up": ready(F.round(mid + k * dev, SCALE), n), "bb_low": ready(F.round(mid - k * dev, SCALE), n)}


def stochastic(n: int = 14, smooth: int = 3) -> DataFrame:
    low, high = F.min("low").over(last(n)), F.max("high").over(last(n))
    return ready(F.when(high > low, F.round(100 * (F.col("close") - low) / (high - low), SCALE)), n)


def rsi_simple(n: int) -> Column:
    """Over plain means of the last n changes; no loss gives 100. Needs a column `ch` (change of close)."""
    up, down = F.avg(F.greatest("ch", F.lit(0.0))).over(last(n)), F.avg(F.greatest(-F.col("ch"), F.lit(0.0))).over(last(n))
    return ready(F.when(F.round(down, 9) == 0, F.lit(100.0)).otherwise(F.round(100 - 100 / (1 + up / down), SCALE)), n + 1)


def changes(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ch", F.col("close") - F.lag("close").over(by_day()))


def readiness(n: int) -> Column:
    return F.row_number().over(by_day()) >= n


# ---------------------------------------------------------------- recurrences


def ema_steps(rank: Column, x: Column, n: int) -> tuple[Column, Column]:
    """Seeded with the first sample."""
    a = 2 / (n + 1)
    return F.when(rank == 0, 0.0).otherwise(1 - a), F.when(rank == 0, x).otherwise(a * x)


def wilder_steps(rank: Column, x: Column, n: int, seed: Column) -> tuple[Column, Column]:
    """The mean of the first n values as seed at rank n - 1, then (avg * (n - 1) + x) / n."""
    return F.when(rank < n, 0.0).otherwise((n - 1) / n), F.when(rank < n - 1, 0.0).when(rank == n - 1, seed).otherwise(x / n)


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Of one short series, seeded with the first sample."""
    a, b = np.full(len(x), 1 - 2 / (n + 1)), x * (2 / (n + 1))
    a[:1], b[:1] = 0, x[:1]
    return composed(a, b)[1]


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Of one short series; NaN before the seed, the mean of the first n values."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        a, b = np.full(len(x) - n + 1, (n - 1) / n), x[n - 1 :] / n
        a[0], b[0] = 0, x[:n].mean()
        out[n - 1 :] = composed(a, b)[1]
    return out


def rsi_wilder(close: np.ndarray, n: int) -> np.ndarray:
    ch = np.diff(close)
    up, down = wilder(np.maximum(ch, 0), n), wilder(np.maximum(-ch, 0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
    return np.concatenate(([np.nan], np.where(np.isnan(up), np.nan, r)))


RECURSIVE = ("ema", "rsi", "macd", "macd_signal", "atr")


def recursive(bars: DataFrame, wanted: tuple[str, ...] = RECURSIVE, n_ema: int = 5, n_rsi: int = 5, n_atr: int = 5, fast: int = 12, slow: int = 26, signal: int = 9, chunk: int = CHUNK) -> DataFrame:
    """symbol, d, close and what is wanted of ema, rsi, macd, macd_signal and atr, rounded; null until ready. Bars are
    ranked over the whole table, neighbours meet by rank, and averages of unbounded memory are scanned in chunks, so that
    no task holds a symbol."""
    rows = settle(ranked(bars.select("symbol", "d", "high", "low", "close"), ["d"], "rank", ("symbol",)), "ranked")
    longest = rows.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    close, rank = F.col("close"), F.col("rank")
    steps: dict[str, tuple[Column, Column]] = {}
    if {"rsi", "atr"} & set(wanted):
        before = rows.select("symbol", (rank + 1).alias("rank"), close.alias("prev"))
        rows = rows.join(before, ["symbol", "rank"], "left")
        change, prev = F.coalesce(close - F.col("prev"), F.lit(0.0)), F.col("prev")
        rows = rows.withColumns({"up": F.greatest(change, F.lit(0.0)), "down": F.greatest(-change, F.lit(0.0)), "true": F.greatest("high", F.coalesce(prev, "high")) - F.least("low", F.coalesce(prev, "low"))})
        spans = (("up", 1, n_rsi), ("down", 1, n_rsi), ("true", 0, n_atr))
        first = rows.where(rank <= max(n_rsi, n_atr)).groupBy("symbol").agg(*(F.avg(F.when((rank >= lo) & (rank < lo + n), F.col(c))).alias(f"seed_{c}") for c, lo, n in spans))
        rows = rows.join(first, "symbol")
        steps |= {f"avg_{c}": wilder_steps(rank - lo, F.col(c), n, F.col(f"seed_{c}")) for c, lo, n in spans}
    if "ema" in wanted:
        steps["ema"] = ema_steps(rank, close, n_ema)
    if {"macd", "macd_signal"} & set(wanted):
        steps |= {"fast": ema_steps(rank, close, fast), "slow": ema_steps(rank, close, slow)}
    rows = scanned(rows, ["symbol"], "rank", steps, longest, chunk)
    if "macd_signal" in wanted:
        rows = rows.withColumn("line", F.col("fast") - F.col("slow"))
        rows = scanned(rows, ["symbol"], "rank", {"signal": ema_steps(rank, F.col("line"), signal)}, longest, chunk)
    col = F.col
    made = {
        "ema": lambda: F.when(rank >= n_ema, col("ema")), "rsi": lambda: F.when(rank >= n_rsi, F.when(col("avg_down") == 0, 100.0).otherwise(100 - 100 / (1 + col("avg_up") / col("avg_down")))), "macd": lambda: col("fast") - col("slow"),
        "macd_signal": lambda: col("signal"), "atr": lambda: F.when(rank >= n_atr - 1, col("avg_true")),
    }
    return rows.select("symbol", "d", "close", *(F.round(made[n](), SCALE).alias(n) for n in wanted))
