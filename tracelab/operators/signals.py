"""Signals over ordered bars, and the alternating tape they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_day, changes, sma


def crossed(x_before: Column, x_now: Column, y_before: Column, y_now: Column, direction: str) -> Column:
    """up, down, any, level_above or level_below; false where a value is missing."""
    up, down = (x_before <= y_before) & (x_now > y_now), (x_before >= y_before) & (x_now < y_now)
    kinds = {"up": up, "down": down, "any": up | down, "level_above": x_now > y_now, "level_below": x_now < y_now}
    return F.coalesce(kinds[direction], F.lit(False))


def before(c: str | Column) -> Column:
    return F.lag(c).over(by_day())


def price_cross(bars: DataFrame, n: int = 5, today_ma: bool = False) -> DataFrame:
    """bars with ma, up and down. today_ma: yesterday's close against today's average."""
    b = bars.withColumn("ma", sma(n))
    y = F.col("ma") if today_ma else before("ma")
    return b.withColumns({k: crossed(before("close"), F.col("close"), y, F.col("ma"), k) for k in ("up", "down")})


def average_cross(bars: DataFrame, fast: int = 3, slow: int = 8) -> DataFrame:
    b = bars.withColumns({"fast": sma(fast), "slow": sma(slow)})
    return b.withColumns({k: crossed(before("fast"), F.col("fast"), before("slow"), F.col("slow"), k) for k in ("up", "down")})


def red(kind: str) -> Column:
    return {"prev_close": F.col("close") < before("close"), "prev_close_le": F.col("close") <= before("close"), "open_close": F.col("close") < F.col("open")}[kind]


def red_streak(bars: DataFrame, kind: str) -> DataFrame:
    """Consecutive red bars that end here; a symbol's first bar never counts."""
    b = bars.withColumn("n", F.row_number().over(by_day()))
    b = b.withColumn("red", F.coalesce(red(kind), F.lit(False)) & (F.col("n") > 1))
    calm = F.max(F.when(~F.col("red"), F.col("n"))).over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("streak", F.col("n") - F.coalesce(calm, F.lit(0)))


def rsi_exit(rsi: str, threshold: float, kind: str) -> Column:
    if kind == "level":
        return F.coalesce(F.col(rsi) > threshold, F.lit(False))
    return F.coalesce((before(rsi) <= threshold) & (F.col(rsi) > threshold), F.lit(False))


def alternating(bars: DataFrame, buy: Column, sell: Column) -> DataFrame:
    """Fills at the next bar's open of signals that change the side; the first one is a buy, a last bar's signal has no
    fill. symbol, fill_d, side, price."""
    s = bars.withColumns({"side": F.when(buy, "B").when(sell, "S"), "price": F.lead("open").over(by_day()), "fill_d": F.lead("d").over(by_day())})
    s = s.where("side is not null and price is not null")
    was = F.lag("side").over(by_day())
    s = s.withColumn("was", was).where("(was is null and side = 'B') or was <> side")
    # a leading sell goes, and what follows it compares with it: a buy, which stays
    return s.select("symbol", "fill_d", "side", "price")


def cross_tape(bars: DataFrame, n: int = 5) -> DataFrame:
    b = price_cross(bars, n)
    return alternating(b, F.col("up"), F.col("down"))


__all__ = ["alternating", "average_cross", "before", "changes", "cross_tape", "crossed", "price_cross", "red", "red_streak", "rsi_exit"]
