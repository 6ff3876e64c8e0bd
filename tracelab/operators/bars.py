"""Bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ohlcv(ticks: DataFrame, bucket, name: str) -> DataFrame:
    """Open, high, low, close and count per symbol and bucket; the tick id breaks ties of time."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", bucket.alias(name)).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")
    )


def daily(ticks: DataFrame) -> DataFrame:
    return ohlcv(ticks, F.to_date("ts"), "d")


def completed(ticks: DataFrame, minutes: int = 5, least: int = 1) -> DataFrame:
    """Tumbling bars by their end; windows with fewer than `least` ticks aren't made up."""
    bars = ohlcv(ticks, F.window("ts", f"{minutes} minutes"), "w").where(F.col("volume") >= least)
    return bars.select("symbol", F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume")


def session(ticks: DataFrame, minutes: int = 5, opens: str = "09:30", closes: str = "16:00", zone: str = "America/New_York", holidays: tuple[str, ...] = (), until=None) -> DataFrame:
    """Completed bars of the regular session by their end in local time: the first ends `minutes` after the opening, on
    either side of a clock change. ts is UTC. Ticks outside the session, at weekends and on holidays belong to no bar;
    bars without ticks aren't made up; a bar that ends after `until` (a UTC time; that of the last tick if not given) isn't
    complete and is left out."""
    local = F.from_utc_timestamp("ts", zone)
    first, last = (F.unix_seconds(F.to_timestamp(F.concat(F.date_format("local", "yyyy-MM-dd "), F.lit(t)))) for t in (opens, closes))
    now = F.unix_seconds("local")
    inside = (F.dayofweek("local").between(2, 6)) & ~F.date_format("local", "yyyy-MM-dd").isin(*holidays) & (now >= first) & (now < last)
    end = F.timestamp_seconds(first + (F.floor((now - first) / (60 * minutes)) + 1) * 60 * minutes)
    rows = ticks.withColumn("local", local)
    bars = ohlcv(rows.where(inside), end, "bar_end")
    seen = ticks.agg(F.max("ts")).scalar() if until is None else until
    return bars.where(F.col("bar_end") <= F.from_utc_timestamp(seen, zone))
