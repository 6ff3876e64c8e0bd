"""Structured Streaming forms of the append-only lanes. Each runs what is there (availableNow) and returns the result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One file a micro-batch, as files of a lane arrive one after the other."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(sf)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("symbol"), "value", "props")


def run(stream: DataFrame, mode: str, put, root: str) -> None:
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def finished(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run to the end and read back. Complete results overwrite per batch; of updates the last one of each key counts."""
    spark, root = stream.sparkSession, scratch(stream.sparkSession, "stream")
    whole = mode == "complete"

    def put(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out" if whole else f"{root}/out/batch={n}")

    run(stream, mode, put, root)
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{root}/out" if whole else f"{root}/out/*")
    if keys:
        others = [F.max_by(c, "_batch").alias(c) for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(*others)
    return out.select(stream.columns)


def tumbling_bars(spark: SparkSession, sf: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars by update: a window leaves the state once the watermark has passed it, and rows that come later are dropped."""
    at = F.struct("ts", "event_id")
    g = events(spark, sf).withWatermark("ts", late).groupBy("symbol", F.window("ts", size).alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return finished(g, "update", ("symbol", "w")).select("symbol", F.to_date("w.start").alias("d"), "open", "high", "low", "close", "volume")


def resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of a lane, each taken once however often it is appended. The lane that is written is the memory: each batch
    adds what isn't there yet, so the stream keeps no state."""
    root = scratch(spark, "lane")
    schema = "user_id long, symbol string"
    spark.createDataFrame([], schema).write.parquet(f"{root}/out")

    def put(df: DataFrame, n: int) -> None:
        # a repeated batch finds its own rows there and adds nothing
        there = spark.read.schema(schema).parquet(f"{root}/out")
        df.distinct().join(there, ["user_id", "symbol"], "left_anti").write.mode("append").parquet(f"{root}/out")

    run(events(spark, sf).select("user_id", "symbol"), "append", put, root)
    return spark.read.schema(schema).parquet(f"{root}/out")


def sessions(spark: SparkSession, sf: str, gap: str = "6 hours") -> DataFrame:
    """Sessions in complete mode, since session windows can't be updated and appended ones end with the watermark: all
    sessions stay in the state."""
    g = events(spark, sf).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return finished(g, "complete").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n_events")


def stateful_cross(spark: SparkSession, sf: str, level: float = 50.0) -> DataFrame:
    """Per symbol, how often value rises through a level; the last value is kept between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, float("nan"))
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"].tolist():
            n += last <= level < v
            last = v
        state.update((int(n), float(last)))
        yield pd.DataFrame({"symbol": [key[0]], "n_cross": [int(n)]})

    g = events(spark, sf).select("symbol", "ts", "event_id", "value").groupBy("symbol")
    out = finished(g.applyInPandasWithState(step, "symbol string, n_cross long", "n long, last double", "update", "NoTimeout"), "update")
    return out.groupBy("symbol").agg(F.max("n_cross").alias("n_cross"))
