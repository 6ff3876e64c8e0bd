"""An append-only lane that holds each row once, whatever crashes on the way.

A batch is written beside the lane and then renamed into it under its own number, so the number commits with the data: a
batch that is replayed because the stream died before the rename is written anew (what the first try left is never read),
and one that died after it is found there, so that its rows are
worked out for the stream's state alone. The checkpoint fixes what a batch holds, so a replay has the same
rows. Needs a file system whose rename of a folder is atomic, as HDFS's is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commit(spark: SparkSession, staged: str, target: str) -> None:
    fs, at = _path(spark, target)
    fs.mkdirs(at.getParent())
    if not fs.rename(_path(spark, staged)[1], at):
        raise OSError(f"{staged} could not be renamed to {target}")


def append_once(df: DataFrame, n: int, root: str) -> bool:
    """Batch n of a lane under root/lane; False if it is there already."""
    spark, target = df.sparkSession, f"{root}/lane/batch={n}"
    fs, at = _path(spark, target)
    if fs.exists(at):
        df.write.format("noop").mode("overwrite").save()  # the stream's state must move on with every batch
        return False
    staged = f"{root}/staged/{n}-{uuid.uuid4().hex[:12]}"
    df.write.json(staged)
    commit(spark, staged, target)
    return True


def run(stream: DataFrame, root: str) -> None:
    """All that is there, from where the lane's checkpoint ended."""

    def put(df: DataFrame, n: int) -> None:
        append_once(df, n, root)

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The lane's rows; blank lines vanish."""
    return spark.read.schema(schema).json(f"{root}/lane/batch=*")


def once_a_day(stream: DataFrame) -> DataFrame:
    """One row per user, kind and day. Repeats of a key lie within a day of each other, so keys are held for a day after
    the watermark and no longer."""
    day = stream.withColumn("day", F.to_date("ts")).withWatermark("ts", "1 day")
    return day.dropDuplicatesWithinWatermark(["user_id", "symbol", "day"]).select("user_id", "symbol", "day")
