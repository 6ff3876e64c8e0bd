"""Sinks: lanes, reports, split quarantine, packets, frozen frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_lane(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report(df: DataFrame, path: str) -> None:
    """One JSON document with all rows of a small report."""
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def new_version(df: DataFrame, root: str, version: int) -> str:
    """Rewrites go to a new version folder, never over what may be being read."""
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").json(path)
    return path


def quarantine(df: DataFrame, bad, path: str, apply: bool = False) -> DataFrame:
    """Counts of both sides; with apply, both are written. Nothing is deleted."""
    if apply:
        df.where(bad).write.mode("append").json(f"{path}/quarantine")
        df.where(~F.coalesce(bad, F.lit(False))).write.mode("append").json(f"{path}/keep")
    return df.agg(F.count_if(bad).alias("n_bad"), F.count_if(~F.coalesce(bad, F.lit(False))).alias("n_keep"))


def packets(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("overwrite").partitionBy(key).json(path)


def freeze(df: DataFrame, path: str, at: str) -> DataFrame:
    """Parquet and its manifest: rows, range of `at`, columns."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"), F.lit(",".join(df.columns)).alias("columns"))


def html_json(df: DataFrame) -> DataFrame:
    """All rows as JSON safe inside a script element."""
    return df.agg(F.replace(F.to_json(F.collect_list(F.struct(*df.columns))), F.lit("</script"), F.lit("<\\/script")).alias("payload"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one of the driver only where
    the master is local."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="tracelab-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a fixed result whose lineage is gone, for what is used repeatedly."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split(df: DataFrame, bad, path: str, reason: str, apply: bool = False) -> DataFrame:
    """Rows of either side, in number. With apply, both sides are written in one pass, quarantined rows with the reason;
    the input stays as it is."""
    aside = F.coalesce(bad, F.lit(False))
    side = F.when(aside, "quarantine").otherwise("keep")
    if apply:
        df.withColumns({"quarantined_reason": F.when(aside, reason), "side": side}).write.mode("append").partitionBy("side").json(path)
        return df.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, quarantined_reason string, side string").json(path).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def blinded_packets(df: DataFrame, path: str, blind: str, hidden: list[str], shelf: int = 1000) -> None:
    """Packets under their blinded number alone, `shelf` of them a folder, and beside them the index that tells what they
    are; who reads packets needn't see the index."""
    df.drop(*hidden).withColumn("shelf", F.floor(F.col(blind) / shelf)).write.mode("errorifexists").partitionBy("shelf").json(f"{path}/packets")
    df.select(blind, *hidden).write.mode("errorifexists").json(f"{path}/index")


def trajectory(df: DataFrame, path: str) -> None:
    """The event log of runs, one folder a kind of event."""
    df.write.mode("append").partitionBy("event").json(path)


def hash_records(df: DataFrame, name: str, content: str, path: str) -> None:
    """One line a record: its content's hash, two blanks, its name."""
    df.select(F.concat(F.sha2(content, 256), F.lit("  "), F.col(name))).write.mode("overwrite").text(path)
