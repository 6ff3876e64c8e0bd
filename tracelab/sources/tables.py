"""Readers, and adapters from plain tables to bars, fills, draws and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fills as broker logs have them; prices stay exact text.
FILL = T.StructType([T.StructField("time", T.DoubleType()), T.StructField("symbol", T.StringType()), T.StructField("qty", T.LongType()), T.StructField("fill_qty", T.LongType()), T.StructField("price", T.StringType()), T.StructField("order_id", T.LongType()), T.StructField("status", T.StringType())])
MANIFEST = T.StructType([T.StructField("outname", T.StringType()), T.StructField("program_sha", T.StringType()), T.StructField("executed_source_sha", T.StringType()), T.StructField("status", T.StringType()), T.StructField("exit_code", T.LongType()), T.StructField("secs", T.DoubleType()), T.StructField("complete", T.BooleanType()), T.StructField("runtime_error", T.StringType()), T.StructField("tape", T.ArrayType(FILL)), T.StructField("ran_at", T.StringType())])
ENVELOPE = T.StructType([T.StructField(c, T.StringType()) for c in ("surface", "model", "effort", "prompt_id", "variant", "condition", "prompt_sha256", "status", "raw_text", "program", "canary")] + [T.StructField("i", T.LongType()), T.StructField("replicate", T.LongType()), T.StructField("wall_ms", T.LongType())])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Append-only lanes, one JSON object a line; blank lines vanish. Both key dialects become (prompt_id, i)."""
    df = spark.read.schema(schema).json(path)
    if {"variant", "replicate"} <= set(df.columns):
        df = df.withColumns({"prompt_id": F.coalesce("prompt_id", "variant"), "i": F.coalesce("i", "replicate")})
    return df


def manifests(spark: SparkSession, glob: str, current: DataFrame | None = None) -> DataFrame:
    """One JSON object a file; malformed files are skipped, and with `current` (outname) only those names are kept."""
    df = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)
    df = df.where("outname is not null")
    return df.join(current, "outname", "left_semi") if current is not None else df


def json_array(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """A JSON array of objects as a dictionary by key: the last of equal keys wins."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(schema)).alias("rows"))
    rows = text.select(F.posexplode("rows").alias("at", "row"))
    return rows.groupBy(F.col(f"row.{key}").alias("_key")).agg(F.max_by("row", "at").alias("row")).select("row.*")


def listed(spark: SparkSession, glob: str) -> list[str]:
    """Paths that match, from the listing alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(x.getPath().toString() for x in found or [])


def last_file(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of the lexicographically last matching file, the only one that is opened; no file gives no line."""
    found = listed(spark, glob)
    if not found:
        return spark.createDataFrame([], "value string, file string")
    return spark.read.text(found[-1]).select("value", F.col("_metadata.file_path").alias("file"))


#: The efforts that a lane may end in.
EFFORTS = ("low", "medium", "high", "xhigh", "max", "default")


def lane_keys(path: str = "file"):
    """Lane, prompt, condition and surface of names such as lane__prompt__condition__surface.jsonl, and the lane's model and
    effort where it ends in an effort, as model_high does; else all of it is the model."""
    base = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    parts = [F.split(base, "__").getItem(i) for i in range(4)]
    pattern = rf"^(.+)_({'|'.join(EFFORTS)})$"
    effort = F.nullif(F.regexp_extract(parts[0], pattern, 2), F.lit(""))
    model = F.when(effort.isNull(), parts[0]).otherwise(F.regexp_extract(parts[0], pattern, 1))
    return [*(c.alias(n) for c, n in zip(parts, ("lane", "prompt_id", "condition", "surface"), strict=True)), model.alias("model"), effort.alias("effort")]


def bench_keys(path: str = "file"):
    """Lane, prompt, condition and surface of names such as bare_model_high_O1e3_noask.jsonl; null where no prompt is named."""
    base = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    plain = F.regexp_replace(base, "_noask$", "")
    lane = F.nullif(F.regexp_extract(plain, "^(.*?)_O1", 1), F.lit(""))
    known = lambda c: F.when(lane.isNotNull(), c)
    prompt = F.concat(F.lit("O1"), F.get(F.split(plain, "_O1"), F.lit(1)))
    return [lane.alias("lane"), known(prompt).alias("prompt_id"), known(F.when(base.endswith("_noask"), "noask").otherwise("base")).alias("condition"), known(F.when(lane.startswith("bare_"), "bare").otherwise("harness")).alias("surface")]


def pooled(spark: SparkSession, root: str, schema: T.StructType, want: int, today: str, pattern: str = "*.jsonl") -> DataFrame:
    """Usable rows of each lane file's name over all dated folders, and what today's folder must reach so that they are
    `want` in all: its own rows and the shortfall of all. Folders of other names and quarantined files don't count."""
    rows = dated_folders(spark, root, schema, pattern)
    day = F.regexp_extract("file", r"/(\d{4}-\d{2}-\d{2})/[^/]+$", 1)
    usable = F.col("status").isin("program", "no-program")
    cells = rows.where(day != "").groupBy(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("cell")).agg(F.count_if(usable).alias("have"), F.count_if(usable & (day == today)).alias("have_today"))
    return cells.withColumns({"want": F.lit(want), "ask_for": F.when(F.col("have") < want, F.col("have_today") + want - F.col("have"))})


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def whole_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and text of whole files; a missing one is an error."""
    found = [p for p in paths if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    if len(found) < len(paths):
        raise FileNotFoundError(", ".join(p for p in paths if p not in found))
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def dated_folders(spark: SparkSession, root: str, schema: T.StructType, pattern: str = "*.jsonl") -> DataFrame:
    """Lanes of all folders under root, with their file, without what lies in quarantine."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root).withColumn("file", F.input_file_name())
    return rows.where(~F.contains(F.lower("file"), F.lit("quarantine")))


def in_range(bars: DataFrame, symbol: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Bars of a symbol from first to last day; no bar at all is an error."""
    rows = bars.where(F.col("symbol") == symbol)
    rows = rows.where(F.col("d") >= F.lit(first).cast("date")) if first else rows
    rows = rows.where(F.col("d") <= F.lit(last).cast("date")) if last else rows
    if rows.isEmpty():
        raise ValueError(f"no bars of {symbol} from {first} to {last}")
    return rows


class BarCache:
    """Bars by (symbol, interval): from memory, else the project's folder, else a second one, else the loader; what the
    loader gives is kept in the second folder."""

    def __init__(self, spark: SparkSession, project: str, second: str, load=None):
        self.spark, self.folders, self.load, self.known = spark, (project, second), load, {}

    def get(self, symbol: str, interval: str, refresh: bool = False) -> DataFrame:
        key = symbol, interval
        if key in self.known and not refresh:
            return self.known[key]
        paths = [f"{folder}/symbol={symbol}/interval={interval}" for folder in self.folders]
        for path in () if refresh else paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                self.known[key] = self.spark.read.parquet(path)
                return self.known[key]
        if self.load is None:
            raise FileNotFoundError(f"{symbol} {interval}")
        self.load(symbol, interval).write.mode("overwrite").parquet(paths[1])
        self.known[key] = self.spark.read.parquet(paths[1])
        return self.known[key]


# ---------------------------------------------------------------- adapters over the test tables


def event_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value", "user_id", "props")


def fills(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """Line items as signed fills of a run (the order), with further columns of theirs as asked."""
    li = table(spark, sf, "lineitem")
    sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    return li.select(
        F.col("l_orderkey").alias("run"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("time"), F.concat("l_returnflag", F.lit(" EQ")).alias("symbol"), F.rint(sign * F.col("l_quantity")).cast("long").alias("qty"),
        F.lit(None).cast("long").alias("fill_qty"), F.format_string("%.2f", "l_extendedprice").alias("price"), F.col("l_linenumber").cast("long").alias("order_id"), F.when(F.col("l_discount") < 0.01, "canceled").when(F.col("l_discount") < 0.03, "partiallyFilled").when(F.col("l_discount") >= 0.03, "filled").alias("status"), *more,
    )


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as graded draws of a model (market segment) on a prompt (priority): code, numeric, n."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("draw"), F.col("c_mktsegment").alias("model"), F.col("o_orderpriority").alias("prompt"), F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("numeric"), F.col("o_custkey").alias("cell"), F.col("c_nationkey").alias("nation"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as judged candidates: truth = quality, judge = not toxic."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("judge"), "n_chars")
