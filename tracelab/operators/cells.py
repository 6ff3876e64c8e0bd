"""Cells of a design: class names, gates, pooled days, repeated lines, faults of a text's surface, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of each bank, its resolutions with their core, the cores by priority, and the absorbed ones.
CROSS_CORES = {
    "conv_reent": "CONV", "conv_wait": "CONV", "inv_reent": "INV", "inv_wait": "INV", "sym_reent": "SYM-CHURN", "sym_wait": "SYM-WAIT", "level_reent": "LEVEL", "level_wait": "LEVEL",
    "uu_reent": "UU", "uu_wait": "UU", "dd_reent": "DD", "dd_wait": "DD", "ua_reent": "UA", "ua_wait": "UA", "au_reent": "AU", "au_wait": "AU", "da_reent": "DA", "da_wait": "DA", "ad_reent": "AD", "ad_wait": "AD",
}
CLASSES = {
    "CROSS": (CROSS_CORES, ["CONV", "INV", "SYM-CHURN", "LEVEL", "UU", "DD", "UA", "AU", "DA", "AD"], ["SYM-WAIT"]),
    "PX-02": (CROSS_CORES, ["CONV", "INV", "SYM-CHURN", "LEVEL", "UU", "DD", "UA", "AU", "DA", "AD"], ["SYM-WAIT"]),
    "BL-04": ({"prev_close": "PREV_CLOSE", "prev_close_le": "PREV_CLOSE_LE", "open_close": "OPEN_CLOSE"}, ["PREV_CLOSE", "OPEN_CLOSE", "PREV_CLOSE_LE"], []),
    "OM-B": ({"private": "PRIVATE", "invested_gate": "INVESTED_GATE", "netting": "NETTING", "buys_first": "BUYS_FIRST"}, ["PRIVATE", "BUYS_FIRST", "NETTING", "INVESTED_GATE"], []),
    "OM-C": ({"parallel": "PARALLEL", "race": "RACE", "sequence": "SEQUENCE", "shared_state": "SHARED_STATE"}, ["PARALLEL", "RACE", "SEQUENCE", "SHARED_STATE"], []),
    "BL-09": ({"all": "ALL", "half_down_lastsell": "HALF_DOWN_LASTSELL", "half_down_hold": "HALF_DOWN_HOLD", "half_up": "HALF_UP"}, ["ALL", "HALF_DOWN_LASTSELL", "HALF_DOWN_HOLD", "HALF_UP"], []),
}


def registry(spark: SparkSession) -> DataFrame:
    """bank, resolution, core, rank (null: not in the priority) and absorbed."""
    rows = [(b, r, c, order.index(c) + 1 if c in order else None, c in gone) for b, (cores, order, gone) in CLASSES.items() for r, c in cores.items()]
    return spark.createDataFrame(rows, "bank string, resolution string, core string, rank int, absorbed boolean")


def class_names(matched: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """The class of each cell's matched resolutions (bank and resolution, beside keys): the first core by priority that
    isn't absorbed, else the first absorbed one; without a core in the priority, all cores joined by '+'; in a bank that
    isn't registered, all resolutions. A resolution without core stands for itself."""
    rows = matched.select(*keys, "bank", "resolution").where("resolution is not null").distinct()
    banks = classes.select("bank").distinct().withColumn("known", F.lit(True))
    j = rows.join(classes, ["bank", "resolution"], "left").join(banks, "bank", "left")
    core = F.coalesce("core", "resolution")
    place = F.when(F.col("rank").isNotNull(), F.struct(F.coalesce("absorbed", F.lit(False)), "rank"))
    joined = F.array_join(F.array_sort(F.collect_set(core)), "+")  # of one bank's resolutions at most
    return j.groupBy(*keys, "bank").agg(F.when(F.max("known").isNotNull(), F.coalesce(F.min_by(core, place), joined)).otherwise(joined).alias("label"))


def gate(runs: Column, expected: Column, incomplete: Column, floor: Column, resolutions: Column) -> Column:
    """N/A for one resolution; PASS if all expected runs are there and complete and each tuple tells two classes apart at
    least; INCOMPLETE if runs are missing or too many; else FAIL."""
    ok = (runs > 0) & (incomplete == 0) & (F.coalesce(floor, F.lit(0)) >= 2) & (runs == expected)
    return F.when(resolutions == 1, "N/A").when(ok, "PASS").when(runs != expected, "INCOMPLETE").otherwise("FAIL")


def pooled(rows: DataFrame, cell: list[str], day: Column, today: Column, usable: Column, want: Column) -> DataFrame:
    """Usable rows of each cell over all days, those of today, and what today must reach so that the cell has `want`."""
    marked = rows.withColumns({"_ok": F.coalesce(usable, F.lit(False)), "_now": day.eqNullSafe(today), "_want": want})
    g = marked.groupBy(*cell).agg(F.count_if("_ok").alias("have"), F.count_if(F.col("_ok") & F.col("_now")).alias("have_today"), F.max("_want").cast("long").alias("want"))
    return g.withColumn("ask_for", F.when(F.col("have") < F.col("want"), F.col("have_today") + F.col("want") - F.col("have")))


def repeated_line(docs: DataFrame, key: str, text: str, more_than: int = 15, keep: int = 80) -> DataFrame:
    """The most repeated line that isn't blank, the first seen of equals, its count, and whether that is a loop. Lines are
    compared as they stand. A text without such a line has none, 0 times."""
    blank = r"^[\s\x1c-\x1f\x85\xa0  -     　]*$"
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("at", "line"))
    counts = lines.where(~F.col("line").rlike(blank)).groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    best = counts.groupBy(key).agg(F.max_by(F.struct("line", "n"), F.struct(F.col("n"), -F.col("at"))).alias("best"))
    found = docs.select(key).join(best, key, "left")
    return found.select(key, F.coalesce(F.left("best.line", F.lit(keep)), F.lit("")).alias("line"), F.coalesce("best.n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.col("best.n") > more_than, F.lit(False)).alias("loops"))


#: Faults of a text's surface and the patterns that show them.
SURFACE = {
    "carriage return": r"\r", "tab": r"\t", "triple blank line": r"\n\n\n", "doubled space": r"  ", "orphan list marker": r"(?m)^\s*(?:[-*+]|\d+[.)])\s*$", "dangling punctuation": r"[,;:]\s*(?:\n\n|\z)", "leading punctuation": r"(?m)^\s*[.,;:!?]",
}


def surface_faults(text: Column) -> Column:
    """Names of the faults found, joined by commas; 'missing final newline' first."""
    found = [F.when(~text.endswith("\n"), "missing final newline"), *(F.when(text.rlike(p), n) for n, p in SURFACE.items())]
    return F.array_join(F.array_compact(F.array(*found)), ",")


def unfinished(jobs: DataFrame, done: DataFrame, keys: list[str], digest: str, status: str, final: tuple[str, ...]) -> DataFrame:
    """Jobs without a finished row of the same keys and the same prompt digest: rows of another status, or of an earlier
    prompt, don't count. Null keys equal each other."""
    rows = done.where(F.col(status).isin(*final)).select(*keys, digest).distinct()
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, digest)]
    return jobs.alias("a").join(rows.alias("b"), same, "left_anti")


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either of two freezes that are dropped, new or changed."""
    j = before.select(key, F.col(value).alias("_was"), F.lit(1).alias("_b")).join(after.select(key, F.col(value).alias("_is"), F.lit(1).alias("_a")), key, "full")
    what = F.when(F.col("_a").isNull(), "dropped").when(F.col("_b").isNull(), "new").when(~F.col("_was").eqNullSafe(F.col("_is")), "changed")
    return j.select(key, what.alias("what")).where("what is not null")
