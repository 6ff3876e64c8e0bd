"""Rules over records of runs: logs, completion and reuse, gates, controls, sets, prompts, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Marks in run logs, and the wordings of an unreachable or busy task and of a short question.
NONCE = "RUN-NONCE "
EXITED = "Exiting Lean"
ERRORS = ("Runtime Error", "exception has occurred")
UNREACHABLE = r"(?i)404 Not Found|Not signed in|codex login|401|403|usage limit|rate.?limit|429|http error|ECONNRESET|ETIMEDOUT|could not create PATH aliases"
BUSY = r"(?i)PENDING|RUNNING|IN_PROGRESS"
ASK_SHORT = (
    r"(?i)what .{0,50}(period|type)|please (provide|specify)|should .{0,40}use\?|i need (the|a|an)?\s?.{0,60}(period|type)"
    r"|is(n.t| not) (specified|defined)|unspecified|is required but not"
)
# How far back each interval's history goes, as a period or from a start to an end.
INTERVALS = [
    ("1m", "7d", None, None), ("5m", "60d", None, None), ("15m", "60d", None, None), ("30m", "60d", None, None), ("1h", "730d", None, None),
    ("1d", None, "2020-01-01", "2025-12-31"),
]


def lines(t: Column) -> Column:
    return F.split(t, "\r\n|\n|\r", -1)


def holds_any(t: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(t, F.lit(p)) for p in parts])


def log_error(t: Column, marks: tuple[str, ...] = ERRORS) -> Column:
    """The last 300 characters of the first line that holds a mark; null without one."""
    return F.right(F.get(F.filter(lines(t), lambda x: holds_any(x, marks)), F.lit(0)), F.lit(300))


def log_exited(t: Column, mark: str = EXITED) -> Column:
    return F.coalesce(F.contains(t, F.lit(mark)), F.lit(False))


def logged_nonce(t: Column, mark: str = NONCE) -> Column:
    """What follows the mark on the first line that holds it; null without one."""
    line = F.get(F.filter(lines(t), lambda x: F.contains(x, F.lit(mark))), F.lit(0))
    return tx.strip(F.substring(line, F.instr(line, mark) + len(mark), F.length(line)))


def complete(has_result: Column, log: Column) -> Column:
    """A run is complete if its result is there and its log says that the engine left."""
    return F.coalesce(has_result, F.lit(False)) & log_exited(log)


def reusable(done: Column, data: Column, want_data: Column, source: Column, want_source: Column, core: Column, want_core: Column, verified: Column) -> Column:
    """A kept run may stand for a new one: complete, on the same data, of equal source or core, and verified."""
    return F.coalesce(done & (data == want_data) & (source.eqNullSafe(want_source) | core.eqNullSafe(want_core)) & verified, F.lit(False))


def alive(status: Column) -> Column:
    return ~F.coalesce(F.startswith(status, F.lit("dead")), F.lit(False))


def without_marks(params: Column) -> Column:
    """A map without its bookkeeping keys, as sorted entries, for comparing."""
    return F.array_sort(F.map_entries(F.map_filter(params, lambda k, _: ~F.startswith(k, F.lit("_")))))


def prune(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.drop(*names)


def gate_pipeline(code: Column, ran: Column, trades: Column) -> list[Column]:
    """structure_ok, backtest_ok, has_trades, gates_pass and error; what isn't reached any more is null."""
    wrong = tx.structure_gate(code)
    ok = wrong.isNull()
    backtest = F.when(ok, F.coalesce(ran, F.lit(False)))
    traded = F.when(backtest, F.coalesce(trades > 0, F.lit(False)))
    return [ok.alias("structure_ok"), backtest.alias("backtest_ok"), traded.alias("has_trades"), F.coalesce(traded, F.lit(False)).alias("gates_pass"), wrong.alias("error")]


def against_registered(fresh: DataFrame, registered: DataFrame) -> DataFrame:
    """name and verdict of fresh runs (name, proj): own-tape, no-tape or TAPE-DIFFERS; inner by name."""
    j = fresh.select("name", F.col("proj").alias("new")).join(registered.select("name", F.col("proj").alias("old")), "name")
    return j.select("name", F.when(F.col("new").isNull(), "no-tape").when(F.col("new") == F.col("old"), "own-tape").otherwise("TAPE-DIFFERS").alias("verdict"))


def lookup_control(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok and total by kind, and for all as kind ALL; the first 50 names that miss). found: name, kind, resolution, hits."""
    hit = F.coalesce(F.array_contains("hits", F.col("resolution")), F.lit(False))
    by_kind = found.rollup("kind").agg(F.count_if(hit).alias("ok"), F.count(F.lit(1)).alias("total")).withColumn("kind", F.coalesce("kind", F.lit("ALL")))
    return by_kind, found.where(~hit).select("name").orderBy("name").limit(50)


def census(tasks: DataFrame) -> DataFrame:
    """part, value, n: histograms of difficulty and of the status before a colon, overrides and live tasks. tasks:
    difficulty, pair_status, binding, data_status."""
    hist = lambda part, value: tasks.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "value", "n")
    one = tasks.agg(F.count_if(F.col("binding") == "requirements-override").alias("o"), F.count_if(alive(F.col("data_status"))).alias("a"))
    single = one.select(F.explode(F.array(F.struct(F.lit("count").alias("part"), F.lit("overrides").alias("value"), F.col("o").alias("n")), F.struct(F.lit("count").alias("part"), F.lit("alive").alias("value"), F.col("a").alias("n"))))).select("col.*")
    return hist("difficulty", F.col("difficulty")).unionByName(hist("pair", F.substring_index("pair_status", ":", 1))).unionByName(single)


def same_sets(a: Column, b: Column) -> Column:
    """Null for equal sets, else what either lacks."""
    left, right = F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))
    return F.when((F.size(left) > 0) | (F.size(right) > 0), F.concat(F.lit("only left: "), F.array_join(left, ","), F.lit("; only right: "), F.array_join(right, ",")))


def asks_short(t: Column) -> Column:
    """The narrower wording of a question, or a question mark among the last three characters."""
    s = tx.strip(t)
    return (F.instr(F.right(s, F.lit(3)), "?") > 0) | s.rlike(ASK_SHORT)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {name} replaced, in order."""
    return reduce(lambda t, x: F.replace(t, F.lit("{" + x[0] + "}"), x[1]), values.items(), template)


def with_suffix(prompt: Column, suffix: str) -> Column:
    """A prompt without its last line feeds, a blank line, the suffix and a line feed."""
    return F.concat(F.rtrim(prompt, F.lit("\n")), F.lit(f"\n\n{suffix}\n"))


def days_to(expiry: Column, now: Column) -> Column:
    """Difference of calendar dates, whatever the hours."""
    return F.datediff(expiry.cast("date"), now.cast("date"))


def owned(quantity: Column) -> Column:
    """Shares held as whole numbers: rounded (halves to even), never cut off, and not below none."""
    return F.greatest(F.rint(quantity).cast("long"), F.lit(0).cast("long"))


def queued(launched: DataFrame, collected: DataFrame) -> DataFrame:
    """launched (i, answer) that isn't collected yet, with what becomes of it: unreachable and busy ones stay queued and
    never become data."""
    left = launched.join(collected.select("i"), "i", "left_anti")
    t = F.coalesce("answer", F.lit(""))
    return left.select("i", F.when((tx.strip(t) == "") | t.rlike(UNREACHABLE), "unreachable").when(t.rlike(BUSY), "busy").otherwise("collect").alias("state"))


def resolve_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name) with target, one hop; a name that no alias has is an error. aliases (alias, name_of)."""
    j = names.join(aliases.withColumnRenamed("alias", "name"), "name", "left")
    return j.select("name", F.when(F.col("name_of").isNull(), F.raise_error(F.concat(F.lit("no bank for "), F.col("name"))).cast("string")).otherwise(F.col("name_of")).alias("target"))


def markdown_fields(t: Column) -> list[Column]:
    """verdict, classes (comma list without ticks) and summary (white space folded, no spaces of any script at its ends) of
    a review; null where a field is missing, but an empty summary is empty."""
    at = lambda pattern: F.get(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.lit(0))
    classes = F.transform(F.split(at(r"(?m)^\**Classes?:?\**:?[ \t]*(.+)$"), ","), lambda c: F.btrim(c, F.lit(" `")))
    summary = F.regexp_replace(F.regexp_replace(at(r"(?s)## Summary\n(.*?)(?:\n## |\z)"), r"\s+", " "), r"\A\p{Zs}+|\p{Zs}+\z", "")
    return [at(r"(?m)^\**Verdict:?\**:?[ \t]*`?([A-Z-]+)").alias("verdict"), classes.alias("classes"), summary.alias("summary")]


def aligned(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One line of fixed-width columns a row: negative widths align left."""
    return df.select(F.format_string(" ".join(f"%{w}s" for w in widths.values()), *[F.col(c).cast("string") for c in widths]).alias("line"))
