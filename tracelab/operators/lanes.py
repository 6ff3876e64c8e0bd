"""Rules over lanes of answers: status, binding, fairness, gates, rewards, targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from . import indicators, signals

#: Fixed value: the base class of a strategy, in lower case.
STRATEGY = "bt.strategy"


def generation_status(raw: Column, program: Column, short_fast: Column) -> Column:
    """harness-error (no text, or cut off), program, provider-blocked (by shape or wording), no-program."""
    cut = program.isNull() & F.coalesce(raw.rlike(tx.TRUNCATED), F.lit(False))
    t = tx.strip(raw)
    stopped = (short_fast & (F.length(t) < 400)) | ((F.length(t) < 600) & t.rlike(tx.BLOCKED))
    return F.when(raw.isNull() | cut, "harness-error").when(program.isNotNull(), "program").when((raw != "") & stopped, "provider-blocked").otherwise("no-program")


def refusal(schema: Column, arm: Column, want_arm: Column, program: Column, program_sha: Column, prompt_sha: Column, want_prompt: Column) -> Column:
    """The first reason why an envelope isn't bound to its lane and contents, or null; absent parts don't refuse."""
    return F.coalesce(
        F.when(~schema.eqNullSafe(F.lit("v2")), F.concat(F.lit("schema "), F.coalesce(schema, F.lit("none")))), F.when(arm.isNotNull() & (arm != want_arm), F.concat(F.lit("arm "), arm)),
        F.when((program != "") & (program_sha != "") & (F.sha2(program, 256) != program_sha), "program hash"), F.when((want_prompt != "") & (prompt_sha != "") & (prompt_sha != want_prompt), "prompt hash"),
    )


def finished(status: Column, raw: Column) -> Column:
    """False for harness errors and empty answers without a program: those are drawn again."""
    return ~((status == "harness-error") | ((status == "no-program") & (tx.strip(F.coalesce(raw, F.lit(""))) == "")))


def target(prompt: Column, surface: Column, eligible: tuple[str, ...], anchors: tuple[str, ...]) -> Column:
    return F.when(surface == "bare", F.when(prompt.isin(*eligible), 30).otherwise(10)).when(prompt.isin(*eligible), 30).when(prompt.isin(*anchors), 20).otherwise(10)


def reward(compiled: Column, ran: Column, trades: Column, judged: Column) -> tuple[Column, Column]:
    """(1.0 or 0.0, whether a missing judgement was taken as a pass)."""
    open_ = compiled & ran & (trades > 0) & judged.isNull()
    return (compiled & ran & (trades > 0) & F.coalesce(judged, F.lit(True))).cast("double"), open_


def sell_rule(rule: str, fast: int, slow: int) -> Column:
    """R1, R2, R5: price across the fast average down, up, either way; R3, R4, R6: fast across slow likewise. Needs
    columns close, fast and slow."""
    way = {"R1": "down", "R2": "up", "R3": "down", "R4": "up", "R5": "any", "R6": "any"}[rule]
    x, y = ("close", "fast") if rule in ("R1", "R2", "R5") else ("fast", "slow")
    return signals.crossed(signals.before(x), F.col(x), signals.before(y), F.col(y), way)


def with_averages(bars, fast: int, slow: int):
    return bars.withColumns({"fast": indicators.sma(fast), "slow": indicators.sma(slow)})


def last_json_line(t: Column) -> Column:
    lines = F.filter(F.split(t, "\n", -1), lambda x: tx.strip(x).rlike(r"^\{.*\}$"))
    return tx.strip(F.try_element_at(lines, F.lit(-1)))


def text_faults(t: Column) -> Column:
    """The structural faults of a text, in order of lines: list marks without an item, and lines that end in a comma or
    semicolon."""
    lines = F.transform(F.split(t, "\n", -1), lambda x, i: F.struct((i + 1).cast("string").alias("n"), tx.strip(x).alias("s")))
    named = F.transform(lines, lambda x: F.when(x["s"] == "-", F.concat(F.lit("line "), x["n"], F.lit(": empty item"))).when(x["s"].rlike("[;,]$"), F.concat(F.lit("line "), x["n"], F.lit(": dangling mark"))))
    return F.array_join(named, ",")


def keyword_overlap(task: Column, code: Column, words: tuple[str, ...]) -> Column:
    """Short code fails; code must use one of the words that the task uses; without any, it must define a class and name
    the strategy's base."""
    named = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(task), w))
    return F.when(F.length(tx.strip(code)) < 100, False).when(F.size(named) == 0, F.contains(F.lower(code), F.lit("class")) & F.contains(F.lower(code), F.lit(STRATEGY))).otherwise(F.exists(named, lambda w: F.contains(F.lower(code), w)))
