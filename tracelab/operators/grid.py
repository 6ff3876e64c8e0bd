"""Parameter grids: full factorial over conditioning levels, one-at-a-time and all-off rows, ordered dedup."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The degrees of freedom and their levels, the reference level first.
EQUITY_LEVELS = {
    "rsi_smoothing": ["wilder", "simple"], "rsi_exit": ["level", "cross"], "warmup": ["strict", "ready_check", "ready_per_rule"], "a_exec": ["calc_shares", "set_holdings"],
    "same_bar_reentry": ["allowed", "wait_bar"], "input_field": ["adjusted", "raw"], "cross_timing": ["both_days", "today_ma"],
}
A_DATES = ["warmup", "input_field", "cross_timing"]
B_DATES = ["rsi_smoothing", "rsi_exit", "warmup", "same_bar_reentry", "input_field"]
ALL_DATES = sorted({*A_DATES, *B_DATES})
EMA_BARS = ["150", "200", "252"]


# The twenty resolutions of the cross bank.
CROSSES = {
    "conv_reent": {"buy_dir": "up", "sell_dir": "down", "same_bar_reentry": "allowed"}, "conv_wait": {"buy_dir": "up", "sell_dir": "down", "same_bar_reentry": "wait_bar"},
    "inv_reent": {"buy_dir": "down", "sell_dir": "up", "same_bar_reentry": "allowed"}, "inv_wait": {"buy_dir": "down", "sell_dir": "up", "same_bar_reentry": "wait_bar"},
    "sym_reent": {"buy_dir": "any", "sell_dir": "any", "same_bar_reentry": "allowed"}, "sym_wait": {"buy_dir": "any", "sell_dir": "any", "same_bar_reentry": "wait_bar"},
    "uu_reent": {"buy_dir": "up", "sell_dir": "up", "same_bar_reentry": "allowed"}, "uu_wait": {"buy_dir": "up", "sell_dir": "up", "same_bar_reentry": "wait_bar"},
    "dd_reent": {"buy_dir": "down", "sell_dir": "down", "same_bar_reentry": "allowed"}, "dd_wait": {"buy_dir": "down", "sell_dir": "down", "same_bar_reentry": "wait_bar"},
    "ua_reent": {"buy_dir": "up", "sell_dir": "any", "same_bar_reentry": "allowed"}, "ua_wait": {"buy_dir": "up", "sell_dir": "any", "same_bar_reentry": "wait_bar"},
    "au_reent": {"buy_dir": "any", "sell_dir": "up", "same_bar_reentry": "allowed"}, "au_wait": {"buy_dir": "any", "sell_dir": "up", "same_bar_reentry": "wait_bar"},
    "da_reent": {"buy_dir": "down", "sell_dir": "any", "same_bar_reentry": "allowed"}, "da_wait": {"buy_dir": "down", "sell_dir": "any", "same_bar_reentry": "wait_bar"},
    "ad_reent": {"buy_dir": "any", "sell_dir": "down", "same_bar_reentry": "allowed"}, "ad_wait": {"buy_dir": "any", "sell_dir": "down", "same_bar_reentry": "wait_bar"},
    "level_reent": {"buy_dir": "level_above", "sell_dir": "level_below", "same_bar_reentry": "allowed"}, "level_wait": {"buy_dir": "level_above", "sell_dir": "level_below", "same_bar_reentry": "wait_bar"},
}


def _one(name: str, prefix: str, values: list[str], reference: str) -> dict[str, dict]:
    return {f"{prefix}{v}": {} if v == reference else {name: v} for v in values}


# Banks with conditioning sets and resolutions.
EQUITY_BANKS = {
    "DONOR": ([], {"pin": {}}),
    "BL-01a": (A_DATES, _one("ma_type", "", ["SMA", "EMA", "WMA"], "SMA")), "BL-01b": (A_DATES, _one("ma_period", "p", ["10", "20", "50", "100", "200"], "100")),
    "BL-01c": (A_DATES, {f"{t}{p}": {"ma_type": t, "ma_period": p} for t in ("SMA", "EMA", "WMA") for p in ("10", "20", "50", "100", "200")}),
    "CROSS": (A_DATES, CROSSES), "BL-03": ([*A_DATES, "a_exec"], _one("size_pct", "pct", ["10", "20", "25", "40", "50", "100"], "40")),
    "BL-04": (B_DATES, _one("red_def", "", ["prev_close", "open_close", "prev_close_le"], "prev_close")), "BL-05": (B_DATES, _one("red_days", "d", ["2", "3", "4", "5"], "3")),
    "BL-07": (B_DATES, _one("rsi_period", "p", ["7", "9", "14", "21"], "14")), "BL-08": (B_DATES, _one("rsi_thresh", "t", ["50", "60", "70", "80"], "60")),
    "BL-09": (list(EQUITY_LEVELS), _one("sell_frac", "", ["all", "half_down_lastsell", "half_down_hold", "half_up"], "all")), "ER-01": ([*A_DATES, "same_bar_reentry"], {f"R{i}": {"er01_sell": f"R{i}"} for i in range(1, 7)}),
    "OM-B": (ALL_DATES, {"private": {}, "invested_gate": {"lots": "invested_gate"}, "netting": {"lots": "netting"}, "buys_first": {"eval_order": "buys_first"}}),
    "OM-C": (ALL_DATES, {"parallel": {}, "race": {"slot_mode": "race"}, "sequence": {"slot_mode": "sequence"}, "shared_state": {"lots": "shared_flag"}}),
    "PX-01": (B_DATES, _one("cash_amt", "c", ["5000", "10000", "20000", "50000"], "20000")), "BL-06": (B_DATES, _one("cash_rule", "", ["skip", "partial", "nocheck"], "skip")), "OM-A": (ALL_DATES, _one("missing_bar", "", ["skip_all", "try_except", "per_ticker"], "skip_all")),
}
OPTION_LEVELS = {
    "strike": ["gte_101pct", "nearest_101pct", "nearest_otm", "nearest_spot", "delta_nearest_040"], "expiry": ["min_calendar_dte_7", "nearest_available", "min_calendar_dte_1", "min_trading_dte_5", "nearest_calendar_dte_30"],
    "right": ["call", "put"], "size": ["fixed_1", "fixed_10", "one_if_premium_le_1pct_equity", "premium_le_1pct_equity", "cash_fraction_5pct"], "profit": ["gain_50pct", "gain_25pct", "gain_100pct", "break_even", "time_stop_only"],
    "exercise": ["liquidate_shares_now", "retain_shares", "preempt_exercise", "do_not_exercise", "liquidate_shares_next_open"], "no_match": ["skip_signal", "retry_next_slice", "relax_strike", "relax_expiry", "raise_error"], "slow_period": ["slow_20", "slow_10", "slow_15", "slow_30", "slow_50"],
}
OPTION_BANKS = {
    "DONOR": (None, []), "O1e1": ("strike", ["expiry", "no_match"]), "O1e2": ("expiry", ["strike", "no_match"]), "O1e3": ("right", ["strike", "expiry", "no_match"]), "O1e4": ("size", ["strike", "expiry", "right"]),
    "O1e5": ("profit", ["strike", "expiry", "right"]), "O1e6": ("exercise", ["right"]), "O1e7": ("no_match", ["strike", "expiry"]), "O1e8": ("slow_period", ["profit"]),
}
_MAP = "map<string,string>"


def banks(spark: SparkSession, options: bool = False) -> DataFrame:
    """ord, bank, own, resolution, override, conditioning."""
    rows = []
    for bank, spec in (OPTION_BANKS if options else EQUITY_BANKS).items():
        own, cond = (spec[0], spec[1]) if options else (None, spec[0])
        resolutions = (({v: ({own: v} if i else {}) for i, v in enumerate(OPTION_LEVELS[own])} if own else {"pin": {}}) if options else spec[1])
        rows += [(len(rows) + i, bank, own, r, ov, cond) for i, (r, ov) in enumerate(resolutions.items())]
    return spark.createDataFrame(rows, f"ord int, bank string, own string, resolution string, override {_MAP}, conditioning array<string>")


def _levels(levels: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for d, v in levels.items() for x in (F.lit(d), F.array(*map(F.lit, v)))])


def _tag(setting: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(setting)), lambda e: F.concat_ws("=", e["key"], e["value"])), "_")


def expand(specs: DataFrame, levels: dict[str, list[str]], warm: bool) -> DataFrame:
    """bank, resolution, kind (grid, oat, spot), tag, setting: all rows in order, before dedup. warm: EMA resolutions
    under strict warm-up also run at each length of EMA_BARS."""
    lv, everything = _levels(levels), F.array(*map(F.lit, levels))
    s = specs.withColumns({"pinned": F.map_keys("override"), "free": F.array_except("conditioning", F.map_keys("override"))})
    s = s.withColumn("rest", F.filter(F.array_except(everything, F.col("conditioning")), lambda d: ~F.array_contains("pinned", d) & (F.col("own").isNull() | (d != F.col("own")))))
    empty = F.array(F.create_map().cast(_MAP))
    grown = F.aggregate("free", empty, lambda acc, d: F.flatten(F.transform(acc, lambda m: F.transform(F.element_at(lv, d), lambda x: F.map_concat(m, F.create_map(d, x))))))
    reference = F.create_map(*[x for d, v in levels.items() for x in (F.lit(d), F.lit(v[0]))])
    g = s.select("ord", "bank", "resolution", "override", F.lit("grid").alias("kind"), F.posexplode(grown).alias("n", "setting"))
    is_ref = F.forall(F.map_entries("setting"), lambda e: e["value"] == F.element_at(reference, e["key"]))
    g = g.withColumn("tag", F.when(is_ref, "ref").otherwise(F.concat(F.lit("T_"), _tag(F.col("setting")))))
    if warm:
        strict = (F.element_at("override", "ma_type") == "EMA") & (F.coalesce(F.element_at("setting", "warmup"), F.lit("strict")) == "strict")
        bars = F.when(strict, F.array(F.lit(None), *map(F.lit, EMA_BARS))).otherwise(F.array(F.lit(None).cast("string")))
        g = g.withColumn("wb", F.explode(bars)).withColumns({"tag": F.concat("tag", F.coalesce(F.concat(F.lit("_wb="), "wb"), F.lit(""))), "setting": F.when(F.col("wb").isNull(), F.col("setting")).otherwise(F.map_concat("setting", F.create_map(F.lit("warmup_bars"), F.col("wb"))))}).drop("wb")
    o = s.select("ord", "bank", "resolution", "override", F.lit("oat").alias("kind"), F.posexplode("rest").alias("n", "dof"))
    o = o.select("*", F.explode(F.slice(F.element_at(lv, F.col("dof")), 2, 99)).alias("level")).select("ord", "bank", "resolution", "override", "kind", "n", F.create_map("dof", "level").alias("setting"), F.concat(F.lit("OAT_"), "dof", F.lit("="), "level").alias("tag"))
    off = F.map_from_entries(F.transform("rest", lambda d: F.struct(d, F.element_at(F.element_at(lv, d), 2))))
    p = s.where(F.size(F.array_except(everything, F.col("conditioning"))) - F.when(F.col("own").isNull(), 0).otherwise(1) > 0).select("ord", "bank", "resolution", "override", F.lit("spot").alias("kind"), F.lit(0).alias("n"), off.alias("setting"), F.lit("SPOT_all_excluded_off").alias("tag"))
    rows = g.select("ord", "bank", "resolution", "override", "kind", "n", "setting", "tag").unionByName(o).unionByName(p)
    # what differs from the reference, as canonical JSON: equal texts are equal experiments
    merged = F.map_filter(F.map_concat(F.map_filter("override", lambda k, v: ~F.array_contains(F.map_keys("setting"), k)), F.col("setting")), lambda k, v: ~F.coalesce(F.element_at(reference, k) == v, F.lit(False)))
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))
    return rows.select("ord", "bank", "resolution", F.col("kind"), "n", "tag", canonical.alias("params"))


def dedup_name_or_params(rows: DataFrame, group: list[str], order: list[str], name: str, params: str) -> DataFrame:
    """In order, drop a row whose name or params an earlier kept row of its group has. A dropped row registers
    neither key, so this is a fold, per group in Arrow batches; groups are the resolutions of a bank, a few hundred
    rows each."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        names, seen, keep = set(), set(), []
        pdf = pdf.sort_values(order)
        for a, b in zip(pdf[name], pdf[params], strict=True):
            fresh = a not in names and b not in seen
            keep.append(fresh)
            if fresh:
                names.add(a)
                seen.add(b)
        return pdf[keep]

    return rows.groupBy(*group).applyInPandas(fold, rows.schema)


def equity(spark: SparkSession, dedup: bool = True) -> DataFrame:
    rows = expand(banks(spark), EQUITY_LEVELS, True)
    rows = rows.withColumn("rank", F.when(F.col("kind") == "grid", 0).when(F.col("kind") == "oat", 1).otherwise(2))
    return dedup_name_or_params(rows, ["bank", "resolution"], ["rank", "n", "tag"], "tag", "params") if dedup else rows


def options(spark: SparkSession) -> DataFrame:
    rows = expand(banks(spark, True), OPTION_LEVELS, False)
    stability = spark.createDataFrame([(0, "DONOR", "pin", "stability", 0, "REF_full_window", json.dumps({"window": "full"}))], rows.schema)
    return rows.unionByName(stability)


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bank").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("kind") == "grid").alias("grid"), F.count_if(F.col("kind") == "oat").alias("oat"), F.count_if(F.col("kind") == "spot").alias("spot"))
