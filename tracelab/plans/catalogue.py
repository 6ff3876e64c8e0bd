"""All registered queries of the trace engine, with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import text as tx
from ..operators import bars, classify, grid, indicators, signals, sim, stats, tape
from ..sources import sinks
from ..sources.tables import draws, event_ticks, fills, table, verdicts
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- bars, indicators, signals


def _daily(s: SparkSession, d: str) -> DataFrame:
    return bars.daily(event_ticks(s, d))


BARS = "bars AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS d, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"
W = "(PARTITION BY symbol ORDER BY d)"


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _sma(n: int, name: str) -> str:
    return f"CASE WHEN row_number() OVER {W} >= {n} THEN round(avg(close) OVER {_frame(n)}, 6) END AS {name}"


@query("bars_daily", f"WITH {BARS} SELECT symbol, d, open, high, low, close, volume FROM bars")
def _(s, d):
    return _daily(s, d)


@query("bars_tumbling_5min", "SELECT event_type AS symbol, CAST(time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS TIMESTAMP) AS bar_end, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def _(s, d):
    return bars.completed(event_ticks(s, d)).withColumn("bar_end", F.col("bar_end").cast("timestamp_ntz"))


@query("sma_window", f"WITH {BARS} SELECT symbol, d, {_sma(5, 'sma')} FROM bars")
def _(s, d):
    return _daily(s, d).select("symbol", "d", indicators.sma(5).alias("sma"))


@query("wma_window", f"WITH {BARS} SELECT symbol, d, CASE WHEN row_number() OVER {W} >= 3 THEN round((lag(close, 2) OVER {W} * 1 + lag(close, 1) OVER {W} * 2 + close * 3) / 6.0, 6) END AS wma FROM bars")
def _(s, d):
    return _daily(s, d).select("symbol", "d", indicators.wma(3).alias("wma"))


@query("bollinger", f"WITH {BARS} SELECT symbol, d, CASE WHEN row_number() OVER {W} >= 5 THEN round(avg(close) OVER {_frame(5)}, 6) END AS bb_mid, CASE WHEN row_number() OVER {W} >= 5 THEN round(avg(close) OVER {_frame(5)} + 2 * stddev_pop(close) OVER {_frame(5)}, 6) END AS bb_up, CASE WHEN row_number() OVER {W} >= 5 THEN round(avg(close) OVER {_frame(5)} - 2 * stddev_pop(close) OVER {_frame(5)}, 6) END AS bb_low FROM bars")
def _(s, d):
    return _daily(s, d).select("symbol", "d", *[c.alias(n) for n, c in indicators.bollinger(5).items()])


@query("stochastic", f"WITH {BARS} SELECT symbol, d, CASE WHEN row_number() OVER {W} >= 5 AND max(high) OVER {_frame(5)} > min(low) OVER {_frame(5)} THEN round(100 * (close - min(low) OVER {_frame(5)}) / (max(high) OVER {_frame(5)} - min(low) OVER {_frame(5)}), 6) END AS k FROM bars")
def _(s, d):
    return _daily(s, d).select("symbol", "d", indicators.stochastic(5).alias("k"))


RSI = f"ch AS (SELECT *, close - lag(close) OVER {W} AS ch FROM bars), rs AS (SELECT *, CASE WHEN row_number() OVER {W} >= 6 THEN CASE WHEN round(avg(greatest(-ch, 0.0)) OVER {_frame(5)}, 9) = 0 THEN 100.0 ELSE round(100 - 100 / (1 + avg(greatest(ch, 0.0)) OVER {_frame(5)} / avg(greatest(-ch, 0.0)) OVER {_frame(5)}), 6) END END AS rsi FROM ch)"


def _rsi(s, d):
    return indicators.changes(_daily(s, d)).withColumn("rsi", indicators.rsi_simple(5))


@query("rsi_simple", f"WITH {BARS}, {RSI} SELECT symbol, d, rsi FROM rs")
def _(s, d):
    return _rsi(s, d).select("symbol", "d", "rsi")


@query("rsi_exit_level", f"WITH {BARS}, {RSI} SELECT symbol, d, coalesce(rsi > 60, false) AS exits FROM rs")
def _(s, d):
    return _rsi(s, d).select("symbol", "d", signals.rsi_exit("rsi", 60.0, "level").alias("exits"))


@query("rsi_exit_cross", f"WITH {BARS}, {RSI} SELECT symbol, d, coalesce(lag(rsi) OVER {W} <= 60 AND rsi > 60, false) AS exits FROM rs")
def _(s, d):
    return _rsi(s, d).select("symbol", "d", signals.rsi_exit("rsi", 60.0, "cross").alias("exits"))


NUMBERED = f"{BARS}, nb AS (SELECT *, row_number() OVER {W} AS i, lag(close) OVER {W} AS prev FROM bars)"


@query("ema_first_seed", f"WITH RECURSIVE {NUMBERED}, e AS (SELECT symbol, d, i, close AS ema FROM nb WHERE i = 1 UNION ALL SELECT nb.symbol, nb.d, nb.i, e.ema + 2.0 / 6 * (nb.close - e.ema) FROM e JOIN nb ON nb.symbol = e.symbol AND nb.i = e.i + 1) SELECT symbol, d, CASE WHEN i > 5 THEN round(ema, 6) END AS ema FROM e")
def _(s, d):
    return indicators.recursive(_daily(s, d), ("ema",)).select("symbol", "d", "ema")


@query("rsi_wilder", f"""WITH RECURSIVE {NUMBERED},
seed AS (SELECT symbol, avg(greatest(close - prev, 0)) AS up, avg(greatest(prev - close, 0)) AS down FROM nb WHERE i BETWEEN 2 AND 6 GROUP BY 1 HAVING count(*) = 5),
e AS (SELECT nb.symbol, nb.d, nb.i, up, down FROM nb JOIN seed USING (symbol) WHERE i = 6 UNION ALL
  SELECT nb.symbol, nb.d, nb.i, (e.up * 4 + greatest(nb.close - nb.prev, 0)) / 5, (e.down * 4 + greatest(nb.prev - nb.close, 0)) / 5 FROM e JOIN nb ON nb.symbol = e.symbol AND nb.i = e.i + 1)
SELECT nb.symbol, nb.d, round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi FROM nb LEFT JOIN e ON nb.symbol = e.symbol AND nb.i = e.i""")
def _(s, d):
    return indicators.recursive(_daily(s, d), ("rsi",)).select("symbol", "d", "rsi")


@query("macd", f"""WITH RECURSIVE {NUMBERED}, e AS (SELECT symbol, d, i, close AS f, close AS g, 0.0::DOUBLE AS sig FROM nb WHERE i = 1 UNION ALL
  SELECT nb.symbol, nb.d, nb.i, e.f + 2.0 / 13 * (nb.close - e.f), e.g + 2.0 / 27 * (nb.close - e.g), e.sig + 0.2 * ((e.f + 2.0 / 13 * (nb.close - e.f)) - (e.g + 2.0 / 27 * (nb.close - e.g)) - e.sig) FROM e JOIN nb ON nb.symbol = e.symbol AND nb.i = e.i + 1)
SELECT symbol, d, round(f - g, 6) AS macd, round(sig, 6) AS macd_signal FROM e""")
def _(s, d):
    return indicators.recursive(_daily(s, d), ("macd", "macd_signal")).select("symbol", "d", "macd", "macd_signal")


@query("atr_wilder", f"""WITH RECURSIVE {NUMBERED}, tr AS (SELECT *, greatest(high, coalesce(prev, high)) - least(low, coalesce(prev, low)) AS tr FROM nb),
seed AS (SELECT symbol, avg(tr) AS a FROM tr WHERE i <= 5 GROUP BY 1 HAVING count(*) = 5),
e AS (SELECT tr.symbol, tr.i, a FROM tr JOIN seed USING (symbol) WHERE i = 5 UNION ALL SELECT tr.symbol, tr.i, (e.a * 4 + tr.tr) / 5 FROM e JOIN tr ON tr.symbol = e.symbol AND tr.i = e.i + 1)
SELECT nb.symbol, nb.d, round(a, 6) AS atr FROM nb LEFT JOIN e ON nb.symbol = e.symbol AND nb.i = e.i""")
def _(s, d):
    return indicators.recursive(_daily(s, d), ("atr",)).select("symbol", "d", "atr")


CROSS = f"m AS (SELECT *, {_sma(5, 'ma')} FROM bars), x AS (SELECT *, lag(close) OVER {W} AS c0, lag(ma) OVER {W} AS m0 FROM m), sg AS (SELECT *, coalesce(c0 <= m0 AND close > ma, false) AS up, coalesce(c0 >= m0 AND close < ma, false) AS down FROM x)"


@query("cross_signals", f"WITH {BARS}, {CROSS} SELECT symbol, d, up, down, up OR down AS any_dir, coalesce(close > ma, false) AS level_above FROM sg")
def _(s, d):
    b = signals.price_cross(_daily(s, d))
    return b.select("symbol", "d", "up", "down", (F.col("up") | F.col("down")).alias("any_dir"), signals.crossed(signals.before("close"), F.col("close"), signals.before("ma"), F.col("ma"), "level_above").alias("level_above")).withColumn("level_above", F.coalesce("level_above", F.lit(False)))


@query("today_ma_cross", f"WITH {BARS}, {CROSS} SELECT symbol, d, coalesce(c0 <= ma AND close > ma, false) AS up, coalesce(c0 >= ma AND close < ma, false) AS down FROM sg")
def _(s, d):
    return signals.price_cross(_daily(s, d), today_ma=True).select("symbol", "d", "up", "down")


@query("ma_ma_cross", f"WITH {BARS}, m AS (SELECT *, {_sma(3, 'f')}, {_sma(8, 'g')} FROM bars), x AS (SELECT *, lag(f) OVER {W} AS f0, lag(g) OVER {W} AS g0 FROM m) SELECT symbol, d, coalesce(f0 <= g0 AND f > g, false) AS up, coalesce(f0 >= g0 AND f < g, false) AS down FROM x")
def _(s, d):
    return signals.average_cross(_daily(s, d)).select("symbol", "d", "up", "down")


for _kind, _test in (("prev_close", "close < prev"), ("prev_close_le", "close <= prev"), ("open_close", "close < open")):

    @query(f"red_streak_{_kind}", f"WITH {NUMBERED}, r AS (SELECT *, i > 1 AND coalesce({_test}, false) AS red FROM nb) SELECT symbol, d, i - coalesce(max(CASE WHEN NOT red THEN i END) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS streak FROM r")
    def _(s, d, kind=_kind):
        return signals.red_streak(_daily(s, d), kind).select("symbol", "d", F.col("streak").cast("long").alias("streak"))


@query("readiness_mask", f"WITH {BARS} SELECT symbol, d, row_number() OVER {W} >= 6 AS ready_lead, row_number() OVER {W} >= 4 AS ready_second, row_number() OVER {W} - 1 AS bar_index FROM bars")
def _(s, d):
    return _daily(s, d).select("symbol", "d", indicators.readiness(6).alias("ready_lead"), indicators.readiness(4).alias("ready_second"), (F.row_number().over(indicators.by_day()) - 1).cast("long").alias("bar_index"))


TAPE = f"{BARS}, {CROSS}, sd AS (SELECT symbol, d, CASE WHEN up THEN 'B' WHEN down THEN 'S' END AS side, lead(open) OVER {W} AS price, lead(d) OVER {W} AS fill_d FROM sg), ev AS (SELECT * FROM sd WHERE side IS NOT NULL AND price IS NOT NULL), ch AS (SELECT *, lag(side) OVER {W} AS was FROM ev), tape AS (SELECT symbol, fill_d, side, price FROM ch WHERE (was IS NULL AND side = 'B') OR was <> side)"


@query("flagship_cross_tape", f"WITH {TAPE} SELECT symbol, string_agg(strftime(fill_d, '%Y-%m-%d') || '|' || side, ';' ORDER BY fill_d) AS projection, sha256(string_agg(strftime(fill_d, '%Y-%m-%d') || '|' || side, ';' ORDER BY fill_d)) AS sha, count(*) AS fills FROM tape GROUP BY 1")
def flagship(s, d):
    """events -> daily bars -> average -> crosses -> alternating fills at the next open -> canonical key."""
    t = signals.cross_tape(_daily(s, d)).withColumn("t", F.concat_ws("|", F.date_format("fill_d", "yyyy-MM-dd"), "side"))
    p = t.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fill_d", "t"))), lambda x: x["t"]), ";").alias("projection"), F.count(F.lit(1)).alias("fills"))
    return p.select("symbol", "projection", F.sha2("projection", 256).alias("sha"), "fills")


@query("cross_tape", f"WITH {TAPE} SELECT symbol, fill_d, side, price FROM tape")
def _(s, d):
    return signals.cross_tape(_daily(s, d))


# ---------------------------------------------------------------- tapes

FILLS = "f AS (SELECT l_orderkey AS run, epoch(l_shipdate) AS time, l_returnflag AS sym, CAST(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS q, l_linenumber AS order_id, l_discount AS disc FROM lineitem), n AS (SELECT run, time, order_id, sym, q, CASE WHEN q > 0 THEN 'B' ELSE 'S' END AS side, strftime(make_timestamp(CAST((time - 18000) * 1000000 AS BIGINT)), '%Y-%m-%d') AS day FROM f WHERE disc >= 0.01)"
_TEXT = {
    "full": ("true", "day || '|' || sym || '|' || side || '|' || abs(q)"), "dates_all": ("true", "day || '|' || sym || '|' || side"), "lead_entries_exits": ("sym = 'A'", "day || '|' || side"), "lead_full": ("sym = 'A'", "day || '|' || side || '|' || abs(q)"),
    "second_entries": ("sym = 'N' AND side = 'B'", "day"), "second_exits": ("sym = 'N' AND side = 'S'", "day"), "second_full": ("sym = 'N'", "day || '|' || side || '|' || abs(q)"),
}
for _kind in tape.KINDS:

    @query(f"proj_{_kind}", f"WITH {FILLS} SELECT run, coalesce(string_agg({_TEXT[_kind][1]}, ';' ORDER BY time, order_id, sym, q) FILTER (WHERE {_TEXT[_kind][0]}), '') AS proj_{_kind} FROM n GROUP BY 1")
    def _(s, d, kind=_kind):
        return tape.project(fills(s, d), (kind,))


@query("proj_all_kinds_map", "WITH " + FILLS + " SELECT run, " + ", ".join(f"coalesce(string_agg({t}, ';' ORDER BY time, order_id, sym, q) FILTER (WHERE {w}), '') AS proj_{k}" for k, (w, t) in _TEXT.items()) + " FROM n GROUP BY 1")
def _(s, d):
    return tape.project(fills(s, d))


@query("tape_normalise", f"WITH {FILLS} SELECT run, CAST(order_id AS BIGINT) AS order_id, sym, q, side, day FROM n")
def _(s, d):
    return tape.normalise(fills(s, d)).select("run", "order_id", "sym", "q", "side", "day")


@query("proj_sell_ratio", f"""WITH RECURSIVE {FILLS}, o AS (SELECT run, q, row_number() OVER (PARTITION BY run ORDER BY time, order_id, q) AS i FROM n WHERE sym = 'A'),
w AS (SELECT run, i, CAST(0 AS BIGINT) AS held0, greatest(q, 0) AS held1, q FROM o WHERE i = 1 UNION ALL SELECT o.run, o.i, w.held1, greatest(w.held1 + o.q, 0), o.q FROM w JOIN o ON o.run = w.run AND o.i = w.i + 1)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY i) - 1 AS sale, least(-q, held0) AS sold, held0 AS held, (200 * least(-q, held0) + held0) // (2 * held0) AS ratio_pct FROM w WHERE q <= 0 AND held0 > 0""")
def _(s, d):
    return tape.sell_ratio(fills(s, d))


@query("tape_compare", f"""WITH {FILLS}, t AS (SELECT run, string_agg(day || side, ';' ORDER BY time, order_id) AS p, string_agg(day || side || q, ';' ORDER BY time, order_id) AS x FROM n GROUP BY 1)
SELECT a.run, a.p = b.p AS primary_match, a.x = b.x AS secondary_match FROM t a JOIN t b ON b.run = a.run + 1""")
def _(s, d):
    n = tape.normalise(fills(s, d)).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("time", "order_id", F.col("day").alias("dt"), "side", F.col("q").cast("double").alias("size")))), lambda x: F.struct(x["dt"].alias("dt"), x["side"].alias("side"), x["size"].alias("size"))).alias("tape"))
    other = n.select((F.col("run") - 1).alias("run"), F.col("tape").alias("canonical"))
    j = n.join(other, "run")
    return j.select("run", *[c.alias(k) for k, c in tape.compare(F.col("tape"), F.col("canonical")).items()])


# ---------------------------------------------------------------- grids


def _values(options: bool) -> str:
    known = {"DONOR": 32, "O1e1": 215, "O1e2": 215, "O1e3": 284, "O1e4": 335, "O1e5": 335, "O1e6": 135, "O1e7": 215, "O1e8": 135} if options else {"BL-01a": 63, "BL-01b": 85, "BL-01c": 315, "BL-03": 168, "BL-04": 153, "BL-05": 204, "BL-06": 153, "BL-07": 204, "BL-08": 204, "BL-09": 768, "CROSS": 320, "DONOR": 10, "ER-01": 168, "OM-A": 291, "OM-B": 388, "OM-C": 388, "PX-01": 204}
    return ", ".join(f"('{b}', {n})" for b, n in known.items())


@query("grid_counts_equity", f"SELECT coalesce(bank, 'TOTAL') AS bank, CAST(sum(n) AS BIGINT) AS runs FROM (VALUES {_values(False)}) t(bank, n) GROUP BY ROLLUP (bank)")
def _(s, d):
    return grid.equity(s).rollup("bank").agg(F.count(F.lit(1)).alias("runs")).select(F.coalesce("bank", F.lit("TOTAL")).alias("bank"), "runs")


@query("grid_counts_options", f"SELECT coalesce(bank, 'TOTAL') AS bank, CAST(sum(n) AS BIGINT) AS runs FROM (VALUES {_values(True)}) t(bank, n) GROUP BY ROLLUP (bank)")
def _(s, d):
    return grid.options(s).rollup("bank").agg(F.count(F.lit(1)).alias("runs")).select(F.coalesce("bank", F.lit("TOTAL")).alias("bank"), "runs")


def _sizes(options: bool) -> str:
    """Rows of each bank before dedup, by arithmetic over the level counts: products, sums and one spot row."""
    levels, banks = (grid.OPTION_LEVELS, grid.OPTION_BANKS) if options else (grid.EQUITY_LEVELS, grid.EQUITY_BANKS)
    specs = []
    for bank, spec in banks.items():
        own, cond = spec if options else (None, spec[0])
        overrides = [({own} if own else set(), False) for _ in range(len(levels[own]) if own else 1)] if options else [(set(o), o.get("ma_type") == "EMA") for o in spec[1].values()]
        specs += [f"('{bank}', {i}, {sorted(cond)!r}::VARCHAR[], {sorted(o)!r}::VARCHAR[], {str(ema).lower()})" for i, (o, ema) in enumerate(overrides)]
    return f"""WITH lv(dof, i, level) AS (VALUES {_sql_levels(levels)}), n AS (SELECT dof, count(*) AS k FROM lv GROUP BY 1), sp(bank, r, cond, pinned, ema) AS (VALUES {", ".join(specs)}),
g AS (SELECT bank, r, any_value(ema) AS ema, CAST(round(exp(sum(ln(CASE WHEN list_contains(cond, dof) AND NOT list_contains(pinned, dof) THEN k ELSE 1 END)))) AS BIGINT) AS grid, sum(CASE WHEN NOT list_contains(cond, dof) AND NOT list_contains(pinned, dof) THEN k - 1 ELSE 0 END) AS oat,
  max(CASE WHEN NOT list_contains(cond, dof) AND NOT list_contains(pinned, dof) THEN 1 ELSE 0 END) AS rest, max(CASE WHEN list_contains(cond, 'warmup') AND dof = 'warmup' THEN k ELSE 1 END) AS warm FROM sp CROSS JOIN n GROUP BY 1, 2)
SELECT bank, CAST(sum(grid + CASE WHEN ema THEN grid // warm * {0 if options else len(grid.EMA_BARS)} ELSE 0 END) AS BIGINT) AS grid, CAST(sum(oat) AS BIGINT) AS oat FROM g GROUP BY 1"""


for _kind in (False, True):

    @query("grid_sizes_options" if _kind else "grid_sizes_equity", None)
    def _(s, d, options=_kind):
        rows = grid.expand(grid.banks(s, options), grid.OPTION_LEVELS if options else grid.EQUITY_LEVELS, not options)
        return rows.groupBy("bank").agg(F.count_if(F.col("kind") == "grid").alias("grid"), F.count_if(F.col("kind") == "oat").alias("oat"))


def _sql_levels(levels: dict) -> str:
    return ", ".join(f"('{d}', {i}, '{v}')" for d, vs in levels.items() for i, v in enumerate(vs))


ORACLE_SQL |= {"grid_sizes_options": _sizes(True), "grid_sizes_equity": _sizes(False)}
_BL09 = " UNION ALL ".join(f"SELECT 'BL-09' AS bank, '{r}' AS resolution" for r in grid.EQUITY_BANKS["BL-09"][1])
_AXES = " ".join(f"CROSS JOIN (SELECT level AS {d} FROM lv WHERE dof = '{d}') AS a_{d}" for d in grid.EQUITY_LEVELS)


@query("grid_equity_full_factorial", f"WITH lv(dof, i, level) AS (VALUES {_sql_levels(grid.EQUITY_LEVELS)}), r AS ({_BL09}) SELECT r.bank, r.resolution, " + " || '_' || ".join(f"'{d}=' || {d}" for d in sorted(grid.EQUITY_LEVELS)) + f" AS cell FROM r {_AXES}")
def _(s, d):
    rows = grid.expand(grid.banks(s).where("bank = 'BL-09'"), grid.EQUITY_LEVELS, True)
    every = "T_" + "_".join(f"{k}={v[0]}" for k, v in sorted(grid.EQUITY_LEVELS.items()))
    return rows.where("kind = 'grid'").select("bank", "resolution", F.substring(F.when(F.col("tag") == "ref", every).otherwise(F.col("tag")), 3, 999).alias("cell"))


@query("oat_rows", f"WITH lv(dof, i, level) AS (VALUES {_sql_levels(grid.OPTION_LEVELS)}), b(bank, own, cond) AS (VALUES " + ", ".join(f"('{b}', {repr(o) if o else 'NULL'}, {c!r}::VARCHAR[])" for b, (o, c) in grid.OPTION_BANKS.items()) + ") SELECT bank, coalesce(o.level, 'pin') AS resolution, 'OAT_' || x.dof || '=' || x.level AS tag FROM b LEFT JOIN lv o ON o.dof = b.own JOIN lv x ON x.i > 0 AND x.dof IS DISTINCT FROM b.own AND NOT list_contains(b.cond, x.dof)")
def _(s, d):
    return grid.expand(grid.banks(s, True), grid.OPTION_LEVELS, False).where("kind = 'oat'").select("bank", "resolution", "tag")


@query("spot_rows", "SELECT bank, CAST(n AS BIGINT) AS spots FROM (VALUES ('DONOR', 1), ('O1e1', 5), ('O1e2', 5), ('O1e3', 2), ('O1e4', 5), ('O1e5', 5), ('O1e6', 5), ('O1e7', 5), ('O1e8', 5)) t(bank, n)")
def _(s, d):
    return grid.expand(grid.banks(s, True), grid.OPTION_LEVELS, False).where("kind = 'spot'").groupBy("bank").agg(F.count(F.lit(1)).alias("spots"))


@query("dedup_name_or_params")
def _(s, d):
    return grid.equity(s).select("bank", "resolution", "kind", "tag", "params")


# ---------------------------------------------------------------- joins


@query("resume_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    done = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("resume_anti_multi_key", "SELECT user_id, event_type, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.value > 99) GROUP BY 1, 2")
def _(s, d):
    e = table(s, d, "events")
    return e.join(e.where("value > 99").select("user_id", "event_type"), ["user_id", "event_type"], "left_anti").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("semi_current", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    now = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey", "c_name").join(now, "c_custkey", "left_semi")


@query("binding_override_left", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS binding, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN CAST(l.quality AS VARCHAR) IS NOT DISTINCT FROM d.lang THEN 'consistent' ELSE 'requirements-override' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    a, b = table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").select("doc_id", F.col("quality").cast("string").alias("need"), F.lit(1).alias("has"))
    return a.join(b, "doc_id", "left").select("doc_id", F.coalesce("need", "lang").alias("binding"), F.when(F.col("has").isNull(), "missing").when(F.col("need").eqNullSafe(F.col("lang")), "consistent").otherwise("requirements-override").alias("status"))


DRAWS = "dr AS (SELECT o_orderkey AS draw, c_mktsegment AS model, o_orderpriority AS prompt, o_orderstatus AS code, o_totalprice AS numeric, o_custkey AS cell, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"
DIST = "dist AS (SELECT model, code, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY model) AS p FROM dr GROUP BY 1, 2)"


@query("dist_full_outer", f"WITH {DRAWS}, {DIST}, a AS (SELECT * FROM dist WHERE model = 'BUILDING'), b AS (SELECT * FROM dist WHERE model = 'MACHINERY') SELECT coalesce(a.code, b.code) AS code, round(coalesce(a.p, 0), 6) AS pa, round(coalesce(b.p, 0), 6) AS pb FROM a FULL JOIN b ON a.code = b.code")
def _(s, d):
    x = stats.distribution(draws(s, d), ["model"], "code")
    a, b = (x.where(F.col("model") == m).select("code", F.col("p").alias(n)) for m, n in (("BUILDING", "pa"), ("MACHINERY", "pb")))
    return a.join(b, "code", "full").select("code", F.round(F.coalesce("pa", F.lit(0.0)), 6).alias("pa"), F.round(F.coalesce("pb", F.lit(0.0)), 6).alias("pb"))


@query("best_envelope_dedup", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value >= 50 DESC, CASE WHEN value >= 50 THEN -event_id ELSE event_id END) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1")
def _(s, d):
    done = F.col("value") >= 50
    best = Window.partitionBy("user_id", "event_type").orderBy(done.desc(), F.when(done, -F.col("event_id")).otherwise(F.col("event_id")))
    return table(s, d, "events").withColumn("rn", F.row_number().over(best)).where("rn = 1").select("user_id", "event_type", "event_id", "value")


@query("invariance_mismatch", "WITH ref AS (SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS ref FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) SELECT o.o_custkey, count(*) AS n, count(*) FILTER (WHERE o.o_orderstatus IS DISTINCT FROM r.ref) AS mismatches FROM orders o LEFT JOIN ref r ON o.o_custkey = r.o_custkey WHERE o_orderpriority NOT LIKE '1%' GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders")
    ref = o.where("o_orderpriority like '1%'").groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("ref"))
    j = o.where("o_orderpriority not like '1%'").join(ref, "o_custkey", "left")
    return j.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("o_orderstatus").eqNullSafe(F.col("ref"))).alias("mismatches"))


@query("asof_last_value", "SELECT s.event_id, q.value AS quote FROM events s ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') q ON s.user_id = q.user_id AND s.ts >= q.ts WHERE s.event_type = 'purchase'")
def _(s, d):
    e = table(s, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "view", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = e.where("event_type in ('view', 'purchase')").withColumn("quote", F.last(F.when(F.col("event_type") == "view", F.col("value")), True).over(order))
    return both.where("event_type = 'purchase'").select("event_id", "quote")


@query("nearest_argmin", "SELECT c_nationkey, arg_min(c_custkey, abs(c_acctbal - 5000) * 1e9 + c_custkey) AS nearest FROM customer WHERE abs(c_acctbal - 5000) <= 4000 GROUP BY 1")
def _(s, d):
    c = table(s, d, "customer").where(F.abs(F.col("c_acctbal") - 5000) <= 4000)
    return c.groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(F.abs(F.col("c_acctbal") - 5000), F.col("c_custkey"))).alias("nearest"))


@query("alias_resolve", "SELECT n_name, coalesce(r_name, 'none') AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    r = table(s, d, "region")  # five rows by definition
    return table(s, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("numeric_resolution", "WITH known(id) AS (VALUES ('p1'), ('p5'), ('p10'), ('p20'), ('p50')) SELECT p_partkey, coalesce(id, 'other') AS code FROM part LEFT JOIN known ON id = 'p' || p_size")
def _(s, d):
    known = s.createDataFrame([(f"p{k}",) for k in (1, 5, 10, 20, 50)], "id string")
    return table(s, d, "part").withColumn("key", F.format_string("p%d", "p_size")).join(F.broadcast(known), F.col("key") == F.col("id"), "left").select("p_partkey", F.coalesce("id", F.lit("other")).alias("code"))


# ---------------------------------------------------------------- aggregates


@query("status_hist", f"WITH {DRAWS} SELECT model, code, count(*) AS n FROM dr GROUP BY 1, 2")
def _(s, d):
    return draws(s, d).groupBy("model", "code").agg(F.count(F.lit(1)).alias("n"))


@query("dispersion_v", f"WITH {DRAWS} SELECT cell, CASE WHEN count(code) > 1 THEN round((count(DISTINCT code) - 1) / (count(code) - 1), 3) END AS v FROM dr GROUP BY 1")
def _(s, d):
    return draws(s, d).groupBy("cell").agg(stats.dispersion(F.col("code")).alias("v"))


@query("total_variation", f"WITH {DRAWS}, {DIST}, a AS (SELECT * FROM dist WHERE model = 'BUILDING'), b AS (SELECT * FROM dist WHERE model = 'MACHINERY') SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS tv FROM a FULL JOIN b ON a.code = b.code")
def _(s, d):
    return stats.total_variation(draws(s, d), "model", "code", "BUILDING", "MACHINERY")


@query("lattice_monotone", f"WITH {DRAWS}, v AS (SELECT cell, {', '.join(f'''count(DISTINCT code) FILTER (WHERE prompt LIKE '{k}%') AS v{k}, count(*) FILTER (WHERE prompt LIKE '{k}%') AS n{k}''' for k in (1, 2, 3))} FROM dr GROUP BY 1) SELECT cell, CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN v3 >= greatest(v1, v2) END AS holds FROM v")
def _(s, d):
    own = {k: F.col("prompt").startswith(str(k)) for k in (1, 2, 3)}
    g = draws(s, d).groupBy("cell").agg(*[F.count_distinct(F.when(c, F.col("code"))).alias(f"v{k}") for k, c in own.items()], *[F.count_if(c).alias(f"n{k}") for k, c in own.items()])
    return g.select("cell", F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0), F.col("v3") >= F.greatest("v1", "v2")).alias("holds"))


@query("code_marginals", "SELECT regexp_extract(p_name, '^(\\S+)', 1) AS kind, regexp_extract(p_type, '(\\S+)$', 1) AS period, count(*) AS n FROM part GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "part").groupBy(F.regexp_extract("p_name", r"^(\S+)", 1).alias("kind"), F.regexp_extract("p_type", r"(\S+)$", 1).alias("period")).agg(F.count(F.lit(1)).alias("n"))


VERD = "v AS (SELECT doc_id, lang, source, quality = 1 AS truth, toxic = 0 AS judge, n_chars FROM documents JOIN labels USING (doc_id))"
_WILSON = "CASE WHEN n > 0 THEN round(least(greatest((k / n + 3.841458881296 / (2 * n) {s} 1.959964 * sqrt(k / n * (1 - k / n) / n + 3.841458881296 / (4 * n * n))) / (1 + 3.841458881296 / n), 0.0), 1.0), 6) END"


@query("wilson_ci", f"WITH {VERD}, g AS (SELECT lang, CAST(count(*) FILTER (WHERE judge AND NOT truth) AS DOUBLE) AS k, CAST(count(*) FILTER (WHERE NOT truth) AS DOUBLE) AS n FROM v GROUP BY 1) SELECT lang, {_WILSON.format(s='-')} AS lo, {_WILSON.format(s='+')} AS hi FROM g")
def _(s, d):
    g = verdicts(s, d).groupBy("lang").agg(F.count_if(F.col("judge") & ~F.col("truth")).cast("double").alias("k"), F.count_if(~F.col("truth")).cast("double").alias("n"))
    lo, hi = stats.wilson(F.try_divide(F.col("k"), F.lit(1)), F.nullif(F.col("n"), F.lit(0.0)))
    return g.select("lang", lo.alias("lo"), hi.alias("hi"))


@query("confusion", f"WITH {VERD} SELECT coalesce(lang, 'ALL') AS lang, count(*) FILTER (WHERE truth AND judge) AS tp, count(*) FILTER (WHERE NOT truth AND judge) AS fp, count(*) FILTER (WHERE truth AND NOT judge) AS fn, count(*) FILTER (WHERE NOT truth AND NOT judge) AS tn, count(*) FILTER (WHERE truth = judge) AS right FROM v GROUP BY GROUPING SETS ((lang), ())".replace(" AS right", ' AS "right"'))
def _(s, d):
    return verdicts(s, d).rollup("lang").agg(*[c.alias(k) for k, c in stats.confusion(F.col("truth"), F.col("judge")).items()]).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "tp", "fp", "fn", "tn", "right")


@query("majority_vote", "SELECT l_orderkey, count(*) AS n_votes, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS yes, 2 * sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) > count(*) AS verdict FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def _(s, d):
    return stats.majority(table(s, d, "lineitem").withColumn("vote", F.col("l_quantity") > 25), ["l_orderkey"], "vote")


@query("flip_count", f"WITH {VERD} SELECT source, count(*) FILTER (WHERE truth <> judge) AS flips, count(*) AS n FROM v GROUP BY 1")
def _(s, d):
    return verdicts(s, d).groupBy("source").agg(F.count_if(F.col("truth") != F.col("judge")).alias("flips"), F.count(F.lit(1)).alias("n"))


@query("convergence", f"WITH {FILLS}, t AS (SELECT run, string_agg(sym || side, ';' ORDER BY time, order_id) AS tape FROM n GROUP BY 1), o AS (SELECT o_custkey AS task, tape FROM orders LEFT JOIN t ON run = o_orderkey) SELECT task, count(tape) AS n_ok, count(DISTINCT tape) AS n_tapes, CASE WHEN count(tape) < 2 THEN 'INSUFFICIENT' WHEN count(DISTINCT tape) = 1 THEN CASE WHEN max(length(tape)) = 0 THEN 'CONVERGED-EMPTY' ELSE 'CONVERGED' END ELSE 'DIVERGED' END AS proposal FROM o GROUP BY 1")
def _(s, d):
    """Fills of equal time and order id stand as in the table, by file and row, as SQL on one thread has them."""
    rows = fills(s, d, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    n = tape.normalise(rows, "file", "row").withColumn("t", F.concat("sym", "side")).where("t is not null")
    item = F.struct(F.isnull("time"), "time", F.isnull("order_id"), "order_id", "file", "row", "t")
    t = n.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ";").alias("tape"))
    o = table(s, d, "orders").join(t, F.col("o_orderkey") == F.col("run"), "left").select(F.col("o_custkey").alias("task"), "tape")
    return stats.convergence(o, "task", "tape")


@query("upper_median", "SELECT user_id, coalesce(list_sort(list(value))[len(list(value)) // 2 + 1], 0.0) AS med FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(stats.upper_median("value").alias("med"))


@query("floor_collapse", f"WITH {DRAWS}, s AS (SELECT cell, code, list_sort(list(DISTINCT prompt)) AS res FROM dr GROUP BY 1, 2) SELECT array_to_string(res, '+') AS collapsed, count(*) AS n FROM s WHERE len(res) > 1 GROUP BY 1")
def _(s, d):
    g = draws(s, d).groupBy("cell", "code").agg(F.array_sort(F.collect_set("prompt")).alias("res")).where(F.size("res") > 1)
    return g.groupBy(F.array_join("res", "+").alias("collapsed")).agg(F.count(F.lit(1)).alias("n"))


@query("discrimination_floor", f"WITH {DRAWS}, s AS (SELECT prompt, cell, count(DISTINCT code) AS k FROM dr GROUP BY 1, 2) SELECT prompt, min(k) AS floor, count(*) FILTER (WHERE k < 2) AS under, CASE WHEN count(*) = 1 THEN 'N/A' WHEN min(k) >= 2 THEN 'PASS' ELSE 'FAIL' END AS gate FROM s GROUP BY 1")
def _(s, d):
    k = draws(s, d).groupBy("prompt", "cell").agg(F.count_distinct("code").alias("k"))
    return k.groupBy("prompt").agg(F.min("k").alias("floor"), F.count_if(F.col("k") < 2).alias("under"), F.when(F.count(F.lit(1)) == 1, "N/A").when(F.min("k") >= 2, "PASS").otherwise("FAIL").alias("gate"))


@query("funnel_rollup", f"WITH {VERD} SELECT coalesce(source, 'ALL') AS source, count(*) AS n, count(*) FILTER (WHERE n_chars > 200) AS compiled, count(*) FILTER (WHERE n_chars > 200 AND truth) AS ran, count(*) FILTER (WHERE n_chars > 200 AND truth AND judge) AS passed, round(100.0 * count(*) FILTER (WHERE n_chars > 200 AND truth AND judge) / count(*), 2) AS pct FROM v GROUP BY ROLLUP (source)")
def _(s, d):
    a = F.col("n_chars") > 200
    b, c = a & F.col("truth"), a & F.col("truth") & F.col("judge")
    g = verdicts(s, d).rollup("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("compiled"), F.count_if(b).alias("ran"), F.count_if(c).alias("passed"), F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 2).alias("pct"))
    return g.withColumn("source", F.coalesce("source", F.lit("ALL")))


@query("cell_completeness", f"WITH {DRAWS}, c AS (SELECT model, prompt, count(*) FILTER (WHERE code <> 'P') AS usable FROM dr GROUP BY 1, 2) SELECT model, bool_and(usable >= 30) AS complete, CAST(sum(usable) AS BIGINT) AS total, count(*) FILTER (WHERE usable < 30) AS short, CAST(sum(greatest(30 - usable, 0)) AS BIGINT) AS ask_for FROM c GROUP BY 1")
def _(s, d):
    c = draws(s, d).groupBy("model", "prompt").agg(F.count_if(F.col("code") != "P").alias("usable"))
    return c.groupBy("model").agg(F.bool_and(F.col("usable") >= 30).alias("complete"), F.sum("usable").alias("total"), F.count_if(F.col("usable") < 30).alias("short"), F.sum(F.greatest(30 - F.col("usable"), F.lit(0))).alias("ask_for"))


@query("best_of_attempts", "WITH u AS (SELECT l_orderkey, l_linenumber AS turn, l_quantity AS reward, min(CASE WHEN l_quantity >= 45 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS until FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY reward DESC, turn) AS rn FROM u WHERE until IS NULL OR turn <= until) SELECT l_orderkey, max(CASE WHEN rn = 1 THEN turn END) AS best_turn, max(reward) AS best_reward, count(*) AS turns FROM k GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("turn"), F.col("l_quantity").alias("reward"))
    return stats.best_attempt(li, "l_orderkey", "turn", "reward", F.col("reward") >= 45)


@query("turns_to_success", "WITH f AS (SELECT l_orderkey, min(CASE WHEN l_quantity >= 45 THEN l_linenumber END) AS turn FROM lineitem GROUP BY 1) SELECT turn, count(*) AS n FROM f GROUP BY 1")
def _(s, d):
    f = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_quantity") >= 45, F.col("l_linenumber"))).alias("turn"))
    return f.groupBy("turn").agg(F.count(F.lit(1)).alias("n"))


@query("ledger_last_wins", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(s, d):
    return stats.latest(table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))


@query("ordered_agg_hash", "SELECT lang, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS agg FROM documents GROUP BY 1")
def _(s, d):
    t = table(s, d, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("h"))
    return t.groupBy("lang").agg(stats.ordered_hash("h", "doc_id").alias("agg"))


@query("frame_manifest", f"WITH {BARS} SELECT symbol, count(*) AS n_rows, min(d) AS first, max(d) AS last FROM bars GROUP BY 1")
def _(s, d):
    return _daily(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("d").alias("first"), F.max("d").alias("last"))


@query("symbol_members", "SELECT c_mktsegment, c_nationkey, array_to_string(list_sort(list(c_custkey)), ',') AS ids FROM customer GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_custkey")), ",").alias("ids"))


@query("nested_topics", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT coalesce(l_returnflag, '?'))), ',') AS topics FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(s, d):
    nested = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("topic"))).alias("assumptions"))
    j = table(s, d, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("assumptions", lambda x: F.coalesce(x["topic"], F.lit("?"))))))), ",").alias("topics"))


@query("consensus", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, CASE count(DISTINCT l_returnflag) WHEN 0 THEN 'no-impl' WHEN 1 THEN 'ok' ELSE 'unresolved' END AS status, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'mixed' ELSE max(l_linestatus) END AS comparator FROM lineitem GROUP BY 1")
def _(s, d):
    n = F.count_distinct("l_returnflag")
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(n.alias("n"), F.when(n == 0, "no-impl").when(n == 1, "ok").otherwise("unresolved").alias("status"), F.when(F.count_distinct("l_linestatus") > 1, "mixed").otherwise(F.max("l_linestatus")).alias("comparator"))


@query("total_return", "SELECT user_id, CASE WHEN arg_min(value, event_id) <= 0 THEN 0 ELSE round((arg_max(value, event_id) - arg_min(value, event_id)) / arg_min(value, event_id) * 100, 4) END AS ret FROM events GROUP BY 1")
def _(s, d):
    a, b = F.min_by("value", "event_id"), F.max_by("value", "event_id")
    return table(s, d, "events").groupBy("user_id").agg(F.when(a <= 0, 0.0).otherwise(F.round((b - a) / a * 100, 4)).alias("ret"))


@query("uniqueness", "SELECT count(DISTINCT doc_id) = count(*) AS unique_ids, count(DISTINCT sha256(text)) = count(*) AS unique_texts FROM documents")
def _(s, d):
    return table(s, d, "documents").agg((F.count_distinct("doc_id") == F.count(F.lit(1))).alias("unique_ids"), (F.count_distinct(F.sha2("text", 256)) == F.count(F.lit(1))).alias("unique_texts"))


# ---------------------------------------------------------------- text

#: White space for DuckDB's trim.
B = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

# Ten kinds of answers over the documents: fences, thoughts with and without end, questions and ratings, odd white space.
_KINDS = [
    ("Plan.\n```python\nimport x\n", "\n```\nDone"), ("<think>hm</think> ", ""), ("", "\nWhat period should I use?"), ("Rating: [[1]] ", ""), ("", ""), ("", " Tell me more?\n\n\t\n\n"), ("<think>no end ", ""), ("<think>hm\n \tclass A:\nimport z\n", "\f"),
    ("\r\nRating: [[99999999999999999999]] or [[", "]]"), ("```\n \t\n``` say\n```\n\tfrom y import z\n", "\n``` \r\n"),
]


def _chars(x: str) -> str:
    """A SQL text of any characters."""
    parts = [f"'{part}'" if part not in BLANK else f"chr({ord(part)})" for part in re.split(r"([\n\t\r\f])", x) if part]
    return "(" + " || ".join(parts or ["''"]) + ")"


BLANK = "\n\t\r\f"
RAW = "raw AS (SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN {_chars(a)} || text || {_chars(b)}" for i, (a, b) in enumerate(_KINDS)) + " END AS t FROM documents)"


def _raw(s, d):
    t, kind = F.col("text"), F.col("doc_id") % 10
    said = F.when(kind == 0, F.concat(F.lit(_KINDS[0][0]), t, F.lit(_KINDS[0][1])))
    for i, (a, b) in enumerate(_KINDS[1:], 1):
        said = said.when(kind == i, F.concat(F.lit(a), t, F.lit(b)))
    return table(s, d, "documents").select("doc_id", said.alias("t"))


_FENCE = "```(?:python)?\\s*\\n([\\s\\S]*?)```"


@query("fence_extract", f"WITH {RAW}, b AS (SELECT doc_id, regexp_extract_all(t, '{_FENCE}', 1) AS blocks FROM raw) SELECT doc_id, sha256(blocks[list_position(list_transform(blocks, lambda x: length(x)), list_max(list_transform(blocks, lambda x: length(x))))]) AS h FROM b")
def _(s, d):
    return _raw(s, d).select("doc_id", F.sha2(tx.fenced(F.col("t")), 256).alias("h"))


@query("ask_classify", f"WITH {RAW} SELECT doc_id, contains(right(trim(t, {B}), 3), '?') OR regexp_matches(t, '{tx.ASK}') AS asks FROM raw")
def _(s, d):
    return _raw(s, d).select("doc_id", tx.asks(F.col("t")).alias("asks"))


@query("ask_rate", f"WITH {RAW}, a AS (SELECT lang, contains(right(trim(t, {B}), 3), '?') OR regexp_matches(t, '{tx.ASK}') AS asks FROM raw JOIN documents USING (doc_id)) SELECT lang, round(avg(CASE WHEN asks THEN 1.0 ELSE 0.0 END), 6) AS rate FROM a GROUP BY 1")
def _(s, d):
    j = _raw(s, d).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.round(F.avg(tx.asks(F.col("t")).cast("int").cast("double")), 6).alias("rate"))


def _from(lines: str, pattern: str, otherwise: str) -> str:
    """Lines from the first that matches on."""
    at = f"list_position(list_transform({lines}, lambda x: regexp_matches(trim(x, {B}), '{pattern}')), true)"
    return f"CASE WHEN {at} > 0 THEN array_to_string({lines}[{at}:], chr(10)) ELSE {otherwise} END"


@query("clean_code", rf"""WITH {RAW}, k AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM raw),
a AS (SELECT doc_id, CASE WHEN contains(t, '</think>') THEN trim(list_last(string_split(t, '</think>')), {B}) WHEN contains(t, '<think>') THEN {_from("ls", tx.CODE_STARTS, "''")} ELSE t END AS t FROM k),
p AS (SELECT doc_id, t, string_split(t, '```python') AS py, list_filter(list_transform(string_split(t, '```'), lambda x, i: CASE WHEN i % 2 = 0 AND trim(x, {B}) <> '' THEN trim(x, {B}) END), lambda x: x IS NOT NULL) AS odd FROM a),
b AS (SELECT doc_id, CASE WHEN len(py) > 1 THEN trim(string_split(py[2], '```')[1], {B}) WHEN contains(t, '```') THEN coalesce(odd[1], t) ELSE t END AS body FROM p),
l AS (SELECT doc_id, body, string_split(body, chr(10)) AS ls FROM b)
SELECT doc_id, sha256(trim({_from("ls", "^(import |from )", "body")}, {B})) AS h FROM l""")
def _(s, d):
    return _raw(s, d).select("doc_id", F.sha2(tx.clean_code(F.col("t")), 256).alias("h"))


@query("structure_gate", f"WITH {RAW} SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN NOT contains(t, 'import ') THEN 'no import' WHEN NOT regexp_matches(t, 'class\\s+\\w+\\s*\\(\\s*[\\w.]*') THEN 'no class' WHEN NOT contains(t, 'def next(self)') THEN 'no next()' END AS reason FROM raw")
def _(s, d):
    return _raw(s, d).select("doc_id", tx.structure_gate(F.col("t")).alias("reason"))


def _kw(words: tuple) -> str:
    return " + ".join("CAST(contains(right(trim(lower(t), " + B + "), 300), '" + w.replace("'", "''") + "') AS INTEGER)" for w in words)


_FOUND = "coalesce(" + ", ".join(f"nullif(list_last(regexp_extract_all(lower(t), '{p}', 1)), '')" for p in tx.RATINGS) + ")"


@query("rating_parse", f"WITH {RAW}, r AS (SELECT doc_id, {_FOUND} AS found, {_kw(tx.POSITIVE)} AS yes, {_kw(tx.NEGATIVE)} AS no FROM raw) SELECT doc_id, CASE WHEN found IS NOT NULL THEN ltrim(found, '0') = '1' ELSE yes > no END AS aligned, CASE WHEN found IS NOT NULL THEN 'rating' WHEN yes = no THEN 'keyword-tie' ELSE 'keyword' END AS mode FROM r")
def _(s, d):
    a, m = tx.rating(F.col("t"))
    return _raw(s, d).select("doc_id", a.alias("aligned"), m.alias("mode"))


@query("provider_block", f"SELECT doc_id, length(text) < 600 AND regexp_matches(text, '{tx.BLOCKED}') AS blocked FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.blocked(F.lit(None).cast("string"), F.col("text")).alias("blocked"))


@query("diff_added_lines", "SELECT page_id, sha256(array_to_string(list_transform(list_filter(string_split(replace(html, '<', chr(10) || '+<'), chr(10)), lambda x: x LIKE '+%' AND x NOT LIKE '+++%'), lambda x: x[2:]), chr(10))) AS h FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.sha2(tx.diff_added(F.replace("html", F.lit("<"), F.lit("\n+<"))), 256).alias("h"))


@query("counted_replace", "SELECT page_id, (length(html) - length(replace(html, '</p>', ''))) // 4 AS n, sha256(CASE WHEN (length(html) - length(replace(html, '</p>', ''))) // 4 = 3 THEN replace(html, '</p>', '<br>') END) AS h FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", tx.occurrences(F.col("html"), "</p>").alias("n"), F.sha2(tx.counted_replace(F.col("html"), "</p>", "<br>", 3), 256).alias("h"))


@query("loop_detect", "WITH l AS (SELECT doc_id, trim(u.line) AS line FROM documents, unnest(string_split(text, chr(10))) u(line)), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2) SELECT doc_id, max(n) AS most, max(n) > 15 AS loops FROM c GROUP BY 1")
def _(s, d):
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("most"), (F.max("n") > 15).alias("loops"))


@query("quarantine_split", f"SELECT count(*) FILTER (WHERE length(text) < 600 AND regexp_matches(text, '{tx.BLOCKED}')) AS n_bad, count(*) FILTER (WHERE NOT (length(text) < 600 AND regexp_matches(text, '{tx.BLOCKED}'))) AS n_keep FROM documents")
def _(s, d):
    return sinks.quarantine(table(s, d, "documents"), tx.blocked(F.lit(None).cast("string"), F.col("text")), "")


@query("safe_names", "SELECT page_id, regexp_replace(replace(url, '''', 'p'), '[^A-Za-z0-9_.-]', '', 'g') AS name, length(html) // 4 AS tokens FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"), F.expr("length(html) div 4").alias("tokens"))


@query("json_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("role_first_message", "SELECT conv_id, arg_min(replace(left(text, 60), chr(10), ' '), turn) AS sample FROM conversations WHERE text <> '' GROUP BY 1")
def _(s, d):
    c = table(s, d, "conversations").where("text <> ''")
    return c.groupBy("conv_id").agg(F.min_by(F.replace(F.left("text", F.lit(60)), F.lit("\n"), F.lit(" ")), "turn").alias("sample"))


# ---------------------------------------------------------------- sets and sampling


@query("hash_pick", "SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(sha256('seed|' || c_custkey), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 7) AS BIGINT) AS pick FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", tx.hash_pick("seed", F.col("c_custkey").cast("string"), 7).alias("pick"))


@query("stratified_sample", "WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7|' || c_custkey), c_custkey) AS rn FROM customer) SELECT c_mktsegment, c_custkey, rn FROM r WHERE rn <= 10")
def _(s, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.sha2(F.concat(F.lit("7|"), F.col("c_custkey").cast("string")), 256), "c_custkey")
    return table(s, d, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 10")


@query("replacement_queue", "WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal > 0 AS alive, row_number() OVER (PARTITION BY c_mktsegment, c_acctbal > 0 ORDER BY c_custkey) AS rn FROM customer) SELECT a.c_mktsegment, a.c_custkey AS dead, b.c_custkey AS swap FROM r a LEFT JOIN r b ON a.c_mktsegment = b.c_mktsegment AND a.rn = b.rn AND b.alive WHERE NOT a.alive")
def _(s, d):
    w = Window.partitionBy("c_mktsegment", "alive").orderBy("c_custkey")
    r = table(s, d, "customer").select("c_mktsegment", "c_custkey", (F.col("c_acctbal") > 0).alias("alive")).withColumn("rn", F.row_number().over(w))
    return r.where("not alive").select("c_mktsegment", F.col("c_custkey").alias("dead"), "rn").join(r.where("alive").select("c_mktsegment", "rn", F.col("c_custkey").alias("swap")), ["c_mktsegment", "rn"], "left").select("c_mktsegment", "dead", "swap")


@query("set_stale_missing_extra", "WITH a AS (SELECT o_custkey AS k, max(o_orderdate) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderdate) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT CASE WHEN a.k IS NULL THEN 'MISSING' WHEN b.k IS NULL THEN 'EXTRA' WHEN a.v IS DISTINCT FROM b.v THEN 'STALE' ELSE 'OK' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders")
    side = lambda c, n: o.where(F.col("o_orderstatus") == c).groupBy(F.col("o_custkey").alias(f"k{n}")).agg(F.max("o_orderdate").alias(f"v{n}"))
    j = side("F", 1).join(side("O", 2), F.col("k1") == F.col("k2"), "full")
    return j.groupBy(F.when(F.col("k1").isNull(), "MISSING").when(F.col("k2").isNull(), "EXTRA").when(~F.col("v1").eqNullSafe(F.col("v2")), "STALE").otherwise("OK").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("union_tagged", "SELECT 'customer' AS origin, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL FROM supplier")
def _(s, d):
    a = table(s, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(s, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@query("custom_order_top", "WITH r AS (SELECT o_orderkey, o_totalprice, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS lvl FROM orders) SELECT o_orderkey, o_totalprice, CAST(lvl AS INTEGER) AS lvl FROM r ORDER BY lvl DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 50")
def _(s, d):
    lvl = F.array_position(F.array(*[F.lit(x) for x in ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")]), F.col("o_orderpriority"))
    r = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.nullif(lvl, F.lit(0)).cast("int").alias("lvl"))
    return r.orderBy(F.desc_nulls_last("lvl"), F.desc("o_totalprice"), "o_orderkey").limit(50)


# ---------------------------------------------------------------- classification


def _bank(s, d):
    """Runs of suppliers as a bank: the projection of a run, its tuple and core."""
    p = tape.project(fills(s, d), ("lead_entries_exits",)).withColumnRenamed("proj_lead_entries_exits", "proj")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("tuple"), F.col("o_orderstatus").alias("core"))
    return p.join(o, "run").select(F.lit("X").alias("bank"), F.expr("regexp_replace(proj, '[0-9-]+[|]', '')").alias("proj"), "tuple", "core", "run")


BANK = f"{FILLS}, pj AS (SELECT run, coalesce(string_agg(side, ';' ORDER BY time, order_id, sym, q) FILTER (WHERE sym = 'A'), '') AS proj FROM n GROUP BY 1), bk AS (SELECT run, proj, o_orderpriority AS tuple, o_orderstatus AS core FROM pj JOIN orders ON o_orderkey = run)"


@query("oracle_lookup", f"WITH {BANK}, ix AS (SELECT proj, array_to_string(list_sort(list(DISTINCT core)), '+') AS cores FROM bk WHERE tuple LIKE '1%' GROUP BY 1) SELECT run, cores FROM bk LEFT JOIN ix USING (proj)")
def _(s, d):
    b = _bank(s, d)
    return classify.lookup(b.select("bank", "proj", "run"), b.where("tuple like '1%'")).select("run", F.array_join("cores", "+").alias("cores"))


@query("classify_ladder", f"""WITH {BANK}, hits AS (SELECT DISTINCT proj, tuple, core FROM bk WHERE tuple LIKE '1%' OR tuple LIKE '2%'),
ix AS (SELECT proj, list_sort(list(DISTINCT core)) AS cores FROM hits GROUP BY 1), pt AS (SELECT DISTINCT proj FROM hits GROUP BY proj, tuple HAVING count(DISTINCT core) > 1),
own AS (SELECT proj, tuple, list(DISTINCT core) AS mine FROM hits GROUP BY 1, 2)
SELECT run, CASE WHEN bk.proj = '' THEN 'EMPTY-TAPE' WHEN NOT contains(bk.proj, 'B') THEN 'NO-IMPLEMENTATION' WHEN cores IS NULL THEN 'DRIFT' WHEN len(cores) > 1 AND len(mine) = 1 THEN mine[1] WHEN len(cores) > 1 AND pt.proj IS NOT NULL THEN 'AMBIGUOUS-AT-TUPLE' WHEN len(cores) > 1 THEN 'AMBIGUOUS-ACROSS-TUPLES' ELSE cores[1] END AS code
FROM bk LEFT JOIN ix ON bk.proj = ix.proj LEFT JOIN pt ON bk.proj = pt.proj LEFT JOIN own ON bk.proj = own.proj AND bk.tuple = own.tuple""")
def _(s, d):
    b = _bank(s, d)
    draw = b.select("bank", "proj", "run", F.col("tuple").alias("own_tuple"), F.lit("p").alias("program"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("runtime_error"), F.length("proj").alias("tape_fills"), F.length(F.replace("proj", F.lit("S"), F.lit(""))).alias("_b"))
    draw = draw.withColumn("leg_fills", F.when(F.contains("proj", F.lit("B")), 1).otherwise(0)).drop("_b")
    return classify.ladder(classify.lookup(draw, b.where("tuple like '1%' or tuple like '2%'"))).select("run", "code")


@query("label_check", f"WITH {BANK}, ix AS (SELECT proj, list(DISTINCT core) AS cores FROM bk GROUP BY 1), c AS (SELECT tuple, CASE WHEN len(cores) > 1 THEN 'ambiguous' WHEN cores[1] = core THEN 'correct' ELSE 'wrong' END AS verdict FROM bk JOIN ix USING (proj)) SELECT coalesce(tuple, 'ALL') AS tuple, count(*) AS n, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE verdict = 'wrong') AS wrong FROM c GROUP BY GROUPING SETS ((tuple), ())")
def _(s, d):
    b = _bank(s, d)
    c = classify.lookup(b, b.select("bank", "proj", "tuple", "core"))
    one = F.size("cores") == 1
    g = c.rollup("tuple").agg(F.count(F.lit(1)).alias("n"), F.count_if(one & (F.get("cores", F.lit(0)) == F.col("core"))).alias("correct"), F.count_if(~one).alias("ambiguous"), F.count_if(one & (F.get("cores", F.lit(0)) != F.col("core"))).alias("wrong"))
    return g.withColumn("tuple", F.coalesce("tuple", F.lit("ALL")))


@query("class_label", f"WITH {DRAWS}, rk(core, rank, absorbed) AS (VALUES ('F', 1, true), ('P', 2, false)), m AS (SELECT DISTINCT cell, code FROM dr) SELECT cell, coalesce(arg_min(code, CASE WHEN rank IS NOT NULL THEN absorbed::INTEGER * 100 + rank END), string_agg(code, '+' ORDER BY code)) AS label FROM m LEFT JOIN rk ON core = code GROUP BY 1")
def _(s, d):
    reg = s.createDataFrame([("F", 1, True), ("P", 2, False)], "core string, rank int, absorbed boolean")
    return classify.class_label(draws(s, d).select("cell", F.col("code").alias("core")).distinct(), reg, ["cell"])


# ---------------------------------------------------------------- simulation, features, streams


def _sim(rows: list[dict]):
    def f(s, d):
        keys = list(sim.DEFAULTS)
        params = s.createDataFrame([(i, "main", *[{**sim.DEFAULTS, **r}[k] for k in keys]) for i, r in enumerate(rows)], sim.PARAMS)
        two = ("click", "purchase")
        return sim.run(params, sim.feeds(_daily(s, d), *two))

    return f


@query("sim_equity_bank")
def _(s, d):
    """Every row of the equity grid, simulated."""
    rows = grid.equity(s).withColumn("p", F.from_json("params", "map<string,string>"))
    own = [F.coalesce(F.element_at("p", k), F.lit(str(v))).cast("double" if isinstance(v, float) else "int" if isinstance(v, int) else "string").alias(k) for k, v in sim.DEFAULTS.items()]
    run = F.concat_ws("/", "bank", "resolution", "tag")
    params = rows.select(F.xxhash64(run).alias("run_id"), F.lit("main").alias("feed"), *own)
    tapes = sim.run(params.repartition(32, "run_id"), sim.feeds(_daily(s, d), "click", "purchase"))
    per_run = tapes.groupBy("run_id").agg(F.count(F.lit(1)).alias("fills"), F.sum(F.when(F.col("side") == "B", F.col("qty")).otherwise(-F.col("qty"))).alias("left"))
    return rows.select("bank", "resolution", F.xxhash64(run).alias("run_id")).join(per_run, "run_id", "left").groupBy("bank").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("fills"), F.lit(0)).alias("fills"), F.count_if(F.col("left") < 0).alias("short"))


for _name, _rows in {
    "sim_sell_rules": [{"er01_sell": f"R{i}", "er01_fast": 3, "er01_slow": 8} for i in range(1, 7)], "sim_orders": [{"fill_limit": 50}, {"buying_power": 0.5}, {"commission": 0.001}],
    "sim_parallel": [{}, {"ma_type": "EMA"}, {"ma_type": "WMA"}], "sim_race": [{"slot_mode": "race"}], "sim_sequence": [{"slot_mode": "sequence"}], "sim_lots": [{"lots": x} for x in ("private", "invested_gate", "netting", "shared_flag")],
    "sim_sizing": [{"a_exec": e, "sell_frac": f, "cash_rule": c} for e in ("calc_shares", "set_holdings", "pct_cash") for f in ("all", "half_down_lastsell", "half_down_hold", "half_up") for c in ("skip", "partial", "nocheck")],
    "sim_grid": [{"rsi_smoothing": a, "rsi_exit": b, "warmup": c, "same_bar_reentry": e, "cross_timing": f, "missing_bar": m} for a in ("wilder", "simple") for b in ("level", "cross") for c in ("strict", "ready_check", "ready_per_rule") for e in ("allowed", "wait_bar") for f in ("both_days", "today_ma") for m in ("skip_all", "per_ticker", "try_except")],
}.items():
    query(_name)(_sim(_rows))


def _programs(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", F.concat(F.lit("class S:\n  period = "), (F.col("n_chars") % 200 + 2).cast("string"), F.lit("\n  def f(self):\n    m = self."), F.when(F.col("lang") == "en", "SMA").otherwise("EMA"), F.lit("(self.period)\n    return rsi > "), (F.col("n_chars") % 100).cast("string"), F.lit("  # SMA(7)\n")).alias("program"))


_FEATURES = "SELECT doc_id, 'ok' AS status, CASE WHEN lang = 'en' THEN 'SMA' ELSE 'EMA' END AS kind, CAST(n_chars % 200 + 2 AS DOUBLE) AS period, '>' AS comparator, CAST(n_chars % 100 AS DOUBLE) AS threshold FROM documents"


@query("code_features", _FEATURES)
def _(s, d):
    return _programs(s, d).withColumn("f", feat.features("program")).select("doc_id", "f.*")


@query("numeric_extract", _FEATURES.replace("'ok' AS status, CASE WHEN lang = 'en' THEN 'SMA' ELSE 'EMA' END AS kind, ", "").replace(", '>' AS comparator", ""))
def _(s, d):
    return _programs(s, d).withColumn("f", feat.features("program")).select("doc_id", "f.period", "f.threshold")


@query("stream_bars_tumbling", ORACLE_SQL["bars_daily"])
def _(s, d):
    return streams.tumbling_bars(s, d)


@query("stream_resume_dedup", "SELECT DISTINCT user_id, event_type AS symbol FROM events")
def _(s, d):
    return streams.resumed(s, d)


@query("stream_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS started, count(*) AS n_events FROM g GROUP BY user_id, k")
def _(s, d):
    return streams.sessions(s, d)


@query("stream_stateful_cross", "WITH x AS (SELECT event_type AS symbol, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS last FROM events) SELECT symbol, count(*) FILTER (WHERE last <= 50 AND value > 50) AS n_cross FROM x GROUP BY 1")
def _(s, d):
    return streams.stateful_cross(s, d)
