"""Values that follow from the definitions alone."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.functions import features, text
from tracelab.operators import classify, grid, indicators, signals, sim, stats, tape
from tracelab.sources import sinks, tables

F1 = [10, 11, 12, 11, 10, 9, 10, 12, 13, 12]


def bars(spark, close, open_=None):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), float(o), float(max(o, c)), float(min(o, c)), float(c)) for i, (c, o) in enumerate(zip(close, open_ or close, strict=True))]
    return spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double")


def column(df, c):
    return [r[c] for r in df.orderBy("d").collect()]


def test_averages(spark):
    b = bars(spark, F1).withColumns({"s": indicators.sma(3), "w": indicators.wma(3)})
    assert column(b, "s") == [None, None, 11.0, 11.333333, 11.0, 10.0, 9.666667, 10.333333, 11.666667, 12.333333]
    assert column(b, "w") == [None, None, 11.333333, 11.333333, 10.666667, 9.666667, 9.666667, 10.833333, 12.166667, 12.333333]


def test_folds():
    x = np.array(F1, float)
    assert np.allclose(indicators.ema(x, 3), [10, 10.5, 11.25, 11.125, 10.5625, 9.78125, 9.890625, 10.945312, 11.972656, 11.986328], atol=1e-6)
    assert np.allclose(indicators.rsi_wilder(x, 3)[3:], [66.666667, 44.444444, 29.62963, 53.08642, 76.54321, 82.940516, 58.861012], atol=1e-6)


def test_rsi_simple(spark):
    b = indicators.changes(bars(spark, F1)).withColumn("r", indicators.rsi_simple(3))
    assert column(b, "r")[3:] == [66.666667, 33.333333, 0.0, 33.333333, 75.0, 100.0, 75.0]


def test_crosses(spark):
    b = signals.price_cross(bars(spark, F1), 3)
    assert [i for i, x in enumerate(column(b, "up")) if x] == [6]
    assert [i for i, x in enumerate(column(b, "down")) if x] == [3, 9]


@pytest.mark.parametrize(("kind", "want"), [("prev_close", [0, 0, 1, 0, 1, 0]), ("prev_close_le", [0, 1, 2, 3, 4, 0]), ("open_close", [0, 1, 0, 1, 2, 0])])
def test_red_streaks(spark, kind, want):
    b = signals.red_streak(bars(spark, [10, 10, 9, 9, 8, 9], [11, 11, 8, 10, 9, 8]), kind)
    assert column(b, "streak") == want


def test_tape_alternates(spark):
    close = [10, 9, 8, 9, 10, 11, 10, 8, 7, 8, 10, 12]
    rows = signals.cross_tape(bars(spark, close), 3).orderBy("fill_d").collect()
    assert [r["side"] for r in rows] == ["B", "S", "B"][: len(rows)] and rows


def test_grid_counts(spark):
    assert grid.equity(spark, False).count() == 4097
    assert {r["bank"]: r["runs"] for r in grid.counts(grid.options(spark)).collect()} == {"DONOR": 32, "O1e1": 215, "O1e2": 215, "O1e3": 284, "O1e4": 335, "O1e5": 335, "O1e6": 135, "O1e7": 215, "O1e8": 135}


def test_dedup_drops_register_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", "y"), (1, 4, "c", "x")], "g int, n int, name string, params string")
    assert [r["n"] for r in grid.dedup_name_or_params(rows, ["g"], ["n"], "name", "params").orderBy("n").collect()] == [1, 3]


def test_wilson(spark):
    df = spark.createDataFrame([(3.0, 20.0), (9.0, 10.0), (0.0, None)], "k double, n double")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(0.052369, 0.360419), (0.59585, 0.982124), (None, None)]


def test_trade_date_and_side(spark):
    f = spark.createDataFrame([(1, 1137790800.0, "SPY R735", 0, None, "1.5", 1, "filled"), (1, 1137790800.0, "SPY R735", 9, 4, "1.5", 2, "partiallyFilled"), (1, 1.0, "SPY", 9, None, "1", 3, "invalid")], "run long, time double, symbol string, qty long, fill_qty long, price string, order_id long, status string")
    assert [(r["sym"], r["q"], r["side"], r["day"]) for r in tape.normalise(f).orderBy("order_id").collect()] == [("SPY", 0, "S", "2006-01-20"), ("SPY", 4, "B", "2006-01-20")]


def test_sell_ratio_ties(spark):
    f = spark.createDataFrame([(1, float(t), "A", q, None, "1", t, "filled") for t, q in enumerate([40, -1, 1, -3, -500, -5])], "run long, time double, symbol string, qty long, fill_qty long, price string, order_id long, status string")
    assert [(r["sold"], r["held"], r["ratio_pct"]) for r in tape.sell_ratio(f).orderBy("sale").collect()] == [(1, 40, 3), (3, 40, 8), (37, 37, 100)]


def test_text(spark):
    t = "x\n```python\nshort\n```\n```\nlonger one\n```\n"
    d = spark.createDataFrame([(t, "Verdict. Rating: [[0]] then rating: [[1]]", "Could be?  ")], "a string, b string, c string")
    r = d.select(text.fenced(F.col("a")), text.rating(F.col("b"))[0], text.rating(F.col("b"))[1], text.asks(F.col("c")), text.counted_replace(F.col("a"), "```", "~", 4), text.counted_replace(F.col("a"), "```", "~", 3)).first()
    assert r[0] == "longer one\n" and r[1] and r[2] == "rating" and r[3] and r[4].count("~") == 4 and r[5] is None


def test_hash_pick_and_shuffle(spark):
    import hashlib

    got = spark.createDataFrame([("m",)], "k string").select(text.hash_pick("s", F.col("k"), 11)).first()[0]
    assert got == int(hashlib.sha256(b"s|m").hexdigest(), 16) % 11
    assert sorted(text.lcg_shuffle(list(range(9)), 5)) == list(range(9)) and text.lcg_shuffle(list(range(9)), 5) == text.lcg_shuffle(list(range(9)), 5)


def test_features_parse_only():
    assert features.extract("# SMA(9)\nx = 'EMA(3)'\nn = 20\ns = SMA(n)\nif 60 < rsi_now: pass") == ("ok", "SMA", 20.0, ">", 60.0)
    assert features.extract("a = SMA(5)\nb = SMA(9)")[0] == "unresolved"
    assert features.extract("x = = 1")[0] == "unparsable" and features.extract("'''")[0] == "unlexable"


def test_ladder_order(spark):
    rows = [("X", None, 1, "ok", None, 3, 1, ["A"], "t"), ("X", "p", 2, "timeout", None, 3, 1, ["A"], "t"), ("X", "p", 3, "ok", None, None, 1, ["A"], "t"), ("X", "p", 4, "ok", None, 0, 0, ["A"], "t"), ("X", "p", 5, "ok", None, 3, 0, ["A"], "t"), ("X", "p", 6, "ok", None, 3, 1, None, "t"), ("X", "p", 7, "ok", None, 3, 1, ["A"], "t"), ("X", "p", 8, "ok", None, 3, 1, ["A", "B"], "t1"), ("X", "p", 9, "ok", None, 3, 1, ["A", "B"], None)]
    d = spark.createDataFrame(rows, "bank string, program string, i int, status string, runtime_error string, tape_fills int, leg_fills int, cores array<string>, own_tuple string")
    d = d.withColumn("hits", F.when(F.size("cores") > 1, F.expr("array(named_struct('tuple','t1','core','A'), named_struct('tuple','t2','core','B'))")).otherwise(F.expr("array(named_struct('tuple','t','core','A'))")))
    assert [r["code"] for r in classify.ladder(d).orderBy("i").collect()] == ["no-program", "non-runnable", "non-runnable", "EMPTY-TAPE", "NO-IMPLEMENTATION", "DRIFT", "A", "A", "AMBIGUOUS-ACROSS-TUPLES"]


def test_simulation_by_hand():
    days = list(range(8))
    up = [(x, x) for x in (10.0, 9, 8, 12, 13, 12, 7, 6)]
    fills = sim.simulate({"ma_period": 2, "warmup": "ready_per_rule", "rsi_period": 50, "red_days": 50, "size_pct": 100.0, "cash": 1200.0}, days, up, [(1.0, 1.0)] * 8)
    assert fills == [(4, "A", "B", 100, 13.0), (6, "A", "S", 100, 7.0)]


def test_sources_and_sinks(spark, tmp_path):
    lane = spark.createDataFrame([("s", "v1", 3), ("s", None, 4)], "surface string, variant string, replicate long")
    sinks.append_lane(lane, f"{tmp_path}/lane")
    got = tables.jsonl(spark, f"{tmp_path}/lane", tables.ENVELOPE)
    assert {(r["prompt_id"], r["i"]) for r in got.collect()} == {("v1", 3), (None, 4)}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{"outname": "a", "tape": null}')
    (tmp_path / "m/b.json").write_text('{"outname": "b", "tape": []}')
    (tmp_path / "m/c.json").write_text("{broken")
    assert {r["outname"]: r["tape"] for r in tables.manifests(spark, f"{tmp_path}/m/*.json").collect()} == {"a": None, "b": []}
    assert sinks.freeze(lane, f"{tmp_path}/f", "replicate").first()["rows"] == 2
    (tmp_path / "arr.json").write_text('[{"id": 1, "v": "a"}, {"id": 1, "v": "b"}]')
    from pyspark.sql import types as T

    assert tables.json_array(spark, f"{tmp_path}/arr.json", T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())]), "id").first()["v"] == "b"
    assert tables.file_hashes(spark, f"{tmp_path}/arr.json").first()["bytes"] == 42


def test_constants_keep_names_and_attributes_apart():
    import ast

    of = lambda t: features.constants(ast.parse(t))
    assert of("class A:\n  period = 5\nclass B:\n  def f(self):\n    self.period = 7") == {"period": 5.0, "self.period": 7.0}
    assert of("n = 20")["self.n"] == 20 and "self.n" not in of("n = 20\nself.n = f()") and "self.n" not in of("n = 20\nself.n += 1")
    assert of("a = 1\na = 2\nb = -3\nb = -3\nc = Decimal('0.4')\nd = True\ne = 5\ne += 3") == {"b": -3.0, "self.b": -3.0, "c": 0.4, "self.c": 0.4, "e": 5.0, "self.e": 5.0}
    assert features.extract("class S:\n  P = 9\n  def f(self):\n    return EMA(self.P)")[1:3] == ("EMA", 9.0)


def test_guards_say_the_opposite():
    test = lambda t: features.read_settings(t)[-2:]
    assert test("def f(self):\n  if self.red_streak < 3: return\n  buy()") == (">=", 3.0)
    assert test("def f(self):\n  if self.red_streak < 3: return 1") == ("<", 3.0)
    assert test("if streak >= 4:\n  buy()") == (">=", 4.0) and test("if 4 <= streak: buy()") == (">=", 4.0)
    assert test("if streak > 1: a()\nif streak > 2: b()") == ("mixed", None)


def test_settings_of_programs():
    names = [x.split()[0] for x in features.SETTINGS.split(", ")]
    of = lambda t: dict(zip(names, features.read_settings(t), strict=True))
    cross = of("""
class S:
    def OnData(self, data):
        if not self.ready(): return
        rsi_now = self.rsi.Current.Value
        if self.prev_close <= self.prev_sma and close > self.sma:
            self.MarketOrder(s, n)
        elif self.prev_rsi <= 60 and rsi_now > 60:
            self.MarketOrder(s, -n)
    def ready(self):
        return self.sma.IsReady
""")
    assert (cross["warmup"], cross["rsi_exit"], cross["cross_timing"], cross["buy_dir"], cross["same_bar_reentry"]) == ("ready_check", "cross", "both_days", "up", "unresolved")
    level = of("""
def on_data(self, data):
    if self.rsi > 60 and self.lot_shares > 0:
        self.Liquidate(s)
        self.lot_shares = 0
    if close < sma and self.lot_shares == 0:
        self.SetHoldings(s, 1)
    if close > sma: self.Sell(s)
""")
    assert (level["rsi_exit"], level["cross_timing"], level["buy_dir"], level["sell_dir"], level["same_bar_reentry"], level["a_exec"], level["warmup"]) == ("level", "today_ma", "down", "up", "allowed", "set_holdings", "none")
    assert of("if self.Portfolio[s].Invested: pass")["same_bar_reentry"] == of("if a:\n  sell()\nelse:\n  buy()")["same_bar_reentry"] == of("if d == last_sell_date: pass")["same_bar_reentry"] == "wait_bar"
    assert of("rsi[1] <= 60 and rsi[0] > 60")["rsi_exit"] == "cross" and of("x = 'RSI('")["rsi_exit"] == "unresolved"
    assert of("self.SetWarmUp(timedelta(days=30))")["warmup_bars"] == "timedelta(days=30)"
    assert of("(" * 5000)["status"] in ("unlexable", "unparsable") and of(None)["status"] == "unlexable"


def test_a_small_index_is_broadcast(spark):
    """Draws of few projections must not meet in as few tasks."""
    bank = spark.createDataFrame([("X", "p", "x=1", "c1"), ("X", "q", "x=0", "c2")], "bank string, proj string, tuple string, core string")
    found = classify.lookup(bank.select("bank", "proj"), bank)
    assert "rightHint=(strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString() or "ResolvedHint (strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString()
    assert {(r["proj"], tuple(r["cores"])) for r in found.collect()} == {("p", ("c1",)), ("q", ("c2",))}


def test_a_program_is_parsed_once():
    text = "class S:\n  def Initialize(self):\n    self.SetWarmUp(31)\n"
    before = features._known_settings.cache_info()
    assert features._known_settings(text) == features._known_settings(text) == features.read_settings(text)
    after = features._known_settings.cache_info()
    assert (after.misses - before.misses, after.hits - before.hits) == (1, 1)
