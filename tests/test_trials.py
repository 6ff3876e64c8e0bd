"""Exact tests, ordered dedup, tolerant JSON, session bars, splits, blinded packets, determinism, table functions."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracelab.functions import tolerant
from tracelab.operators import bars, dedup, exact, ranks
from tracelab.sources import sinks, tables

# ---------------------------------------------------------------- ordered dedup


def one_by_one(rows):
    names, params, out = set(), set(), []
    for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, str(r[1]), r[2] is not None, str(r[2]))):
        if r[1] not in names and r[2] not in params:
            names.add(r[1])
            params.add(r[2])
            out.append(r)
    return sorted(out, key=str)


def deduped(spark, rows, **how):
    df = spark.createDataFrame(rows, "seq long, name string, params string")
    return sorted(map(tuple, dedup.first_by_either(df, ["seq"], ["name"], ["params"], **how).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fold", [0, 30])
def test_first_by_either_key(spark, seed, fold):
    """Random keys with a hot name, nulls and repeated rows; by rounds alone and with the fold."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", None, *"abcdefgh"]), rng.choice([None, *map(str, range(12))])) for i in range(120)]
    rows += [rows[3], rows[50]]
    assert deduped(spark, rows, rounds=2, fold_rows=fold) == one_by_one(rows)


def test_a_chain_of_rows_that_wait(spark):
    """Each row shares a key with the one before it, so every second one stays, decided one after the other."""
    rows = [(i, f"n{(i + 1) // 2}", f"p{i // 2}") for i in range(400)]
    assert deduped(spark, rows, rounds=2) == one_by_one(rows) and len(one_by_one(rows)) == 200
    assert deduped(spark, rows[:12], rounds=1, fold_rows=0) == one_by_one(rows[:12])


def test_a_dropped_row_registers_nothing(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y")]
    assert deduped(spark, rows) == [(1, "a", "x"), (3, "b", "y")]
    assert deduped(spark, []) == []


# ---------------------------------------------------------------- exact tests


def tail(k, n, p):
    p = Fraction(p).limit_denominator(1000)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1)))


def test_binomial_tails(spark):
    cases = [(k, n, p) for n in (1, 2, 10, 30, 300) for k in (0, 1, n // 2, n - 1, n, n + 1) for p in (0.1, 0.5, 0.9)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    c = [F.col(x) for x in "knp"]
    for r in df.select("*", exact.at_least(*c).alias("up"), exact.at_most(*c).alias("down"), exact.two_sided(*c).alias("two")).collect():
        up, down = tail(r["k"], r["n"], r["p"]), 1 - tail(r["k"] + 1, r["n"], r["p"])
        assert math.isclose(r["up"], up, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r["down"], down, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r["two"], min(1, 2 * min(up, down)), rel_tol=1e-9, abs_tol=1e-12)


def test_tails_of_many_trials(spark):
    """Around the mean of 10^7 trials, where the normal law is near, and far from it."""
    n = 10**7
    df = spark.createDataFrame([(n // 2,), (n // 2 + 5000,), (n,), (0,)], "k long")
    mid, some, all_of, none = (r[0] for r in df.select(exact.at_least(F.col("k"), F.lit(n), F.lit(0.5))).collect())
    assert math.isclose(mid, 0.5 + 0.5 * math.exp(-0.5 * math.log(math.pi * n / 2)), rel_tol=1e-6)
    assert math.isclose(some, 0.5 * math.erfc((5000 - 0.5) / math.sqrt(n / 2)), rel_tol=1e-3)
    assert all_of == 0 and none == 1


def test_bounds_and_equivalence(spark):
    df = spark.createDataFrame([(0, 30), (3, 30), (30, 30), (0, 0)], "k long, n long")
    zero, three, full, nothing = (r[0] for r in df.select(exact.upper_bound(F.col("k"), F.col("n"))).collect())
    assert math.isclose(zero, 1 - 0.05 ** (1 / 30), rel_tol=1e-9) and full == 1 and nothing is None
    assert math.isclose(1 - tail(4, 30, Fraction(three).limit_denominator(10**9)), 0.05, rel_tol=1e-2)
    (e,) = spark.range(1).select(exact.equivalence(F.lit(50), F.lit(100), 0.5, 0.1)).first()
    assert math.isclose(e, max(tail(50, 100, 0.4), 1 - tail(51, 100, 0.6)), rel_tol=1e-9)


def test_agreement_beyond_chance(spark):
    (k, p, never) = spark.range(1).select(exact.kappa(F.lit(20), F.lit(5), F.lit(10), F.lit(15)), exact.pabak(F.lit(35), F.lit(50)), exact.kappa(F.lit(9), F.lit(0), F.lit(0), F.lit(0))).first()
    assert math.isclose(k, 0.4) and math.isclose(p, 0.4) and never is None


# ---------------------------------------------------------------- tolerant JSON, table function


def test_tolerant_json(spark):
    texts = ['{"k": 3}', '{"k": 3', None, "", '{"a": {"k": "x"}}', "null", '{"k": null}', "[1]", "x" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r) for r in df.select(tolerant.nested(F.col("t"), "$.k", "bigint", -1), tolerant.nested(F.col("t"), "$.a.k", "string", "none"), tolerant.parse_error(F.col("t"))).collect()]
    assert [g[0] for g in got] == [3, -1, -1, -1, -1, -1, -1, -1, -1] and got[4][1] == "x" and {g[1] for i, g in enumerate(got) if i != 4} == {"none"}
    assert [g[2] for g in got] == [None, 'not JSON: {"k": 3', "no text", "not JSON: ", None, None, None, None, "not JSON: " + "x" * 300]


def test_word_windows(spark):
    tolerant.register(spark)
    spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None), (4, "a b"), (5, "a b c d")], "id int, t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, w.* FROM texts, LATERAL word_windows(t, 3, 2) w ORDER BY id, n").collect()
    assert [(r["id"], r["n"], r["first_word"], r["n_words"], r["window"]) for r in rows] == [(1, 0, 0, 3, "a b c"), (1, 1, 2, 3, "c d e"), (4, 0, 0, 2, "a b"), (5, 0, 0, 3, "a b c"), (5, 1, 2, 2, "c d")]


# ---------------------------------------------------------------- session bars


def test_session_bars_across_a_clock_change(spark):
    """Friday is standard time (opening at 14:30 UTC), Monday daylight time (13:30 UTC)."""
    at = lambda day, h, m, s=0: dt.datetime(2024, 3, day, h, m, s)
    ticks = [(at(8, 14, 29, 59), 1.0), (at(8, 14, 30), 2.0), (at(8, 14, 34, 59), 3.0), (at(8, 14, 35), 4.0), (at(8, 20, 59, 59), 5.0), (at(8, 21, 0), 6.0), (at(9, 15, 0), 7.0), (at(11, 13, 29), 8.0), (at(11, 13, 30), 9.0), (at(11, 13, 44), 10.0), (at(11, 13, 47), 11.0), (at(12, 15, 0), 12.0)]
    df = spark.createDataFrame([(i, t, "x", v) for i, (t, v) in enumerate(ticks)], "event_id long, ts timestamp, symbol string, value double")
    show = lambda b: sorted((r["bar_end"].strftime("%d %H:%M"), r["open"], r["close"], r["volume"]) for r in b.collect())
    want = [("08 09:35", 2.0, 3.0, 2), ("08 09:40", 4.0, 4.0, 1), ("08 16:00", 5.0, 5.0, 1), ("11 09:35", 9.0, 9.0, 1), ("11 09:45", 10.0, 10.0, 1), ("11 09:50", 11.0, 11.0, 1)]
    assert show(bars.session(df)) == want  # that of the last tick isn't complete
    assert show(bars.session(df, holidays=("2024-03-08",))) == want[3:]
    assert show(bars.session(df.where("event_id <= 10"))) == want[:5]
    assert show(bars.session(df, until=F.lit("2024-03-12 15:05:00").cast("timestamp"))) == [*want, ("12 11:05", 12.0, 12.0, 1)]
    assert show(bars.session(df.limit(0))) == []


# ---------------------------------------------------------------- writes


def test_split_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "bad")], "id long, t string")
    show = lambda x: {r["side"]: r["n"] for r in x.collect()}
    assert show(sinks.split(df, F.col("t") == "bad", str(tmp_path / "q"), "it is bad")) == {"keep": 2, "quarantine": 2} and not (tmp_path / "q").exists()
    assert show(sinks.split(df, F.col("t") == "bad", str(tmp_path / "q"), "it is bad", apply=True)) == {"keep": 2, "quarantine": 2}
    back = spark.read.json(str(tmp_path / "q"))
    assert sorted((r["id"], r["side"], r["quarantined_reason"]) for r in back.collect()) == [(1, "keep", None), (2, "keep", None), (3, "quarantine", "it is bad"), (4, "quarantine", "it is bad")]


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 100, 257):
        df = spark.range(n).select("id", ranks.permuted(F.col("id"), n, "key").alias("b"))
        rows = df.select("id", "b", ranks.permuted(F.col("b"), n, "key", inverse=True).alias("back")).collect()
        assert sorted(r["b"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)
    other = [r[0] for r in spark.range(257).select(ranks.permuted(F.col("id"), 257, "other")).collect()]
    assert sum(a == b["b"] for a, b in zip(other, rows, strict=True)) < 20


def test_packets_hide_who_they_are(spark, tmp_path):
    df = spark.range(50).select((F.col("id") + 900).alias("sample"), F.concat(F.lit("t"), "id").alias("t"), ranks.permuted(F.col("id"), 50, "k").alias("blind"))
    sinks.blinded_packets(df, str(tmp_path / "p"), "blind", ["sample"], shelf=20)
    packets, index = spark.read.json(str(tmp_path / "p/packets")), spark.read.json(str(tmp_path / "p/index"))
    assert "sample" not in packets.columns and sorted(x.name for x in (tmp_path / "p/packets").iterdir() if x.is_dir()) == ["shelf=0", "shelf=1", "shelf=2"]
    assert {(r["sample"], r["t"]) for r in packets.join(index, "blind").collect()} == {(i + 900, f"t{i}") for i in range(50)}


def test_ranks_of_a_hot_group(spark):
    rows = [("hot", i % 97, i) for i in range(600)] + [("a", 5, 1), ("b", None, 2), ("b", 1, 3), (None, 1, 4), (None, 0, 5)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = ranks.ranked(df, ["v", "id"], groups=("g",)).collect()
    assert len(got) == len(rows)
    for g in ("hot", "a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert [(r["v"], r["id"]) for r in own] == sorted(((r["v"], r["id"]) for r in own), key=lambda x: (x[0] is not None, x))
    assert sorted(r["rank"] for r in ranks.ranked(df, ["id", "v"]).collect()) == list(range(len(rows)))


def test_fingerprints_tell_runs_apart(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 3, None), ("b", 4, "z")]
    mark = lambda r: ranks.fingerprint(spark.createDataFrame(r, "c string, i int, t string"), ["c"], ["i", "t"])
    same = lambda r: {x["c"]: x["identical"] for x in ranks.same_runs(mark(rows), mark(r), ["c"]).collect()}
    assert same(rows[::-1]) == {"a": True, "b": True}
    assert same([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "Y"), *rows[3:]]) == {"a": False, "b": True}  # changed
    assert same([*rows, ("b", 4, "z")]) == {"a": True, "b": False}  # doubled
    assert same([("b", 1, "x"), *rows[1:]]) == {"a": False, "b": False}  # moved
    assert same(rows[:3]) == {"a": True, "b": False}  # a cell gone


# ---------------------------------------------------------------- files by their names


def test_only_the_last_file_is_opened(spark, tmp_path):
    for name in ("1-order-events.json", "3-order-events.json", "2-order-events.json", "9-other.json"):
        (tmp_path / name).write_text(f"{name}\n")
    last = tables.last_file(spark, f"{tmp_path}/*order-events.json")
    assert [r["value"] for r in last.collect()] == ["3-order-events.json"]
    assert [x.rpartition("/")[2] for x in last.inputFiles()] == ["3-order-events.json"]
    assert tables.last_file(spark, f"{tmp_path}/none*.json").collect() == []


def test_keys_from_names(spark):
    names = ["/d/m1_high__p1__base__s.jsonl", "/d/m_x_xhigh__p2__noask__bare.jsonl", "/d/plain__p__c__s.jsonl"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    got = [tuple(r) for r in df.select(*tables.lane_keys()).collect()]
    assert [(g[4], g[5]) for g in got] == [("m1", "high"), ("m_x", "xhigh"), ("plain", None)] and got[0][:4] == ("m1_high", "p1", "base", "s")
    names = ["/d/bare_m_high_O1e3_noask.jsonl", "/d/m_low_O1e2.jsonl", "/d/notes.jsonl"]
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "file string").select(*tables.bench_keys()).collect()]
    assert got == [("bare_m_high", "O1e3", "noask", "bare"), ("m_low", "O1e2", "base", "harness"), (None, None, None, None)]


def test_cells_pooled_over_dated_folders(spark, tmp_path):
    def put(folder, name, statuses):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text("".join(f'{{"status": "{s}"}}\n' for s in statuses))

    put("2026-01-01", "c1.jsonl", ["program", "no-program", "harness-error"])
    put("2026-01-02", "c1.jsonl", ["program"])
    put("2026-01-01", "c2.jsonl", ["program"] * 5)
    put("old", "c1.jsonl", ["program"] * 9)
    put("2026-01-02/quarantine", "c1.jsonl", ["program"] * 9)
    got = {r["cell"]: (r["have"], r["have_today"], r["ask_for"]) for r in tables.pooled(spark, str(tmp_path), tables.ENVELOPE, 5, "2026-01-02").collect()}
    assert got == {"c1": (3, 1, 3), "c2": (5, 0, None)}
