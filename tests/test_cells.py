"""Class names, gates, pooled days, repeated lines and surface faults by small cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelab.functions import text as tx
from tracelab.operators import cells


def named(bank, matched):
    """The rule, one cell at a time."""
    if bank not in cells.CLASSES:
        return "+".join(sorted(matched))
    cores, order, absorbed = cells.CLASSES[bank]
    found = {cores.get(r, r) for r in matched}
    ranked = [c for c in order if c in found]
    if not ranked:
        return "+".join(sorted(found))
    return ([c for c in ranked if c not in absorbed] or ranked)[0]


def test_class_names(spark):
    rng = random.Random(4)
    cases = [("CROSS", ["sym_wait"]), ("CROSS", ["sym_wait", "da_wait"]), ("CROSS", ["zz", "sym_wait"]), ("NONE", ["b", "a"]), ("NONE", ["a"])]
    cases += [(b, rng.sample([*cells.CLASSES[b][0], "other"], rng.randint(1, 3))) for b in cells.CLASSES for _ in range(20)]
    rows = [(i, b, r) for i, (b, rs) in enumerate(cases) for r in rs]
    got = {r["i"]: r["label"] for r in cells.class_names(spark.createDataFrame([*rows, *rows[:3], (999, "CROSS", None)], "i int, bank string, resolution string"), cells.registry(spark), ["i"]).collect()}
    assert got == {i: named(b, rs) for i, (b, rs) in enumerate(cases)}


def test_absorbed_cores_name_only_what_is_theirs_alone(spark):
    classes = spark.createDataFrame([("B", "r1", "X", 1, True), ("B", "r2", "Y", 2, False), ("B", "r3", "Z", 3, True)], "bank string, resolution string, core string, rank int, absorbed boolean")
    rows = spark.createDataFrame([(1, "B", "r1"), (1, "B", "r2"), (2, "B", "r1"), (2, "B", "r3"), (3, "B", "r3")], "i int, bank string, resolution string")
    assert {r["i"]: r["label"] for r in cells.class_names(rows, classes, ["i"]).collect()} == {1: "Y", 2: "X", 3: "Z"}


@pytest.mark.parametrize(("case", "want"), [((4, 4, 0, 2, 3), "PASS"), ((4, 4, 1, 2, 3), "FAIL"), ((4, 4, 0, 1, 3), "FAIL"), ((4, 5, 0, 2, 3), "INCOMPLETE"), ((5, 4, 1, 1, 3), "INCOMPLETE"), ((4, 4, 0, 2, 1), "N/A"), ((0, 0, 0, None, 2), "FAIL")])
def test_gate(spark, case, want):
    row = spark.createDataFrame([case], "runs int, expected int, incomplete int, floor int, res int")
    assert row.select(cells.gate(*(F.col(c) for c in row.columns))).first()[0] == want


def test_pooled_days(spark):
    rows = [("a", "d1", True), ("a", "d2", True), ("a", "d2", False), ("a", "d2", None), ("b", "d1", True), ("b", "d1", True), ("b", "d1", True), (None, "d2", True)]
    got = cells.pooled(spark.createDataFrame(rows, "c string, d string, ok boolean"), ["c"], F.col("d"), F.lit("d2"), F.col("ok"), F.lit(3))
    assert {r["c"]: (r["have"], r["have_today"], r["ask_for"]) for r in got.collect()} == {"a": (2, 1, 2), "b": (3, 0, None), None: (1, 1, 3)}


def test_repeated_line(spark):
    texts = ["b\na\na\nb\n\n\n\n", "", None, " \n\t\n \n", "x" * 100, "\n".join(["go"] * 16 + ["no"] * 16), "\n".join(["go"] * 15), "a \na\na ", "\u3000\n\u3000\ny"]
    got = {r["i"]: tuple(r)[1:] for r in cells.repeated_line(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()}
    for i, t in enumerate(texts):
        best = next(((line, n) for line, n in Counter((t or "").split("\n")).most_common() if line.strip()), ("", 0))
        assert got[i] == (best[0][:80], best[1], best[1] > 15), i


def test_surface_faults(spark):
    texts = ["fine.\n", "no end", "a\r\n", "a\tb\n", "a\n\n\nb\n", "a  b\n", "a\n- \nb\n", "1.\n", "a,\n\nb\n", "end;", "x\n . y\n", "", "a:\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rules = {"carriage return": "\r", "tab": "\t", "triple blank line": "\n\n\n", "doubled space": "  ", "orphan list marker": r"(?m)^\s*(?:[-*+]|\d+[.)])\s*$", "dangling punctuation": r"[,;:]\s*(?:\n\n|\Z)", "leading punctuation": r"(?m)^\s*[.,;:!?]"}
    for r in df.select("i", cells.surface_faults(F.col("t")).alias("f")).collect():
        t = texts[r["i"]]
        assert r["f"] == ",".join(["missing final newline"] * (not t.endswith("\n")) + [n for n, p in rules.items() if re.search(p, t)]), repr(t)


def test_unfinished_by_prompt_and_status(spark):
    jobs = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h1"), (None, "h1")], "i int, h string")
    done = spark.createDataFrame([(1, "h1", "ok"), (2, "h0", "ok"), (3, "h1", "error"), (None, "h1", "ok"), (1, "h1", "ok")], "i int, h string, s string")
    assert sorted(r["i"] for r in cells.unfinished(jobs, done, ["i"], "h", "s", ("ok",)).collect()) == [2, 3]


def test_changed(spark):
    a, b = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b"), (3, None), (4, "d")], [(1, "a"), (2, "B"), (3, None), (5, "e")]))
    assert {r["k"]: r["what"] for r in cells.changed(a, b, "k", "v").collect()} == {2: "changed", 4: "dropped", 5: "new"}


def test_shuffle_as_a_fold(spark):
    rows = [(seed, list(range(n))) for seed in (0, 7, 20260823, 2**32 - 1) for n in (0, 1, 2, 5, 40)]
    df = spark.createDataFrame(rows, "seed long, ids array<int>")
    for r in df.select("seed", "ids", tx.lcg_order(F.col("ids"), F.col("seed")).alias("out")).collect():
        assert r["out"] == tx.lcg_shuffle(r["ids"], r["seed"])
