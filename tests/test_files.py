"""Sources and sinks that need files."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tracelab.operators import records as rec
from tracelab.sources import sinks, tables


def test_whole_text_and_missing_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\n\ntwo\n")
    (row,) = tables.whole_text(spark, [str(tmp_path / "a.md")]).collect()
    assert row["text"] == "one\n\ntwo\n" and row["path"].endswith("a.md")
    with pytest.raises(FileNotFoundError, match="b.md"):
        tables.whole_text(spark, [str(tmp_path / "a.md"), str(tmp_path / "b.md")])


def test_dated_folders_leave_quarantine_out(spark, tmp_path):
    for folder in ("2026-01-02", "2026-01-03", "h5", "2026-01-03/quarantine"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "m__p__c__s.jsonl").write_text(f'{{"prompt_id": "{folder}", "i": 1}}\n')
    (tmp_path / "h5" / "notes.txt").write_text("{}")
    rows = tables.dated_folders(spark, str(tmp_path), tables.ENVELOPE)
    assert sorted(r["prompt_id"] for r in rows.collect()) == ["2026-01-02", "2026-01-03", "h5"]
    assert [r["surface"] for r in rows.select(*tables.lane_keys()).collect()] == ["s"] * 3


def test_last_file(spark, tmp_path):
    for name in ("r1.txt", "r3.txt", "r2.txt"):
        (tmp_path / name).write_text(name)
    assert [r["value"] for r in tables.last_file(spark, f"{tmp_path}/*.txt").collect()] == ["r3.txt"]


def test_bars_in_range_and_tiers(spark, tmp_path):
    bars = spark.sql("select 'x' as symbol, date'2026-01-01' + cast(id as int) as d, double(id) as close from range(5)")
    assert tables.in_range(bars, "x", "2026-01-02", "2026-01-04").count() == 3
    for symbol, first in (("y", None), ("x", "2027-01-01")):
        with pytest.raises(ValueError, match="no bars"):
            tables.in_range(bars, symbol, first)
    calls = []
    cache = tables.BarCache(spark, str(tmp_path / "project"), str(tmp_path / "second"), lambda s, i: calls.append((s, i)) or bars)
    assert cache.get("x", "1d").count() == 5 and cache.get("x", "1d").count() == 5 and calls == [("x", "1d")]
    again = tables.BarCache(spark, str(tmp_path / "project"), str(tmp_path / "second"))
    assert again.get("x", "1d").count() == 5
    bars.limit(2).write.parquet(str(tmp_path / "project/symbol=x/interval=1d"))
    assert tables.BarCache(spark, str(tmp_path / "project"), str(tmp_path / "second")).get("x", "1d").count() == 2
    with pytest.raises(FileNotFoundError):
        again.get("z", "1d")


def test_alias_without_target_is_an_error(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    aliases = spark.createDataFrame([("a", "bank1")], "alias string, name_of string")
    assert rec.resolve_alias(names.limit(1), aliases).first()["target"] == "bank1"
    with pytest.raises(Exception, match="no bank for b"):
        rec.resolve_alias(names, aliases).collect()


def test_sinks_write_what_they_say(spark, tmp_path):
    df = spark.createDataFrame([(1, "start", "a"), (1, "turn", "b"), (2, "start", "c</script>")], "id long, event string, text string")
    sinks.trajectory(df, str(tmp_path / "t"))
    sinks.trajectory(df.where("id = 2"), str(tmp_path / "t"))
    assert sorted(x.name for x in (tmp_path / "t").iterdir() if x.is_dir()) == ["event=start", "event=turn"]
    assert spark.read.json(str(tmp_path / "t")).count() == 4
    sinks.hash_records(df.limit(1), "event", "text", str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).first()["value"] == f"{hashlib.sha256(b'a').hexdigest()}  start"
    sinks.report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    assert sinks.new_version(df, str(tmp_path / "v"), 2).endswith("v=2") and spark.read.json(str(tmp_path / "v")).count() == 3
    sinks.packets(df, str(tmp_path / "p"), "event")
    assert spark.read.json(str(tmp_path / "p")).count() == 3
    (n,) = sinks.quarantine(df, F.col("id") == 2, str(tmp_path / "q"), apply=True).collect()
    assert (n["n_bad"], n["n_keep"]) == (1, 2) and spark.read.json(str(tmp_path / "q/quarantine")).count() == 1
    frozen = sinks.freeze(df, str(tmp_path / "f"), "id").first()
    assert (frozen["rows"], frozen["first"], frozen["last"], frozen["columns"]) == (3, 1, 2, "id,event,text")
    assert "</script" not in sinks.html_json(df).first()["payload"]


def test_rating_and_log_edges(spark):
    from tracelab.functions import text as tx

    rows = spark.createDataFrame([("rating: [[99999999999999999999]]",), ("Rating: [[0001]]",), ("\n rating: 1 \t",)], "t string")
    assert [r[0] for r in rows.select(tx.rating(F.col("t"))[0]).collect()] == [False, True, True]
    cases = [("Tell me more?\n\n\n\n", True), ("<think>no code", ""), ("<think>a\nimport x\ny", "import x\ny")]
    assert spark.createDataFrame([(cases[0][0],)], "t string").select(tx.asks(F.col("t"))).first()[0] is True
    for t, want in cases[1:]:
        assert spark.createDataFrame([(t,)], "t string").select(tx.clean_code(F.col("t"))).first()[0] == want
