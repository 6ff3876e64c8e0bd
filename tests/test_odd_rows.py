"""Queries and their SQL over ties, nulls and texts that the test tables don't hold."""

from __future__ import annotations

import datetime as dt

import duckdb

from tracelab.plans import catalogue, cells, lanes, records, trials  # noqa: F401

LINE = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
DAY = dt.datetime(2020, 5, 17)


def both(spark, path, name: str, tables: list[str]) -> tuple[list, list]:
    """Rows of the query and of its SQL on one thread, which leaves ties in the order of the files' rows."""
    df = catalogue.QUERIES[name](spark, str(path))
    c = duckdb.connect(config={"threads": 1})
    c.execute("SET timezone = 'UTC'")
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    theirs = c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(theirs, key=str)


def orders(spark, path, runs) -> None:
    spark.createDataFrame([(run, run // 10) for run in runs], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{path}/orders.parquet")


def fill(run, flag, line=1, quantity=3.0, discount=0.05, status="O", at=DAY):
    return run, line, quantity, 9.0, discount, flag, status, at


def test_tied_fills_stand_as_in_the_table(spark, tmp_path):
    first = [fill(10, "R"), fill(10, "A"), fill(11, "A"), fill(11, "R"), fill(20, "R"), fill(21, "R"), fill(30, "N")]
    second = [fill(20, "A"), fill(21, "A"), fill(30, "A"), fill(31, "A"), fill(31, "N")]
    for rows in (first, second):
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/made.parquet")
    made = sorted((tmp_path / "made.parquet").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    (tmp_path / "lineitem.parquet").mkdir()
    for name, file in zip("ab", made, strict=True):
        (tmp_path / "lineitem.parquet" / f"{name}.parquet").write_bytes(file.read_bytes())
    orders(spark, tmp_path, (10, 11, 20, 21, 30, 31))
    ours, theirs = both(spark, tmp_path, "convergence", ["orders", "lineitem"])
    assert ours == theirs == [(1, 2, 2, "DIVERGED"), (2, 2, 1, "CONVERGED"), (3, 2, 2, "DIVERGED")]


def test_odd_fills_count_as_in_sql(spark, tmp_path):
    rows = [
        fill(10, None), fill(11, "A"), fill(20, "A", discount=None), fill(21, "A"), fill(30, "A", quantity=0.7), fill(31, "A"), fill(40, "A", quantity=0.5), fill(41, "A", status="F"),
        fill(50, "R", at=DAY + dt.timedelta(milliseconds=900)), fill(50, "A", line=2, at=DAY + dt.timedelta(milliseconds=100)), fill(51, "A"), fill(51, "R", line=2),
        fill(60, "A", at=None), fill(60, "R", line=2), fill(61, "R"), fill(61, "A", line=2), fill(70, "A", line=None), fill(70, "R"), fill(71, "R"), fill(71, "A", line=2),
    ]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders(spark, tmp_path, sorted({r[0] for r in rows}))
    ours, theirs = both(spark, tmp_path, "convergence", ["orders", "lineitem"])
    assert ours == theirs and [(r[1], r[2]) for r in ours] == [(1, 1), (1, 1), *[(2, 1)] * 5]


def test_reviews_of_odd_texts_read_as_in_sql(spark, tmp_path):
    plain = "lorem  ipsum\n dolor"
    texts = [
        None, "", " \n\t", plain, f"{plain}\n## Notes\nmore\n## Summary\nagain", "## Summary\nfirst", "a\n##", "a\n## ", "\n## b", "a\n\n## \n## c\r\n## d", "# Review\n**Verdict:** OK\n**Classes:** x",
        "\xa0 a\xa0b\u3000\xa0\n", "\xa0 a \u2028 ", "\u3000", "a\x0b\x0cb\x85", "x" * 200_000,
    ]
    names = [(None, "src0"), ("en", None), (None, None), ("", ""), ("", "src0"), ("en", ""), ("e,n", "s,"), ("`en`", " src0 "), ("en\n", "\n## Summary\n"), ("e+n", "%2C*"), ("\xe9\u2028", "\U0001f600")]
    rows = [("en", "src0", t) for t in texts] + [(*n, plain) for n in names] + [(None, None, None), ("a,b", None, None), (None, "src0", "**Verdict:** OK\n**Classes:** x")]
    spark.createDataFrame([(i, t, lang, source) for i, (lang, source, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ours, theirs = both(spark, tmp_path, "markdown_fields", ["documents"])
    assert ours == theirs and len(ours) == len(rows)
