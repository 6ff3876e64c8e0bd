"""Source divergence, filter interaction and language-model scores against brute force and SQL, and their edge cases."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.llm import common, divergence, filter_audit, lm_score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, p long, print long, row long, block long, mask int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
ROWS = [
    (1, "One two, three! Été ÀÉ one", "en", "a"), (2, "One two, three! Été ÀÉ one", "en", "b"), (3, None, None, None), (3, "", None, None), (4, " \n\t", "en", "a"), (5, "one ONE oNe", "en", "c"), (None, "one two", "en", "c"), (None, "one two", "en", "c"),
    (6, LONG, "de", "a"), (7, LONG, "de", "b"), (7, LONG, "de", "b"), (8, "日本語 日本語 日本語 日本語", "ja", "a"), (9, "one two", "en", ""), (10, "A$B", "fr", "z"), (11, "a-b_c a1b2c", "fr", "z"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 1, "x", 1, 2, 3, 4, 5, 6) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 1, "x"), (2, 0, None, "x"), (7, 1, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")


def same_as_sql(got, sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        rows = df.toPandas()  # noqa: F841
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
    want = c.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    ours, theirs = Counter(map(tuple, got.select(names).collect())), Counter(map(tuple, want.fetchall()))
    assert ours == theirs and ours


# ---------------------------------------------------------------- source divergence


def spelled(rows, min_docs=10, top=10):
    """The contract word by word."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    uses, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = term.findall((text or "").translate(lower))
        uses[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = [s for x, s in uses if x == lang]
        of = {s: [uses[lang, s][t] for t in kept] for s in groups}
        whole = [sum(c) for c in zip(*of.values(), strict=True)]
        p = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        f = lambda a, b: [(x - y) ** 2 // (x + y) for x, y in zip(a, b, strict=True)]
        for s in groups:
            parts = {"pair": [(sum(f(p(of[s]), p(of[o]))), o) for o in groups if o != s], "term": [(v, t) for v, t, n, x, y in zip(f(p(of[s]), p(whole)), kept, of[s], p(of[s]), p(whole), strict=True) if n and x > y]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, v, k) for k, (v, i) in enumerate(ranked[: top if part == "term" else None], 1)}
    return out


@pytest.mark.parametrize("least", [1, 2, 10])
def test_divergence(edge, least):
    got = divergence.divergence(edge, least)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert set(map(tuple, got.collect())) == spelled(ROWS, least) and got.count() == len(spelled(ROWS, least))


def test_divergence_like_sql_and_over_flushes(spark, edge, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same_as_sql(divergence.divergence(docs), divergence.ORACLE, documents=docs)
    # every row is a document of its own; ten of each text keep all terms
    many = edge.where("doc_id is null or doc_id not in (6, 7)").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("k")
    same_as_sql(divergence.divergence(many), divergence.ORACLE, documents=many)
    monkeypatch.setattr(divergence, "HELD_TERMS", 0)
    assert divergence.term_counts(edge).agg(F.sum("n")).first()[0] == sum(len(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")) for r in ROWS)


def test_shares_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**13, 3 * 10**13, 5)], "c long, t long, v long")
    assert rows.select(divergence.share("c", "t", "v")).first()[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 10)


def test_empty_tables(spark, edge, labels):
    none = edge.limit(0)
    assert divergence.divergence(none).collect() == []
    assert filter_audit.audit(none, labels).collect() == []
    assert lm_score.score(none).collect() == []
    assert filter_audit.audit(edge, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# ---------------------------------------------------------------- filter interaction


def audited(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    masks = []
    for i, text, _, source, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        masks.append((source or "", i, {k for k, v in fails.items() if v}))
    out, shapley = [], Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in masks}:
            left = [(i, f) for p, i, f in masks if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                here = [(i, f) for i, f in left if x in f]
                shapley[part, x] += len(here)
                redundant = sum(x in f for _, f in gone)
                left = [r for r in left if x not in r[1]]
                gone += here
                out.append((part, order, step, len(left), len(here), redundant, sum(f == {x} for p, _, f in masks if p == part), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)))
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit(edge, labels):
    got = filter_audit.audit(edge, labels)
    assert set(map(tuple, got.select(COLUMNS).collect())) == audited(ROWS, [(1, 1, 0), (2, 1, 1), (2, 0, None), (7, 1, 1), (None, 1, 1)])
    same_as_sql(got, filter_audit.ORACLE, documents=edge, labels=labels)


def test_audit_like_sql(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    same_as_sql(filter_audit.audit(docs, labels), filter_audit.ORACLE, documents=docs, labels=labels)


def test_copies_over_many_ranges(spark, labels):
    """One text of half the rows, spread over ranges; repeated ids at the borders; all source orders."""
    rng = np.random.default_rng(3)
    rows = [(int(i), "the same words in all of them" if rng.random() < 0.5 else f"text {rng.integers(40)}", "en", f"s{i % 3}") for i in rng.integers(0, 150, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = filter_audit.masks(docs).withColumn("copy", (F.col("mask") >= 16).cast("int")).groupBy("copy").agg(F.sum("n").alias("n")).collect()
        made = filter_audit.audit(docs, labels)
        same_as_sql(made, filter_audit.ORACLE, documents=docs, labels=labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first = {}
    for i, t, *_ in rows:
        first[t] = min(i, first.get(t, i))
    assert {r["copy"]: r["n"] for r in got} == Counter(int(first[t] < i) for i, t, *_ in rows)


def test_fingerprints_that_collide(spark):
    """Equal fingerprints of different texts: bytes decide, within a range and across."""
    import pyarrow as pa

    rows = [(1, b"x", "p", 7), (3, b"x", "p", 7), (2, b"y", "p", 7), (4, b"y", "p", 7), (5, b"z", "p", 8)]
    batch = lambda some: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.int64(), pa.binary(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "text", "part", "print"])
    out = [r for b in filter_audit.judged(iter([batch(rows[:3]), batch(rows[3:])])) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["mask"] >> 4, r["text"]) for r in out) == [(1, 0, b"x"), (2, 0, b"y"), (3, 1, None), (4, 1, None), (5, 0, b"z")]


# ---------------------------------------------------------------- language model


def tokens(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")] + [None]


def counted(rows, order):
    """Training n-grams of each order, from the beginning on."""
    out = [Counter() for _ in range(order)]
    n_docs = 0
    for i, text, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            n_docs += 1
            s = ["<", *tokens(text)]
            for k in range(order):
                out[k].update(tuple(s[j - k : j + 1]) for j in range(max(1, k), len(s)))
    out[0]["<",] = n_docs  # a context only
    return out


def plain_estimates(text, grams, order, own=None):
    """[(estimate, context count) of each level] of each token; own: grams of a document that is deleted."""
    s, out = ["<", *tokens(text)], []
    total = sum(n for g, n in grams[0].items() if g != ("<",)) - (sum(n for g, n in own[0].items() if g != ("<",)) if own else 0)
    c = lambda g: grams[len(g) - 1][g] - (own[len(g) - 1][g] if own else 0)
    for j in range(1, len(s)):
        row = []
        for k in range(order):
            whole = (total if k == 0 else c(tuple(s[j - k : j]))) if j >= k else 0
            row.append((c(tuple(s[j - k : j + 1])) / whole if whole else 0.0, whole))
        out.append(row)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_and_weights(spark, sf, monkeypatch, order):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()] + [(None, "the a the a"), (None, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = lm_score.blocks(docs, 5)
    asked = lm_score.counts(table, order, 5)
    model = lm_score.fit(lm_score.answered(table, asked, 5), asked, order)
    grams = counted(rows, order)
    total, distinct = sum(n for g, n in grams[0].items() if g != ("<",)), len(grams[0]) - 1
    assert (model.total, model.distinct) == (total, distinct)

    # weights: maximisation over the exact estimates gives nearly the same
    seen = [r for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for r in plain_estimates(t, grams, order, counted([(None, t)], order))]
    f, b = np.array([[x for x, _ in r] for r in seen]), np.array([[1 if k == 0 else int(n).bit_length() for k, (_, n) in enumerate(r)] for r in seen])
    w = [np.full(64, 0.5) for _ in range(order)]
    for x in w[1:]:
        x[0] = 0
    for _ in range(60):
        p, at = np.full(len(f), 1 / (distinct + 1)), []
        for k in range(order):
            own = w[k][b[:, k]] * f[:, k]
            p = own + (1 - w[k][b[:, k]]) * p
            at.append(own / p)
        reach = np.ones(len(f))
        for k in range(order - 1, -1, -1):
            stay = reach * at[k]
            w[k] = (np.bincount(b[:, k], stay, 64) + 0.5) / (np.bincount(b[:, k], reach, 64) + 1)
            w[k][0] = 0
            reach = reach - stay
    for k in range(order):
        for x in np.unique(b[:, k]):
            assert abs(model.weights[k][x] - w[k][x]) < 0.02

    # scores: by the model's weights, the plain counts give the same
    monkeypatch.setattr(lm_score, "fit", lambda *a: model)
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_score.score(docs, order).collect()}
    assert len(got) == len(set((i, len(tokens(t))) for i, t in rows))
    for i, text in rows:
        base = own = 0.0
        for tok, row in zip(tokens(text), plain_estimates(text, grams, order), strict=True):
            base += math.log10((grams[0][tok,] + 0.5) / (total + 0.5 * (distinct + 1)))
            p = 1 / (distinct + 1)
            for k, (x, n) in enumerate(row):
                weight = model.weights[k][1 if k == 0 else int(n).bit_length()]
                p = weight * x + (1 - weight) * p
            own += math.log10(p)
        r = got[i, len(tokens(text))]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1) and r["train_tokens"] == total
        assert r["n_known"] == sum(grams[0][t,] > 0 for t in tokens(text))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["score"], own, rel_tol=1e-9, abs_tol=1e-9)


def test_probabilities_sum_to_one(spark, sf):
    """Over all training tokens and the unknown one, after any context."""
    rows = [(1, "a b a c"), (4, "a b b"), (5, "c a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = lm_score.blocks(docs, 3)
    asked = lm_score.counts(table, 2, 3)
    model = lm_score.fit(lm_score.answered(table, asked, 3), asked, 2)
    grams = counted(rows, 2)
    for context in ("<", "a", "b", "c", "zz"):
        whole, mass = grams[0][context,], 0.0
        for tok in ("a", "b", "c", None, "unknown"):
            p = 1 / (model.distinct + 1)
            w = model.weights[0][1]
            p = w * grams[0][tok,] / model.total + (1 - w) * p
            w = model.weights[1][whole.bit_length()]
            mass += w * (grams[1][context, tok] / whole if whole else 0) + (1 - w) * p
        assert math.isclose(mass, 1)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    docs = spark.read.parquet(f"{os.path.dirname(os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001'))}/sf0.01/documents.parquet")
    got = lm_score.score(docs).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 2 and all(r["s"] > r["b"] for r in got) and sum(r["n"] for r in got) == docs.count()


def test_lm_edges(spark, edge):
    got = lm_score.score(edge).collect()
    assert len(got) == len(ROWS) and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1)
    nothing = lm_score.score(spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")).collect()
    assert [(r["score"], r["base_score"], r["train_tokens"], r["n_known"]) for r in nothing] == [(0.0, 0.0, 0, 0)] * 2


def test_word_keys_tell_words_apart():
    """Structured texts, such as a Thue-Morse word and its complement, and words that differ in one place only."""
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate({97: 98, 98: 97})
    words = [thue, thue.translate({97: 98, 98: 97}), *(f"{'x' * i}{c}{'x' * (40 - i)}" for i in range(41) for c in "yz"), *("a" * n for n in range(1, 40)), *("\0" * n for n in range(1, 20))]
    raw = "".join(words).encode()
    end = np.cumsum([len(w) for w in words])
    data = np.frombuffer(raw, np.uint8)
    keys = common.word_keys(data, end - np.diff(end, prepend=0), end)
    assert len(set(keys.tolist())) == len(set(words))
    assert (keys == np.concatenate([common.word_keys(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])) for w in words])).all()
