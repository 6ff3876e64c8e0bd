"""The corpus pipeline, stage by stage, against what each stage promises."""

from __future__ import annotations

import corpus_pipeline as cp
from tests.llm.test_near_copies import groups, shingles
from tracelab.llm import common, mixing, pii, sentencepiece_codec, toxicity


def test_stages(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        seen[name] = docs
        docs = common.settle(stage(spark, docs, sf), name)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    scored = toxicity.score(seen["toxicity"], toxicity.fit(seen["toxicity"], common.table(spark, sf, "labels")))
    assert ids(seen["simhash"]) == ids(scored.where("score < 0.3"))
    rows = sorted((r["doc_id"], r["text"]) for r in seen["simhash"].collect())
    label = groups([shingles(t) for _, t in rows])
    assert ids(seen["pii"]) == [rows[i][0] for i, x in enumerate(label) if i == x]
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (seen["pii"], seen["mixing"]))
    assert before.keys() == after.keys()
    for k, t in before.items():
        base = pii.base_spans(t)
        assert (after[k] == t) if not base else all(t[s:e] not in after[k] for s, kind, e in base if kind == 0)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(seen["mixing"]).collect()}
    assert ids(seen["sentencepiece"]) == sorted(k for k, n in taken.items() for _ in range(n))
    assert docs.count() == seen["sentencepiece"].count() and docs.where("not round_trip").isEmpty()
    assert sentencepiece_codec.decode(docs).where("decoded <> text").isEmpty()


def test_edge_documents(spark, sf):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 2), (3, "write to a@b.cc now please", "en", "b", 5, 3), (3, "write to a@b.cc now please", "en", "b", 5, 3), (4, "write to a@b.cc now please", "en", "a", 5, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long")
    for name, stage in cp.STAGES:
        docs = common.settle(stage(spark, docs, sf), name)
    got = docs.collect()
    assert {r["doc_id"] for r in got} == {3} and all(r["text"] == "write to [EMAIL] now please" and r["n_chars"] == 27 for r in got)


WORDS = "quiet rivers carry small boats past the old mill every morning while children wave from the stone bridge above".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, sf, rows, schema=COLUMNS, stages=cp.STAGES):
    docs = spark.createDataFrame(rows, schema)
    for name, stage in stages:
        docs = common.settle(stage(spark, docs, sf), name)
    return docs


def test_rows_without_id_stay(spark, sf):
    """A lone clean text is kept by every stage, with or without an id; copies of it are not."""
    text = " ".join(WORDS)
    other = " ".join(reversed(WORDS))
    got = through(spark, sf, [(None, text, "en", "a", 1), (None, other, "en", "a", 1), (None, text, "en", "b", 1), (7, text + " now", None, "a", 1)], stages=cp.STAGES[:3]).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(7, text + " now"), (0, other)])
    got = through(spark, sf, [(None, text, "en", "a", 1)])
    assert [r["text"] for r in got.collect()] == [text]


def test_one_id_for_different_texts(spark, sf):
    """Ids 3 and 5 hold one text, another row of id 5 holds a different one: two rows stay."""
    text, other = " ".join(WORDS), " ".join(reversed(WORDS))
    for rows in ([(3, text), (5, text), (5, other)], [(3, text), (3, text), (5, text), (5, other), (5, other), (6, "x y z")]):
        got = through(spark, sf, [(i, t, "en", "a", 1) for i, t in rows], stages=cp.STAGES[1:2]).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted({(3, text), (5, other)} | {r for r in rows if r[0] == 6})


def test_clashing_columns_and_long_texts(spark, sf):
    """Columns named as stages might name their own, and a text of 200,000 words."""
    extra = ["_copies", "_lap", "_mix_copies", "_key", "size", "taken", "_set", "_h", "component_id", "score", "part", "list", "id", "a", "node"]
    long = " ".join(f"w{i % 997}x{i}" for i in range(200_000))
    rows = [(1, " ".join(WORDS), "en", "a", 1, *extra), (2, long, "en", "a", 1, *extra), (3, long + " end", "en", "a", 1, *extra)]
    schema = COLUMNS + "".join(f", {c} string" for c in extra)
    got = through(spark, sf, rows, schema, cp.STAGES[:4]).collect()
    assert {r["doc_id"] for r in got} <= {1, 2} and all([r[c] for c in extra] == extra for r in got) and got
    assert through(spark, sf, rows, schema).count() == len(got)


def test_empty_table(spark, sf):
    assert through(spark, sf, []).count() == 0


def test_mix_comes_near_its_targets(spark, sf):
    """Whole copies: each source ends within one longest document of its target, and no document over three times."""
    docs = common.table(spark, sf, "documents")
    plan = mixing.mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    got = [(r["source"], len((r["text"] or "").split())) for r in cp.mix(spark, docs, sf).collect()]
    for s in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == s]
        assert abs(sum(n for x, n in got if x == s) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
