"""Results that don't hang on hash luck, nor on one long row."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.llm import common, near_copies, quality, simhash, suffix_dedup, toxicity


def thue(n: int, a: str = "a", b: str = "b") -> str:
    t = a
    while len(t) < n:
        t += t.translate(str.maketrans({a: b, b: a}))
    return t


PAIRS = [(thue(n), thue(n, "b", "a")) for n in (1024, 2048, 4096)]


@pytest.mark.parametrize("pair", PAIRS)
def test_structured_lines_and_words_differ(spark, pair):
    one, other = pair
    lines = spark.createDataFrame([(1, f"{one}\n{other}"), (2, f"{one}\n{one}"), (3, " ".join([one, other] * 4 + ["x"] * 3)), (4, " ".join([one] * 9))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judge(lines).collect()}
    assert got[1][0] == 0 and got[2][0] == 1 and got[3][1] == 0 and got[4][1] == 9


def test_structured_documents_stay(spark):
    """Texts of one long word each, and of many words that differ in it alone."""
    docs = [(i, t) for i, t in enumerate(t for p in PAIRS for t in p)]
    docs += [(100, " ".join(PAIRS[0][0] + str(i) for i in range(30))), (101, " ".join(PAIRS[0][1] + str(i) for i in range(30)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.survivors(df).collect()) == sorted(i for i, _ in docs)


def test_structured_passages_are_no_copies(spark):
    one, other = PAIRS[1]
    df = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(df).collect()}[1] == 0
    windows = {one[i : i + 50] for i in range(len(one) - 49)}
    covered = np.zeros(len(other), bool)
    for i in range(len(other) - 49):
        if other[i : i + 50] in windows:
            covered[i : i + 50] = True
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(df).collect()}[2] == covered.sum()


def test_span_hashes_against_bytes():
    """Equal spans have equal hashes wherever they stand; different ones differ, structured ones too."""
    rng = np.random.default_rng(5)
    text = (thue(4096) + thue(4096, "b", "a") + "".join(rng.choice(list("ab"), 3000))).encode()
    data = np.frombuffer(text, np.uint8)
    prefix = common.prefix_hash(data)
    for n in (1, 8, 50, 1024, 2048):
        start = rng.integers(0, len(data) - n, 2000)
        start[:2] = 0, 4096
        h = common.span_hash(prefix, start, start + n)
        seen = {}
        for s, x in zip(start.tolist(), h.tolist(), strict=True):
            assert seen.setdefault(x, text[s : s + n]) == text[s : s + n]
        assert len(seen) == len({text[s : s + n] for s in start.tolist()})


def test_a_long_labelled_text_leaves_the_model_standing(spark):
    """Whatever its place in the order: it is left out, the others are learnt from."""
    rows = [(i, f"{'awful idiots hate' if i % 2 else 'calm words here'} number {i}") for i in range(60)] + [(i, "x " * 5000) for i in range(60, 66)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, example_bytes=5000)
    assert model is not None and set(model.ids.tolist()) == {r["doc_id"] for r in docs.where("doc_id < 60").where(~toxicity.held_out()).collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id < 60"), model).collect()} if hasattr(toxicity, "score") else {}
    assert all((scores[i] >= 0.3) == bool(i % 2) for i in scores)
    with pytest.raises(ValueError, match="no labelled text"):
        toxicity.fit(docs.where("doc_id >= 60"), labels, example_bytes=100)


def test_rules_see_fewer_texts_down_the_cascade(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    import pyarrow as pa

    block = quality.Block(*common.text_column(pa.array([r["text"] for r in docs], pa.string())))
    made = [block.n_words, block.n_repeat_words]  # noqa: F841
    failed = quality._few_words(block) | quality._repeats(block)
    seen = []
    rules = [quality.Rule(r.name, lambda b, r=r: seen.append(len(b)) or r.rejects(b)) for r in quality.RULES if r not in quality.BASE]
    kept = quality.cascade(block, rules, ~failed)
    assert failed.any() and seen[0] == (~failed).sum() and seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    alone = ~failed
    for r in quality.RULES:
        alone &= ~r.rejects(block)
    assert (kept == alone).all()


def test_near_copy_sets_by_brute_force(spark):
    texts = ["a b c d e f g", "A b c d e f G", "a b", "", "a b c d e f h", PAIRS[0][0]]
    import pyarrow as pa

    h, off = near_copies.shingle_sets(pa.array(texts))
    sets = [set(h[s:e].tolist()) for s, e in zip(off[:-1], off[1:], strict=True)]
    words = [t.lower().split() for t in texts]
    plain = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in words]
    for i in range(len(texts)):
        assert len(sets[i]) == len(plain[i])
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def test_text_is_measured_not_estimated(spark, tmp_path):
    """Repeated texts compress to nothing; groups are dealt by the bytes that tasks will hold."""
    spark.range(400).selectExpr("id AS doc_id", "repeat('one long line of text ', 500) AS text").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert common.text_bytes(docs, "text") == 400 * (11_000 + 16)
    assert common.planned_bytes(docs) < 400 * 1_100


def test_components_broadcast_nothing(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f g h i j")], "doc_id long, text string")
    assert {(r["node"], r["component"]) for r in simhash.components(edges).collect()} == {(2, 1), (3, 1), (8, 7)}
    assert "BroadcastHashJoin" not in simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()


def test_a_model_goes_in_parts():
    cut, term = np.array([0, 2, 4, 5]), np.array([0, 1, 1, 2, 0])
    m = toxicity.Model(np.array([3, 5, 9], np.uint64), cut, term, np.ones(5), np.array([2, 2, 1]), np.array([1, 0, 1]), np.array([4, 5, 6]))
    parts = list(m.parts(most=8))
    again = toxicity.Model.of_parts(iter(parts[::-1]))
    assert vars(again).keys() == vars(m).keys()
    assert all(np.array_equal(x, getattr(again, c)) and np.asarray(x).dtype == np.asarray(getattr(again, c)).dtype for c, x in vars(m).items())


def test_freed_memory_leaves_the_worker():
    """Arrays of a few megabytes, freed among others that stay, go back to the system."""
    code = """
import re, numpy as np
from tracelab.llm import common
own = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
before, kept = own(), []
for size in (4_000_000, 2_000_000, 400_000):
    x = []
    for _ in range(40):
        x.append(np.ones(size // 8))
        kept.append(np.ones(100))
    x.append(np.ones(size // 8))
    del x
common.release_memory()
print(own() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], check=True)
    assert float(out.stdout.split()[-1]) < 40
