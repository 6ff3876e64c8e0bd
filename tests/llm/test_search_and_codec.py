"""Pruning on clustered vectors, sums that don't fit, and ids that no model has."""

from __future__ import annotations

import numpy as np
import pytest

from tracelab.llm import sentencepiece_codec, topk


def plain(queries, ids, rows, row_ids, k):
    for q, i in zip(queries, ids, strict=True):
        score = rows @ q
        yield [(int(row_ids[j]), int(score[j])) for j in np.lexsort((row_ids, -score)) if row_ids[j] != i][:k]


@pytest.mark.parametrize("clusters", [0, 12])
def test_bounds_prune_clustered_vectors_and_lose_nothing(clusters):
    rng = np.random.default_rng(7)
    n, d = 3000, 64
    rows = rng.normal(0, 1, (n, d)) * (0.2 if clusters else 1)
    if clusters:
        rows += rng.normal(0, 3, (clusters, d))[rng.integers(0, clusters, n)]
    rows, row_ids = np.floor(64 * rows), np.arange(n)
    ids = np.arange(0, n, 20)
    shares: list[float] = []
    got = {q: [(int(row_ids[a]), int(s)) for s, a in zip(score, at, strict=True)] for q, score, at in topk.branch_and_bound(rows[ids], ids, rows, row_ids, 10, shares=shares)}
    assert [got[i] for i in range(len(ids))] == list(plain(rows[ids], ids, rows, row_ids, 10))
    if clusters:
        assert np.mean(shares) < 0.6  # of the candidates are left, over all bounds


def test_vectors_beyond_exact_sums_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1e12, 1e12]), (1, [1e12, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="pass 2\\*\\*53"):
        topk.search_embeddings(rows).collect()


def test_ids_outside_the_model(spark):
    own = sentencepiece_codec.codec()
    (good,) = own.encode(["a word"])
    ids = np.frombuffer(good, "<i4").tolist()
    rows = spark.createDataFrame([(1, ids), (2, [*ids, 10**9, -1, None]), (3, [-5]), (4, []), (5, None), (6, [-1, *ids])], "i int, ids array<int>")
    got = {r["i"]: r["decoded"] for r in sentencepiece_codec.decode(rows).collect()}
    assert got == {1: "a word", 2: "a word\ufffd\ufffd\ufffd", 3: "\ufffd", 4: "", 5: None, 6: "\ufffd a word"}
