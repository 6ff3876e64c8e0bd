"""Near copies against brute-force Jaccard similarity over five-word shingles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tracelab.llm import common, near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups(sets):
    """The label of each set: the place of the first set that it is connected to."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def found(docs, texts, **how):
    """The same from near_copies, for texts by doc_id 0, 1, ..."""
    linked = near_copies.near_copies(docs, **how)
    named = near_copies.with_class(docs).join(linked, F.col("_set") == F.col("node"), "left")
    of = {r["doc_id"]: r["of"] for r in named.select("doc_id", F.coalesce("component", "_set").alias("of")).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(of[i], i)
    return [first[of[i]] for i in range(len(texts))]


def test_stage_drops_near_copies_of_five_words(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    label = groups([shingles(t) for _, t in rows])
    want = [rows[i][0] for i, x in enumerate(label) if i == x]
    assert sorted(r["doc_id"] for r in cp.drop_near_copies(spark, docs, sf).collect()) == want


@pytest.mark.parametrize("how", [{}, {"small": 2, "list_rows": 4}])
def test_no_pair_is_lost(spark, how):
    """Copies of a few texts with words changed, some only near by way of others, a line that most texts share, and short texts."""
    rng = np.random.default_rng(11)
    line = [f"line{i}" for i in range(12)]
    base = [[f"t{b}w{i}" for i in range(n)] for b, n in enumerate((40, 60, 90, 300))]
    texts = [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "A b\tc d e"]
    for i in range(160):
        words = list(base[i % 4])
        for at in rng.integers(0, len(words), rng.integers(0, 1 + len(words) // 40 + i % 3)):
            words[at] = f"new{rng.integers(0, 50)}"
        texts.append(" ".join(line + words if i % 3 else words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = groups([shingles(t) for t in texts])
    assert len(set(want)) > 8 and found(docs, texts, **how) == want


def test_the_nearest_pairs_are_a_forest():
    rng = np.random.default_rng(4)
    p, q = np.triu_indices(40, 1)
    of, far = rng.integers(0, 12, 40), rng.integers(0, 9, len(p))
    apart = of[p] != of[q]
    p, q, far = p[apart], q[apart], far[apart]
    kept = near_copies.spanning(p, q, of, far)
    assert len(kept) == len(set(of.tolist())) - 1
    lone = near_copies.spanning(p[kept], q[kept], of, far[kept])
    assert sorted(lone.tolist()) == list(range(len(kept)))


def test_a_group_gives_pairs_in_proportion(spark, monkeypatch):
    """Texts of one group that meet in the same lists: the nearest pairs connect them, and few are left for the rest."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        own = list(base)
        for j in rng.choice(300, 5, replace=False):
            own[j] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []

    def counted(entries, *more):
        pairs = near_copies.settle(other(entries, *more), "pairs")
        made.append((entries.count(), pairs.count()))
        return pairs

    other = near_copies.other_pairs
    monkeypatch.setattr(near_copies, "other_pairs", counted)
    near_copies.near_copies(docs).count()
    assert made and all(pairs <= rows for rows, pairs in made)


def sets_of(sizes_and_changes, rng):
    """Pairs of sets: n elements of which the second has `gone` less and `new` others."""
    pairs = []
    for n, gone, new in sizes_and_changes:
        one = rng.integers(0, 1 << 63, n + new).astype(np.uint64)
        pairs += [np.sort(one[:n]), np.sort(one[gone:])]
    return np.concatenate(pairs), np.append(0, np.cumsum([len(x) for x in pairs]))


def test_linked_sets_share_their_simhash_bytes():
    """Pairs of similarity 4/5, sizes around those where the number of cells doubles: none is under the minimum."""
    rng = np.random.default_rng(2)
    linked = [(n, n // 9, n // 9) for n in (1, 9, 100, 400, 511, 512, 513, 560, 1024, 1030, 5000)]
    linked += [(512, 0, 128), (511, 0, 127), (420, 0, 100), (410, 0, 102), (1025, 205, 0), (514, 102, 0), (2040, 0, 510)]
    h, off = sets_of(linked, rng)
    cells, n = near_copies.cell_bytes(h, off), np.diff(off)
    assert near_copies.shares_enough(n[::2], n[1::2], cells[::2], cells[1::2]).all()
    assert near_copies.shares_enough(n[1::2], n[::2], cells[1::2], cells[::2]).all()
    h, off = sets_of([(n, n // 2, n // 2) for n in (100, 400, 511, 513, 1024, 5000)], rng)
    cells, n = near_copies.cell_bytes(h, off), np.diff(off)
    assert not near_copies.shares_enough(n[::2], n[1::2], cells[::2], cells[1::2]).any()


def test_pairs_under_the_minimum_of_simhash_bytes_go(spark):
    """Equal parity maps don't keep a pair whose tally of shared SimHash bytes is under the minimum of 256 - 200 // 9."""
    rows = [(i, 100, bytes([1] * (256 - i) + [2] * i), bytes(128), None) for i in (0, 22, 23, 255)]
    signs = spark.createDataFrame(rows, "id long, n int, cells binary, map binary, wide binary")
    pairs = spark.createDataFrame([(0, 22), (0, 23), (0, 255)], "a long, b long")
    assert near_copies.plausible(pairs, signs).collect() == [(0, 22)]


def test_linked_sets_pass_their_thin_maps():
    """Pairs of similarity 4/5, sizes around those where the thin map doubles: none is excluded, and apart ones are."""
    rng = np.random.default_rng(6)

    def likely(changes):
        h, off = sets_of(changes, rng)
        n = np.diff(off)
        thin = []
        for s, e, bits in zip(off[:-1], off[1:], near_copies.thin_bits(n).tolist(), strict=True):
            odd = np.bincount((h[s:e] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            thin.append(np.packbits(odd.astype(bool)).tobytes())
        return near_copies.all_possible(n[::2], n[1::2], thin[::2], thin[1::2])

    sizes = (1, 2, 9, 63, 64, 65, 100, 511, 512, 513, 1024, 1030, 5000)
    assert likely([(n, n // 9, n // 9) for n in sizes] + [(n, n // 5, 0) for n in sizes] + [(n, 0, n // 4) for n in sizes]).all()
    assert not likely([(n, n // 2, n // 2) for n in (100, 511, 513, 1024, 5000)] + [(100, 21, 0), (512, 0, 129)]).any()


def test_pairs_of_a_shared_passage_end_at_their_thin_maps(spark, monkeypatch):
    """Texts that share a passage and no more pair up in its lists: none gets to the join with the large signatures, and texts
    of unfit sizes don't pair at all. A near copy does both."""
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([f"t{t}w{i}" for i in range(200 if t < 20 else 330)] + passage) for t in range(40)]
    texts.append(texts[3] + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    firsts, whole = [], []
    first, plausible = near_copies.first_pairs, near_copies.plausible

    def first_kept(*how):
        firsts.append(near_copies.settle(first(*how), "kept"))
        return firsts[-1]

    def plausible_kept(pairs, signs):
        whole.append((pairs.count(), signs.count()))
        return plausible(pairs, signs)

    monkeypatch.setattr(near_copies, "first_pairs", first_kept)
    monkeypatch.setattr(near_copies, "plausible", plausible_kept)
    assert found(docs, texts) == [*range(40), 3]
    size = {r["id"]: r["n"] for r in near_copies.signatures(docs).select("id", "n").collect()}
    pairs = {(r["a"], r["b"]) for r in firsts[0].where("list is null").collect()}
    assert len(pairs) > 10 and all(5 * min(size[a], size[b]) >= 4 * max(size[a], size[b]) for a, b in pairs)
    assert sum(p for p, _ in whole) <= 2 and sum(s for _, s in whole) <= 4, whole


def test_linked_sets_meet_by_maps_of_their_sizes():
    """Pairs of similarity 4/5, sizes around those where the map doubles and beyond its largest: each pair meets, once; sets of
    half the similarity don't."""
    rng = np.random.default_rng(8)

    def met(changes):
        h, off = sets_of(changes, rng)
        rise = np.argsort(np.diff(off), kind="stable")
        n, bits = np.diff(off)[rise], near_copies.unit_bits(np.diff(off))
        maps = []
        for i in rise.tolist():
            odd = np.bincount((h[off[i] : off[i + 1]] & np.uint64(bits[i] - 1)).astype(np.int64), minlength=bits[i]) & 1
            maps.append(np.packbits(odd.astype(bool)).tobytes())
        two = rise // 2
        pairs = [two[x].tolist() for x, y, _ in near_copies.meetings(n, maps, lambda i, j: two[i, None] == two[None, j])]
        return sorted(sum(pairs, []))

    sizes = (1, 2, 9, 100, 1023, 1024, 1025, 2047, 2048, 2050, 4097, 16385, 40000)
    linked = [(n, n // 9, n // 9) for n in sizes] + [(n, n // 5, 0) for n in sizes] + [(n, 0, n // 4) for n in sizes]
    assert met(linked) == list(range(len(linked)))
    assert met([(n, n // 2, n // 2) for n in (100, 1000, 1025, 3000, 5000, 9000, 16000)]) == []


def test_long_texts_of_a_shared_passage_make_no_pairs(spark, monkeypatch):
    """Long texts that have a third in common meet in long lists, yet only the near copies among them become pairs there."""
    passage = [f"p{i}" for i in range(1500)]
    texts = [" ".join(passage + [f"t{t}w{i}" for i in range(3000)]) for t in range(12)]
    texts += [texts[3] + " end", texts[3] + " last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []

    def counted(*how):
        pairs = near_copies.settle(other(*how), "pairs")
        made.append((how[0].count(), pairs.distinct().count()))
        return pairs

    other = near_copies.other_pairs
    monkeypatch.setattr(near_copies, "other_pairs", counted)
    assert found(docs, texts) == [*range(12), 3, 3]
    assert made and all(rows > 100 and pairs <= 3 for rows, pairs in made), made
