"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight (position, byte) entries. Two fingerprints within `distance` <= 4 differing bits differ
in at most 4 bytes, so they share at least 8 - distance = 4 positional bytes: the guaranteed minimum. Posting lists of
single bytes would be thousands of rows long at any real size, so lists are kept for position *triples*: 20 triples
(a Turan cover: two or three of them inside one of the position groups {0,1,2}, {3,4,5}, {6,7}, or two in a group and
one in the next) such that any 4 of the 8 positions contain one of them; so every qualifying pair meets in a list. Inside
a list the shared positional bytes of each pair are tallied over all eight positions, pairs under the minimum are
dropped, and the rest are verified by their differing bits.

Copies collapse before all that: one posting set per distinct fingerprint, and fingerprints are the nodes of all links,
so ids may be null or repeated. A list with
more than `list_rows` entries is split into chunk pairs, one task unit for each pair of chunks, so no task holds a
whole hot list and no pair is lost. Tasks emit a spanning forest of the links that they verified, not all pairs.
Components follow from alternating large-star and small-star steps on those edges, settled in the shared folder after
each round, until a round changes nothing. All joins are sort-merge joins, so the driver holds no side of any, round by
round.

Texts that are near by word shingles rather than by 64 bits are found by the same kind of index over larger
fingerprints: see near_copies.

Edge cases: null or blank text has fingerprint zero and links like any other; fewer words than a shingle give one
shingle of the whole sequence; rows without id link like any other, and a component that has no id at all has a null
component_id; rows of one id with different texts are rows of their own; repeated rows share their component; a very
long text is hashed in parts of 4,096 shingles; only id and text are read, so other columns can't clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_shuffles, settle, slices

GROUPS = [0, 0, 0, 1, 1, 1, 2, 2]


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions of which every 4 positions contain one."""
    out = []
    for t in combinations(range(8), 3):
        g = sorted(GROUPS[p] for p in t)
        if g[0] == g[2] or (len(set(g)) == 2 and (g[1], g[0] + g[2] - g[1]) in {(0, 1), (1, 2), (2, 0)}):
            out.append(t)
    return out


TRIPLES = position_triples()


def fingerprint(text: bytes, shingle: int = 4) -> int:
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared positional bytes of each pair of fingerprints."""
    x = a ^ b
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


def verified(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs pass the count filter and then have at most `distance` differing bits."""
    ok = tally(a, b) >= 8 - distance
    ok[ok] = np.bitwise_count((a ^ b)[ok]) <= distance
    return ok


def list_links(fp: np.ndarray, side: np.ndarray, distance: int, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links in one list. side: chunk of each entry; with two chunks, pairs inside either
    are another task unit's, yet finding them here is harmless."""
    n, forest, out = len(fp), Forest(len(fp)), []
    for i in range(0, n, block):
        for j in range(i, n, block):
            a, b = np.broadcast_arrays(fp[i : i + block, None], fp[None, j : j + block])
            x, y = np.nonzero(verified(np.ascontiguousarray(a), np.ascontiguousarray(b), distance))
            for p, q in zip((x + i).tolist(), (y + j).tolist(), strict=True):
                if p < q and forest.join(p, q):
                    out.append((p, q))
    return out


def links(classes: DataFrame, distance: int = 4, list_rows: int = 2048) -> DataFrame:
    """Edges (a, b), a < b, between representatives of fingerprint classes (rep, fp): they connect just what lies
    within `distance`."""
    if not 0 <= distance <= 4:
        raise ValueError("the triples guarantee distances up to 4")
    parts = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for n, (p, q, r) in enumerate(TRIPLES):
        keys.append(F.lit(n << 24).bitwiseOR(F.shiftleft(parts[p], 16)).bitwiseOR(F.shiftleft(parts[q], 8)).bitwiseOR(parts[r]))
    posted = classes.select("rep", "fp", F.explode(F.array(*keys)).alias("list"))
    lengths = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posted = posted.join(lengths.hint("merge"), "list")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / list_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    posted = posted.select("rep", "fp", "list", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    unit = F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))
    spread = posted.select(unit.alias("unit"), "rep", "fp", "own").repartition("unit").sortWithinPartitions("unit")

    def flush(unit_rep: np.ndarray, unit_fp: np.ndarray, unit_own: np.ndarray, cut: np.ndarray) -> pa.RecordBatch | None:
        """Links of whole units; those of two or three rows are compared together."""
        n = np.diff(cut)
        a, b = [], []
        for step in (1, 2):
            first = np.flatnonzero((np.repeat(n, n) <= 3) & (np.arange(len(unit_fp)) + step < np.repeat(cut[1:], n)))
            good = first[verified(unit_fp[first], unit_fp[first + step], distance)] if len(first) else first
            a += unit_rep[good].tolist()
            b += unit_rep[good + step].tolist()
        for i in np.flatnonzero(n > 3).tolist():
            s, e = int(cut[i]), int(cut[i + 1])
            for x, y in list_links(unit_fp[s:e], unit_own[s:e], distance):
                a.append(int(unit_rep[s + x]))
                b.append(int(unit_rep[s + y]))
        if not a:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        pair = pair[pair[:, 0] != pair[:, 1]]
        return pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            unit = held[0]
            if not len(unit):
                continue
            done = int(np.searchsorted(unit, unit[-1], "left"))  # the last unit may go on
            if done:
                part = [x[:done] for x in held]
                cut = np.concatenate(([0], np.flatnonzero(np.diff(part[0])) + 1, [done]))
                if out := flush(part[1], part[2].view(np.uint64), part[3], cut):
                    yield out
                held = [x[done:] for x in held]
        if len(held[0]) and (out := flush(held[1], np.ascontiguousarray(held[2]).view(np.uint64), held[3], np.array([0, len(held[0])]))):
            yield out

    return spread.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by large-star and small-star steps. Nodes without edges are
    left out. Each round's edges are settled in the shared folder; nothing but counts reaches the driver."""
    now = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.where("m < u").select("m", "u")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small.hint("merge"), "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(small.select("m", "u")).distinct()
        now = settle(small, "edges")
        release_shuffles(edges.sparkSession)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = settle(fingerprints(docs, shingle, key, text), "fingerprints")
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(links(classes.select(F.col("fp").alias("rep"), "fp"), distance))
    named = settle(classes.join(found.hint("merge"), classes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("of")), "named")
    least = named.groupBy("of").agg(F.min("first").alias("component_id"))
    label = named.join(least.hint("merge"), "of").select("fp", "component_id")
    return fps.join(label.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of texts that are near by word shingles (five words, Jaccard 0.8): see near_copies."""
    from . import near_copies  # which builds on this module

    return near_copies.survivors(docs)
