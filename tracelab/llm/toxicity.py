"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Fit. Up to `examples` labelled rows (lowest key hash first), and of these as many as hold `example_bytes` of text, are
the examples: the two bounds are the parameters. An id's smallest text stands for all its rows. Terms are lower-cased
words and their byte prefixes of PREFIXES; all terms of all examples form the vocabulary. A term weighs
(1 + ln tf) * idf * relevance, with idf = ln((1 + N) / (1 + df)) + 1 and relevance = FLOOR + lift**2, where lift is how
far the log odds of the label given the term lie above the prior ones, `PRIOR` rows of the prior mixed in; no term weighs
nothing. A length term of words / 12.5 stands in every text, so that one marker in a long text weighs little. Vectors
are L2-normalised over the vocabulary.

Search. Examples are ordered so that like ones stand together (their strongest term if it outweighs their length, then
their length) and cut into blocks of BLOCK. A term's list holds (example, weight) by block, and the largest weight in
each block; the maxima of terms that stand in a quarter of the blocks or more are kept as a matrix. For a text only the
lists of its own terms are walked: the sum of its weights times block maxima bounds a block; blocks are scored in
falling order of that bound, in waves, until it is under the k-th best cosine. So the k nearest examples are exact, ties
to the smaller id.

Score. Votes weigh 1 / (1 - cosine + 0.02) per example; the share of toxic votes is calibrated by a logistic curve
fitted to shares that each half of the examples gets from the other half alone. Evidence lists the nearest examples with cosine and label.

Edge cases: null or blank text has only the length term and is scored as the nearest of such examples; with no usable
label every score is 0; repeated rows score alike; rows without id are scored like any other and never are examples; an
empty table gives an empty result; columns beside id and text are never read by a score (labels, lang, source and
doc_id are no inputs). A very long text costs time and memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, settle, slices, text_column, word_bounds, word_keys

LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
PREFIXES = (5, 7)
BLOCK = 16
SLICE = 500_000  # bytes of text taken at once
PRIOR, FLOOR = 20.0, 0.005
FIRST = 12  # blocks scored at first, then all that may still count
MODEL_FILES = 32  # into which the parts of a fitted model are dealt


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each term, term hash, words per text): whole words, then their prefixes, as often as they stand."""
    data, off = text_column(pc.utf8_lower(column))
    starts, ends = word_bounds(data, off, LETTER)
    owner = np.searchsorted(off, starts, "right") - 1
    who, h = [owner], [word_keys(data, starts, ends)]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        who.append(owner[long])
        h.append(word_keys(data, starts[long], starts[long] + n))
    return np.concatenate(who), np.concatenate(h), np.bincount(owner, minlength=len(off) - 1)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of count places."""
    to = np.cumsum(count)
    return np.repeat(start - (to - count), count) + np.arange(to[-1] if len(to) else 0)


class Model:
    """vocabulary: sorted term hashes. Examples: the places of their terms in it and 1 + ln tf, example by example with
    bounds cut and terms rising; their words, labels and ids."""

    def __init__(self, vocabulary: np.ndarray, cut: np.ndarray, term: np.ndarray, tf: np.ndarray, words: np.ndarray, toxic: np.ndarray, ids: np.ndarray, k: int = 15, calibrate: bool = True):
        n, v, share = len(ids), len(vocabulary), float(toxic.mean())
        self.slope, self.shift = 1.0, 0.0
        if calibrate:  # first, while there is no index in memory
            shares = np.full(n, share)
            for side in (0, 1):
                mine, rest = np.arange(side, n, 2), np.arange(1 - side, n, 2)
                if len(mine) and 0 < toxic[rest].sum() < len(rest):
                    size = np.diff(cut)
                    at, my = spread(cut[rest], size[rest]), spread(cut[mine], size[mine])
                    other = Model(vocabulary, np.append(0, np.cumsum(size[rest])), term[at], tf[at], words[rest], toxic[rest], ids[rest], k, False)
                    shares[mine] = other.share(*other.search(*other.unit(np.append(0, np.cumsum(size[mine])), term[my], tf[my], words[mine])))
                    del other, at, my
            self.fit(np.clip(shares, 1e-4, 1 - 1e-4), toxic)
        self.vocabulary, self.k = vocabulary, k
        self.near = np.zeros(1 << 16, bool)
        self.near[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        df, bad = np.bincount(term, minlength=v), np.bincount(term, np.repeat(toxic, np.diff(cut)), v)
        odds = (bad + PRIOR * share) / (df + PRIOR)
        lift = np.log(odds / (1 - odds)) - np.log(share / (1 - share))
        self.weight = np.append((np.log((1 + n) / (1 + df)) + 1) * (FLOOR + np.maximum(lift, 0) ** 2), 2 / 25).astype(np.float32)
        at, x, cut = self.unit(cut, term, tf, words)
        strong = np.full(n, -1)
        for i in range(n):
            own_x = x[cut[i] : cut[i + 1]]  # the length term is the last one
            if own_x.argmax() < len(own_x) - 1:
                strong[i] = at[cut[i] + own_x.argmax()]
        order = np.lexsort((ids, x[cut[1:] - 1], strong))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        self.ids, self.toxic = ids[order], toxic[order].astype(float)
        self.blocks = -(-n // BLOCK)
        key = at.astype(np.int64) * n + np.repeat(place, np.diff(cut))
        by = np.argsort(key).astype(np.int32)
        key, self.x = key[by], x[by]
        del by, at, x
        self.doc = (key % n).astype(np.uint16 if n < 1 << 16 else np.int32)
        key = key // n * self.blocks + self.doc // BLOCK
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.begin = np.append(head, len(key)).astype(np.int32)
        key = key[head]
        self.block = (key % self.blocks).astype(np.int16 if self.blocks < 1 << 15 else np.int32)
        self.most = np.maximum.reduceat(self.x, head)
        self.lists = np.searchsorted(key // self.blocks, np.arange(v + 2)).astype(np.int32)
        del key, head
        spans = np.diff(self.lists)
        common = np.flatnonzero(4 * spans >= self.blocks)
        self.wide = np.full(v + 1, -1, np.int32)
        self.wide[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks), np.float32)
        seg = spread(self.lists[common], spans[common])
        row = np.repeat(np.arange(len(common)), spans[common])
        self.dense[row, self.block[seg]] = self.most[seg]
        self.where = np.full((len(common), self.blocks), -1, np.int32)  # where the list of a common term has a block
        self.where[row, self.block[seg]] = seg

    def parts(self, most: int = 1 << 20) -> Iterator[tuple[str, list[int], str, int, bytes]]:
        """(name, shape, type, first byte, bytes) of all that the model holds, in parts of up to `most` bytes."""
        for name, value in vars(self).items():
            value = np.asarray(value)
            flat = np.ascontiguousarray(value).reshape(-1).view(np.uint8)
            for at in range(0, max(len(flat), 1), most):
                yield name, list(value.shape), value.dtype.str, at, flat[at : at + most].tobytes()

    @classmethod
    def of_parts(cls, rows: Iterator[tuple[str, list[int], str, int, bytes]]) -> Model:
        """The model that parts() has taken apart, in any order of the parts."""
        model = cls.__new__(cls)
        for name, shape, kind, at, data in rows:
            if name not in vars(model):
                setattr(model, name, np.empty(shape, kind))
            vars(model)[name].reshape(-1).view(np.uint8)[at : at + len(data)] = np.frombuffer(data, np.uint8)
        for name, value in vars(model).items():
            if not value.shape:
                setattr(model, name, value.item())
        return model

    def unit(self, cut: np.ndarray, term: np.ndarray, tf: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term places, weights, bounds) of unit vectors; the length term is the last one of each text."""
        term = np.insert(term, cut[1:], len(self.vocabulary))
        x = np.insert(tf.astype(np.float32), cut[1:], np.maximum(words, 1)) * self.weight[term]
        cut = cut + np.arange(len(cut))
        size = np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, cut[:-1])) if len(words) else np.zeros(0)
        return term, (x / np.repeat(size, np.diff(cut))).astype(np.float32), cut

    def search(self, term: np.ndarray, x: np.ndarray, cut: np.ndarray, group: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Exact k nearest examples of each unit vector: (cosines falling, places), -1 where there are fewer."""
        n, total, blocks = len(cut) - 1, len(self.ids), self.blocks
        k = min(self.k, total)
        best, which = np.full((n, self.k), -1.0), np.full((n, self.k), -1)
        for at in range(0, n, group):
            to = min(n, at + group)
            g, t, w = to - at, term[cut[at] : cut[to]], x[cut[at] : cut[to]]
            own, wide = np.repeat(np.arange(g), np.diff(cut[at : to + 1])), self.wide[t]
            broad = wide >= 0
            weights = np.zeros((g, len(self.dense)), np.float32)
            weights[own[broad], wide[broad]] = w[broad]
            rare = np.flatnonzero(~broad)
            count = self.lists[t[rare] + 1] - self.lists[t[rare]]
            seg, rare = spread(self.lists[t[rare]], count), np.repeat(rare, count)
            cell = own[rare] * blocks + self.block[seg]
            bound = np.bincount(cell, w[rare] * self.most[seg], g * blocks).reshape(g, blocks)
            bound = (bound + weights @ self.dense) * (1 + 1e-5) + 1e-9
            dots, done, floor = np.zeros(g * total), np.zeros((g, blocks), bool), np.full(g, -1.0)
            for most in (FIRST, blocks):
                take = ~done & (bound >= floor[:, None])
                if most < blocks:
                    lead = np.argpartition(-bound, most - 1, axis=1)[:, :most]
                    take = np.zeros((g, blocks), bool)
                    np.put_along_axis(take, lead, True, axis=1)
                if not take.any():
                    continue
                on = take.ravel()[cell]
                row, block = np.nonzero(take)
                first = np.searchsorted(row, np.arange(g + 1))
                wides = np.flatnonzero(broad)
                count = np.diff(first)[own[wides]]
                found = self.where[np.repeat(wide[wides], count), block[spread(first[own[wides]], count)]]
                entry, s = np.concatenate((rare[on], np.repeat(wides, count)[found >= 0])), np.concatenate((seg[on], found[found >= 0]))
                length = self.begin[s + 1] - self.begin[s]
                entry, posted = np.repeat(entry, length), spread(self.begin[s], length)
                dots += np.bincount(own[entry] * total + self.doc[posted], w[entry] * self.x[posted], g * total)
                done |= take
                if most < blocks:  # the k-th best so far, less what rounding may change
                    seen = (lead[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(g, -1)
                    cos = np.where(seen < total, dots.reshape(g, total)[np.arange(g)[:, None], np.minimum(seen, total - 1)], -1.0)
                    floor = np.partition(cos, -k, axis=1)[:, -k] - 2e-9 if cos.shape[1] >= k else floor
            r, c = np.nonzero((dots.reshape(g, total) >= floor[:, None]) & np.repeat(done, BLOCK, axis=1)[:, :total])
            cos = np.round(dots.reshape(g, total)[r, c], 9)
            order = np.lexsort((self.ids[c], -cos, r))
            r, c, cos = r[order], c[order], cos[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, cos, nth = r[nth < k], c[nth < k], cos[nth < k], nth[nth < k]
            best[at + r, nth], which[at + r, nth] = cos, c
        return best, which

    def share(self, best: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Share of toxic votes."""
        w = np.where(which >= 0, 1 / (1 - np.minimum(best, 1) + 0.02), 0)
        return ((w * self.toxic[which]).sum(1) + 0.02) / (w.sum(1) + 0.2)

    def fit(self, share: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> None:
        x = np.log(share / (1 - share))
        z = np.stack([x, np.ones_like(x)], 1)
        w = np.array([1.0, 0.0])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z @ w))
            g = z.T @ (p - toxic) + w - [1.0, 0.0]
            w = w - np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2), g), -0.5, 0.5)
        self.slope, self.shift = max(float(w[0]), 0.05), float(w[1])

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of the texts, as unit() gives them."""
        own, h, words = term_counts(column)
        v = len(self.vocabulary)
        maybe = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        own, h = own[maybe], h[maybe]
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(v - 1, 0))
        hit = self.vocabulary[at] == h if v else np.zeros(len(h), bool)
        key, tf = np.unique(own[hit] * v + at[hit], return_counts=True)
        return self.unit(np.searchsorted(key, np.arange(len(words) + 1) * max(v, 1)), (key % max(v, 1)).astype(np.int32), 1 + np.log(tf), words)

    def score(self, column: pa.Array, shown: int = 3) -> tuple[np.ndarray, list[str]]:
        best, which = self.search(*self.vectors(column))
        share = np.clip(self.share(best, which), 1e-4, 1 - 1e-4)
        p = 1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.shift)))
        return p, [",".join(f"{self.ids[i]}:{c:.3f}:{self.toxic[i]:.0f}" for c, i in zip(cs[:shown], ws[:shown], strict=True) if i >= 0) for cs, ws in zip(best, which, strict=True)]


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, examples: int = 6000, example_bytes: int = 64 << 20, seed: int = 5, key: str = "doc_id", text: str = "text") -> Model | None:
    """A model from at most `examples` labelled rows and `example_bytes` of text; rows that are held out are never read
    for it."""
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), key), key).limit(examples)
    # at most `examples` rows of two numbers: safe to broadcast
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen.select(F.col(key).cast("long").alias("id"), F.col("toxic").cast("long"))), "id")
    # one text for each id: an id that many rows share must not outgrow the bound; settled, since it is read twice
    rows = settle(rows.groupBy("id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("id", "text", "toxic"), "examples")
    sizes = rows.select("id", "toxic", F.octet_length("text").alias("n")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").collect()
    fits, room = np.zeros(len(sizes), bool), example_bytes
    for i, r in enumerate(sizes):  # a text that doesn't fit is left out, and the next one tried
        fits[i] = r["n"] <= room
        room -= r["n"] * int(fits[i])
    if len(sizes) and not fits.any():
        raise ValueError(f"no labelled text is under {example_bytes} bytes")
    if not any(r["toxic"] for r, ok in zip(sizes, fits, strict=True) if ok) or all(r["toxic"] for r, ok in zip(sizes, fits, strict=True) if ok):
        return None
    if not fits.all():
        kept = docs.sparkSession.createDataFrame([(r["id"],) for r, ok in zip(sizes, fits, strict=True) if ok], "id long")
        rows = rows.join(F.broadcast(kept), "id", "left_semi").select("id", "text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            own, h, words = term_counts(b.column(1))
            order = np.lexsort((h, own))
            own, h = own[order], h[order]
            head = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(own, prepend=-1) != 0))
            tf = np.diff(np.append(head, len(h))).astype("<f4")
            own, h = own[head], h[head]
            cut = np.searchsorted(own, np.arange(b.num_rows + 1)).tolist()
            parts = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(words.astype(np.int64)), pa.array([h[s:e].tobytes() for s, e in parts], pa.binary()), pa.array([tf[s:e].tobytes() for s, e in parts], pa.binary())], names=["id", "toxic", "words", "terms", "tf"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        t = pa.Table.from_batches(list(batches))
        words, toxic, ids = (t.column(c).to_numpy() for c in ("words", "toxic", "id"))
        term, tf = (np.frombuffer(b"".join(x.as_py() for x in t.column(c)), kind) for c, kind in (("terms", np.uint64), ("tf", "<f4")))
        cut = np.append(0, np.cumsum(np.array([len(x.as_py()) // 8 for x in t.column("terms")], np.int64)))
        del t
        vocabulary = np.unique(term)
        term = np.searchsorted(vocabulary, term).astype(np.int32)
        for name, shape, kind, at, data in Model(vocabulary, cut, term, 1 + np.log(tf), words, toxic, ids).parts():
            yield pa.record_batch([pa.array([name]), pa.array([shape], pa.list_(pa.int64())), pa.array([kind]), pa.array([at]), pa.array([data], pa.binary())], names=["name", "shape", "kind", "at", "data"])
        del term, tf, vocabulary
        release_memory()

    # bounded by examples and example_bytes; one task fits, so that the driver holds the finished arrays alone
    counted = rows.mapInArrow(count, "id long, toxic long, words long, terms binary, tf binary")
    made = counted.repartition(1).sortWithinPartitions("id").mapInArrow(build, "name string, shape array<long>, kind string, at long, data binary")
    # read in many small results: one of the whole model takes the driver several times its size
    return Model.of_parts(settle(made.repartition(MODEL_FILES), "model").toLocalIterator())


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and evidence of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit("").alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by `examples` and `example_bytes`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            p, why = shared.value.score(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(p.astype(np.float64)), pa.array(why, pa.string())], names=["doc_id", "score", "evidence"])

    return rows.mapInArrow(run, "doc_id long, score double, evidence string")


def keep_under(docs: DataFrame, model: Model | None, threshold: float, text: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, SLICE):
            p, _ = shared.value.score(b.column(b.schema.get_field_index(text)))
            yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
