"""Language-model scores by deleted interpolation.

A word's probability mixes maximum-likelihood estimates of the n-grams that end in it:
P_k(w | h) = L_k[b] * c(h w) / c(h) + (1 - L_k[b]) * P_(k-1)(w | h'), where b is the bucket (bit length) of the context's
count c(h), h' drops the oldest word, and P_0 is even over all training tokens and one unknown token. Contexts start at
the text's beginning; each text ends in an end token. Weights come from expectation-maximisation on held-out counts: every
training document is deleted in turn, so its words are predicted from the counts of all others.

Texts are packed into blocks of about a megabyte, written as a table bucketed by block. A block asks for the counts of its
distinct n-grams, sorted 64-bit keys in parts of the key space; a part adds up what all blocks hold of each key and
answers each block. So a frequent n-gram is one entry a block, however often it stands, and no task holds more than a part
of the keys. Answers meet the texts in a bucketed join without moving the texts again. Estimation needs, of all training
tokens, how many have which (bucket, estimate) at each level, with estimates in quarter octaves: a table bounded by that
grid, whatever the corpus.

Keys of words of up to 8 bytes are exact for their length; longer ones and n-grams are mixed to 64 bits, so that two
n-grams of a corpus of 10^9 distinct ones meet in one count with a chance of about 3 %.

Edge cases: null text is an empty one (its end token alone); rows without doc_id are no held-out rows, so they are learnt
from and scored; repeated rows are documents of their own; a very long text is a block of its own; without any training
token all estimates are even and every score is 0; only doc_id and text are read, so other columns can't clash; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, mix64, planned_bytes, settle, shared_dir, slices, small_batches, text_column, word_bounds, word_keys

#: Text of a block, of a row group of the table of blocks, and of a part of the key space or a bucket as planned from the table's size.
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 4 << 20
PART_BYTES = 8 << 20
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
BEGIN, END = np.uint64(0x0B5E55ED), np.uint64(0x0E4D)
BLOCK = "block long, ids array<long>, held array<boolean>, ends array<long>, text binary"


# ---------------------------------------------------------------- tokens and keys of a block


def packed(values: np.ndarray) -> bytes:
    """As few bytes a value as the largest needs, by place, so that equal high bytes lie together for the codec of files
    and exchanges."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel()


class Tokens:
    """The n-grams of a block: of each order the distinct keys, sorted, and each token's place among them."""

    def __init__(self, text: bytes, ends: np.ndarray, held: np.ndarray, order: int):
        data = LOWERED[np.frombuffer(text, np.uint8)]
        off = np.concatenate((np.zeros(1, np.int64), ends))
        starts, stops = word_bounds(data, off)
        first = np.searchsorted(starts, off)
        words = np.diff(first)
        self.n = words + 1
        self.off = np.concatenate(([0], np.cumsum(self.n)))
        self.doc = np.repeat(np.arange(len(ends)), self.n)
        self.train = ~np.repeat(held, self.n)
        keys = np.full(self.off[-1], END, np.uint64)
        keys[np.arange(len(starts)) + np.repeat(np.arange(len(ends)), words)] = word_keys(data, starts, stops)
        self.start = self.off[:-1]
        self.grams = []
        gram, there = keys, np.ones(len(keys), bool)
        for k in range(1, order + 1):
            if k > 1:
                before = np.empty_like(gram)
                before[1:] = gram[:-1]
                known = np.zeros(len(keys), bool)
                known[1:] = there[:-1]
                known[self.start] = k == 2
                before[self.start] = BEGIN
                gram, there = mix64(mix64(before + np.uint64(k)) ^ keys), known
            self.grams.append(self._sorted(gram, there))

    def _sorted(self, gram: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
        """(distinct keys, training uses of each, each token's place or -1, each token's uses in its own document)."""
        at = np.flatnonzero(there)
        at = at[np.argsort(gram[at], kind="stable")]
        key, doc = gram[at], self.doc[at]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        place = np.full(len(gram), -1, np.int64)
        place[at] = np.cumsum(new) - 1
        run = new.copy()
        run[1:] |= doc[1:] != doc[:-1]
        lengths = np.diff(np.append(np.flatnonzero(run), len(at)))
        own = np.zeros(len(gram), np.int64)
        own[at] = np.repeat(lengths, lengths)
        distinct = key[new]
        return distinct, np.bincount(place[at][self.train[at]], minlength=len(distinct)), place, own


# ---------------------------------------------------------------- blocks, questions and answers


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """A table of packed texts, bucketed by block, in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("held", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        kept, size = [], 0

        def made() -> pa.RecordBatch:
            ids, held = ([x for b in kept for x in b.column(i).to_pylist()] for i in (0, 2))
            parts = [text_column(b.column(1)) for b in kept]
            ends = np.cumsum(np.concatenate([np.diff(off) for _, off in parts]))
            cols = [[block], [ids], [held], [ends.tolist()], [b"".join(data.tobytes() for data, _ in parts)]]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["block", "ids", "held", "ends", "text"])

        for b in slices(batches):
            kept.append(b)
            size += b.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield made()
                block, kept, size = block + 1, [], 0
        if kept:
            yield made()

    name = f"blocks_{uuid.uuid4().hex}"
    made = rows.mapInArrow(pack, BLOCK)
    made.write.bucketBy(buckets, "block").option("parquet.block.size", GROUP_BYTES).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _tokens(b: pa.RecordBatch, i: int, order: int) -> Tokens:
    ends, held = (np.array(b.column(c)[i].values, d) for c, d in ((3, np.int64), (2, bool)))
    return Tokens(b.column(4)[i].as_py(), ends, held, order)


def counts(table: DataFrame, order: int, parts: int) -> DataFrame:
    """block, level, part and the training uses of the block's keys in that part; rows without block hold, of a part, the
    number of keys with training uses and the sum of those."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for level, (keys, uses, _, _) in enumerate(_tokens(b, i, order).grams, 1):
                    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the key
                    cut = np.flatnonzero(np.diff(part, prepend=np.uint64(parts))) if len(keys) else np.zeros(0, np.int64)
                    spans = list(zip(cut, [*cut[1:], len(keys)], strict=True))
                    cols = [[b.column(0)[i].as_py()] * len(spans), [level] * len(spans), part[cut].astype(np.int64), [packed(np.diff(keys[s:e], prepend=np.uint64(0))) for s, e in spans], [packed(uses[s:e]) for s, e in spans]]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "level", "part", "keys", "uses"])

    def answer(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in t.column("keys").to_pylist()]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([unpacked(x).view(np.int64) for x in t.column("uses").to_pylist()]))
        at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        cols = [[*t.column("block").to_pylist(), None], [t.column("level")[0].as_py()] * (len(keys) + 1), [t.column("part")[0].as_py()] * (len(keys) + 1), [*(packed(total[place[s:e]]) for s, e in zip(at[:-1], at[1:], strict=True)), None], [None] * len(keys) + [int((total > 0).sum())], [None] * len(keys) + [int(total.sum())]]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "level", "part", "uses", "distinct", "total"])

    asked = table.mapInArrow(ask, "block long, level int, part long, keys binary, uses binary")
    return settle(asked.groupBy("level", "part").applyInArrow(answer, "block long, level int, part long, uses binary, distinct long, total long"), "counts")


def answered(table: DataFrame, counted: DataFrame, buckets: int) -> DataFrame:
    """Blocks with the answers to them; the texts stay where their bucket is, so answers are dealt once, like the buckets."""
    own = counted.where("block is not null").repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("level", "part", "uses")).alias("answers"))
    return table.join(own.hint("shuffle_hash"), "block").select("block", "ids", "held", "ends", "text", "answers")


# ---------------------------------------------------------------- model


@dataclass(frozen=True)
class Model:
    """total: training tokens; distinct: different ones; weights[k - 1][b]: weight of level k in bucket b of its context's
    count (level 1 has one bucket)."""

    order: int
    total: int
    distinct: int
    weights: tuple[np.ndarray, ...]


def bucket(n: np.ndarray) -> np.ndarray:
    """Bit length: 0 for 0, 1 for 1, 2 to 3, 4 to 7, ..."""
    return np.frexp(n.astype(float))[1]


def estimates(t: Tokens, uses: list[np.ndarray], total: int, deleted: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each level, each token's estimate and its bucket; deleted: without the uses in the token's own document."""
    out, context, own_context = [], None, None
    ends = uses[0][t.grams[0][2][t.off[1:] - 1]]  # documents learnt from, which are the uses of the beginning as well
    for (_, _, place, own), found in zip(t.grams, uses, strict=True):
        c = np.where(place >= 0, found[place] if len(found) else 0, 0) - own * t.train * deleted
        if context is None:
            whole = total - np.repeat(t.n, t.n) * t.train * deleted
            at = np.ones(len(c), np.int64)
        else:
            whole = np.empty_like(context)
            whole[1:] = context[:-1]
            whole[t.start] = (ends - t.train[t.start] * deleted) if len(out) == 1 else 0
            at = bucket(whole)
        out.append((np.where(whole > 0, c / np.maximum(whole, 1), 0.0), at))
        context = c
    return out


def cells(estimated: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Buckets and estimates, in quarter octaves, of all levels as one number."""
    code = np.zeros(len(estimated[0][0]), np.int64)
    for f, b in estimated:
        with np.errstate(divide="ignore"):
            octaves = np.where(f > 0, 1 + np.clip(np.rint(-4 * np.log2(f)), 0, 254), 0).astype(np.int64)
        code = (code << 14) | b << 8 | octaves
    return code


def maximise(code: np.ndarray, n: np.ndarray, order: int, distinct: int, rounds: int = 60) -> tuple[np.ndarray, ...]:
    """Weights of all levels and buckets by expectation-maximisation over the cells. Half a token for and against keeps
    weights inside (0, 1); buckets without tokens take the weight of the next smaller one."""
    places, found = [], []
    for k in range(order):
        cell = code >> (14 * (order - 1 - k)) & 0x3FFF
        places.append(cell >> 8)
        found.append(np.where(cell & 255, 2.0 ** (-((cell & 255) - 1) / 4), 0.0))
    weights = [np.full(64, 0.5) for _ in range(order)]
    for w in weights[1:]:
        w[0] = 0  # unseen contexts say nothing
    for _ in range(rounds):
        at_level, p = [], np.full(len(n), 1 / (distinct + 1))
        for f, b, w in zip(found, places, weights, strict=True):
            own = w[b] * f
            p = own + (1 - w[b]) * p
            at_level.append(own / p)
        reach = n.astype(float)  # tokens that come down to the level
        for k in range(order - 1, -1, -1):
            stay = reach * at_level[k]
            weights[k] = (np.bincount(places[k], stay, 64) + 0.5) / (np.bincount(places[k], reach, 64) + 1)
            weights[k][0] = 0
            reach = reach - stay
    for w, b in zip(weights, places, strict=True):
        seen = np.bincount(b, n, 64)
        for i in range(2, 64):
            if not seen[i]:
                w[i] = w[i - 1]
    return tuple(weights)


def _uses(t: Tokens, answers: list[dict]) -> list[np.ndarray]:
    out = []
    for level, (keys, *_) in enumerate(t.grams, 1):
        own = sorted((a for a in answers if a["level"] == level), key=lambda a: a["part"])
        out.append(np.concatenate([np.zeros(0, np.int64), *(unpacked(a["uses"]).view(np.int64) for a in own)]))
        if len(out[-1]) != len(keys):
            raise ValueError("answers don't fit their block")
    return out


def fit(joined: DataFrame, counted: DataFrame, order: int) -> Model:
    """The weights, from all training tokens of all blocks."""
    total, distinct = counted.where("block is null and level = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = _tokens(b, i, order)
                code, n = np.unique(cells(estimates(t, _uses(t, b.column(5)[i].as_py()), total, True))[t.train], return_counts=True)
                yield pa.record_batch([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    rows = joined.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    return Model(order, total, distinct, maximise(rows["cell"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), order, distinct))


def probabilities(t: Tokens, uses: list[np.ndarray], model: Model) -> np.ndarray:
    """Each token's probability."""
    p = np.full(len(t.doc), 1 / (model.distinct + 1))
    for (f, b), w in zip(estimates(t, uses, model.total, False), model.weights, strict=True):
        p = w[b] * f + (1 - w[b]) * p if model.total else p
    return p


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row. order: words of the
    longest n-gram, up to 4."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), planned_bytes(docs) // PART_BYTES)
    table = blocks(docs, parts)
    counted = counts(table, order, parts)
    joined = answered(table, counted, parts)
    model = fit(joined, counted, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = _tokens(b, i, order)
                uses = _uses(t, b.column(5)[i].as_py())
                c = uses[0][t.grams[0][2]]
                base = np.log10((c + 0.5) / (model.total + 0.5 * (model.distinct + 1)))
                sums = (np.add.reduceat(x, t.start) for x in (c > 0, base, np.log10(probabilities(t, uses, model))))
                known, base, own = (x.astype(d) for x, d in zip(sums, (np.int64, float, float), strict=True))
                cols = [b.column(1)[i].values, b.column(2)[i].values, t.n, known, np.full(len(t.n), model.total), base, own]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
