"""Removing repeated passages by longest-previous-factor arrays over suffix order.

A byte goes if some `least`-byte string over it also starts in a document of smaller id. For positions in suffix
order, the nearest neighbours above and below whose document is smaller (previous and next smaller values) give the
longest earlier match; a position whose match reaches `least` starts a repeated string. lpf() makes that array.

One suffix array over a whole corpus can't be built in tasks of bounded memory, so only text that can hold a match
goes into suffix arrays:

A. Every `least`-byte window has an anchor, its k-gram of smallest hash (a minimizer, leftmost on ties), which depends
   on the window's bytes alone; equal windows have equal anchors. The windows of one anchor are a run, about 13 of
   them. Runs are dealt by anchor hash as packed planes, about 15 bytes each after compression.
   Copies that a task sees again end here: within a chunk of text by sorting, across chunks by a table of the runs that
   were found twice in a chunk. What a full table forgets is merely dealt, so a passage that stands in a third of all
   documents reaches step B about once a task, not once a chunk.
B. Runs whose anchor occurs in one document only hold no match and end here. Runs of identical bytes form one class: a
   copy in a larger document is its representative's text again, so its bytes go; the representative (smallest id)
   stands for the class.
C. Representatives that share an anchor but not all bytes are candidates. Their text, about 63 bytes, is cut out of
   the documents and dealt by anchor hash. For an anchor with more than `hot` candidates single windows are dealt by
   their own hash instead, after each part has kept one document for each window, so that no task gathers a hot group.
D. Each bucket of candidates gets a suffix array and its LPF array; positions that reach `least` are repeated.
E. Documents meet their removed intervals and are cut.

Matches of any length are found: a long match is many windows, each judged through its own run. Hashes of 64 or 48
bits within an anchor group decide which runs are equal; step D compares bytes.

Edge cases: null texts are empty; texts shorter than `least` stay whole; rows of one id, with equal or different texts,
don't remove from each other (their ids tie) and are cut each by itself; rows without id neither remove nor lose
anything; very long texts are taken in chunks until the last step, which holds one whole; only id and text are read, so
other columns can't clash; an empty table gives an empty result; bytes are judged on the input, never on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import mix64, prefix_hash, release_shuffles, settle, slices, span_hash, text_bytes, text_column

GRAM = 24
CHUNK = 1_000_000  # bytes of text taken at once
PLACES = 250_000  # places of one suffix array, more only where one anchor has more
KNOWN = 400_000  # frequent runs that a task remembers, 16 bytes each
RUN = np.dtype([("h", "<u4"), ("r1", "<u4"), ("r2", "<u2"), ("doc", "<i8"), ("w", "<u4"), ("at", "<u4"), ("n", "u1")])
CUT = np.dtype([("doc", "<i8"), ("w", "<u4"), ("at", "<u4"), ("to", "<u4")])
PIECE = np.dtype([("doc", "<i8"), ("w", "<u4"), ("at", "<u4"), ("n", "u1"), ("h", "<u4"), ("b", "<u4"), ("hot", "u1")])
TASK_BYTES = 26  # about 2**26 bytes of text a task in the exchanges, whatever spark.sql.shuffle.partitions says


def pack(rows: np.ndarray) -> bytes:
    """Byte planes of a structured array: constant planes then compress to nothing."""
    return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def unpack(payloads: list[bytes], dtype: np.dtype) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype) for p in payloads if p]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def grouped(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edge = np.flatnonzero(np.diff(bucket)) + 1
    for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)], strict=True):
        if e > s:
            yield int(bucket[s]), rows[s:e]


def row_key(doc: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash for a row's id and the mark of its text."""
    return mix64(mix64(doc.astype(np.uint64)) + w.astype(np.uint64))


# ---------------------------------------------------------------- suffix order


def windows(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The depth bytes from each place, as big-endian words of 8 (the last one padded)."""
    wide = -(-depth // 8) * 8
    padded = np.concatenate((data, np.zeros(wide, np.uint8)))
    out = np.empty((wide // 8, len(at)), ">u8")
    for i in range(wide // 8):
        own = np.zeros((len(at), 8), np.uint8)
        keep = min(8, depth - 8 * i)
        own[:, :keep] = padded[at[:, None] + np.arange(8 * i, 8 * i + keep)]
        out[i] = own.view(">u8").ravel()
    return out.astype(np.uint64)


def lpf(data: np.ndarray, at: np.ndarray, doc: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """For each place, min(depth, length of its longest match with a place of a smaller document), or 0 if under
    `least`. Places must have depth bytes ahead."""
    n = len(at)
    keys = windows(data, at, depth)
    order = np.lexsort(keys[::-1])
    keys, owner = keys[:, order], doc[order]
    lcp = np.zeros(n + 1, np.int64)  # lcp[i]: of places i - 1 and i in suffix order
    same = np.ones(max(n - 1, 0), bool)
    for i, word in enumerate(keys):
        x = word[1:] ^ word[:-1]
        alike = np.full(len(x), min(8, depth - 8 * i))
        for b in range(8):
            alike = np.minimum(alike, np.where((x >> np.uint64(56 - 8 * b)) & np.uint64(255) != 0, b, 8))
        lcp[1:n] += np.where(same, alike, 0)
        same &= x == 0
    best = np.zeros(n, np.int64)
    for owners, steps in ((owner, lcp[:n]), (owner[::-1], lcp[1:][::-1])):
        before, reach = np.arange(n) - 1, steps.copy()  # previous smaller value by pointer jumping, with the least lcp on the way
        live = np.flatnonzero((before >= 0) & (reach >= least))
        reach[before < 0] = 0
        while len(live):
            on = owners[before[live]] >= owners[live]
            live = live[on]
            hop = before[live]
            reach[live] = np.minimum(reach[live], reach[hop])
            before[live] = before[hop]
            gone = before[live] < 0
            reach[live[gone]] = 0
            live = live[~gone & (reach[live] >= least)]
        best = np.maximum(best, reach if owners is owner else reach[::-1])
    out = np.empty(n, np.int64)
    out[order] = np.where(best >= least, best, 0)
    return out


class Known:
    """Runs that were found twice in a chunk, with the smallest document that held them so far: at most `most` of
    them, the least recently added ones go first. A forgotten run costs time, never a match."""

    def __init__(self, most: int):
        self.most = most
        self.run, self.doc, self.age = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.round = 0

    def smallest(self, run: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each run the smallest document known to hold it, its own one if none is smaller."""
        if not len(self.run):
            return doc
        at = np.minimum(np.searchsorted(self.run, run), len(self.run) - 1)
        return np.where(self.run[at] == run, np.minimum(doc, self.doc[at]), doc)

    def add(self, run: np.ndarray, doc: np.ndarray) -> None:
        """Remember runs (unique here) with the smallest document of their chunk."""
        if not len(run):
            return
        self.round += 1
        run, doc = np.concatenate((self.run, run)), np.concatenate((self.doc, doc))
        age = np.concatenate((self.age, np.full(len(run) - len(self.age), self.round)))
        order = np.lexsort((doc, run))
        run, doc, age = run[order], doc[order], age[order]
        head = np.flatnonzero(np.diff(run, prepend=run[:1] + np.uint64(1)))
        run, doc, age = run[head], doc[head], np.maximum.reduceat(age, head)
        if len(run) > self.most:
            keep = np.sort(np.argsort(-age, kind="stable")[: self.most])
            run, doc, age = run[keep], doc[keep], age[keep]
        self.run, self.doc, self.age = run, doc, age


# ---------------------------------------------------------------- runs of windows


def runs(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor hash, hash of the run's bytes and place of the anchor) of all runs."""
    none = np.zeros(0, np.int64)
    n, w = len(data), least - GRAM + 1
    if n < least:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(n + 1 - GRAM)
    gram = span_hash(prefix, at, at + GRAM)
    low = np.uint64((1 << 24) - 1)
    span = 1
    small = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    while span * 2 <= w:
        small = np.minimum(small[:-span], small[span:])
        span *= 2
    small = np.minimum(small[: len(small) - (w - span)], small[w - span :])
    anchor = (small & low).astype(np.int64)  # of each window
    whole = np.zeros(n + 1, np.int64)
    size = np.diff(off)
    fit = np.flatnonzero(size >= least)
    whole[off[fit]] += 1
    np.subtract.at(whole, off[fit] + size[fit] - least + 1, 1)
    whole = np.cumsum(whole[: len(anchor)]) > 0
    new = whole.copy()
    starts_here = np.zeros(n + 1, bool)
    starts_here[off] = True
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1] | starts_here[1 : len(anchor)]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(whole))
    ends = np.flatnonzero(~np.append(whole, False))  # first window after the run that isn't whole
    stop = np.minimum(stop, ends[np.searchsorted(ends, first)])
    a = anchor[first]
    content = mix64(span_hash(prefix, first, stop + least - 1) ^ (a - first).astype(np.uint64))
    return np.searchsorted(off, first, "right") - 1, first, stop - first, gram[a], content


def repeated(docs: DataFrame, least: int = 50, hot: int = 20_000, key: str = "doc_id", text: str = "text") -> tuple[GroupedData, GroupedData]:
    """Documents dealt into parts (part, doc_id, text, w) and removed intervals (part, payload of CUT), both by part."""
    if not GRAM < least <= 255:
        raise ValueError(f"least must be in {GRAM + 1}..255")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    about = text_bytes(rows, "text")
    # w tells the texts of one id apart; all 0, and so free, where ids are unique
    h = F.xxhash64("text")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high")
    mark = F.lit(0).cast("long") if several.isEmpty() else F.crc32(F.col("text").cast("binary"))
    rows = rows.withColumn("w", mark)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), about >> TASK_BYTES)

    def by(df: DataFrame, column: str):
        return df.repartition(tasks, column).groupBy(column)

    parts, buckets = max(64, about >> 23), max(64, about >> 22)
    flag = "part int, kind int, payload binary"

    def part_of(doc: np.ndarray) -> np.ndarray:
        return (mix64(doc.astype(np.uint64) + np.uint64(77)) % np.uint64(parts)).astype(np.int64)

    def out(found: list[tuple[int, int, bytes]], names: tuple[str, str, str] = ("part", "kind", "payload")) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=list(names))

    def cuts(doc: np.ndarray, w: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        got = np.zeros(len(doc), CUT)
        got["doc"], got["w"], got["at"], got["to"] = doc, w, at, to
        return got

    def deal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(KNOWN)
        for b in slices(batches, most=CHUNK):
            b = b.filter(b.column(0).is_valid())
            data, off = text_column(b.column(1))
            ids, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for s, e in pieces(off, CHUNK):  # a very long text alone may be larger
                yield from deal(data[off[s] : off[e]], off[s : e + 1] - off[s], ids[s:e], w[s:e], known)

    def pieces(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(off) - 1:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield at, to
            at = to

    def deal(data: np.ndarray, off: np.ndarray, ids: np.ndarray, w: np.ndarray, known: Known) -> Iterator[pa.RecordBatch]:
        chunk, lap = CHUNK, least - 1
        if len(data) <= chunk:
            yield from deal_chunk(data, off, ids, w, np.zeros(len(ids), np.int64), known)
            return
        for at in range(0, len(data) - lap, chunk):  # one text: chunks overlap by a window less one byte
            part = data[at : at + chunk + lap]
            yield from deal_chunk(part, np.array([0, len(part)]), ids, w, np.array([at]), known)

    def deal_chunk(data: np.ndarray, off: np.ndarray, ids: np.ndarray, w: np.ndarray, shift: np.ndarray, known: Known) -> Iterator[pa.RecordBatch]:
        row, first, count, h, content = runs(data, off, least)
        if not len(row):
            return
        doc, at = ids[row], first - off[row] + shift[row]
        order = np.lexsort((doc, content))
        head = np.ones(len(order), bool)
        head[1:] = content[order][1:] != content[order][:-1]
        kind = np.flatnonzero(head)
        run = content[order[kind]]
        least_doc = known.smallest(run, doc[order[kind]])
        copy = np.zeros(len(order), bool)
        copy[order] = doc[order] > least_doc[np.cumsum(head) - 1]  # a copy of a run of a smaller document of this task
        often = np.diff(np.append(kind, len(order))) > 1
        known.add(run[often], least_doc[often])
        found = []
        gone = cuts(doc[copy], w[row[copy]], at[copy], at[copy] + count[copy] + least - 1)
        for p, own in grouped(gone, part_of(gone["doc"])):
            found.append((p % buckets, 1, p.to_bytes(4, "little") + pack(own)))
        keep = np.flatnonzero(~copy)
        send = np.zeros(len(keep), RUN)
        send["h"], send["r1"], send["r2"] = h[keep] & np.uint64(0xFFFFFFFF), content[keep] >> np.uint64(32), (content[keep] >> np.uint64(16)) & np.uint64(0xFFFF)
        send["doc"], send["w"], send["at"], send["n"] = doc[keep], w[row[keep]], at[keep], count[keep]
        for p, own in grouped(send, ((h[keep] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)):
            found.append((p, 0, pack(own)))
        yield out(found, ("bucket", "kind", "payload"))

    def match_runs(t: pa.Table) -> pa.Table:
        kinds, loads = t.column("kind").to_numpy(), t.column("payload").to_pylist()
        bucket = t.column("bucket")[0].as_py()
        found = [(int.from_bytes(p[:4], "little"), 1, p[4:]) for k, p in zip(kinds, loads, strict=True) if k == 1]
        r = unpack([p for k, p in zip(kinds, loads, strict=True) if k == 0], RUN)
        h = np.sort(r["h"])
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        r = r[np.isin(r["h"], twice)] if len(twice) else r[:0]
        if len(r):
            content = (r["r1"].astype(np.uint64) << np.uint64(16)) | r["r2"]
            order = np.lexsort((r["at"], r["doc"], content, r["h"]))
            r, content = r[order], content[order]
            group = np.ones(len(r), bool)
            group[1:] = r["h"][1:] != r["h"][:-1]
            kind = group.copy()
            kind[1:] |= content[1:] != content[:-1]
            g, c = np.cumsum(group) - 1, np.cumsum(kind) - 1
            small = r["doc"][kind][c]
            copy = r["doc"] > small
            gone = cuts(r["doc"][copy], r["w"][copy], r["at"][copy], r["at"][copy].astype(np.int64) + r["n"][copy] + least - 1)
            found += [(p, 1, pack(own)) for p, own in grouped(gone, part_of(gone["doc"]))]
            starts = np.flatnonzero(group)
            varied = np.add.reduceat(kind.astype(np.int64), starts) > 1
            apart = np.minimum.reduceat(r["doc"], starts) < np.maximum.reduceat(r["doc"], starts)
            many = np.add.reduceat((~copy).astype(np.int64), starts)
            pick = ~copy & (varied & apart)[g]
            got = np.zeros(int(pick.sum()), PIECE)
            got["doc"], got["w"], got["at"], got["n"], got["h"], got["b"], got["hot"] = r["doc"][pick], r["w"][pick], r["at"][pick], r["n"][pick], r["h"][pick], bucket, many[g[pick]] > hot
            found += [(p, 2, pack(own)) for p, own in grouped(got, part_of(got["doc"]))]
        return pa.Table.from_batches([out(found)])

    def cut_pieces(d: pa.Table, f: pa.Table) -> pa.Table:
        names = ("bucket", "kind", "payload")
        piece = unpack(f.column("payload").to_pylist(), PIECE)
        if not len(piece) or not d.num_rows:
            return pa.Table.from_batches([out([], names)])
        data, off = text_column(d.column("text"))
        ids = row_key(d.column("doc_id").to_numpy(), d.column("w").to_numpy())
        order = np.argsort(ids, kind="stable")
        row = order[np.searchsorted(ids[order], row_key(piece["doc"], piece["w"]))]
        start, n = off[row] + piece["at"], piece["n"].astype(np.int64)
        # hot anchors: single windows, one document for each window here
        wide = np.flatnonzero(piece["hot"] == 1)
        each = np.repeat(wide, n[wide])
        s = start[each] + np.concatenate([np.arange(x) for x in n[wide]]) if len(wide) else np.zeros(0, np.int64)
        found = []
        if len(s):
            key = span_hash(prefix_hash(data), s, s + least)
            order = np.lexsort((piece["doc"][each], key))
            each, s, key = each[order], s[order], key[order]
            head = np.ones(len(s), bool)
            head[1:] = key[1:] != key[:-1]
            first = piece["doc"][each][head][np.cumsum(head) - 1]
            later = piece["doc"][each] > first
            place = s - off[row[each]]
            gone = cuts(piece["doc"][each][later], piece["w"][each][later], place[later], place[later] + least)
            found += [(p % buckets, 1, p.to_bytes(4, "little") + pack(own)) for p, own in grouped(gone, part_of(gone["doc"]))]
            each, s, key, place = each[~later], s[~later], key[~later], place[~later]
            found += bundle(data, piece[["doc", "w"]][each], place, np.ones(len(s), np.int64), s, (key % np.uint64(buckets)).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32))
        cold = np.flatnonzero(piece["hot"] == 0)
        found += bundle(data, piece[["doc", "w"]][cold], piece["at"][cold], n[cold], start[cold], (piece["b"][cold].astype(np.int64) * 31 + piece["h"][cold]) % buckets, piece["h"][cold])
        return pa.Table.from_batches([out(found, names)])

    def bundle(data: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, start: np.ndarray, bucket: np.ndarray, group: np.ndarray) -> list[tuple[int, int, bytes]]:
        found = []
        for p, own in grouped(np.arange(len(doc)), bucket):
            head = np.zeros(len(own), PIECE)
            head["doc"], head["w"], head["at"], head["n"], head["h"] = doc["doc"][own], doc["w"][own], at[own], n[own], group[own]
            size = n[own] + least - 1
            to = np.cumsum(size)
            body = data[np.repeat(start[own] - (to - size), size) + np.arange(to[-1])]
            found.append((p, 0, len(own).to_bytes(4, "little") + pack(head) + body.tobytes()))
        return found

    def match_suffixes(t: pa.Table) -> pa.Table:
        found, heads, bodies = [], [], []
        for kind, p in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist(), strict=True):
            if kind == 1:
                found.append((int.from_bytes(p[:4], "little"), 1, p[4:]))
                continue
            n = int.from_bytes(p[:4], "little") * PIECE.itemsize
            heads.append(p[4 : 4 + n])
            bodies.append(p[4 + n :])
        head = unpack(heads, PIECE)
        if len(head):
            data = np.frombuffer(b"".join(bodies), np.uint8)
            n = head["n"].astype(np.int64)
            first = np.cumsum(n + least - 1) - (n + least - 1)
            # equal windows have equal anchors, so anchors may go into suffix arrays of their own
            order = np.argsort(head["h"], kind="stable")
            group = np.flatnonzero(np.diff(head["h"][order], prepend=head["h"][order[:1]] + np.uint32(1)))
            load = np.add.reduceat(n[order], group)
            lot = np.cumsum(load) // PLACES
            edge = [*group[np.flatnonzero(np.diff(lot, prepend=-1))].tolist(), len(order)]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                own = order[s:e]
                owner = np.repeat(own, n[own])
                inside = np.arange(len(owner)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                match = lpf(data, first[owner] + inside, head["doc"][owner], least, least)
                hit = np.flatnonzero(match >= least)
                place = head["at"][owner[hit]].astype(np.int64) + inside[hit]
                gone = cuts(head["doc"][owner[hit]], head["w"][owner[hit]], place, place + least)
                found += [(p, 1, pack(own)) for p, own in grouped(gone, part_of(gone["doc"]))]
        return pa.Table.from_batches([out(found)])

    spark = docs.sparkSession
    flags = settle(by(rows.mapInArrow(deal_runs, "bucket int, kind int, payload binary"), "bucket").applyInArrow(match_runs, flag), "runs")
    release_shuffles(spark)

    def deal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(part_of(ids).astype(np.int32)), *b.columns], names=["part", "doc_id", "text", "w"])

    dealt = rows.mapInArrow(deal_texts, "part int, doc_id long, text string, w long")
    pieces_of = flags.where("kind = 2")
    snippets = by(dealt.where("doc_id is not null"), "part").cogroup(by(pieces_of, "part")).applyInArrow(cut_pieces, "bucket int, kind int, payload binary")
    more = settle(by(snippets, "bucket").applyInArrow(match_suffixes, flag), "suffixes")
    release_shuffles(spark)
    return by(dealt, "part"), by(flags.where("kind = 1").select("part", "payload").union(more.select("part", "payload")), "part")


def dedup(docs: DataFrame, least: int = 50, hot: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of every row. kept_text is the remaining bytes as
    UTF-8; characters cut apart show as U+FFFD."""
    dealt, removed = repeated(docs, least, hot, key=key, text=text)

    def cut(d: pa.Table, f: pa.Table) -> pa.Table:
        gone = unpack(f.column("payload").to_pylist(), CUT)
        keys = row_key(gone["doc"], gone["w"])
        order = np.argsort(keys, kind="stable")
        gone, keys = gone[order], keys[order]
        mine = row_key(d.column("doc_id").fill_null(-1).to_numpy(), d.column("w").to_numpy())
        cols: list[list] = [[], [], [], [], [], []]
        data, off = text_column(d.column("text"))
        for i, doc in enumerate(d.column("doc_id").to_pylist()):
            own = data[off[i] : off[i + 1]]
            n = len(own)
            at = np.zeros(0, np.int64)
            if doc is not None and len(gone):
                s, e = np.searchsorted(keys, mine[i], "left"), np.searchsorted(keys, mine[i], "right")
                at, to = np.minimum(gone["at"][s:e].astype(np.int64), n), np.minimum(gone["to"][s:e].astype(np.int64), n)
            count = spans = 0
            if len(at):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at, 1)
                np.subtract.at(edge, to, 1)
                hit = np.cumsum(edge[:n]) > 0
                count, spans = int(hit.sum()), int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())
                own = own[~hit]
            raw = own.tobytes()
            for c, v in zip(cols, (doc, n, count, spans, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace")), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return dealt.cogroup(removed).applyInArrow(cut, schema)
