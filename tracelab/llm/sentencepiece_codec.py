"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text becomes a dummy-prefix space plus the text, spaces as U+2581; it is cut before every space run, where no piece
of the model crosses. Distinct new words of a block are grouped by length and advance together: at each end position
the hashes of all substrings that may end there probe the sorted piece keys, and the maximum over starts leaves a
score and a backpointer for every word of the group at once. Ties go to the earlier start. A character outside the
vocabulary scores `min score - 10` and is written as its UTF-8 byte pieces; a literal U+2581 goes the same way, so
decoding gives back exactly the text. Words already seen by a worker come from a bounded cache.

The model file is read, never copied or trained; its path is a parameter.

Edge cases: null and empty texts have no pieces and decode to the empty text; repeated rows encode alike; very long
words are cut at unknown characters, which no piece spans; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
HEAD = np.uint64(44)  # the filter before the search sees the first 20 bits of a key
CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE = 200_000


def proto_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def key_of(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.zeros(codes.shape[0], np.uint64)
    for i in range(codes.shape[1]):
        h = h * BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
    return h * SPREAD


class Codec:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        for number, value in proto_fields(model):
            if number == 1:
                piece = dict(proto_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, 1))
        plain = [i for i, k in enumerate(kinds) if k == 1]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece of this model crosses a space")
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == 6}
        if len(self.byte_id) != 256:
            raise ValueError("this model has no byte fallback")
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.unknown = min(scores[i] for i in plain) - 10.0
        keys, ids = [], []
        for n in range(1, self.longest + 1):
            own = [i for i in plain if len(self.pieces[i]) == n]
            if own:
                keys.append(key_of(np.array([[ord(c) for c in self.pieces[i]] for i in own])))
                ids += own
        keys, ids = np.concatenate(keys), np.array(ids)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], ids[order], np.array(scores)[ids[order]]
        self.single = {self.pieces[i] for i in plain if len(self.pieces[i]) == 1} - {SPACE}
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.head = np.zeros(1 << 20, bool)
        self.head[(self.keys >> HEAD).astype(np.int64)] = True
        self.surface = [b"" for _ in self.pieces]
        for i in plain:
            self.surface[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.surface[i] = bytes([b])
        self.seen: dict[str, bytes] = {}

    def fallback(self, text: str) -> list[int]:
        return [self.byte_id[b] for b in text.encode()]

    def probe(self, key: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted ones, or -1."""
        out = np.full(len(key), -1)
        maybe = np.flatnonzero(self.head[(key >> HEAD).view(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == key[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of one length."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.uint64)
        prefix = np.zeros((size + 1, n), np.uint64)  # hash of the first i characters
        for i in range(size):
            prefix[i + 1] = prefix[i] * BASE + codes[:, i] + np.uint64(1)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(min(self.longest, size), BASE))), dtype=np.uint64)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        start, place = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
        rows = np.arange(n)
        for end in range(1, size + 1):
            begins = np.arange(max(0, end - self.longest), end)
            key = (prefix[end] - prefix[begins] * power[end - begins][:, None]) * SPREAD
            at = self.probe(key.ravel()).reshape(key.shape)
            gain = np.where(at >= 0, self.scores[at], -np.inf)
            gain[-1][at[-1] < 0] = self.unknown
            total = best[begins] + gain
            top = total.argmax(axis=0)
            best[end], start[end], place[end] = total[top, rows], begins[top], at[top, rows]
        end, count, strange = np.full(n, size), np.zeros(n, np.int64), np.zeros(n, bool)
        back = np.zeros((n, size), np.int32)
        live = rows
        while len(live):
            p = place[end[live], live]
            strange[live] |= p < 0
            back[live, count[live]] = self.ids[p]
            count[live] += 1
            end[live] = start[end[live], live]
            live = live[end[live] > 0]
        turn = count[:, None] - 1 - np.arange(int(count.max()))
        flat = np.take_along_axis(back, np.maximum(turn, 0), 1)[turn >= 0].astype("<i4").tobytes()
        cut = (np.cumsum(count) * 4).tolist()
        out = [flat[s:e] for s, e in zip([0, *cut[:-1]], cut, strict=True)]
        for i in np.flatnonzero(strange).tolist():
            ids, e = [], size
            while e:
                s, p = int(start[e, i]), int(place[e, i])
                ids += [int(self.ids[p])] if p >= 0 else self.fallback(words[i][s:e])[::-1]
                e = s
            out[i] = np.array(ids[::-1], "<i4").tobytes()
        return out

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of distinct words."""
        groups: dict[int, list[str]] = {}
        whole: dict[str, list[str]] = {}
        for w in words:
            if len(w) <= 64:
                groups.setdefault(len(w), []).append(w)
                continue
            parts, run = [], []  # no piece spans an unknown character, so the word may be cut there
            for c in w:
                if c in self.single or c == SPACE:
                    run.append(c)
                else:
                    parts += ["".join(run)] * bool(run) + [c]
                    run = []
            parts += ["".join(run)] * bool(run)
            whole[w] = parts
            for p in parts:
                groups.setdefault(len(p), []).append(p)
        packed: dict[str, bytes] = {}
        for size, group in groups.items():
            if whole:
                group = list(dict.fromkeys(group))
            step = max(1, 400_000 // (size * min(size, self.longest)))
            for at in range(0, len(group), step):
                packed.update(zip(group[at : at + step], self.viterbi(group[at : at + step]), strict=True))
        for w, parts in whole.items():
            packed[w] = b"".join([packed[p] for p in parts])
        return packed

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        cut = []
        for t in texts:
            if t and SPACE in t:
                parts: list = []
                for k, x in enumerate(t.split(SPACE)):  # literal U+2581: byte pieces between the rest
                    parts += [np.array(self.fallback(SPACE), "<i4").tobytes()] * bool(k)
                    line = (" " * (not k) + x).replace(" ", SPACE)
                    parts += CUT.findall(line)
                cut.append(parts)
            else:
                cut.append(CUT.findall((" " + t).replace(" ", SPACE)) if t else [])
        if len(self.seen) > CACHE:
            self.seen = {}
        new = {w for w in set().union(*cut) if type(w) is str and w not in self.seen}
        now = self.learn(new) if new else {}
        if len(self.seen) + len(now) <= 2 * CACHE:
            self.seen |= now
            now = self.seen
        else:
            now |= self.seen
        return [b"".join([now[w] if type(w) is str else w for w in words]) for words in cut]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; one that the model doesn't have is U+FFFD."""
        surface, ids = self.surface, np.frombuffer(packed, "<i4")
        if len(ids) and (ids.min() < 0 or ids.max() >= len(surface)):
            surface = dict(enumerate(surface))
            first = [surface.get(i, UNKNOWN) for i in ids.tolist()]
            # the blank that encoding puts before a text is there unless the first id is unknown
            return b"".join(first).decode("utf-8", "replace")[first[0] is not UNKNOWN :]
        return b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


UNKNOWN = "\ufffd".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_open: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    path = path or default_model()
    if path not in _open:
        with open(path, "rb") as f:
            _open[path] = Codec(f.read())
    return _open[path]


def encode(docs: DataFrame, model: str | None = None, text: str = "text", check: bool = True) -> DataFrame:
    """docs with ids array<int>, n_pieces and, with check, round_trip (decoding gives the text again). Columns of
    these names in docs are replaced."""
    rows = docs.drop("ids", "n_pieces", "round_trip")
    schema = rows.select("*", F.array(F.lit(0)).alias("ids"), F.lit(0).alias("n_pieces"), F.lit(True).alias("round_trip")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in slices(batches, text):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            packed = own.encode(texts)
            off = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            same = [own.decode(x) == (t or "") for x, t in zip(packed, texts, strict=True)] if check else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(np.diff(off)), pa.array(same, pa.bool_())], names=[*b.schema.names, "ids", "n_pieces", "round_trip"])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """rows with decoded, the text of their ids, which replaces a column of this name; a null list decodes to null, a null
    id or one that the model doesn't have to U+FFFD."""
    kept = rows.drop("decoded")
    schema = kept.select("*", F.lit("").cast("string").alias("decoded")).schema
    schema["decoded"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            out = [None if x is None else own.decode(np.array([-1 if i is None else i for i in x], "<i4").tobytes()) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)
