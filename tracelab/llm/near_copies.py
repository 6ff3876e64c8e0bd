"""Near copies by word-shingle similarity: SimHash bytes of shingle cells in a byte-position inverted index.

A text is the set of its five-word shingles (ASCII case folded; fewer words give one shingle of the whole sequence, null
or blank text one of its own). Two texts are linked when their sets have a Jaccard similarity of 4/5 or more. Every such
pair is found (but for collisions of 64-bit hashes, which stand for shingles and for whole sets):

- One SimHash of 64 bits can't tell 0.8 from less, so the shingles of a text are dealt into cells by hash, and each cell
  has a SimHash of four bytes: a fingerprint of (cell, byte) entries that grows with the text. Sets of n and m elements
  with similarity >= 4/5 differ in at most (n + m) / 9 <= n / 4 elements, and an element touches one cell, so with c
  filled cells at least c - n // 4 cells keep their four bytes. By that count the first n // 4 + 1 filled cells, in any
  order common to all texts, hold a shared one: only those are posted. Cells whose bytes are frequent come last; that
  order comes from a count sketch of fixed size and decides cost alone, never a result. A text with too few filled
  cells is posted once more with its shingles dealt anew, until it has enough.
- The number of cells depends on the size class of a text (a power of four); a text close under a border is posted in
  the next class too.
- Lists of up to `small` texts give all their pairs. In longer ones each text meets the one of smallest id. Then texts
  of a list that those links haven't connected yet meet in chunks: first the nearest, a spanning forest of the chunk's
  components, and once those are verified all that are still apart.
- Count filter: dealt into cells of one SimHash byte each, eight to sixteen cells for 16 shingles, an element touches one
  positional byte, so a pair shares all but (n + m) / 9 of them. Shared bytes are tallied per pair and pairs under that
  minimum go. The number of cells is a power of two; a text close under the next one has bytes of that number too, so
  that any two sets that may be linked can be tallied.
- Parity maps of 2 n bits or more spare the rest: an element touches one bit, so at most (n + m) / 9 bits differ. What
  is left is verified on whole sets.
- Texts that share a passage make far more pairs than near copies do, and the more, the larger the table. So pairs are
  made of texts of fitting sizes alone, and first compared by parity maps of n bits, an eighth of the rest: only what
  they leave is joined with the tally's bytes and the larger maps, and only the texts named there are shuffled for it.
- In long lists pairs are made of texts by maps that grow with them: one of fixed size is full for long texts and lets
  through all that share a passage, the square of a list.

Equal sets collapse to one class before all that. No row needs an id here. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, release_memory, release_shuffles, settle, slices, text_column, word_bounds, word_keys
from .simhash import Forest, components

WORDS = 5
BUCKETS = 20
BITS = 1024
BROADCAST_IDS = 2_000_000
SLICE = 500_000  # bytes of text taken at once
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) << np.uint64(32)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the set of shingle hashes of each text, ascending; never empty."""
    data, off = text_column(column)
    data = LOWER[data]
    start, end = word_bounds(data, off)
    first = np.searchsorted(start, off)
    size = np.diff(first)
    word = word_keys(data, start, end)
    own = np.repeat(np.arange(len(size)), size)
    n = max(0, len(word) - WORDS + 1)
    whole = np.flatnonzero(own[:n] == own[len(own) - n :])
    h = np.zeros(len(whole), np.uint64)
    for d in range(WORDS):
        h += word[whole + d] * PLACE[d]
    short = np.flatnonzero(size < WORDS)
    g = size[short].astype(np.uint64) + np.uint64(1)
    for d in range(WORDS - 1):
        on = size[short] > d
        g[on] += word[first[short[on]] + d] * PLACE[d]
    text, h = np.concatenate((own[whole], short)), mix64(np.concatenate((h, g)))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(size) + 1))


def set_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash a set."""
    return mix64(np.add.reduceat(mix64(h ^ np.uint64(0x5BD1E995)), off[:-1]) + np.diff(off).astype(np.uint64)).view(np.int64)


def with_class(docs: DataFrame) -> DataFrame:
    """docs and the hash `_set` of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            ids = set_ids(*shingle_sets(b.column(b.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids)], [*b.schema.names, "_set"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias("_set")).schema)


def cells_of(kind: np.ndarray) -> np.ndarray:
    """How many cells a text of a size class has; class c holds sizes from 0.8 * 4**c to 4**(c + 1) - 1."""
    return (28 * 4 ** (kind + 1) + 99) // 100 + 2


def simhash_cells(place: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, elements, SimHash bytes) of the filled cells, ascending, of elements at place by the lowest bytes of x; a
    bit that half of a cell's elements set is that of its largest."""
    order = np.argsort(place)
    place, x = place[order], x[order] & np.uint64((1 << 8 * width) - 1)
    first = np.flatnonzero(np.diff(place, prepend=~place[:1]))
    filled = np.diff(np.append(first, len(x)))
    bits = lambda v: np.unpackbits(v.astype(f">u{width}").view(np.uint8).reshape(-1, width), axis=1)
    ones = np.add.reduceat(bits(x), first, axis=0, dtype=np.int32)
    lead = bits(np.maximum.reduceat(x, first)).astype(np.int32)
    return place[first], filled, np.packbits(4 * ones + 2 * lead - 1 > 2 * filled[:, None], axis=1)


def tokens(h: np.ndarray, off: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, list): the filled cells of each text with their SimHash bytes, folded into one hash a cell. With rank only
    those that have to be posted, cells of low rank first."""
    n = np.diff(off)
    kind = (np.frexp(n)[1].astype(np.int64) - 1) // 2
    text = np.arange(len(n))
    close = np.flatnonzero(5 * n >= 4 * 4 ** (kind + 1))
    text, kind, seed = np.concatenate((text, close)), np.concatenate((kind, kind[close] + 1)), 0
    texts, lists = [], []
    while len(text):
        size = n[text]
        to = np.cumsum(size)
        row = np.repeat(np.arange(len(text)), size)
        x = mix64(h[np.repeat(off[text] - (to - size), size) + np.arange(to[-1])] + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        cell = ((x >> np.uint64(32)) * cells_of(kind)[row].astype(np.uint64)) >> np.uint64(32)
        place = (row.astype(np.uint64) << np.uint64(32)) | cell
        place, _, value = simhash_cells(place, x, 4)
        value = value.view(">u4").ravel().astype(np.uint64)
        row = (place >> np.uint64(32)).astype(np.int64)
        label = (kind[row].astype(np.uint64) << np.uint64(40)) | (np.uint64(seed & 255) << np.uint64(32)) | (place & np.uint64(0xFFFFFFFF))
        token = mix64(mix64(label) + value)
        if rank is None:
            return text[row], token
        order = np.lexsort((token, rank[(token >> np.uint64(64 - BUCKETS)).astype(np.int64)], row))
        row, token = row[order], token[order]
        start = np.searchsorted(row, np.arange(len(text) + 1))
        on = np.arange(len(row)) - start[row] <= (size // 4)[row]
        texts.append(text[row[on]])
        lists.append(token[on])
        poor = np.diff(start) <= size // 4
        text, kind, seed = text[poor], kind[poor], seed + 1
    return (np.concatenate(texts), np.concatenate(lists)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def frequent(docs: DataFrame) -> np.ndarray:
    """For each bucket of cell hashes, 0, or for those well over the mean in some task the log of their count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for b in slices(batches, most=SLICE):
            _, token = tokens(*shingle_sets(b.column(0)))
            total += np.bincount((token >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS)
        # a bucket that is not frequent in any task is not frequent: it needn't be told
        at = np.flatnonzero(total > 4 * total.mean() + 8)
        for i in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(at[i : i + (1 << 16)]), pa.array(total[at[i : i + (1 << 16)]])], names=["bucket", "n"])

    counts = settle(docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "sketch")
    rank = np.zeros(1 << BUCKETS, np.uint8)
    for r in counts.select("bucket", F.ceil(F.log2("n")).cast("int").alias("log")).collect():
        rank[r["bucket"]] = r["log"]
    return rank


def postings(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(list, id, n): the posted cells of each set with its size, once a set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, most=SLICE):
            h, off = shingle_sets(b.column(0))
            ids = set_ids(h, off)
            text, token = tokens(h, off, rank)
            fresh = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()])[text]
            own = text[fresh]
            yield pa.record_batch([pa.array(token[fresh].view(np.int64)), pa.array(ids[own]), pa.array(np.diff(off)[own].astype(np.int32))], names=["list", "id", "n"])

    return docs.select("text").mapInArrow(run, "list long, id long, n int")


def whole_units(batches: Iterator[pa.RecordBatch], most: int = 1 << 62) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of rows in the order of the first, cut where it changes: (columns, bounds). No unit of up to `most` rows
    is divided; longer ones come in parts, each starting a new yield."""
    held: list[np.ndarray] | None = None
    release_memory()
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        done = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
        if not done and len(held[0]) > most:
            done = len(held[0])
        if done:
            part = [x[:done] for x in held]
            yield part, np.concatenate(([0], np.flatnonzero(np.diff(part[0])) + 1, [done]))
            held = [x[done:] for x in held]
    if held is not None and len(held[0]):
        yield held, np.concatenate(([0], np.flatnonzero(np.diff(held[0])) + 1, [len(held[0])]))


def first_pairs(posted: DataFrame, small: int, most: int = 1 << 18) -> DataFrame:
    """(a, b, list): pairs to verify (list is null), whose sizes fit, and the texts a of lists over `small` (b is null). A
    task holds `most` texts of a list at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_list, last_id, hub, hub_n = None, None, None, None
        for (key, ids, n), cut in whole_units(batches, most):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            goes_on = last_list == key[0]
            new[0] = not (goes_on and last_id == ids[0])
            key, ids, n = key[new], ids[new], n[new].astype(np.int64)
            if not len(key):
                continue
            cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            length = np.diff(cut)
            many = length > small
            if goes_on:
                many[0] = True
            heads, head_n = ids[cut[:-1]], n[cut[:-1]]
            if goes_on:
                heads[0], head_n[0] = hub, hub_n
            fits = sizes_fit(np.repeat(head_n, length), n)
            a, b = [np.repeat(heads, length)[fits]], [ids[fits]]
            few = np.repeat(~many, length)
            for step in range(1, small):
                x = np.flatnonzero(few & (np.arange(len(key)) + step < np.repeat(cut[1:], length)))
                x = x[sizes_fit(n[x], n[x + step])]
                a.append(ids[x])
                b.append(ids[x + step])
            pair = np.stack([np.concatenate(a), np.concatenate(b)], 1)
            pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)  # ids rise within a list
            yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.nulls(len(pair), pa.int64())], names=["a", "b", "list"])
            if many.any():
                at = np.repeat(many, length)
                yield pa.record_batch([pa.array(ids[at]), pa.nulls(int(at.sum()), pa.int64()), pa.array(key[at])], names=["a", "b", "list"])
            last_list, last_id, hub, hub_n = key[-1], ids[-1], heads[-1], head_n[-1]

    dealt = posted.repartition("list").sortWithinPartitions("list", "id")
    return dealt.mapInArrow(run, "a long, b long, list long")


def sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of sizes sets of similarity >= 4/5 may have."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def possible(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sets, by sizes n, m and parity bytes a, b of equal length (last axis), may have similarity >= 4/5:
    all but (n + m) / 9 of the bytes are shared, and at most (n + m) / 9 bits differ."""
    x = a ^ b
    size = x.shape[-1] * 8
    ok = sizes_fit(n, m) & ((x.view(np.uint8).reshape(*x.shape[:-1], size) == 0).sum(axis=-1) >= size - (n + m) // 9)
    ok[ok] = 9 * np.bitwise_count(x[ok]).sum(axis=-1, dtype=np.int64) <= np.broadcast_to(n + m, ok.shape)[ok]
    return ok


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity maps of fewer words (a power of two less): the same elements, modulo fewer bits."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def all_possible(n: np.ndarray, m: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The same for parity maps of various lengths, powers of two: the longer map of a pair is folded."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)]).reshape(-1, 2)
    on = np.zeros(len(sizes), bool)
    for x, y in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (x, y)).all(axis=1))
        least = min(x, y) // 8
        a, b = (folded(np.frombuffer(b"".join(side[i] for i in at.tolist()), np.uint64).reshape(len(at), -1), least) for side in (left, right))
        on[at] = possible(n[at], m[at], a, b)
    return on


def meetings(n: np.ndarray, maps: list[bytes], apart: Callable[[slice, slice], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, differing bits): pairs of rows x < y, sizes n ascending, whose sets may be linked by their maps (see unit_bits),
    of which the longer is folded. apart: which pairs of two ranges of rows are asked for."""
    size = np.array([len(m) for m in maps])
    cut = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(n)]
    for start, end in zip(cut[:-1], cut[1:], strict=True):
        to = int(np.searchsorted(n, 5 * n[end - 1] // 4, "right"))
        width = int(size[start]) // 8
        runs = [(s, min(e, to)) for s, e in zip(cut[:-1], cut[1:], strict=True) if start <= s < to]
        words = np.concatenate([folded(np.frombuffer(b"".join(maps[s:e]), np.uint64).reshape(e - s, -1), width) for s, e in runs])
        step = max(1, min(16, (1 << 20) // (width * (to - start))))
        for i in range(start, end, step):
            j = min(end, i + step)
            x, y = np.nonzero(apart(slice(i, j), slice(i, int(np.searchsorted(n, 5 * n[j - 1] // 4, "right")))))
            x, y = x[x < y] + i, y[x < y] + i
            on = possible(n[x], n[y], words[x - start], words[y - start])
            x, y = x[on], y[on]
            if len(x):
                yield x, y, np.bitwise_count(words[x - start] ^ words[y - start]).sum(axis=1, dtype=np.int64)


def spanning(p: np.ndarray, q: np.ndarray, of: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the pairs (p, q) of rows are a spanning forest of the components that they join, the nearest first."""
    _, code = np.unique(np.concatenate((of[p], of[q])), return_inverse=True)
    a, b = np.minimum(code[: len(p)], code[len(p) :]), np.maximum(code[: len(p)], code[len(p) :])
    order = np.lexsort((q, p, far, b, a))
    head = np.ones(len(order), bool)
    head[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    order = order[head]
    order = order[np.lexsort((q[order], p[order], far[order]))]
    forest = Forest(len(code))
    return order[[forest.join(x, y) for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True)]]


def other_pairs(entries: DataFrame, linked: DataFrame, signs: DataFrame, list_rows: int, nearest: bool = False, held: int = 1 << 16) -> DataFrame:
    """(a, b): possible pairs of one list whose sets are not connected yet. In each list the texts of its most common
    component meet the rest, and the rest meets itself. With nearest only the nearest ones that would connect all
    components of a unit whose sets may be linked, so fewer than it has rows; about `held` pairs are kept meanwhile."""
    labelled = entries.join(linked, entries.a == linked.node, "left").select("list", "a", F.coalesce("component", "a").alias("of"))
    kinds = labelled.groupBy("list", "of").agg(F.count(F.lit(1)).alias("n"))
    lists = kinds.groupBy("list").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows"), F.max(F.struct("n", "of")).alias("top")).where("kinds > 1")
    lists = lists.select("list", F.col("top.of").alias("main"), F.ceil(F.col("top.n") / list_rows).cast("int").alias("mains"), F.ceil((F.col("rows") - F.col("top.n")) / list_rows).cast("int").alias("rests"))
    rows = settle(labelled.join(lists, "list").join(signs.select(F.col("id").alias("a"), "n", "map"), "a"), "open")
    is_main = F.col("of") == F.col("main")
    mine = F.pmod(F.xxhash64("a"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    rest = lambda i: F.concat(F.lit("r"), i.cast("string"))
    main = lambda i: F.concat(F.lit("m"), i.cast("string"))
    with_rests = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.concat(main(F.col("mine")), rest(j)))
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.concat(main(j), rest(F.col("mine"))))
    among = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.concat(rest(F.least(j, F.col("mine"))), rest(F.greatest(j, F.col("mine")))))
    units = rows.withColumn("mine", mine).withColumn("unit", F.explode(F.when(is_main, with_rests).otherwise(F.concat(with_mains, among))))
    spread = units.select(F.xxhash64("list", "unit").alias("unit"), "a", "n", "of", is_main.alias("main"), "map").repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ids, n, of, first, maps), cut in whole_units(batches):
            n = n.astype(np.int64)
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                row = s + np.argsort(n[s:e], kind="stable")
                own, main = of[row], first[row].astype(bool)
                with_main = bool(main.any())
                apart = lambda i, j: (own[i, None] != own[None, j]) & ~(with_main & ~(main[i, None] | main[None, j]))  # noqa: E731, B023
                near = np.zeros((0, 3), np.int64)
                for x, y, far in meetings(n[row], maps[row].tolist(), apart):
                    p, q = row[x], row[y]
                    if nearest:
                        near = np.concatenate((near, np.stack([p, q, far], 1)))
                        if len(near) > held:
                            near = near[spanning(near[:, 0], near[:, 1], of, near[:, 2])]
                    else:
                        pair = np.unique(np.stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])], 1), axis=0)
                        yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])
                if len(near):
                    near = near[spanning(near[:, 0], near[:, 1], of, near[:, 2])]
                    p, q = ids[near[:, 0]], ids[near[:, 1]]
                    yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return spread.mapInArrow(run, "a long, b long")


def map_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity map, and four times the cells, of sets of n elements: a power of two of 2 * n or more."""
    return np.maximum(BITS, 1 << np.frexp(2 * n - 1)[1].astype(np.int64))


def unit_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity map that goes to the units of other_pairs: a power of two of n or more, from BITS to 16 times that."""
    return np.clip(1 << np.frexp(n - 1)[1].astype(np.int64), BITS, 16 * BITS)


def thin_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the thin parity map: a power of two of n or more, and a word at least."""
    return np.maximum(64, 1 << np.frexp(n - 1)[1].astype(np.int64))


def cell_bytes(h: np.ndarray, off: np.ndarray) -> list[bytes]:
    """SimHash bytes of each set's cells, 0 for empty ones; where a set of similarity 4/5 may have twice as many cells,
    followed by the bytes of that many."""
    n = np.diff(off)
    own = map_bits(n) // 4
    close = 5 * n > 2 * 4 * own
    parts = []
    for rows, size in ((np.arange(len(n)), own), (np.flatnonzero(close), 2 * own[close])):
        begin = np.append(0, np.cumsum(size))
        out = np.zeros(begin[-1], np.uint8)
        if len(rows):
            to = np.cumsum(n[rows])
            row = np.repeat(np.arange(len(rows)), n[rows])
            x = mix64(h[np.repeat(off[rows] - (to - n[rows]), n[rows]) + np.arange(to[-1])] ^ np.uint64(0x2545F4914F6CDD1D))
            cells, _, value = simhash_cells(begin[row] + ((x >> np.uint64(32)).astype(np.int64) & (size - 1)[row]), x, 1)
            out[cells] = value.ravel()
        parts.append([out[s:e].tobytes() for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
    for i, more in zip(np.flatnonzero(close).tolist(), parts[1], strict=True):
        parts[0][i] += more
    return parts[0]


def shares_enough(n: np.ndarray, m: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Which pairs of sets, by sizes n, m and the bytes that cell_bytes gives, share all but (n + m) / 9 of their
    positional SimHash bytes, as similarity >= 4/5 implies."""
    a, b = map_bits(n) // 4, map_bits(m) // 4
    ok = sizes_fit(n, m)
    for x, y in np.unique(np.stack([a[ok], b[ok]], 1), axis=0).tolist():
        size = max(x, y)
        at = np.flatnonzero(ok & (a == x) & (b == y))
        cells = [np.frombuffer(b"".join(side[i][0 if own == size else own :][:size] for i in at.tolist()), np.uint8).reshape(len(at), size) for side, own in ((left, x), (right, y))]
        ok[at] = (cells[0] == cells[1]).sum(axis=1) >= size - (n[at] + m[at]) // 9
    return ok


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n, cells, map, wide, thin): size and SimHash bytes (see cell_bytes) of each set and its parity bytes: map,
    see unit_bits; wide, of the power of two of bits that holds 2 * n, null where that is BITS, as map is; thin, see thin_bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, most=SLICE):
            h, off = shingle_sets(b.column(0))
            ids = set_ids(h, off)
            n = np.diff(off)
            fresh = np.flatnonzero([not (i in seen or seen.add(i)) for i in ids.tolist()])
            maps, wides, thins, cells = [], [], [], cell_bytes(h, off)
            sizes, units, least = map_bits(n).tolist(), unit_bits(n).tolist(), thin_bits(n).tolist()
            for i in fresh.tolist():
                size = sizes[i]
                odd = np.bincount((h[off[i] : off[i + 1]] & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
                wide = np.packbits(odd.astype(bool))
                maps.append(folded(wide.view(np.uint64)[None], units[i] // 64).tobytes())
                wides.append(wide.tobytes() if size > BITS else None)
                thins.append(folded(wide.view(np.uint64)[None], least[i] // 64).tobytes())
            yield pa.record_batch([pa.array(ids[fresh]), pa.array(n[fresh].astype(np.int32)), pa.array([cells[i] for i in fresh.tolist()], pa.binary()), pa.array(maps, pa.binary()), pa.array(wides, pa.binary()), pa.array(thins, pa.binary())], names=["id", "n", "cells", "map", "wide", "thin"])

    return docs.select("text").mapInArrow(run, "id long, n int, cells binary, map binary, wide binary, thin binary").dropDuplicates(["id"])


def likely(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs without those that the thin parity maps exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta", SLICE):
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(all_possible(n, m, batch.column(4).to_pylist(), batch.column(5).to_pylist())))

    left, right = (signs.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("thin").alias(f"t{c}")) for c in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs without those that the tally of shared SimHash bytes excludes, then the parity maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ma", SLICE):
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            enough = shares_enough(n, m, *(batch.column(c).to_pylist() for c in ("ca", "cb")))
            batch, n, m = batch.filter(pa.array(enough)), n[enough], m[enough]
            if not batch.num_rows:
                continue
            on = all_possible(n, m, batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(on))

    left, right = (signs.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.coalesce("wide", "map").alias(f"m{c}"), F.col("cells").alias(f"c{c}")) for c in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.select("a", "b", "na", "nb", "ma", "mb", "ca", "cb").mapInArrow(run, "a long, b long")


def named_in(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose id is in some pair. Few ids are broadcast, so that no other row is shuffled; many are joined by a
    shuffle of all rows."""
    named = settle(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "named")
    return rows.join(F.broadcast(named) if named.count() <= BROADCAST_IDS else named, "id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs whose whole sets have a Jaccard similarity of 4/5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, most=SLICE):
            h, off = shingle_sets(b.column(0))
            ids = set_ids(h, off)
            items = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))
            fresh = pa.array([not (i in seen or seen.add(i)) for i in ids.tolist()])
            yield pa.record_batch([pa.array(ids), items], names=["id", "items"]).filter(fresh)

    pairs = settle(likely(settle(pairs.distinct(), "pairs"), signs), "likely")
    release_shuffles(docs.sparkSession)
    pairs = settle(plausible(pairs, named_in(signs, pairs)), "plausible")
    release_shuffles(docs.sparkSession)
    sets = named_in(docs.select("text").mapInArrow(run, "id long, items array<long>"), pairs)
    sets = settle(sets.dropDuplicates(["id"]), "sets")
    release_shuffles(docs.sparkSession)
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def near_copies(docs: DataFrame, small: int = 3, list_rows: int = 2048) -> DataFrame:
    """(node, component) for each set (see with_class) that has a near copy with another set."""
    rank = frequent(docs)
    release_shuffles(docs.sparkSession)
    found = settle(first_pairs(postings(docs, rank), small), "first")
    release_shuffles(docs.sparkSession)
    signs = settle(signatures(docs), "signatures")
    links = settle(verified(docs, found.where("list is null").select("a", "b"), signs), "links")
    entries = found.where("list is not null").select("list", "a")
    linked = components(links)
    if entries.isEmpty():
        return linked
    for nearest in (True, False):  # near ones connect a group, so that few pairs are left for the whole search
        linked = settle(linked, "linked")
        more = settle(verified(docs, other_pairs(entries, linked, signs, list_rows, nearest), signs), "links")
        release_shuffles(docs.sparkSession)
        if not more.isEmpty():
            links = links.union(more)
            linked = components(links)
    return linked


def survivors(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies: that of the smallest doc_id (null last), then of the smallest row
    hash. Rows are told apart by two 64-bit hashes of all their columns, not by id; equal rows count once."""
    release_shuffles(docs.sparkSession)  # and what an earlier stage has left, such as a model
    names = [F.col(f"`{c}`") for c in docs.columns]
    h1, h2 = F.xxhash64(*names).alias("_h1"), F.xxhash64(F.lit(1), *names).alias("_h2")
    rows = settle(with_class(docs.select("doc_id", h1, h2, "text")).drop("text"), "sets")
    linked = settle(near_copies(docs), "linked")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_h1", "_h2"))
    sets = rows.groupBy("_set").agg(best.alias("best")).join(linked, F.col("_set") == F.col("node"), "left")
    keep = sets.groupBy(F.coalesce("component", "_set").alias("of")).agg(F.min("best").alias("best")).select("best._h1", "best._h2")
    # as many rows as documents: never broadcast, whatever the estimate
    kept = docs.select(F.struct(*names).alias("row"), h1, h2).join(keep.hint("merge"), ["_h1", "_h2"], "left_semi")
    if not rows.groupBy("_h1", "_h2").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_h1", "_h2"])
    return kept.select("row.*")
