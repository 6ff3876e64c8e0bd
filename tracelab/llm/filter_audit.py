"""Filter interaction audit: what each of five filters removes in every order of the five, and what it alone would.

Each row gets a mask of the filters that it fails, and everything reported is a sum over the rows of a mask, so masks are
counted where the rows lie and only counters are merged.

Copies are found by sorting. Rows are ranged over (fingerprint, doc_id) and sorted in each range by fingerprint, whole text
and doc_id; a row whose text, byte by byte, is its predecessor's is a copy if its run began with a smaller doc_id. Bounds
hold no text, since Spark draws them from a sample that passes through the driver; doc_id spreads a text with most of the
rows over many ranges. A run that touches the first or last fingerprint of a range may go on in another range: its rows of
smallest doc_id stay open, and are settled by the smallest doc_id among all open rows of their text. There are as many
open runs as there are ranges, or twice as many; equal open rows are one row with a number.

Edge cases: null text is an empty one, null source the empty part; a row without doc_id has no order, so it fails no copy
test and makes no other row a copy; rows of one doc_id and text aren't copies of each other; several labels of a doc_id
count if any says 1; documents without label are in no lost column; texts are compared whole; only doc_id, text and source
are read, so other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, planned_bytes, settle, slices, text_column

LETTERS = "ABCDE"
COPY = 16
#: Bytes of a range, as planned from the size of the table.
RANGE_BYTES = 8 << 20
JUDGED = "doc_id long, part string, mask int, n long, print long, text binary"
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ODD = np.zeros(256, bool)
ODD[list(b"#$%&*|")] = True
LEAD = (np.arange(256) & 0xC0) != 0x80


def failures(texts: list[bytes], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits 1, 2, 4, 8 for filters A to D."""
    words = np.zeros((len(texts), 2), np.int64)
    for i, t in enumerate(texts):
        found = t.split()  # at the six blanks of ASCII
        words[i] = len(found), len(set(found))
    n, kinds = words.T
    return (n < 200) | (100 * kinds < 50 * n) << 1 | (100 * per_text(UPPER[data], off) > 2 * per_text(LEAD[data], off)) << 2 | (per_text(ODD[data], off) > 0) << 3


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "part", "mask", "n", "print", "text"])


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JUDGED rows of one sorted range (doc_id, text, part, print). Rows with text are open: whether they are copies
    depends on other ranges."""
    first = now = text = head = None  # fingerprints of the range's first and current rows; text and first doc_id of the run
    held: Counter = Counter()  # rows of the current fingerprint that are no copies here
    for b in slices(batches, most=1 << 20):
        data, off = text_column(b.column(1))
        raw = data.tobytes()
        texts = [raw[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        masks, out = failures(texts, data, off).tolist(), []
        for doc_id, part, mark, mask, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), masks, texts, strict=True):
            if mark != now:
                out += [(*row, n, now, whole if now == first else None) for (*row, whole), n in held.items()]
                first = mark if now is None else first
                now, text, held = mark, None, Counter()
            if t != text:
                text, head = t, doc_id
            if doc_id > head:
                out.append((doc_id, part, mask | COPY, 1, mark, None))
            else:
                held[doc_id, part, mask, text] += 1
        yield _batch(out)
    yield _batch([(*row, n, now, whole) for (*row, whole), n in held.items()])


def unordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JUDGED rows of documents without doc_id, which no order reaches."""
    for b in slices(batches, most=1 << 20):
        data, off = text_column(b.column(1))
        raw = data.tobytes()
        masks = failures([raw[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], data, off)
        yield _batch([(None, *row, n, None, None) for row, n in Counter(zip(b.column(2).to_pylist(), masks.tolist(), strict=True)).items()])


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits of A to E) and how many such rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.coalesce("source", F.lit("")).alias("part"), F.xxhash64(text).alias("print"))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), planned_bytes(docs) // RANGE_BYTES)
    dealt = rows.where("doc_id is not null").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, "print", "doc_id", "row").drop("row").sortWithinPartitions("print", "text", "doc_id")
    made = settle(dealt.mapInArrow(judged, JUDGED).unionByName(rows.where("doc_id is null").mapInArrow(unordered, JUDGED)), "masks")
    opened = made.where("text is not null")
    least = opened.groupBy("print", "text").agg(F.min("doc_id").alias("least"))
    late = F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask"))
    settled = opened.join(least, ["print", "text"]).select("doc_id", "part", late.alias("mask"), "n")
    return made.where("text is null").select("doc_id", "part", "mask", "n").unionByName(settled)


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of each part and mask, and those of them labelled good and toxic."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").drop("doc_id")
    unknown = rows.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    weighed = (F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))
    return known.unionByName(unknown).groupBy("part", "mask").agg(*weighed, F.sum("n").alias("n"))


def effects(docs: DataFrame) -> DataFrame:
    """What a row of each mask counts for at each step of each order: 32 masks, 120 orders and 5 steps."""
    orders = docs.sparkSession.createDataFrame([("".join(p),) for p in permutations(LETTERS)], "filter_order string")
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS))))).withColumn("bit", F.expr(f"shiftleft(1, instr('{LETTERS}', substr(filter_order, step, 1)) - 1)"))
    steps = steps.withColumn("before", F.expr(f"aggregate(sequence(1, 5), 0, (a, i) -> a + if(i < step, shiftleft(1, instr('{LETTERS}', substr(filter_order, i, 1)) - 1), 0))"))
    rows = steps.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(31))))
    # of all orders, a filter is the first of the k that a row fails in one k-th
    return rows.select(
        "mask", "filter_order", "step", F.expr("int(mask & (before | bit) = 0)").alias("kept_w"), F.expr("int(mask & bit <> 0 and mask & before = 0)").alias("removed_w"), F.expr("int(mask & bit <> 0 and mask & before <> 0)").alias("redundant_w"),
        F.expr("int(mask = bit)").alias("unique_w"), F.expr("if(mask & bit <> 0, 120 div bit_count(mask), 0)").alias("shapley_w"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order and step with its counts."""
    rows = counters(masks(docs), labels).join(F.broadcast(effects(docs)), "mask")  # 19,200 rows, whatever the table
    summed = [("n", "kept_w", "kept"), ("n", "removed_w", "removed"), ("n", "redundant_w", "redundant"), ("n", "unique_w", "unique_fails"), ("good", "removed_w", "good_lost"), ("toxic", "removed_w", "toxic_lost"), ("n", "shapley_w", "shapley")]
    return rows.groupBy("part", "filter_order", "step").agg(*(F.sum(F.col(n) * F.col(w)).alias(c) for n, w, c in summed))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
k AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM f p JOIN f q ON q.x <> p.x JOIN f r ON r.x NOT IN (p.x, q.x) JOIN f s ON s.x NOT IN (p.x, q.x, r.x) JOIN f u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
z AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i < step THEN 1 << (ascii(filter_order[i]) - 65) ELSE 0 END))::INT AS before FROM o, range(1, 6) s(step)),
g AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM k, z GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""
