"""Exact top-k search by inner product: columnar branch-and-bound over dimension blocks.

Vectors are quantised to integers and laid out vertically, one row per dimension, dimensions in falling order of
energy. For a block of queries that lie near each other (dealt by the nearest of some rows) the partial products grow dimension block by dimension block; the norm of what is left of
both vectors bounds the rest (Cauchy-Schwarz). A candidate survives while, for some query of the block, partial + bound
reaches the k-th best exact score known so far; survivors are compacted after every dimension block. Sums of integers
are exact in doubles below 2**53; vectors whose norms could pass that are an error.

The stated query set meets all rows in blocks: queries and candidates are dealt into chunks, a task unit is a pair of
chunks, and each unit returns at most k rows per query, which a window then merges.

Rows without id, and vectors that are null, empty, or hold null or non-finite components take no part. A query is a
distinct pair of id and vector: a repeated query row asks once, and two vectors of one id ask separately, under the same
query_id. Rows with a query's own id aren't its candidates; all other rows are, repeated ones as often as they stand.
Vectors of another length than a query's take no part in its list; ties go to the smaller vec_id. Very long vectors cost
memory in proportion, `rows_a_chunk` of them a task. Only id and vector are read, so other columns can't clash; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


def quantised(column: Column, scale: float = 64.0) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def sound(column: Column) -> Column:
    return column.isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def branch_and_bound(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, width: int = 16, pivots: int = 32, shares: list[float] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, scores, candidate places) of the k best rows of each query, ties to the smaller id. Rows must be in
    rising order of id. shares gets the share of candidates that is left at each bound."""
    if np.sqrt((queries**2).sum(axis=1)).max(initial=0) * np.sqrt((rows**2).sum(axis=1)).max(initial=0) >= 2**53:
        raise ValueError("inner products of these vectors pass 2**53")
    near = (queries @ rows[:: max(1, len(rows) // pivots)][:pivots].T).argmax(axis=1)
    turn = np.argsort(near, kind="stable")
    queries, ids = queries[turn], ids[turn]
    order = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
    queries, tall = queries[:, order], np.ascontiguousarray(rows[:, order].T)  # tall: vertical layout
    cuts = [*range(0, tall.shape[0], width), tall.shape[0]]
    left_rows = [np.sqrt((tall[c:] ** 2).sum(axis=0)) for c in cuts]
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        live, partial = np.arange(tall.shape[1]), q[:, : cuts[1]] @ tall[: cuts[1]]
        partial[ids[at : at + len(q), None] == row_ids[None, :]] = -np.inf
        floor = np.full(len(q), -np.inf)
        for step in range(1, len(cuts) - 1):
            if len(live) > 4 * k:
                if step == 1:  # exact scores of the most promising ones
                    lead = np.argpartition(-partial, 2 * k, axis=1)[:, : 2 * k]
                    exact = np.einsum("qd,dqc->qc", q, tall[:, live[lead]])
                    exact[np.take_along_axis(partial, lead, 1) == -np.inf] = -np.inf
                    floor = np.partition(exact, -k, axis=1)[:, -k]
                rest = np.sqrt((q[:, cuts[step] :] ** 2).sum(axis=1))[:, None] * left_rows[step][live] * (1 + 1e-9) + 1e-6
                keep = (partial + rest >= floor[:, None]).any(axis=0)
                if shares is not None:
                    shares.append(float(keep.mean()) * len(live) / tall.shape[1])
                if keep.mean() < 0.9:
                    live, partial = live[keep], partial[:, keep]
            partial += q[:, cuts[step] : cuts[step + 1]] @ tall[cuts[step] : cuts[step + 1], live]
        for i in range(len(q)):
            found = partial[i]
            mine = np.flatnonzero(found >= max(floor[i], np.finfo(float).min))
            if len(mine) > k:
                mine = mine[found[mine] >= np.partition(found[mine], -k)[-k]]
            top = mine[np.lexsort((row_ids[live[mine]], -found[mine]))[:k]]
            yield int(turn[at + i]), found[top], live[top]


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, rows_a_chunk: int = 16_384, queries_a_chunk: int = 4_096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates."""
    sane = vectors.where(F.col(key).isNotNull() & sound(F.col(vector)))
    base = settle(sane.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    n, asking = base.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    across, down = max(1, -(-n // rows_a_chunk)), max(1, -(-asking // queries_a_chunk))
    deal = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40))  # repeated rows are dealt like one; a chunk of them is no longer than they are
    own = base.select("id", "v", F.pmod(deal, F.lit(across)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"))
    asks = base.where("asks").select("id", "v").distinct().select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"), F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(down)).cast("int").alias("r"))
    schema = "query_id long, asked binary, vec_id long, score long"

    def unit(q: pa.Table, c: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]
        asked: list[bytes] = []

        def by_size(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            ids, v = t.column("id").to_numpy(), t.column("v").combine_chunks()
            sizes, flat, start = v.value_lengths().to_numpy(), v.values.to_numpy().astype(float), v.offsets.to_numpy()
            out = {}
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                at = at[np.argsort(ids[at], kind="stable")]
                out[int(d)] = ids[at], flat[start[at][:, None] + np.arange(d)]
            return out

        if q.num_rows and c.num_rows:
            rows = by_size(c)
            for d, (ids, m) in by_size(q).items():
                if d in rows:
                    row_ids, r = rows[d]
                    for i, score, at in branch_and_bound(m, ids, r, row_ids, k):
                        parts.append([np.full(len(at), ids[i]), row_ids[at], score.astype(np.int64)])
                        asked += [hashlib.blake2b(m[i].tobytes(), digest_size=8).digest()] * len(at)
        query, row, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pa.table([pa.array(query), pa.array(asked, pa.binary()), pa.array(row), pa.array(score)], names=["query_id", "asked", "vec_id", "score"])

    found = asks.groupBy("r", "c").cogroup(own.groupBy("r", "c")).applyInArrow(unit, schema)
    best = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def search_embeddings(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)
