"""First come, first kept, over two keys: a row stays if no kept row before it has its name or its parameters.

A dropped row registers neither key, so whether a row stays depends on rows before it, on those before them, and so on.
Rows are decided in rounds instead of one by one: a row that comes first among the undecided ones of both its keys is sure
to stay, and all others with one of its keys are sure to go. Rounds end when nothing is undecided; a long chain of rows
that wait for each other takes many, so what is left after some rounds is folded in order in one task once it is at most
fold_rows rows (a bound on that task; longer rests go on in rounds).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import settle


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, params = set(), set()
    for b in batches:
        keep = []
        for n, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            first = n not in names and p not in params
            if first:
                names.add(n)
                params.add(p)
            keep.append(first)
        yield b.filter(pa.array(keep, pa.bool_()))


def first_by_either(df: DataFrame, order: list[str], name: list[str], params: list[str], rounds: int = 6, fold_rows: int = 200_000) -> DataFrame:
    """order, name and params of the rows that stay. Equal orders are settled by name, then params; nulls are values like
    any other; equal rows are one."""
    # keys as text, since rows of nulls equal each other there
    key = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    rows = df.select(F.struct(*order, *name, *params).alias("row"), key(name).alias("name"), key(params).alias("params"))
    left = settle(rows.groupBy("name", "params").agg(F.min("row").alias("row")).select("row", "name", "params"), "open")
    kept: list[DataFrame] = []
    for n in range(1_000_000):
        count = left.count()
        if not count:
            break
        if n >= rounds and count <= fold_rows:
            kept.append(left.coalesce(1).sortWithinPartitions("row").mapInArrow(_fold, left.schema))
            break
        firsts = left
        for k in ("name", "params"):
            firsts = firsts.join(left.groupBy(k).agg(F.min("row").alias("row")), [k, "row"], "left_semi")
        kept.append(settle(firsts.select("row", "name", "params"), "kept"))
        left = settle(left.join(kept[-1].select("name"), "name", "left_anti").join(kept[-1].select("params"), "params", "left_anti").select("row", "name", "params"), "open")
    return reduce(DataFrame.unionByName, kept).select("row.*") if kept else left.select("row.*")
