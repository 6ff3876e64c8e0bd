"""Linear recurrences over long series: y[i] = a[i] * y[i - 1] + b[i], with y[-1] = 0.

Steps are affine maps, and maps compose, so a series is cut into chunks of consecutive ranks: each chunk composes its own
steps by doubling (vectors, no loop a row), the chunks' maps are a series of their own, scanned in the same way, and each
row then applies its chunk's map to what the chunk before ended with. No task holds more than a chunk, and two levels reach
chunk ** 2 rows of one series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps from before the first step to after each one."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]  # the right side is made before anything is written
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def scanned(df: DataFrame, group: list[str], rank: str, steps: dict[str, tuple[Column, Column]], longest: int, chunk: int = CHUNK) -> DataFrame:
    """df with a column of results for each name in steps; rank: 0, 1, 2 ... in each group, up to `longest`."""
    names, part = list(steps), f"_chunk_{rank}"
    rows = df.withColumns({f"_{x}{n}": c.cast("double") for n, pair in steps.items() for x, c in zip("ab", pair, strict=True)}).withColumn(part, F.floor(F.col(rank) / chunk))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(rank)
        for n in names:
            pair = composed(*(t.column(f"_{x}{n}").to_numpy(zero_copy_only=False) for x in "ab"))
            for x, v in zip("ab", pair, strict=True):
                t = t.set_column(t.schema.get_field_index(f"_{x}{n}"), f"_{x}{n}", pa.array(v))
        return t

    made = rows.groupBy(*group, part).applyInArrow(run, rows.schema)
    if longest < chunk:  # one chunk each
        return made.select(*df.columns, *(F.col(f"_b{n}").alias(n) for n in names))
    ends = made.groupBy(*group, part).agg(*(F.max_by(f"_{x}{n}", rank).alias(f"_{x}{n}") for n in names for x in "ab"))
    carried = scanned(ends, group, part, {f"_c{n}": (F.col(f"_a{n}"), F.col(f"_b{n}")) for n in names}, longest // chunk, chunk)
    carried = carried.select(*group, (F.col(part) + 1).alias(part), *(f"_c{n}" for n in names))
    same = [*(F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group), F.col(f"a.{part}") == F.col(f"b.{part}")]
    both = made.alias("a").join(carried.alias("b"), same, "left")
    return both.select(*(F.col(f"a.{c}") for c in df.columns), *((F.col(f"a._a{n}") * F.coalesce(F.col(f"b._c{n}"), F.lit(0.0)) + F.col(f"a._b{n}")).alias(n) for n in names))
