"""Ranks of a whole table, and a keyed permutation of them, without gathering rows or storing a map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settle


def ranked(df: DataFrame, by: list[str], into: str = "rank", groups: tuple[str, ...] = ()) -> DataFrame:
    """Rank from 0 in the order of `by` (in each group): rows are ranged and written, ranges counted, and each range
    starts where the counts of those before it end. Windows hold one range, or one row a range, however large a group."""
    spark = df.sparkSession
    keys = [*groups, *by]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range", *groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*by)) - 1
    own = ranged.withColumn("_inside", inside)
    same = [F.col("a._range") == F.col("b._range"), *(F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups)]
    return own.alias("a").join(sizes.alias("b"), same).select("a.*", (F.col("_before") + F.col("_inside")).cast("long").alias(into)).drop("_range", "_inside")


def _round(secret: str, i: int, x: Column) -> Column:
    return F.conv(F.left(F.md5(F.concat_ws("|", F.lit(secret), F.lit(i), x).cast("binary")), F.lit(8)), 16, 10).cast("long")


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: int, secret: str, rounds: int = 4, inverse: bool = False, walk: int = 40) -> Column:
    """A permutation of 0 to n - 1 by a Feistel network over the sides of a rectangle of n or a few more places: each
    round shifts one side by a keyed hash of the other. Places beyond n are walked on from; fewer than one in sqrt(n) are,
    so `walk` steps don't suffice only by a chance under 2 ** -walk, which is an error."""
    a, b = _sides(n)

    def once(s: Column) -> Column:
        sides = [F.floor(s / b).cast("long"), F.pmod(s, F.lit(b)).cast("long")]
        sizes = (a, b)
        for i in range(rounds)[:: -1 if inverse else 1]:
            side, other = i % 2, 1 - i % 2
            by = _round(secret, i, sides[other])
            sides[side] = F.pmod(sides[side] - by if inverse else sides[side] + by, F.lit(sizes[side]).cast("long"))
        return sides[0] * b + sides[1]

    end = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), F.struct(x.cast("long").alias("at"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(F.transform(F.array(once(s["at"])), lambda y: F.struct(y.alias("at"), (y < n).alias("done")))[0]))
    return F.when(end["done"], end["at"]).otherwise(F.raise_error(F.lit("the permutation walked too far")).cast("long"))


def fingerprint(df: DataFrame, cell: list[str], columns: list[str]) -> DataFrame:
    """Rows and an order-free fingerprint of each cell's multiset of rows: the sum of 60 bits of each row's MD5, exact in
    decimals, so that a row more, less or changed shows and the order doesn't."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns))
    number = F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum(number).cast("string").alias("fingerprint"))


def same_runs(first: DataFrame, second: DataFrame, cell: list[str]) -> DataFrame:
    """Cells of two runs' fingerprints, and whether they are identical."""
    j = first.join(second.select(*cell, F.col("n").alias("n_again"), F.col("fingerprint").alias("again")), cell, "full")
    return j.select(*cell, "n", "n_again", "fingerprint", (F.col("n").eqNullSafe(F.col("n_again")) & F.col("fingerprint").eqNullSafe(F.col("again"))).alias("identical"))
