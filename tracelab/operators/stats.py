"""Summaries of lanes: dispersion, distances, intervals, votes, confusion, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

Z = 1.959964
UNNAMED = ("DRIFT", "AMBIGUOUS-AT-TUPLE", "AMBIGUOUS-ACROSS-TUPLES", "other")


def named(code: Column, status: Column | None = None) -> Column:
    ok = code.isNotNull() & ~code.isin(*UNNAMED)
    return ok if status is None else ok & (status == "coded")


def dispersion(code: Column) -> Column:
    """(distinct - 1) / (n - 1), null for n <= 1."""
    return F.when(F.count(code) > 1, F.round((F.count_distinct(code) - 1) / (F.count(code) - 1), 3))


def distribution(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    n = df.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def total_variation(df: DataFrame, key: str, code: str, a: str, b: str) -> DataFrame:
    """Half the summed distance of two groups' distributions over the union of codes; null if either is empty."""
    d = distribution(df.where(F.col(key).isin(a, b)), [key], code)
    x, y = d.where(F.col(key) == a).select(code, F.col("p").alias("pa")), d.where(F.col(key) == b).select(code, F.col("p").alias("pb"))
    j = x.join(y, code, "full")
    tv = F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0)))) / 2
    return j.agg(F.when((F.count("pa") > 0) & (F.count("pb") > 0), F.round(tv, 6)).alias("tv"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval within [0, 1], null at n = 0."""
    p, z2 = k / n, Z * Z
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    ends = [(p + z2 / (2 * n) + s * half) / (1 + z2 / n) for s in (-1, 1)]
    return tuple(F.when(n > 0, F.round(F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0)), 6)) for e in ends)


def confusion(truth: Column, said: Column) -> dict[str, Column]:
    return {"tp": F.count_if(truth & said), "fp": F.count_if(~truth & said), "fn": F.count_if(truth & ~said), "tn": F.count_if(~truth & ~said), "right": F.count_if(truth == said)}


def majority(df: DataFrame, keys: list[str], vote: str, least: int = 3) -> DataFrame:
    """More than half of at least `least` votes."""
    g = df.groupBy(*keys).agg(F.count(vote).alias("n_votes"), F.sum(F.col(vote).cast("int")).cast("long").alias("yes")).where(F.col("n_votes") >= least)
    return g.withColumn("verdict", 2 * F.col("yes") > F.col("n_votes"))


def upper_median(x: str) -> Column:
    """The element of rank n // 2 of the sorted values, 0 if none: not an interpolated percentile."""
    items = F.array_sort(F.collect_list(x))
    return F.coalesce(F.get(items, F.floor(F.size(items) / 2).cast("int")), F.lit(0).cast("double"))


def convergence(df: DataFrame, key: str, tape: str) -> DataFrame:
    """Per task: runs, distinct tapes and the proposal."""
    g = df.groupBy(key).agg(F.count(tape).alias("n_ok"), F.count_distinct(tape).alias("n_tapes"), F.max(F.length(tape)).alias("_most"))
    p = F.when(F.col("n_ok") < 2, "INSUFFICIENT").when((F.col("n_tapes") == 1) & (F.col("_most") == 0), "CONVERGED-EMPTY").when(F.col("n_tapes") == 1, "CONVERGED").otherwise("DIVERGED")
    return g.withColumn("proposal", p).drop("_most")


def latest(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """The last row of each key: an append-only ledger as a dictionary."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, seq).alias("_r")).select(*keys, "_r.*")


def best_attempt(df: DataFrame, key: str, turn: str, reward: str, success: Column) -> DataFrame:
    """Highest reward among the turns up to the first success; the earliest of equals."""
    until = F.min(F.when(success, F.col(turn))).over(Window.partitionBy(key))
    kept = df.withColumn("_until", until).where(F.col("_until").isNull() | (F.col(turn) <= F.col("_until")))
    return kept.groupBy(key).agg(F.max_by(turn, F.struct(F.col(reward), -F.col(turn))).alias("best_turn"), F.max(reward).alias("best_reward"), F.count(F.lit(1)).alias("turns"))


def ordered_hash(h: str, order: str) -> Column:
    """sha256 of the hex digests joined in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, h))), lambda x: x[h]), ""), 256)


# ---------------------------------------------------------------- by rank, so that no group is gathered


def upper_medians(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """upper_median of each group as `med`: the row of rank n // 2 of those with a value."""
    rows = df.select(*group, F.col(x).cast("double").alias("_x"))
    sizes = rows.groupBy(*group).agg(F.floor(F.count("_x") / 2).alias("_at"))
    values = ranked(rows.where("_x is not null"), ["_x"], "_rank", tuple(group))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    found = sizes.alias("a").join(values.alias("b"), [*same, F.col("a._at") == F.col("b._rank")], "left")
    return found.select(*(F.col(f"a.{g}") for g in group), F.coalesce("b._x", F.lit(0.0)).alias("med"))


def tree_hash(df: DataFrame, group: list[str], order: list[str], h: str, fan: int = 256) -> DataFrame:
    """One digest of each group's ordered digests, `fan` of them hashed at a time, and those hashed again until one is
    left: like a hash of all of them joined, it changes with any row or order, but no row holds more than `fan`."""
    rows = ranked(df.select(*group, *order, F.col(h).alias("_h")), order, "_i", tuple(group)).select(*group, "_i", "_h")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.coalesce(F.max("_n"), F.lit(1))).first()[0]
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    rows = rows.alias("a").join(sizes.alias("b"), same).select("a.*", "_n", F.lit(True).alias("_more"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]), "")
    while most:
        up = F.floor(F.col("_i") / fan)
        rows = rows.groupBy(*group, up.alias("_up"), "_n", "_more").agg(F.when(F.col("_more"), F.sha2(joined, 256)).otherwise(F.max("_h")).alias("_h"))
        rows = rows.select(*group, F.col("_up").alias("_i"), "_h", F.ceil(F.col("_n") / fan).alias("_n")).withColumn("_more", F.col("_n") > 1)
        most = -(-most // fan) if most > fan else 0
    return rows.select(*group, F.col("_h").alias("digest"))


def prefix_hash(df: DataFrame, group: list[str], order: list[str], h: str, n: int) -> DataFrame:
    """sha256 of the first n digests of each group, joined in order."""
    rows = ranked(df.select(*group, *order, F.col(h).alias("_h")), order, "_i", tuple(group)).where(F.col("_i") < n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]), "")
    return rows.groupBy(*group).agg(F.sha2(joined, 256).alias("digest"))
