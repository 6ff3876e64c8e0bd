"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the sorted set of sources they belong to).
2. On the driver small networks route words from patterns to source quotas: each pattern offers its words once at
   cost 0, a second time at a higher cost and so on (convex repetition costs), so no document is repeated before all
   documents that could serve the same quota have been used once. Sources that no pattern joins, directly or by way of
   others, are networks of their own; a source alone needs no search, its flow is the lesser of quota and laps. Patterns
   are aggregates, not documents: up to `max_patterns` rows reach the driver, and up to `max_joined` patterns are routed
   in one network (about 5 s of the driver at 800); more raise an error.
3. Documents of a pattern are laid on a line in seeded order, one lap per repetition; a source takes an interval of
   that line. A document's share is the overlap of its laps with the interval, found from prefix sums that are
   computed per hash bucket (no task ever orders a whole pattern).

Edge cases: null text has size 0; a null source is a source of its own, last in order; rows without id, and rows of one
id with different texts, are documents of their own; repeated rows are separate documents, one behind the other; a very
long text is one document, of which a mix may take a part; an empty table gives an empty result; sources without words
get target 0. Only the columns named are read; with `carry` the
others travel in a struct, so no name can clash.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import planned_bytes, settle, word_count


def code_point_order(sources: set) -> list:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def water_fill(sizes: dict, weights: dict, total: int, most: int = 3) -> dict:
    """Targets that share `total` by weight, none above `most` times its source's size; the excess is shared again."""
    target, free, left = {}, set(sizes), Fraction(total)
    while free:
        scale = left / sum(Fraction(weights[s]) for s in free)
        over = {s for s in free if scale * Fraction(weights[s]) > most * sizes[s]}
        if not over:
            return target | {s: scale * Fraction(weights[s]) for s in free}
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, costs: list[int]) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources: maximal, then cheapest (successive shortest paths)."""
    names: dict = {"from": 0, "to": 1}
    graph: list[list[list[int]]] = [[], []]

    def node(key) -> int:
        if key not in names:
            names[key] = len(graph)
            graph.append([])
        return names[key]

    def arc(u: int, v: int, room: int, cost: int) -> list[int]:
        there, back = [v, room, cost, len(graph[v])], [u, 0, -cost, len(graph[u])]
        graph[u].append(there)
        graph[v].append(back)
        return there

    routed = {}
    for pattern, words in patterns.items():
        for cost in costs:
            arc(0, node(("p", pattern)), words, cost)
        for s in pattern:
            routed[pattern, s] = arc(node(("p", pattern)), node(("s", s)), words * len(costs), 0)
    for s, quota in quotas.items():
        arc(node(("s", s)), 1, quota, 0)
    height = [0] * len(graph)
    while True:
        far: list[float] = [float("inf")] * len(graph)
        far[0], came, queue = 0, {}, [(0, 0)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for k, (v, room, cost, _) in enumerate(graph[u]):
                if room and (e := d + cost + height[u] - height[v]) < far[v]:
                    far[v], came[v] = e, (u, k)
                    heapq.heappush(queue, (e, v))
        if 1 not in came:
            break
        height = [h + (int(d) if d < float("inf") else 0) for h, d in zip(height, far, strict=True)]
        path, v = [], 1
        while v:
            u, k = came[v]
            path.append(graph[u][k])
            v = u
        push = min(x[1] for x in path)
        for x in path:
            x[1] -= push
            graph[x[0]][x[3]][1] += push
    flow: dict[tuple, dict] = {}
    for (pattern, s), x in routed.items():
        flow.setdefault(pattern, {})[s] = patterns[pattern] * len(costs) - x[1]
    return flow


def route(patterns: dict[tuple, int], quotas: dict, costs: list[int], max_joined: int) -> dict[tuple, dict]:
    """min_cost_flow of all patterns, network by network."""
    up = {s: s for s in quotas}

    def root(s):
        while up[s] != s:
            up[s] = up[up[s]]
            s = up[s]
        return s

    for pattern in patterns:
        for s in pattern[1:]:
            up[root(s)] = root(pattern[0])
    networks: dict = {}
    for pattern, words in patterns.items():
        networks.setdefault(root(pattern[0]) if pattern else (), {})[pattern] = words
    flow: dict[tuple, dict] = {}
    for own in networks.values():
        if len(own) > max_joined:
            raise ValueError(f"more than {max_joined} patterns in one network")
        if len(own) == 1 and len(next(iter(own))) == 1:
            ((pattern, words),) = own.items()
            flow[pattern] = {pattern[0]: min(words * len(costs), quotas[pattern[0]])}
        else:
            flow |= min_cost_flow(own, {s: quotas[s] for s in sorted({s for p in own for s in p}, key=lambda s: (s is None, s or ""))}, costs)
    return flow


def mix(
    docs: DataFrame, sources: Column, size: Column, weights: Callable[[list], dict], key: str = "doc_id", passes: int = 3,
    costs: list[int] | None = None, seed: int = 17, max_patterns: int = 1_000_000, max_joined: int = 1_000, carry: bool = False,
) -> DataFrame:
    """One row per document: key, size, taken (words of all laps), copies (whole laps, the last one rounded) and taken_by
    (by source: words, the source's size and target). With carry, row (a struct of the columns of docs) and copies."""
    names = [f"_mix_c{i}" for i in range(len(docs.columns))] if carry else []
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=False)]
    measured = docs.select(F.col(f"`{key}`").alias("_key"), F.to_json(F.array_sort(F.array_distinct(sources))).alias("_pattern"), size.alias("size"), *kept)
    h = F.xxhash64(F.lit(seed), F.col("_key"))
    # about 30,000 documents a bucket and pattern at most, from the planned size
    bits = min(24, max(12, (planned_bytes(docs) >> 25).bit_length()))
    base = settle(measured.select("_key", "_pattern", "size"), "mix-base")
    stats = base.groupBy("_pattern").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(stats) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(json.loads(r["_pattern"])): r["words"] for r in stats}
    sizes: dict = {}
    for pattern, words in patterns.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + words
    order = code_point_order(set(sizes))
    target = water_fill(sizes, weights(order), sum(patterns.values()), passes)
    flow = route(patterns, {s: round(target[s]) for s in order}, costs or [k * k for k in range(passes)], max_joined)
    shares = []
    for r in stats:
        pattern, at, parts = tuple(json.loads(r["_pattern"])), 0, []
        for s in code_point_order(set(pattern)):
            parts.append((s, at, at + flow[pattern][s], sizes[s], float(target[s])))
            at += flow[pattern][s]
        shares.append((r["_pattern"], r["words"], parts))
    kind = "_pattern string, _words long, _parts array<struct<source:string,lo:long,hi:long,source_size:long,target:double>>"
    plan = base.sparkSession.createDataFrame(shares, kind)
    place = {"_h": h, "_bucket": F.shiftrightunsigned(h, 64 - bits)}
    buckets = base.withColumns(place).groupBy("_pattern", "_bucket").agg(F.sum("size").alias("_in"))
    ahead = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_pattern", "_bucket", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_before"))
    tie = [F.xxhash64(*names)] if carry else []
    inside = Window.partitionBy("_pattern", "_bucket").orderBy("_h", "_key", "size", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (measured if carry else base).withColumns(place)
    lined = placed.withColumn("_in", F.sum("size").over(inside) - F.col("size")).join(buckets, ["_pattern", "_bucket"])
    # the plan has a row per membership pattern: broadcast where there are few
    lined = lined.withColumn("_at", F.col("_before") + F.col("_in")).join(F.broadcast(plan) if len(shares) <= 10_000 else plan, "_pattern")

    def overlap(part: Column) -> Column:
        laps = [F.greatest(F.lit(0), F.least(F.col("_at") + j * F.col("_words") + F.col("size"), part["hi"]) - F.greatest(F.col("_at") + j * F.col("_words"), part["lo"])) for j in range(passes)]
        return sum(laps[1:], laps[0]).cast("long")

    taken_by = F.transform("_parts", lambda p: F.struct(p["source"].alias("source"), overlap(p).alias("words"), p["source_size"].alias("source_size"), p["target"].alias("target")))
    taken = F.aggregate("taken_by", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    out = lined.withColumn("taken_by", taken_by).withColumn("taken", taken)
    if carry:
        return out.select(F.struct(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True))).alias("row"), copies.alias("copies"))
    return out.select(F.col("_key").alias(key), "size", "taken", copies.alias("copies"), "taken_by")


def cycle_weights(order: list) -> dict:
    """Sources in code-point order, null last, weigh 5, 2, 1, repeating."""
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}


def mix_documents(docs: DataFrame) -> DataFrame:
    mixed = mix(docs, F.array("source"), word_count(F.col("text")), cycle_weights)
    own = F.element_at("taken_by", 1)
    return mixed.select("doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"), "taken", "copies")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix of mix_documents takes it, the last lap rounded."""
    mixed = mix(docs, F.array("source"), word_count(F.col("text")), cycle_weights, carry=True)
    again = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")))
    return mixed.select("row", again.alias("lap")).select("row.*")
