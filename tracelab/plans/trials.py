"""Queries over trials: exact tests, determinism, ordered dedup, tolerant parsing, splits and blinded packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tolerant
from ..operators import bars, dedup, exact, ranks
from ..sources import sinks
from ..sources.tables import event_ticks, table, verdicts
from ..streaming import ledger, sessions, streams
from .catalogue import VERD, query

# ---------------------------------------------------------------- streams

_IDLE = "INTERVAL '12 hours'"


@query("stream_trajectories", f"""WITH e AS (SELECT user_id, ts, event_id, value, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' ELSE 'turn' END AS kind FROM events),
s AS (SELECT *, sum((kind = 'start')::INT) OVER w AS seg, ts > lag(ts) OVER w + {_IDLE} AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, coalesce(sum((kind = 'complete' OR (gap AND kind <> 'start'))::INT) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s WHERE seg > 0),
g AS (SELECT user_id, seg, min(ts) FILTER (WHERE kind = 'start') AS started, max(ts) FILTER (WHERE over = 0 AND (NOT coalesce(gap, false) OR kind = 'start')) AS ended, count(*) FILTER (WHERE over = 0 AND kind <> 'start' AND NOT coalesce(gap, false)) AS n_turns,
    max(value) FILTER (WHERE over = 0 AND kind <> 'start' AND NOT coalesce(gap, false)) AS best, bool_or(over = 0 AND kind = 'complete' AND NOT coalesce(gap, false)) AS complete, bool_or(over = 0 AND gap AND kind <> 'start') AS idle FROM f GROUP BY 1, 2),
n AS (SELECT *, lead(started) OVER (PARTITION BY user_id ORDER BY seg) AS next, (SELECT max(ts) FROM events) - INTERVAL '1 hour' AS mark FROM g),
c AS (SELECT *, CASE WHEN complete THEN 'complete' WHEN idle OR next > ended + {_IDLE} OR (next IS NULL AND ended + {_IDLE} < mark) THEN 'expired' WHEN next IS NOT NULL THEN 'restart' END AS closed FROM n)
SELECT user_id AS session, started, ended, n_turns, best, closed FROM c WHERE closed IS NOT NULL""")
def _(s, d):
    return sessions.trajectories(s, d).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("stream_exactly_once", "SELECT DISTINCT user_id, event_type AS symbol, CAST(ts AS DATE) AS day FROM events")
def _(s, d):
    root = sinks.scratch(s, "once")
    ledger.run(ledger.once_a_day(streams.events(s, d)), root)
    return ledger.read(s, root, "user_id long, symbol string, day date")


# ---------------------------------------------------------------- ordered dedup by either of two keys


@query("first_by_name_or_params", """WITH RECURSIVE o AS (SELECT min(o_orderkey) AS k, o_custkey AS n, o_orderdate AS p FROM orders GROUP BY 2, 3),
r AS (SELECT k, n, p, 'open' AS st FROM o UNION ALL
  (SELECT k, n, p, CASE WHEN first THEN 'kept' WHEN hit THEN 'gone' ELSE 'open' END FROM (
    SELECT *, bool_or(first) OVER (PARTITION BY n) OR bool_or(first) OVER (PARTITION BY p) AS hit FROM (
      SELECT k, n, p, k = min(k) OVER (PARTITION BY n) AND k = min(k) OVER (PARTITION BY p) AS first FROM r WHERE st = 'open'))))
SELECT k AS o_orderkey, n AS o_custkey, p AS o_orderdate FROM r WHERE st = 'kept'""")
def _(s, d):
    return dedup.first_by_either(table(s, d, "orders"), ["o_orderkey"], ["o_custkey"], ["o_orderdate"])


# ---------------------------------------------------------------- exact tests

_TAIL = "(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM range({a}, {b}) t(i))"
_GE = lambda p: _TAIL.format(p=p, a="CAST(k AS BIGINT)", b="CAST(n AS BIGINT) + 1")
_LE = lambda p: _TAIL.format(p=p, a="0", b="CAST(k AS BIGINT) + 1")


@query("exact_agreement", f"""WITH {VERD}, g AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE truth = judge) AS DOUBLE) AS k, CAST(count(*) FILTER (WHERE truth AND judge) AS DOUBLE) AS yy, CAST(count(*) FILTER (WHERE truth AND NOT judge) AS DOUBLE) AS yn, CAST(count(*) FILTER (WHERE NOT truth AND judge) AS DOUBLE) AS ny, CAST(count(*) FILTER (WHERE NOT truth AND NOT judge) AS DOUBLE) AS nn FROM v GROUP BY 1),
t AS (SELECT *, {_GE('0.7')} AS up, {_LE('0.7')} AS down, {_GE('0.6')} AS low, {_LE('0.8')} AS high, ((yy + yn) * (yy + ny) + (nn + yn) * (nn + ny)) / (n * n) AS chance FROM g)
SELECT lang, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS agree, round(up, 9) AS p_upper, round(down, 9) AS p_lower, round(least(1, 2 * least(up, down)), 9) AS p_two_sided, round(greatest(low, high), 9) AS p_equivalent,
  CASE WHEN chance < 1 THEN round((k / n - chance) / (1 - chance), 9) END AS kappa, round(2 * k / n - 1, 9) AS pabak FROM t""")
def _(s, d):
    v = verdicts(s, d).select("lang", "truth", "judge")
    said = {"yy": F.col("truth") & F.col("judge"), "yn": F.col("truth") & ~F.col("judge"), "ny": ~F.col("truth") & F.col("judge"), "nn": ~F.col("truth") & ~F.col("judge")}
    g = v.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in said.items())).withColumn("agree", F.col("yy") + F.col("nn"))
    k, n, at = F.col("agree"), F.col("n"), F.lit(0.7)
    made = {"p_upper": exact.at_least(k, n, at), "p_lower": exact.at_most(k, n, at), "p_two_sided": exact.two_sided(k, n, at), "p_equivalent": exact.equivalence(k, n, 0.7, 0.1), "kappa": exact.kappa(*(F.col(c) for c in ("yy", "yn", "ny", "nn"))), "pabak": exact.pabak(k, n)}
    return g.select("lang", "n", "agree", *(F.round(c, 9).alias(name) for name, c in made.items()))


# ---------------------------------------------------------------- tolerant JSON

_RAW_PROPS = "raw AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN left(props, length(props) - 1) WHEN 2 THEN '{\"a\": ' || props || '}' WHEN 3 THEN NULL WHEN 4 THEN '[' || props || ']' ELSE '{\"k\": null, \"a\": {\"k\": \"seven\"}}' END AS t FROM events)"


@query("tolerant_json", f"""WITH {_RAW_PROPS}, j AS (SELECT event_id, t, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM raw)
SELECT event_id, coalesce(TRY_CAST(j->>'$.k' AS BIGINT), -1) AS k, coalesce(TRY_CAST(j->>'$.a.k' AS BIGINT), -1) AS nested_k, coalesce(TRY_CAST(j->>'$[0].k' AS BIGINT), -1) AS first_k, CASE WHEN t IS NULL THEN 'no text' WHEN j IS NULL THEN 'not JSON: ' || left(t, 300) END AS error FROM j""")
def _(s, d):
    e, props = table(s, d, "events"), F.col("props")
    shape = F.col("event_id") % 6
    raw = F.when(shape == 0, props).when(shape == 1, F.left(props, F.length(props) - 1)).when(shape == 2, F.concat(F.lit('{"a": '), props, F.lit("}"))).when(shape == 3, None).when(shape == 4, F.concat(F.lit("["), props, F.lit("]"))).otherwise('{"k": null, "a": {"k": "seven"}}')
    t = F.col("t")
    return e.select("event_id", raw.alias("t")).select("event_id", tolerant.nested(t, "$.k", "bigint", -1).alias("k"), tolerant.nested(t, "$.a.k", "bigint", -1).alias("nested_k"), tolerant.nested(t, "$[0].k", "bigint", -1).alias("first_k"), tolerant.parse_error(t).alias("error"))


# ---------------------------------------------------------------- session bars

_SUNDAY = "make_date(year(ts), {m}, 1) + CAST((7 - dayofweek(make_date(year(ts), {m}, 1))) % 7 + {w} AS INTEGER)"


@query("session_bars", f"""WITH z AS (SELECT *, ts - CASE WHEN ts >= {_SUNDAY.format(m=3, w=7)} + INTERVAL '7 hours' AND ts < {_SUNDAY.format(m=11, w=0)} + INTERVAL '6 hours' THEN INTERVAL '4 hours' ELSE INTERVAL '5 hours' END AS l FROM events),
b AS (SELECT *, time_bucket(INTERVAL '5 minutes', l) + INTERVAL '5 minutes' AS bar_end, max(l) OVER () AS seen FROM z)
SELECT event_type AS symbol, bar_end, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM b WHERE dayofweek(l) BETWEEN 1 AND 5 AND CAST(l AS TIME) >= TIME '09:30:00' AND CAST(l AS TIME) < TIME '16:00:00' AND bar_end <= seen GROUP BY 1, 2""")
def _(s, d):
    return bars.session(event_ticks(s, d)).withColumn("bar_end", F.col("bar_end").cast("timestamp_ntz"))


# ---------------------------------------------------------------- writes


@query("split_written", "SELECT CASE WHEN n_chars < 200 THEN 'quarantine' ELSE 'keep' END AS side, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    return sinks.split(table(s, d, "documents"), F.col("n_chars") < 200, sinks.scratch(s, "split"), "short", apply=True)


_SIDE = "CAST(('0x' || left(md5('seed|{i}|' || {x}), 8)) AS BIGINT)"


@query("blinded_packets", f"""WITH RECURSIVE c AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS rank, count(*) OVER () AS n FROM customer),
k AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM c), s AS (SELECT *, (n + a - 1) // a AS b FROM k),
w AS (SELECT c_custkey, c_mktsegment, n, a, b, rank, rank AS x, false AS done FROM s UNION ALL
  (SELECT c_custkey, c_mktsegment, n, a, b, rank, y, y < n FROM (SELECT *, l2 * b + (r1 + {_SIDE.format(i=3, x='l2')}) % b AS y FROM (SELECT *, (l1 + {_SIDE.format(i=2, x='r1')}) % a AS l2 FROM (SELECT *, (r0 + {_SIDE.format(i=1, x='l1')}) % b AS r1 FROM (SELECT *, x % b AS r0, (x // b + {_SIDE.format(i=0, x='x % b')}) % a AS l1 FROM w WHERE NOT done))))))
SELECT x AS blind, c_mktsegment, c_custkey, rank, rank AS back FROM w WHERE done""")
def _(s, d):
    c = sinks.settle(ranks.ranked(table(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]), "ranked")
    n, path = c.count(), sinks.scratch(s, "packets")
    sinks.blinded_packets(c.withColumn("blind", ranks.permuted(F.col("rank"), n, "seed")), path, "blind", ["c_custkey", "rank"])
    packets = s.read.schema("blind long, c_mktsegment string").json(f"{path}/packets")
    index = s.read.schema("blind long, c_custkey long, rank long").json(f"{path}/index")
    return packets.select("blind", "c_mktsegment").join(index, "blind").withColumn("back", ranks.permuted(F.col("blind"), n, "seed", inverse=True))


# ---------------------------------------------------------------- determinism

_LINE = "concat_ws('|', l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT), CAST(l_shipdate AS DATE))"


@query("determinism", f"SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) AS n_again, CAST(sum(CAST(('0x' || left(md5({_LINE}), 15)) AS HUGEINT)) AS VARCHAR) AS fingerprint, true AS identical FROM lineitem GROUP BY 1, 2")
def _(s, d):
    def run(parts: int, name: str):
        rows = table(s, d, "lineitem").repartition(parts, "l_partkey").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"), F.to_date("l_shipdate").alias("day"))
        return ranks.fingerprint(sinks.settle(rows, name), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "qty", "day"])

    return ranks.same_runs(run(8, "first"), run(13, "second"), ["l_returnflag", "l_linestatus"])


# ---------------------------------------------------------------- table function


@query("word_windows", """WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents), i AS (SELECT doc_id, ws, unnest(range(0, greatest(1, CAST(ceil((len(ws) - 50) / 25.0) AS BIGINT) + 1))) AS n FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(25 * n AS INTEGER) AS first_word, CAST(least(50, len(ws) - 25 * n) AS INTEGER) AS n_words, md5(array_to_string(ws[25 * n + 1 : 25 * n + 50], ' ')) AS h FROM i""")
def _(s, d):
    tolerant.register(s)
    return s.sql("SELECT doc_id, w.n, w.first_word, w.n_words, md5(CAST(w.window AS BINARY)) AS h FROM {docs} AS d, LATERAL word_windows(d.text, 50, 25) AS w", docs=table(s, d, "documents"))
