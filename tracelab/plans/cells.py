"""Queries over cells of a design, and rows instead of gathered groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cells, ranks, stats, tape
from ..sources.tables import draws, fills, table, verdicts
from .catalogue import DRAWS, FILLS, VERD, query

# ---------------------------------------------------------------- classes and gates

_BANKS = sorted(cells.CLASSES)
_NAMED = [(b, r) for b in _BANKS for r in sorted(cells.CLASSES[b][0])]
_REG = ", ".join(f"('{b}', '{r}', '{c}', {order.index(c) + 1 if c in order else 'NULL'}, {str(c in gone).lower()})" for b, (cores, order, gone) in cells.CLASSES.items() for r, c in cores.items())
_PICK = ", ".join(f"({i}, '{b}', '{r}')" for i, (b, r) in enumerate(_NAMED))


@query("class_names", f"""WITH reg(bank, resolution, core, rank, absorbed) AS (VALUES {_REG}), pick(i, bank, resolution) AS (VALUES {_PICK}),
m AS (SELECT DISTINCT o_custkey AS cell, bank, CASE WHEN o_orderkey % 97 = 0 THEN 'unheard_of' ELSE resolution END AS resolution FROM orders JOIN pick ON i = o_orderkey * 7 % {len(_NAMED)} UNION SELECT DISTINCT o_custkey, 'NONE', o_orderpriority FROM orders WHERE o_orderkey % 5 = 0),
j AS (SELECT m.*, coalesce(core, m.resolution) AS c, rank, coalesce(absorbed, false) AS absorbed, m.bank IN (SELECT bank FROM reg) AS known FROM m LEFT JOIN reg ON reg.bank = m.bank AND reg.resolution = m.resolution)
SELECT cell, bank, CASE WHEN bool_or(known) THEN coalesce(arg_min(c, absorbed::INT * 100 + rank), string_agg(DISTINCT c, '+' ORDER BY c)) ELSE string_agg(DISTINCT c, '+' ORDER BY c) END AS label FROM j GROUP BY 1, 2""")
def _(s, d):
    o = table(s, d, "orders")
    pick = s.createDataFrame([(i, b, r) for i, (b, r) in enumerate(_NAMED)], "i int, bank string, resolution string")
    found = o.withColumn("i", F.col("o_orderkey") * 7 % len(_NAMED)).join(pick, "i").select(F.col("o_custkey").alias("cell"), "bank", F.when(F.col("o_orderkey") % 97 == 0, "unheard_of").otherwise(F.col("resolution")).alias("resolution"))
    other = o.where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("cell"), F.lit("NONE").alias("bank"), F.col("o_orderpriority").alias("resolution"))
    return cells.class_names(found.unionByName(other), cells.registry(s), ["cell"])


@query("gate_verdict", f"""WITH {DRAWS}, t AS (SELECT nation, prompt, count(DISTINCT code) AS k, count(*) AS n, count(*) FILTER (WHERE numeric < 2000) AS bad, count(DISTINCT model) AS res FROM dr WHERE nation <> 3 OR model = 'BUILDING' GROUP BY 1, 2)
SELECT nation, CAST(sum(n) AS BIGINT) AS runs, CAST(sum(n) + (nation % 4 = 1)::INT AS BIGINT) AS expected, CAST(sum(bad) AS BIGINT) AS incomplete, min(k) AS floor,
  CASE WHEN max(res) = 1 THEN 'N/A' WHEN sum(bad) = 0 AND min(k) >= 2 AND nation % 4 <> 1 THEN 'PASS' WHEN nation % 4 = 1 THEN 'INCOMPLETE' ELSE 'FAIL' END AS gate FROM t GROUP BY nation""")
def _(s, d):
    rows = draws(s, d).where("nation <> 3 or model = 'BUILDING'")
    t = rows.groupBy("nation", "prompt").agg(F.count_distinct("code").alias("k"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("numeric") < 2000).alias("bad"), F.count_distinct("model").alias("res"))
    g = t.groupBy("nation").agg(F.sum("n").alias("runs"), F.sum("bad").alias("incomplete"), F.min("k").alias("floor"), F.max("res").alias("res"))
    g = g.withColumn("expected", F.col("runs") + (F.col("nation") % 4 == 1).cast("long"))
    return g.select("nation", "runs", "expected", "incomplete", "floor", cells.gate(*(F.col(c) for c in ("runs", "expected", "incomplete", "floor", "res"))).alias("gate"))


@query("pooled_cells", """WITH t AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'P') AS have, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderdate = last) AS have_today, CAST(CASE WHEN o_custkey % 2 = 0 THEN 12 ELSE 8 END AS BIGINT) AS want FROM orders, (SELECT max(o_orderdate) AS last FROM orders) GROUP BY o_custkey)
SELECT *, CASE WHEN have < want THEN have_today + want - have END AS ask_for FROM t""")
def _(s, d):
    o = table(s, d, "orders")
    last = o.agg(F.max("o_orderdate")).scalar()
    return cells.pooled(o, ["o_custkey"], F.col("o_orderdate"), last, F.col("o_orderstatus") != "P", F.when(F.col("o_custkey") % 2 == 0, 12).otherwise(8))


# ---------------------------------------------------------------- texts


@query("repeated_line", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, line, count(*) AS n, min(pos) AS pos FROM l WHERE NOT regexp_full_match(line, '[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*') GROUP BY 1, 2),
b AS (SELECT doc_id, arg_max(left(line, 80), n * 100000000 - pos) AS line, max(n) AS n FROM c GROUP BY 1)
SELECT doc_id, coalesce(line, '') AS line, coalesce(n, 0) AS n, coalesce(n > 15, false) AS loops FROM documents LEFT JOIN b USING (doc_id)""")
def _(s, d):
    return cells.repeated_line(table(s, d, "documents"), "doc_id", "text")


_SHAPED = "CASE doc_id % 8 WHEN 0 THEN text || chr(10) WHEN 1 THEN replace(text, '. ', ';' || chr(10) || chr(10)) WHEN 2 THEN replace(text, ' of ', '  of ') WHEN 3 THEN text || chr(10) || ' - ' || chr(10) WHEN 4 THEN replace(text, ' the ', chr(9) || 'the ') WHEN 5 THEN replace(text, '.' || chr(10), '.' || chr(13) || chr(10)) WHEN 6 THEN replace(text, '.' || chr(10), chr(10) || chr(10) || chr(10) || '. ') ELSE text || ',' END"


@query("surface_faults", rf"""WITH t AS (SELECT doc_id, {_SHAPED} AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT suffix(t, chr(10)) THEN 'missing final newline' END, CASE WHEN contains(t, chr(13)) THEN 'carriage return' END, CASE WHEN contains(t, chr(9)) THEN 'tab' END, CASE WHEN contains(t, chr(10) || chr(10) || chr(10)) THEN 'triple blank line' END, CASE WHEN contains(t, '  ') THEN 'doubled space' END,
  CASE WHEN regexp_matches(t, '(?m)^[\s\x0B]*(?:[-*+]|\d+[.)])[\s\x0B]*$') THEN 'orphan list marker' END, CASE WHEN regexp_matches(t, '[,;:][\s\x0B]*(?:\n\n|\z)') THEN 'dangling punctuation' END, CASE WHEN regexp_matches(t, '(?m)^[\s\x0B]*[.,;:!?]') THEN 'leading punctuation' END], lambda x: x IS NOT NULL), ',') AS faults FROM t""")
def _(s, d):
    t, k = F.col("text"), F.col("doc_id") % 8
    swap = lambda a, b: F.replace(t, F.lit(a), F.lit(b))
    shaped = F.when(k == 0, F.concat(t, F.lit("\n"))).when(k == 1, swap(". ", ";\n\n")).when(k == 2, swap(" of ", "  of ")).when(k == 3, F.concat(t, F.lit("\n - \n"))).when(k == 4, swap(" the ", "\tthe ")).when(k == 5, swap(".\n", ".\r\n")).when(k == 6, swap(".\n", "\n\n\n. ")).otherwise(F.concat(t, F.lit(",")))
    return table(s, d, "documents").select("doc_id", cells.surface_faults(shaped).alias("faults"))


# ---------------------------------------------------------------- joins and sets


@query("leg_exists", f"WITH {FILLS} SELECT run, bool_or(sym = 'N') AS has_leg, CASE WHEN bool_or(sym = 'N') THEN 'ok' ELSE 'NO-IMPLEMENTATION' END AS status FROM n GROUP BY 1")
def _(s, d):
    tapes = tape.normalise(fills(s, d)).groupBy("run").agg(F.collect_list(F.struct("time", "sym", "q")).alias("tape"))  # the fills of one run
    has = F.exists("tape", lambda e: e["sym"] == "N")
    return tapes.select("run", has.alias("has_leg"), F.when(has, "ok").otherwise("NO-IMPLEMENTATION").alias("status"))


@query("resume_by_prompt", """WITH done AS (SELECT o_custkey, sha256(o_orderpriority) AS h FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT c_custkey AS o_custkey, sha256(p) AS h FROM customer, (VALUES ('1-URGENT'), ('5-LOW')) t(p) WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.o_custkey = c_custkey AND done.h = sha256(p))""")
def _(s, d):
    prompts = F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("p")
    jobs = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), prompts).select("o_custkey", F.sha2("p", 256).alias("h"))
    done = table(s, d, "orders").withColumn("h", F.sha2("o_orderpriority", 256))
    return cells.unfinished(jobs, done, ["o_custkey"], "h", "o_orderstatus", ("F", "O"))


@query("graded_envelopes", "SELECT l_orderkey, l_linenumber, l_returnflag, o_orderstatus, o_orderkey IS NULL AS ungraded FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 7 = l_linenumber % 7")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_linenumber") % 7).alias("replicate"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).alias("replicate"), "o_orderstatus", F.lit(True).alias("graded"))
    return li.join(o, ["l_orderkey", "replicate"], "left").select("l_orderkey", "l_linenumber", "l_returnflag", "o_orderstatus", F.col("graded").isNull().alias("ungraded"))


@query("zipped_by_id", "SELECT a.doc_id, a.n, b.n AS other FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, n_chars AS n FROM documents) a JOIN (SELECT row_number() OVER (ORDER BY page_id) - 1 AS pos, CAST(length(html) AS BIGINT) AS n FROM pages) b USING (pos)")
def _(s, d):
    a = ranks.ranked(table(s, d, "documents").select("doc_id", F.col("n_chars").alias("n")), ["doc_id"], "at")
    b = ranks.ranked(table(s, d, "pages").select("page_id", F.length("html").cast("long").alias("other")), ["page_id"], "at")
    return a.join(b, "at").select("doc_id", "n", "other")


@query("changed_between_freezes", """WITH b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < DATE '1998-01-01' AND o_orderpriority < '3' GROUP BY 1), a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderpriority < '3' AND o_orderdate >= DATE '1996-06-01' GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'dropped' WHEN b.k IS NULL THEN 'new' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS what FROM a FULL JOIN b ON a.k = b.k) WHERE what IS NOT NULL""")
def _(s, d):
    o = table(s, d, "orders").where("o_orderpriority < '3'")
    best = lambda x: x.groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return cells.changed(best(o.where("o_orderdate < date'1998-01-01'")), best(o.where("o_orderdate >= date'1996-06-01'")), "o_custkey", "v")


@query("seeded_shuffle", """WITH RECURSIVE g AS (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, ids, len(ids) - 1 AS i, CAST(l_orderkey % 4294967296 AS BIGINT) AS x FROM g UNION ALL
  (SELECT l_orderkey, list_transform(range(len(ids)), lambda k: CASE WHEN k = i THEN ids[j + 1] WHEN k = j THEN ids[i + 1] ELSE ids[k + 1] END), i - 1, y FROM (SELECT *, y * (i + 1) // 4294967296 AS j FROM (SELECT *, (x * 1664525 + 1013904223) % 4294967296 AS y FROM r WHERE i > 0))))
SELECT l_orderkey, array_to_string(ids[1:3], ',') AS first_lines FROM r WHERE i <= 0""")
def _(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("ids"))  # the lines of an order
    return lines.select("l_orderkey", F.array_join(F.slice(tx.lcg_order(F.col("ids"), F.col("l_orderkey")), 1, 3), ",").alias("first_lines"))


# ---------------------------------------------------------------- summaries with all their columns


@query("false_pass_both_keys", f"WITH {VERD}, k AS (SELECT *, CASE WHEN n_chars % 5 = 0 THEN NOT truth ELSE truth END AS second FROM v) SELECT source, count(*) FILTER (WHERE judge AND NOT truth) AS false_pass, count(*) FILTER (WHERE NOT judge AND truth) AS false_fail, count(*) FILTER (WHERE judge AND NOT second) AS false_pass_2, count(*) FILTER (WHERE NOT judge AND second) AS false_fail_2, count(*) FILTER (WHERE judge) AS passed, count(*) FILTER (WHERE NOT truth) AS bad, count(*) FILTER (WHERE NOT second) AS bad_2 FROM k GROUP BY 1")
def _(s, d):
    v = verdicts(s, d).withColumn("second", F.when(F.col("n_chars") % 5 == 0, ~F.col("truth")).otherwise(F.col("truth")))
    j = F.col("judge")
    keys = {n: F.col(c) for n, c in (("", "truth"), ("_2", "second"))}
    made = {f"{a}{n}": c for n, t in keys.items() for a, c in (("false_pass", j & ~t), ("false_fail", ~j & t), ("bad", ~t))}
    return v.groupBy("source").agg(F.count_if(j).alias("passed"), *(F.count_if(c).alias(n) for n, c in made.items()))


@query("success_by_difficulty", "WITH t AS (SELECT o_orderpriority, l_orderkey, count(*) AS turns, min(CASE WHEN l_quantity >= 45 THEN l_linenumber END) AS won FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT o_orderpriority, count(*) AS n, count(won) AS won, round(100.0 * count(won) / count(*), 4) AS rate, round(avg(turns), 6) AS avg_turns, round(avg(won), 6) AS avg_turns_to_win FROM t GROUP BY 1")
def _(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = rows.groupBy("o_orderpriority", "l_orderkey").agg(F.count(F.lit(1)).alias("turns"), F.min(F.when(F.col("l_quantity") >= 45, F.col("l_linenumber"))).alias("won"))
    return t.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("won").alias("won"), F.round(100 * F.count("won") / F.count(F.lit(1)), 4).alias("rate"), F.round(F.avg("turns"), 6).alias("avg_turns"), F.round(F.avg("won"), 6).alias("avg_turns_to_win"))


@query("frozen_frames", """WITH t AS (SELECT event_type AS symbol, count(*) AS n_rows, min(ts) AS first, max(ts) AS last, CAST(sum(CAST(('0x' || left(md5(concat_ws('|', event_id, user_id, epoch_us(ts))), 15)) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM events GROUP BY 1)
SELECT *, 'event_id,ts,symbol,value,user_id,props' AS columns, 'UTC' AS zone FROM t""")
def _(s, d):
    from ..sources.tables import event_ticks

    e = event_ticks(s, d).withColumn("us", F.unix_micros("ts"))
    spans = e.groupBy("symbol").agg(F.min("ts").cast("timestamp_ntz").alias("first"), F.max("ts").cast("timestamp_ntz").alias("last"))
    marks = ranks.fingerprint(e, ["symbol"], ["event_id", "user_id", "us"]).withColumnRenamed("n", "n_rows")
    return spans.join(marks, "symbol").withColumns({"columns": F.lit(",".join(e.drop("us").columns)), "zone": F.lit("UTC")})


# ---------------------------------------------------------------- by rank


@query("upper_median_by_rank", "SELECT user_id, coalesce(list_sort(list(value))[len(list(value)) // 2 + 1], 0.0) AS med FROM events GROUP BY 1")
def _(s, d):
    return stats.upper_medians(table(s, d, "events"), ["user_id"], "value")


@query("symbol_member_rows", "SELECT c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS at, c_custkey FROM customer")
def _(s, d):
    return ranks.ranked(table(s, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey"), ["c_custkey"], "at", ("c_mktsegment", "c_nationkey"))


@query("ordered_tree_hash", """WITH RECURSIVE t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, sha256(text) AS h, count(*) OVER (PARTITION BY lang) AS n, 0 AS lv FROM documents UNION ALL
  (SELECT lang, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16), any_value(lv) + 1 FROM t WHERE lv = 0 OR n > 1 GROUP BY lang, i // 16))
SELECT lang, h AS digest FROM t WHERE lv > 0 AND n = 1""")
def _(s, d):
    return stats.tree_hash(table(s, d, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("h")), ["lang"], ["doc_id"], "h", fan=16)


@query("ordered_prefix_hash", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, sha256(text) AS h FROM documents) SELECT lang, sha256(string_agg(h, '' ORDER BY doc_id)) AS digest FROM r WHERE i <= 15 GROUP BY 1")
def _(s, d):
    return stats.prefix_hash(table(s, d, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("h")), ["lang"], ["doc_id"], "h", 15)
