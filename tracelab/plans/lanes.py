"""Queries over lanes of answers; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lanes, stats
from ..sources.tables import table, verdicts
from .catalogue import B, BARS, DRAWS, RAW, VERD, W, _daily, _raw, _sma, draws, query

ENV = f"{RAW}, env AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE t END AS raw, CASE WHEN contains(t, 'import x') THEN t END AS program, doc_id % 7 = 0 AS fast FROM raw)"
CUT = tx.TRUNCATED
STATUS = f"CASE WHEN raw IS NULL OR (program IS NULL AND coalesce(regexp_matches(raw, '{CUT}'), false)) THEN 'harness-error' WHEN program IS NOT NULL THEN 'program' WHEN raw <> '' AND ((fast AND length(trim(raw, {B})) < 400) OR (length(trim(raw, {B})) < 600 AND regexp_matches(trim(raw, {B}), '{tx.BLOCKED}'))) THEN 'provider-blocked' ELSE 'no-program' END"


def _env(s, d):
    r = _raw(s, d)
    return r.select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("t")).alias("raw"), F.when(F.contains("t", F.lit("import x")), F.col("t")).alias("program"), (F.col("doc_id") % 7 == 0).alias("fast"))


@query("generation_status", f"WITH {ENV} SELECT doc_id, {STATUS} AS status FROM env")
def _(s, d):
    return _env(s, d).select("doc_id", lanes.generation_status(F.col("raw"), F.col("program"), F.col("fast")).alias("status"))


@query("fairness_filter", f"WITH {ENV}, st AS (SELECT doc_id, raw, {STATUS} AS status FROM env) SELECT status, count(*) AS n FROM st WHERE NOT (status = 'harness-error' OR (status = 'no-program' AND trim(coalesce(raw, ''), {B}) = '')) GROUP BY 1")
def _(s, d):
    e = _env(s, d).withColumn("status", lanes.generation_status(F.col("raw"), F.col("program"), F.col("fast")))
    return e.where(lanes.finished(F.col("status"), F.col("raw"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("binding_refusal", "WITH e AS (SELECT doc_id, lang, source, text, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'v1' ELSE 'v2' END AS schema, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE sha256(text) END AS h FROM documents) SELECT doc_id, CASE WHEN schema IS DISTINCT FROM 'v2' THEN 'schema ' || coalesce(schema, 'none') WHEN lang <> 'en' THEN 'arm ' || lang WHEN text <> '' AND sha256(text) <> h THEN 'program hash' WHEN source <> 'src1' THEN 'prompt hash' END AS reason FROM e")
def _(s, d):
    k = F.col("doc_id") % 5
    schema = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "v1").otherwise("v2")
    h = F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.sha2("text", 256))
    return table(s, d, "documents").select("doc_id", lanes.refusal(schema, F.col("lang"), F.lit("en"), F.col("text"), h, F.col("source"), F.lit("src1")).alias("reason"))


@query("target_case", f"WITH {DRAWS}, t AS (SELECT model, prompt, count(*) AS n, CASE WHEN model = 'BUILDING' THEN CASE WHEN prompt IN ('1-URGENT', '2-HIGH') THEN 30 ELSE 10 END WHEN prompt IN ('1-URGENT', '2-HIGH') THEN 30 WHEN prompt = '3-MEDIUM' THEN 20 ELSE 10 END AS target FROM dr GROUP BY 1, 2) SELECT model, prompt, target, greatest(target - n, 0) AS short FROM t")
def _(s, d):
    g = draws(s, d).groupBy("model", "prompt").agg(F.count(F.lit(1)).alias("n"))
    bare = F.when(F.col("model") == "BUILDING", "bare").otherwise("full")
    return g.withColumn("target", lanes.target(F.col("prompt"), bare, ("1-URGENT", "2-HIGH"), ("3-MEDIUM",))).select("model", "prompt", "target", F.greatest(F.col("target") - F.col("n"), F.lit(0).cast("long")).alias("short"))


@query("reward_binary", f"WITH {VERD}, r AS (SELECT doc_id, n_chars > 200 AS a, truth AS b, n_chars % 3 AS trades, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE judge END AS j FROM v) SELECT doc_id, CASE WHEN a AND b AND trades > 0 AND coalesce(j, true) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, a AND b AND trades > 0 AND j IS NULL AS fail_open FROM r")
def _(s, d):
    judged = F.when(F.col("doc_id") % 4 != 0, F.col("judge"))
    r, o = lanes.reward(F.col("n_chars") > 200, F.col("truth"), F.col("n_chars") % 3, judged)
    return verdicts(s, d).select("doc_id", r.alias("reward"), o.alias("fail_open"))


@query("false_pass_by_lang", f"WITH {VERD} SELECT coalesce(lang, 'ALL') AS lang, count(*) FILTER (WHERE judge AND NOT truth) AS false_pass, count(*) FILTER (WHERE NOT judge AND truth) AS false_fail, count(*) FILTER (WHERE judge) AS passed, count(*) FILTER (WHERE NOT truth) AS bad FROM v GROUP BY ROLLUP (lang)")
def _(s, d):
    j, t = F.col("judge"), F.col("truth")
    g = verdicts(s, d).rollup("lang").agg(F.count_if(j & ~t).alias("false_pass"), F.count_if(~j & t).alias("false_fail"), F.count_if(j).alias("passed"), F.count_if(~t).alias("bad"))
    return g.withColumn("lang", F.coalesce("lang", F.lit("ALL")))


for _rule, _test in {"R1": "c0 >= f0 AND close < fast", "R2": "c0 <= f0 AND close > fast", "R3": "f0 >= g0 AND fast < slow", "R4": "f0 <= g0 AND fast > slow", "R5": "(c0 <= f0 AND close > fast) OR (c0 >= f0 AND close < fast)", "R6": "(f0 <= g0 AND fast > slow) OR (f0 >= g0 AND fast < slow)"}.items():

    @query(f"sell_rule_{_rule}", f"WITH {BARS}, m AS (SELECT *, {_sma(3, 'fast')}, {_sma(8, 'slow')} FROM bars), x AS (SELECT *, lag(close) OVER {W} AS c0, lag(fast) OVER {W} AS f0, lag(slow) OVER {W} AS g0 FROM m) SELECT symbol, d, coalesce({_test}, false) AS sells FROM x")
    def _(s, d, rule=_rule):
        return lanes.with_averages(_daily(s, d), 3, 8).select("symbol", "d", lanes.sell_rule(rule, 3, 8).alias("sells"))


@query("last_json_line", f"WITH t AS (SELECT event_id, 'log ' || event_type || chr(10) || '{{\"old\": 1}}' || chr(10) || chr(9) || props || chr(13) || chr(10) || 'bye' AS t FROM events) SELECT event_id, list_last(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, {B})), lambda x: regexp_matches(x, '^\\{{.*\\}}$'))) AS line FROM t")
def _(s, d):
    t = F.concat(F.lit("log "), F.col("event_type"), F.lit('\n{"old": 1}\n\t'), F.col("props"), F.lit("\r\nbye"))
    return table(s, d, "events").select("event_id", lanes.last_json_line(t).alias("line"))


@query("text_faults", f"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', ';' || chr(9) || chr(10) || ' -' || chr(13) || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '. ', ';' || chr(9) || chr(10) || ' -' || chr(13) || chr(10)), chr(10)), 1) AS n FROM documents),
f AS (SELECT doc_id, n, CASE WHEN trim(line, {B}) = '-' THEN 'line ' || n || ': empty item' WHEN right(rtrim(line, {B}), 1) IN (';', ',') THEN 'line ' || n || ': dangling mark' END AS fault FROM l)
SELECT doc_id, coalesce(string_agg(fault, ',' ORDER BY n), '') AS faults FROM f GROUP BY 1""")
def _(s, d):
    t = F.replace("text", F.lit(". "), F.lit(";\t\n -\r\n"))
    return table(s, d, "documents").select("doc_id", lanes.text_faults(t).alias("faults"))


@query("fallback_evaluation", f"WITH t AS (SELECT page_id, url, chr(10) || CASE page_id % 3 WHEN 0 THEN 'class A(bt.Strategy)' WHEN 1 THEN 'class A' ELSE '' END || html || chr(9) AS code, list_filter(['page1', 'nav', 'page7', 'www'], lambda w: contains(lower(url), w)) AS named FROM pages) SELECT page_id, CASE WHEN length(trim(code, {B})) < 100 THEN false WHEN len(named) = 0 THEN contains(lower(code), 'class') AND contains(lower(code), 'bt.strategy') ELSE len(list_filter(named, lambda w: contains(lower(code), w))) > 0 END AS passes FROM t")
def _(s, d):
    kind = F.col("page_id") % 3
    code = F.concat(F.lit("\n"), F.when(kind == 0, "class A(bt.Strategy)").when(kind == 1, "class A").otherwise(""), F.col("html"), F.lit("\t"))
    return table(s, d, "pages").select("page_id", lanes.keyword_overlap(F.col("url"), code, ("page1", "nav", "page7", "www")).alias("passes"))


@query("code_share", r"WITH l AS (SELECT page_id, list_filter(string_split(html, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM pages) SELECT page_id, CASE WHEN len(ls) > 0 THEN round(len(list_filter(ls, lambda x: regexp_matches(x, '[=(){}\[\]:;]\s*$|^\s*(def|class|import|from|return|if|for)\b'))) / len(ls), 6) ELSE 0.0 END AS share FROM l")
def _(s, d):
    return table(s, d, "pages").select("page_id", tx.code_fraction(F.col("html")).alias("share"))


@query("named_codes", f"WITH {DRAWS} SELECT model, count(*) FILTER (WHERE code IS NOT NULL AND code NOT IN ('DRIFT', 'AMBIGUOUS-AT-TUPLE', 'AMBIGUOUS-ACROSS-TUPLES', 'other')) AS named, round(avg(CASE WHEN code = 'F' THEN 1.0 ELSE 0.0 END), 2) AS compliance FROM dr GROUP BY 1")
def _(s, d):
    return draws(s, d).groupBy("model").agg(F.count_if(stats.named(F.col("code"))).alias("named"), F.round(F.avg((F.col("code") == "F").cast("double")), 2).alias("compliance"))


@query("latency_failures", "SELECT event_type, count(*) AS n, list_sort(list(value))[len(list(value)) // 2 + 1] AS med, arg_min(replace(props, chr(10), ' '), event_id) AS sample FROM events WHERE value > 90 GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").where("value > 90")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), stats.upper_median("value").alias("med"), F.min_by(F.replace("props", F.lit("\n"), F.lit(" ")), "event_id").alias("sample"))
