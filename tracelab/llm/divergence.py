"""Source divergence audit: how the sources of a language differ in their words.

Terms are matched and counted in Arrow batches, so that a row stands for a term of many documents before anything is
shuffled; the rest is joins, groups and windows. Groups (lang, source) meet the kept vocabulary of their language in an
equi-join over the language and a part of the vocabulary, which spreads a language with most of the terms over all tasks
without broadcasting either side; counts that are missing become zeros. The dense table is joined to itself on language
and term for pairs of sources (one direction; the divergence is symmetric) and summed. Each row is a document, so repeated
rows count as often as they stand. All arithmetic is on integers (decimals where products pass 64 bits).

Edge cases: null text, lang and source are read as ''; groups without terms keep zeros for every kept term; a language
without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; a very long text is read
whole in one task; equal values rank by the item's UTF-8 bytes; only lang, source and text are read, so other columns can't
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices

#: Letters A-Z and a-z and everything beyond ASCII, in UTF-8 bytes; texts are lower-cased before.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms that a task holds before it passes their counts on.
HELD_TERMS = 1_000_000
SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents that have it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple, Counter] = {}
        having: dict[tuple, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in uses.items():
                terms = list(n)
                d = having[lang, source]
                yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "d"])

        for b in slices(batches):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = TERM.findall(text.lower())  # of bytes: lowers A-Z alone
                if found:
                    uses.setdefault((lang, source), Counter()).update(found)
                    having.setdefault((lang, source), Counter()).update(set(found))
            if sum(map(len, uses.values())) > HELD_TERMS:
                yield from rows()
                uses, having = {}, {}
        yield from rows()

    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    made = plain.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly: decimals, as the product passes 64 bits."""
    return F.expr(f"1 + (cast({count} + 2 as decimal(20, 0)) * {SCALE}BD) div cast({total} + 2 * {kept} as decimal(20, 0))")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank: part `pair` ranks the other sources of the language by their distance,
    part `term` the `top` terms that the source uses more than its language does."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = settle(term_counts(docs), "terms")
    kept = settle(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= min_docs).drop("d"), "kept")
    used = counts.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = settle(groups.join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"]), "groups")

    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    spread = groups.where("v > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cells = kept.withColumn("part", part("term")).join(spread, ["lang", "part"]).drop("part")
    dense = cells.join(used, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    dense = settle(dense.select("lang", "source", "term", "n", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q")), "dense")

    one, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(other, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(distance("p", "q")).alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    sums = sums.select("lang", ways.alias("w"), "value").select("lang", "w.*", "value")
    bare = groups.where("v = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.unionByName(zeros).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
x AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM t),
c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
d AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v)::HUGEINT AS q
  FROM g JOIN v USING (lang) JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM d a JOIN d b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM d WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
