"""Matching draws against an indexed bank, and the decision ladder that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of an index, its pairs and each 64 letters of its projections, all counted, up to which it is broadcast.
SMALL = 10_000


def index(bank: DataFrame) -> DataFrame:
    """bank, proj -> cores, (tuple, core) pairs, and mixed: whether one tuple has several cores. bank: bank, proj,
    tuple, core."""
    of = bank.groupBy("bank", "proj", "tuple").agg(F.collect_set("core").alias("of_tuple"))
    pairs = F.flatten(F.collect_list(F.transform("of_tuple", lambda c: F.struct(F.col("tuple"), c.alias("core")))))
    return of.groupBy("bank", "proj").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("of_tuple")))).alias("cores"), pairs.alias("hits"), F.max(F.size("of_tuple") > 1).alias("mixed"))


def lookup(draws: DataFrame, bank: DataFrame) -> DataFrame:
    """draws with cores, hits and mixed of their projection, null without match. Long projections meet by hash, then
    text. An index of up to SMALL rows and pairs is broadcast: few projections would be few partitions of draws."""
    i = index(bank).withColumn("h", F.sha2("proj", 256)).withColumnRenamed("proj", "_proj").withColumnRenamed("bank", "_bank")
    if i.select(F.coalesce(F.sum(F.size("hits") + F.length("_proj") / 64 + 1), F.lit(0))).first()[0] <= SMALL:
        i = F.broadcast(i)
    d = draws.withColumn("h", F.sha2("proj", 256))
    return d.join(i, (d.bank == i._bank) & (d.h == i.h) & (d.proj == i._proj), "left").select(*[d[c] for c in draws.columns], "cores", "hits", "mixed")


def tuple_consistent(dofs: Column, wanted: Column) -> Column:
    """Every (d, v) wanted is unread, unresolved or equal in the draw's own degrees of freedom."""
    return F.forall(F.map_entries(wanted), lambda e: F.element_at(dofs, e["key"]).isNull() | F.element_at(dofs, e["key"]).isin("unresolved") | (F.element_at(dofs, e["key"]) == e["value"]))


def numeric_key(prefix: str, value: Column) -> Column:
    """The name of a numeric resolution: the prefix and the value, without a fraction where it is whole."""
    return F.concat(F.lit(prefix), F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string")))


def ladder(d: DataFrame) -> DataFrame:
    """d (program, status, runtime_error, tape_fills, leg_fills, cores, hits, and own_tuple or dofs; mixed if it is known)
    with code and flag.

    In order: no program; timeout or failed run; no fills; no fills of the leg; a numeric bank's own reading; no match;
    several cores, restricted to what the draw itself says; one core. Several cores are never settled by priority.

    own_tuple restricts to hits of that tuple. dofs, a map, restricts to hits whose tuple (key=value, comma-joined) has
    nothing that the draw reads otherwise; what it doesn't read, or can't resolve, fits anything. With the columns
    numeric_status (null: not a numeric bank), numeric_code and resolutions, a numeric bank's draw is coded by its value:
    numeric_code if that is a resolution, else "other"; flagged where the tape isn't one of that resolution's."""
    if "dofs" in d.columns:
        fits = lambda h: tuple_consistent(F.coalesce("dofs", F.create_map().cast("map<string,string>")), F.when(h["tuple"] == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(h["tuple"], F.lit(","), F.lit("="))))
    else:
        fits = lambda h: F.col("own_tuple").isNull() | (h["tuple"] == F.col("own_tuple"))
    consistent = F.array_distinct(F.transform(F.filter("hits", fits), lambda h: h["core"]))
    several = F.size("cores") > 1
    # one tuple has several cores: there are fewer tuples than pairs
    mixed = F.col("mixed") if "mixed" in d.columns else F.size(F.array_distinct(F.transform("hits", lambda h: h["tuple"]))) < F.size(F.array_distinct("hits"))
    restricted = several & (F.size(consistent) == 1)
    matched = F.when(F.col("cores").isNull(), "DRIFT").when(restricted, F.get(consistent, F.lit(0))).when(several & mixed, "AMBIGUOUS-AT-TUPLE").when(several, "AMBIGUOUS-ACROSS-TUPLES").otherwise(F.get("cores", F.lit(0)))
    flag = F.when(restricted, "tuple-restricted")
    if "numeric_status" in d.columns:
        numeric, read = F.col("numeric_status").isNotNull(), F.col("numeric_status") == "ok"
        known = F.array_contains("resolutions", F.col("numeric_code"))
        matched = F.when(numeric, F.when(~read, F.col("numeric_status")).when(known, F.col("numeric_code")).otherwise("other")).otherwise(matched)
        flag = F.when(numeric, F.when(read & known & ~F.coalesce(F.array_contains("cores", F.col("numeric_code")), F.lit(False)), "implementation-drift")).otherwise(flag)
    stopped = (
        F.when(F.col("program").isNull(), "no-program").when(F.col("status") == "timeout", "non-runnable").when(F.col("tape_fills").isNull() | (F.col("status") != "ok") | F.col("runtime_error").isNotNull(), "non-runnable")
        .when(F.col("tape_fills") == 0, "EMPTY-TAPE").when(F.col("leg_fills") == 0, "NO-IMPLEMENTATION")
    )
    return d.withColumns({"code": F.coalesce(stopped, matched), "flag": F.when(stopped.isNull(), flag)})


def class_label(matches: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """The present core of highest priority that isn't absorbed (unless all are); without a registered one, all cores
    joined. matches: keys, core; classes: core, rank, absorbed."""
    m = matches.join(F.broadcast(classes.select(F.col("core").alias("_c"), "rank", "absorbed")), F.col("core") == F.col("_c"), "left")  # a registry of a few rows
    order = F.when(F.col("rank").isNotNull(), F.struct(F.col("absorbed"), F.col("rank")))
    return m.groupBy(*keys).agg(F.coalesce(F.min_by("core", order), F.array_join(F.array_sort(F.collect_set("core")), "+")).alias("label"))
