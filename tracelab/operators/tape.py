"""Tapes: normalised fills, canonical projections and comparison. A tape is null (run incomplete), empty or filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("full", "dates_all", "lead_entries_exits", "lead_full", "second_entries", "second_exits", "second_full")


def normalise(fills: DataFrame, *more: str) -> DataFrame:
    """Filled and partly filled rows with ticker (first word of the symbol), quantity filled, side and trade date.

    The trade date is UTC minus five hours; a quantity of zero is a sale."""
    q = F.coalesce("fill_qty", "qty")
    return fills.where(F.col("status").isin("filled", "partiallyFilled")).select(
        "run", "time", F.substring_index("symbol", " ", 1).alias("sym"), q.alias("q"), F.when(q > 0, "B").otherwise("S").alias("side"), F.date_format(F.to_date(F.timestamp_seconds(F.col("time") - 18000)), "yyyy-MM-dd").alias("day"), "order_id", "price", *more
    )


def projection(kind: str, lead: str, second: str) -> tuple[Column, Column]:
    """(which fills, text of a fill) of a projection kind."""
    day, sym, side, q = F.col("day"), F.col("sym"), F.col("side"), F.abs("q").cast("string")
    everything, own, other = F.lit(True), sym == lead, sym == second
    return {
        "full": (everything, F.concat_ws("|", day, sym, side, q)), "dates_all": (everything, F.concat_ws("|", day, sym, side)),
        "lead_entries_exits": (own, F.concat_ws("|", day, side)), "lead_full": (own, F.concat_ws("|", day, side, q)),
        "second_entries": (other & (side == "B"), day), "second_exits": (other & (side == "S"), day), "second_full": (other, F.concat_ws("|", day, side, q)),
    }[kind]


def project(fills: DataFrame, kinds: tuple[str, ...] = KINDS, lead: str = "A", second: str = "N") -> DataFrame:
    """One row per run with a column per kind; a complete run without matching fills has the empty text."""
    key = F.struct("time", "order_id", "sym", "q")
    cols = []
    for kind in kinds:
        which, text = projection(kind, lead, second)
        items = F.array_sort(F.collect_list(F.when(which, F.struct(key.alias("k"), text.alias("t")))))
        cols.append(F.array_join(F.transform(items, lambda x: x["t"]), ";").alias(f"proj_{kind}"))
    return normalise(fills).groupBy("run").agg(*cols)


def sell_ratio(fills: DataFrame, lead: str = "A") -> DataFrame:
    """Per sale of the lead leg: sold, held before it (never under zero) and sold/held in hundredths, half up."""
    own = normalise(fills).where(F.col("sym") == lead)
    items = F.array_sort(F.collect_list(F.struct("time", "order_id", "q")))
    first = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<sold:bigint,held:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        sold = F.least(-x["q"], a["held"])
        kept = F.when((x["q"] <= 0) & (a["held"] > 0), F.concat(a["out"], F.array(F.struct(sold.alias("sold"), a["held"].alias("held"))))).otherwise(a["out"])
        return F.struct(F.greatest(a["held"] + x["q"], F.lit(0)).cast("long").alias("held"), kept.alias("out"))

    folded = own.groupBy("run").agg(items.alias("items")).select("run", F.aggregate("items", first, step)["out"].alias("out"))
    return folded.select("run", F.posexplode("out").alias("sale", "x")).select("run", F.col("sale").cast("long"), "x.sold", "x.held", F.expr("(200 * x.sold + x.held) div (2 * x.held)").alias("ratio_pct"))


def compare(a: Column, b: Column) -> dict[str, Column]:
    """Equality of two tapes (arrays of dt, side, size): primary on (dt, side), secondary with size to 8 digits."""
    first = lambda t: F.transform(t, lambda e: F.struct(e["dt"], e["side"]))
    both = lambda t: F.transform(t, lambda e: F.struct(e["dt"], e["side"], F.round(e["size"], 8)))
    return {"primary_match": first(a) == first(b), "secondary_match": both(a) == both(b)}
