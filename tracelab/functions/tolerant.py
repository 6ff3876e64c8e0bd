"""JSON that may be broken, and table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def parsed(text: Column) -> Column:
    """The text as a variant; null if it is no JSON."""
    return F.try_parse_json(text)


def nested(text: Column, path: str, kind: str, default) -> Column:
    """What stands at a path such as $.a.k; the default where the text is broken, the path isn't there, is null or of
    another kind."""
    return F.coalesce(F.try_variant_get(parsed(text), path, kind), F.lit(default).cast(kind))


def parse_error(text: Column, keep: int = 300) -> Column:
    """Null for JSON; else what was found instead, its first `keep` characters."""
    return F.when(text.isNull(), "no text").when(parsed(text).isNull(), F.concat(F.lit("not JSON: "), F.left(text, F.lit(keep))))


@udtf(returnType="n int, first_word int, n_words int, window string")
class Windows:
    """Windows of `size` words, each `step` after the one before; the last may be shorter. No words, no window."""

    def eval(self, text: str | None, size: int, step: int) -> Iterator[tuple]:
        words = (text or "").split(" ")
        words = [w for w in words if w]
        at = 0
        while at < len(words):
            part = words[at : at + size]
            yield at // step, at, len(part), " ".join(part)
            if at + size >= len(words):
                break
            at += step


def register(spark: SparkSession) -> None:
    """Makes word_windows(text, size, step) known to SQL."""
    spark.udtf.register("word_windows", Windows)
