"""Text expressions over model answers and logs. Program text is data; nothing is ever run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that say what counts as a question, a refusal by the provider, a rating.
ASK = (
    r"(?i)what .{0,60}(period|percent|number|threshold|value|definition|type|mean)|please (provide|specify|clarify)|should .{0,50}use\?"
    r"|i need (the|a|an)?\s?.{0,70}(period|percent|number|threshold|value|definition|type)|is(n.t| not) (specified|defined|stated)|unspecified|ambiguous"
    r"|is required but not|could you (provide|specify|clarify)"
)
BLOCKED = r"(?i)limits?|quota|resets?|Not signed in|please (?:sign|log) ?in|credit balance|insufficient_quota|Overloaded|too many requests|429"
RATINGS = (r"rating:\s*\[\[(\d+)\]\]", r"rating\s*\[\[(\d+)\]\]", r"\[\[(\d+)\]\]", r"rating:\s*(\d+)")
POSITIVE = ("matches", "correct", "aligned", "yes", "compliant")
NEGATIVE = ("doesn't match", "incorrect", "not aligned", "no", "non-compliant")
TRUNCATED = r"(?i)output token maximum|max_tokens|exceeded the [\d,]+ output"
BLANKS = " \t\n\r\v\f"
CODE_STARTS = "^(import |from |class |def )"
FENCE = r"```(?:python)?\s*\n([\s\S]*?)```"


def strip(t: Column) -> Column:
    """t without white space at either end, line feeds and tabs too."""
    return F.btrim(t, F.lit(BLANKS))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fenced(t: Column) -> Column:
    """The longest fenced block, the first of equals; null without one."""
    blocks = F.regexp_extract_all(t, F.lit(FENCE), F.lit(1))
    ranked = F.array_sort(F.transform(blocks, lambda b, i: F.struct((-F.length(b)).alias("n"), i.alias("i"), b.alias("b"))))
    return F.get(ranked, F.lit(0))["b"]


def asks(t: Column) -> Column:
    """A question mark among the last three characters, or a question's wording."""
    s = strip(t)
    return (F.instr(F.right(s, F.lit(3)), "?") > 0) | s.rlike(ASK)


def from_line(t: Column, pattern: str, otherwise: Column) -> Column:
    """The lines from the first one that matches, stripped, on."""

    def cut(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: strip(x).rlike(pattern)), F.lit(True)).cast("int")
        return F.when(first > 0, F.array_join(F.slice(lines, first, F.size(lines)), "\n")).otherwise(otherwise)

    return bound(F.split(t, "\n", -1), cut)


def first_fence(t: Column) -> Column:
    """The first python fence, else the first non-blank one, stripped; else the text."""
    marked, plain = F.split(t, "```python", -1), F.split(t, "```", -1)
    inside = F.get(F.filter(plain, lambda x, i: (i % 2 == 1) & (strip(x) != "")), F.lit(0))
    python = strip(F.substring_index(F.get(marked, F.lit(1)), "```", 1))
    return F.when(~F.contains(t, F.lit("```")), t).when(F.size(marked) > 1, python).otherwise(F.coalesce(strip(inside), t))


def clean_code(t: Column) -> Column:
    """What follows the last closed thought, or after a thought without end the first line of code on, else nothing; of
    that the first python fence, else the first non-blank one; of that the first import on."""
    after = F.when(F.contains(t, F.lit("</think>")), strip(F.substring_index(t, "</think>", -1))).when(F.contains(t, F.lit("<think>")), from_line(t, CODE_STARTS, F.lit(""))).otherwise(t)
    return strip(bound(bound(after, first_fence), lambda body: from_line(body, "^(import |from )", body)))


def structure_gate(code: Column, module: str = "", base: str = r"[\w.]*") -> Column:
    """The first failing check's message, or null. module: what must be imported; base: pattern of the class it needs."""
    return F.when(F.coalesce(code, F.lit("")) == "", "empty").when(~F.contains(code, F.lit(f"import {module}")), "no import").when(~code.rlike(rf"class\s+\w+\s*\(\s*{base}"), "no class").when(~F.contains(code, F.lit("def next(self)")), "no next()")


def rating(t: Column) -> tuple[Column, Column]:
    """(aligned, mode): the last match of the first pattern that matches, else keywords among the last 300 characters;
    keywords are substrings, ties fail."""
    hits = lambda tail, words: sum((F.contains(tail, F.lit(w)).cast("int") for w in words[1:]), F.contains(tail, F.lit(words[0])).cast("int"))
    last = lambda low: F.coalesce(*[F.try_element_at(F.regexp_extract_all(low, F.lit(p), F.lit(1)), F.lit(-1)) for p in RATINGS])
    read = bound(F.lower(strip(t)), lambda low: F.struct(last(low).alias("found"), bound(F.right(low, F.lit(300)), lambda x: hits(x, POSITIVE) - hits(x, NEGATIVE)).alias("lead")))
    found, lead = read["found"], read["lead"]
    return F.when(found.isNotNull(), F.ltrim(found, F.lit("0")) == "1").otherwise(lead > 0), F.when(found.isNotNull(), "rating").when(lead == 0, "keyword-tie").otherwise("keyword")


def blocked(program: Column, t: Column) -> Column:
    return program.isNull() & (F.length(t) < 600) & t.rlike(BLOCKED)


def diff_added(t: Column) -> Column:
    kept = F.filter(F.split(t, "\n", -1), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def occurrences(t: Column, part: str) -> Column:
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("long")


def counted_replace(t: Column, old: str, new: str, n: int) -> Column:
    """The text with old replaced if it occurs just n times, else null."""
    return F.when(occurrences(t, old) == n, F.replace(t, F.lit(old), F.lit(new)))


def safe_name(t: Column) -> Column:
    return F.regexp_replace(F.replace(t, F.lit("'"), F.lit("p")), "[^A-Za-z0-9_.-]", "")


def code_fraction(t: Column) -> Column:
    """Share of the non-blank lines that look like code."""
    lines = F.filter(F.split(t, "\n", -1), lambda x: strip(x) != "")
    code = F.filter(lines, lambda x: x.rlike(r"[=(){}\[\]:;]\s*$|^\s*(def|class|import|from|return|if|for)\b"))
    return F.when(F.size(lines) > 0, F.round(F.size(code) / F.size(lines), 6)).otherwise(0.0)


def hash_pick(seed: str, key: Column, n: int) -> Column:
    """int(sha256(seed|key)) mod n, folded over the hex digits."""
    digits = F.transform(F.split(F.sha2(F.concat_ws("|", F.lit(seed), key), 256), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % n)


def lcg_shuffle(ids: list, seed: int) -> list:
    """Fisher-Yates by the linear congruential generator x -> 1664525 x + 1013904223 mod 2**32; for driver-sized lists."""
    out, x = list(ids), seed & 0xFFFFFFFF
    for i in range(len(out) - 1, 0, -1):
        x = (1664525 * x + 1013904223) & 0xFFFFFFFF
        j = int(x / 2**32 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def lcg_order(ids: Column, seed: Column) -> Column:
    """lcg_shuffle of an array, as a fold; for arrays of bounded size, which each step rewrites."""

    def step(s: Column, i: Column) -> Column:
        x = F.pmod(s["x"] * 1664525 + 1013904223, F.lit(1 << 32))
        j = F.floor(x * (i + 1) / (1 << 32)).cast("int")
        out = F.transform(s["out"], lambda v, k: F.when(k == i, F.get(s["out"], j)).when(k == j, F.get(s["out"], i)).otherwise(v))
        return F.struct(x.alias("x"), out.alias("out"))

    start = F.struct(F.pmod(seed.cast("long"), F.lit(1 << 32)).alias("x"), ids.alias("out"))
    downward = F.when(F.size(ids) > 1, F.sequence(F.size(ids) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(downward, start, step, lambda s: s["out"])
