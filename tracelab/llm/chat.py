"""Chat formatting: linking tool calls to their results.

Calls and results are hash-joined by (conversation, call identifier); calls are put in a topological order of their
dependencies; arguments are validated against the schema of the tool they name; each call becomes one canonical JSON
record (sorted keys, no spaces, UTF-8, code points unescaped but for control characters).

Order: position counts the calls of a conversation in a topological order of what they name in `after`. Where every
dependency stands earlier in the log, the log order (turn, idx) is one, and all levels are 0: no iteration, however
long the conversation. In the other conversations levels are peeled off round by round with joins (rounds = longest
dependency chain there): 0 without dependency, else one more than the highest level among those, and the order is
(level, turn, idx). Calls on a cycle, or that depend on one or on an unknown call, get level -1 and come last.

No task orders a whole conversation: turns are cut into stretches of `TURNS` and each stretch is ordered by itself;
what goes before it (the last call of a user, the number of records) comes from one summary row per stretch.

Edge cases: an identifier that several calls of a conversation share belongs to the earliest of them, the others are
"duplicate"; a result whose identifier no call has is an "orphan" record; a call without result is "unanswered";
null texts are empty; null conversations form one conversation; arguments that aren't a JSON object are invalid, and
stand in the record as a string where they aren't JSON at all (NaN, infinities, numbers beyond a double and texts nested
beyond the parser's depth aren't); lone surrogates are written as escapes; a schema type that JSON doesn't know fits
nothing; records equal in turn and place are ordered by identifier, status and arguments; very long texts are values like
any other; other columns aren't read, so they can't clash; repeated rows collapse; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Turns of a conversation that one task orders.
TURNS = 4096

SURROGATE = re.compile("[\ud800-\udfff]")
KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def parse(text: str) -> object:
    """The value of a JSON text; ValueError for anything else: NaN and infinities, numbers beyond a double's range, and
    texts nested too deeply to read."""

    def no(name: str) -> float:
        raise ValueError(name)

    def number(x: str) -> float:
        value = float(x)
        return value if abs(value) < float("inf") else no(x)

    try:
        return json.loads(text, parse_constant=no, parse_float=number)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def printable(text: str) -> str:
    """text with lone surrogates, which no UTF-8 holds, as escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    try:
        return printable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def violations(value: object, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, required, properties, additionalProperties, items, minLength,
    maxLength, minimum, maximum."""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []

    def fits(kind: str) -> bool:
        if kind in ("number", "integer"):
            return not isinstance(value, bool) and isinstance(value, (int, float) if kind == "number" else int)
        return kind in KINDS and isinstance(value, KINDS[kind])  # nothing is of an unknown type

    if kinds and not any(map(fits, kinds)):
        return [f"{path}: not {'|'.join(kinds)}"]
    out = [f"{path}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{path}: length {len(value)}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{path}: out of range")
    return out


def _extracted(messages: DataFrame) -> DataFrame:
    """Rows of kind call, result, and message, which names (by role and MD5 of its text) what the others came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if role not in ("assistant", "tool") or not (text or "").lstrip().startswith("{"):
                    continue
                try:
                    got = parse(text)
                    canonical(got)  # what can't be written again is no message
                except ValueError:
                    continue
                before = len(rows)
                if role == "tool":
                    if isinstance(got.get("tool_call_id"), str):
                        content = got.get("content")
                        rows.append((conv, turn, 0, "result", printable(got["tool_call_id"]), None, None, printable(content) if isinstance(content, str) else canonical(content), None))
                calls = got.get("tool_calls") if role == "assistant" else None
                for i, call in enumerate(calls if isinstance(calls, list) else []):
                    if isinstance(call, dict) and isinstance(call.get("id"), str):
                        args = call.get("arguments")
                        after = call.get("after")
                        rows.append((conv, turn, i, "call", printable(call["id"]), printable(str(call.get("name"))), printable(args) if isinstance(args, str) else canonical(args), None, [printable(x) for x in after if isinstance(x, str)] if isinstance(after, list) else []))
                if len(rows) > before:
                    rows.append((conv, turn, 0, "message", role, hashlib.md5(text.encode()).hexdigest(), None, None, None))
            names = ["conv_id", "turn", "idx", "kind", "call_id", "name", "arguments", "content", "after"]
            types = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string())]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    kind = "conv_id long, turn long, idx int, kind string, call_id string, name string, arguments string, content string, after array<string>"
    return settle(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, kind), "tool-rows")


def _sides(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    return both.where("kind = 'call'").drop("kind", "content"), both.where("kind = 'result'").select("conv_id", "turn", "idx", "call_id", "content")


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) whose text is JSON: assistants' "tool_calls" (id,
    name, arguments, after) and the tool role's "tool_call_id" with "content". Other messages give neither."""
    return _sides(_extracted(messages))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations in the same shape: each user turn calls "reply" with its text and, after the first, names
    the call before it; each later message of an assistant, up to the next user turn, is a result of it. All other messages
    (of the system, of an assistant before the first user turn, of other roles) are results without a call, named by their
    role and turn, so that each of them reaches a record."""
    rows = settle(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "turns")
    name = F.when(F.col("role") == "user", F.concat(F.lit("turn-"), F.coalesce(F.col("turn").cast("string"), F.lit("none"))))
    rows = rows.withColumn("part", F.floor(F.col("turn") / TURNS))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    rows = rows.withColumns({"own": F.last(name, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "last": F.last(name, True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    ends = rows.groupBy("conv_id", "part").agg(F.max(F.when(name.isNotNull(), F.struct("turn", name.alias("name"))))["name"].alias("end"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.last("end", True).over(ahead).alias("before"))
    rows = settle(rows.join(ends, [rows.conv_id.eqNullSafe(ends.c), rows.part.eqNullSafe(ends.p)]).withColumns({"own": F.coalesce("own", "before"), "last": F.coalesce("last", "before")}), "named")
    calls = rows.where("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("idx"), F.col("own").alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"),
        F.when(F.col("last").isNotNull() & (F.col("last") != F.col("own")), F.array("last")).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    answers = (F.col("role") == "assistant") & F.col("own").isNotNull()
    alone = F.concat("role", F.lit("-"), F.coalesce(F.col("turn").cast("string"), F.lit("none")))
    results = rows.where("role <> 'user'").select("conv_id", "turn", F.lit(0).alias("idx"), F.when(answers, F.col("own")).otherwise(alone).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls of conversations whose log order isn't topological; -1 for what no order
    reaches. calls: conv_id, call_id, turn, idx, after."""
    place = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "idx")
    needs = calls.select("conv_id", "call_id", place.alias("at"), F.explode(F.array_distinct("after")).alias("dep"))
    known = calls.select(F.col("conv_id").alias("dep_conv"), F.col("call_id").alias("dep"), place.alias("dep_at"))
    placed = needs.join(known, [needs.conv_id.eqNullSafe(known.dep_conv), needs.dep == known.dep], "left").select("conv_id", "call_id", "at", needs.dep, "dep_at")
    odd = settle(placed.where("dep_at is null or dep_at >= at").select("conv_id").distinct(), "odd")
    mine = calls.join(odd, calls.conv_id.eqNullSafe(odd.conv_id), "left_semi")
    open_needs = settle(mine.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("dep")), "needs")
    layer = settle(mine.where(F.size("after") == 0).select("conv_id", "call_id", F.lit(0).alias("level")), "levels")
    done, rounds = layer, 0
    while not layer.isEmpty():
        rounds += 1
        known = done.select(F.col("conv_id").alias("dep_conv"), F.col("call_id").alias("dep"), F.col("level").alias("dep_level"))
        met = open_needs.join(known, [open_needs.conv_id.eqNullSafe(known.dep_conv), open_needs.dep == known.dep], "left").select("conv_id", "call_id", open_needs.dep, "dep_level")
        layer = settle(met.groupBy("conv_id", "call_id").agg(F.count_if(F.col("dep_level").isNull()).alias("open"), (F.max("dep_level") + 1).alias("level")).where("open = 0").select("conv_id", "call_id", "level"), "levels")
        left = layer.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
        open_needs = settle(open_needs.join(left, [open_needs.conv_id.eqNullSafe(left.c), open_needs.call_id == left.i], "left_anti"), "needs")
        done = settle(done.unionByName(layer), "levels")
    got = mine.alias("x").join(done.alias("d"), [F.col("x.conv_id").eqNullSafe(F.col("d.conv_id")), F.col("x.call_id") == F.col("d.call_id")], "left")
    return got.select("x.conv_id", "x.call_id", F.coalesce("d.level", F.lit(-1)).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per orphan result: conv_id, call_id, turn, status, level, position, n_results, valid,
    errors, json. schemas: JSON schema of the arguments by tool name; a tool without one is an error."""
    first = Window.partitionBy("conv_id", "call_id").orderBy("turn", "idx", "arguments")
    ranked = settle(calls.withColumn("nth", F.row_number().over(first)), "calls")
    main = ranked.where("nth = 1")
    gathered = results.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(F.struct("turn", "idx", "content"))).alias("results"), F.min("turn").alias("result_turn"))
    m, g, lv = main.alias("m"), gathered.alias("g"), levels(main).alias("l")
    joined = m.join(g, [F.col("m.conv_id").eqNullSafe(F.col("g.conv_id")), F.col("m.call_id") == F.col("g.call_id")], "full")
    joined = joined.join(lv, [F.col("m.conv_id").eqNullSafe(F.col("l.conv_id")), F.col("m.call_id") == F.col("l.call_id")], "left")
    rows = joined.select(
        F.when(F.col("m.call_id").isNotNull(), F.col("m.conv_id")).otherwise(F.col("g.conv_id")).alias("conv_id"), F.coalesce("m.call_id", "g.call_id").alias("call_id"), F.when(F.col("m.call_id").isNotNull(), F.col("m.turn")).otherwise(F.col("g.result_turn")).alias("turn"), F.coalesce("m.idx", F.lit(0)).alias("idx"),
        F.when(F.col("m.call_id").isNull(), "orphan").when(F.col("g.call_id").isNull(), "unanswered").otherwise("answered").alias("status"), F.coalesce("l.level", F.when(F.col("m.call_id").isNull(), -1).otherwise(0)).alias("level"), "m.name", "m.arguments", F.coalesce("m.after", F.array().cast("array<string>")).alias("after"), F.transform(F.coalesce("g.results", F.array().cast("array<struct<turn:long,idx:int,content:string>>")), lambda r: r["content"]).alias("contents"),
    )
    doubles = ranked.where("nth > 1").select("conv_id", "call_id", "turn", "idx", F.lit("duplicate").alias("status"), F.lit(-1).alias("level"), "name", "arguments", "after", F.array().cast("array<string>").alias("contents"))
    ready = settle(rows.unionByName(doubles).withColumns({"late": F.col("level") < 0, "part": F.floor(F.col("turn") / TURNS)}), "records")
    counts = ready.groupBy("conv_id", "late", "level", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("late", "level", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c"), F.col("level").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "level", "part").orderBy("turn", "idx", "call_id", "status", "arguments")
    numbered = ready.withColumn("nth", F.row_number().over(inside))
    placed = numbered.join(counts, [numbered.conv_id.eqNullSafe(counts.c), numbered.level == counts.l, numbered.part.eqNullSafe(counts.p)]).withColumn("position", F.col("before") + F.col("nth") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, errors, out, n = [], [], [], []
            for r in b.to_pylist():
                wrong = []
                try:
                    args = parse(r["arguments"]) if r["arguments"] is not None else None
                    canonical(args)
                except ValueError:
                    args = r["arguments"]
                if r["status"] == "orphan":
                    wrong = ["no such call"]
                elif r["name"] not in schemas:
                    wrong = ["no such tool"]
                else:
                    wrong = violations(args, {"type": "object"} | schemas[r["name"]])
                valid.append(not wrong)
                errors.append(printable("; ".join(wrong)))
                n.append(len(r["contents"]))
                out.append(canonical({"after": r["after"], "arguments": args, "id": r["call_id"], "name": r["name"], "results": r["contents"]}))
            yield pa.record_batch([b.column(i) for i in range(6)] + [pa.array(n, pa.int32()), pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(out, pa.string())], names=[*b.schema.names[:6], "n_results", "valid", "errors", "json"])

    shaped = placed.select("conv_id", "call_id", "turn", "status", F.col("level").cast("int"), F.col("position").cast("int"), "name", "arguments", "after", "contents")
    return shaped.mapInArrow(run, "conv_id long, call_id string, turn long, status string, level int, position int, n_results int, valid boolean, errors string, json string")


REPLY = {"reply": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string", "minLength": 1}}, "additionalProperties": False}}


def format_conversations(conversations: DataFrame, schemas: dict[str, dict] = REPLY) -> DataFrame:
    """One record per tool call, per user turn, and per message that answers neither. Messages that hold tool calls or
    results of tools stand for these alone; tools without a schema are errors in their records."""
    both = _extracted(conversations)
    taken = both.where("kind = 'message'").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("call_id").alias("r"), F.col("name").alias("h"))
    if taken.isEmpty():
        return link(*turns_as_calls(conversations), schemas)
    m = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    plain = m.join(taken, [m.conv_id.eqNullSafe(taken.c), m.turn.eqNullSafe(taken.t), m.role == taken.r, F.md5(m.text.cast("binary")) == taken.h], "left_anti")
    return link(*(x.unionByName(y) for x, y in zip(_sides(both), turns_as_calls(plain), strict=True)), schemas)


ORACLE = """
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
named AS (
  SELECT *, last_value(CASE WHEN role = 'user' THEN 'turn-' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own,
         last_value(CASE WHEN role = 'user' THEN 'turn-' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM rows),
calls AS (SELECT conv_id, turn, own AS call_id, text, prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM named WHERE role = 'user'),
results AS (SELECT conv_id, own AS call_id, count(*) AS n, string_agg(CAST(to_json(text) AS VARCHAR), ',' ORDER BY turn, text) AS texts FROM named WHERE role = 'assistant' AND own IS NOT NULL GROUP BY ALL),
alone AS (SELECT conv_id, role || '-' || coalesce(CAST(turn AS VARCHAR), 'none') AS call_id, min(turn) AS turn, count(*) AS n, string_agg(CAST(to_json(text) AS VARCHAR), ',' ORDER BY turn, text) AS texts FROM named WHERE role <> 'user' AND NOT (role = 'assistant' AND own IS NOT NULL) GROUP BY ALL)
SELECT c.conv_id, c.call_id, c.turn, CASE WHEN n IS NULL THEN 'unanswered' ELSE 'answered' END AS status, 0 AS level, CAST(position AS INTEGER) AS position,
  CAST(coalesce(n, 0) AS INTEGER) AS n_results, length(text) > 0 AS valid, CASE WHEN length(text) > 0 THEN '' ELSE '$.prompt: length 0' END AS errors,
  '{"after":[' || coalesce('"' || prev || '"', '') || '],"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || '},"id":"' || c.call_id || '","name":"reply","results":[' || coalesce(texts, '') || ']}' AS json
FROM calls c LEFT JOIN results r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.call_id = r.call_id
UNION ALL
SELECT a.conv_id, a.call_id, a.turn, 'orphan', -1, CAST(coalesce((SELECT count(*) FROM calls c WHERE c.conv_id IS NOT DISTINCT FROM a.conv_id), 0) + row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn, a.call_id) - 1 AS INTEGER),
  CAST(a.n AS INTEGER), false, 'no such call', '{"after":[],"arguments":null,"id":' || CAST(to_json(a.call_id) AS VARCHAR) || ',"name":null,"results":[' || a.texts || ']}'
FROM alone a
"""
