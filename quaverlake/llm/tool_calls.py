"""Chat formatting: links tool calls with their results, orders them, validates arguments and writes canonical JSON.

Calls and results are joined by (conversation, call id). A call may name calls that it comes after. The order is topological
and as near to the turns as that allows: a call's key is the larger of (its turn, 0) and, over the calls before it, (their turn, their
depth + 1). First the latest turn that a call waits for is found: each call takes one of the calls before it as its next step, and steps are doubled until no turn changes, so
that chains and rings take rounds by the logarithm of their length; a look at all edges then shows whether another choice of steps knows a later turn. Then calls that wait for one of the same turn are peeled off in rounds, each once no such call before it is left; the round is the depth.
Where all calls before stand in earlier turns, which is the rule, neither part needs more than a look at the edges. What can't be peeled lies on a cycle or behind it, within the cycle's latest turn.

Positions take two steps, counts of turn ranges and row numbers inside a range, so a conversation that holds a third of all rows is not one task.
Arguments are validated against JSON Schema (type, enum, const, required, properties, additionalProperties, items, minItems, maxItems, minimum, maximum,
minLength, maxLength, pattern). Tools are definitions, a bounded parameter. Messages are JSON with sorted keys (by UTF-16 units), no spaces and
shortest numbers, as in RFC 8785; halves of surrogate pairs that stand alone are escaped. The first row of an id is found by partial minima over `SALTS` groups, so that many rows of one id are no one task.

Defined results, one row per call and per result that no call claims: status is linked, unanswered, orphan (a result without a call), repeated (a later call of the same id: it
has no result and its own position), cycle (kept at its turn) or unnamed (a null id: never linked). Of several results of an id the first by turn, then content, counts, the others
are orphans. A null conversation is a conversation of its own. Arguments that are null or no JSON are an error and stay as text. Names of calls before that do not exist are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table, uncut

RANGE = 64
SALTS = 64
LONE = re.compile("[\ud800-\udfff]")


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" in text:
        mantissa, exponent = text.split("e")
        n = int(exponent)
        if -7 < n < 0:
            return f"{x:.{len(mantissa.replace('-', '').replace('.', '')) - 1 - n}f}"
        return f"{mantissa}e{'+' if n > 0 else '-'}{abs(n)}"
    return text


def _escaped(text: str) -> str:
    """Halves of surrogate pairs that stand alone have no UTF-8, so they are written as escapes."""
    return text if text.isascii() else LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_escaped(json.dumps(k, ensure_ascii=False))}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return _escaped(json.dumps(value, ensure_ascii=False))


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None, "number": number, "integer": number and value == int(value)}.get(kind, False)


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with value, each as path: reason."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    same = canonical(value)
    if "enum" in schema and same not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the values")
    if "const" in schema and same != canonical(schema["const"]):
        out.append(f"{at}: not the value")
    if _is(value, "number"):
        out += [f"{at}: {word} {k}" for k, word, bad in (("minimum", "below", lambda m: value < m), ("maximum", "above", lambda m: value > m)) if k in schema and bad(schema[k])]
    if isinstance(value, str):
        out += [f"{at}: {word}" for k, word, bad in (("minLength", "too short", lambda m: len(value) < m), ("maxLength", "too long", lambda m: len(value) > m), ("pattern", "does not match", lambda m: not re.search(m, value))) if k in schema and bad(schema[k])]
    if isinstance(value, list):
        out += [f"{at}: {word}" for k, word, bad in (("minItems", "too few items", lambda m: len(value) < m), ("maxItems", "too many items", lambda m: len(value) > m)) if k in schema and bad(schema[k])]
        if "items" in schema:
            out += [e for i, x in enumerate(value) for e in validate(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in sorted(value.items()):
            if k in own:
                out += validate(x, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += validate(x, schema["additionalProperties"], f"{at}.{k}")
    return out


def _no_constant(name: str):
    raise ValueError(name)


def _write(batches: Iterator[pa.RecordBatch], tools: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    """Replaces name, arguments and content by errors and the message."""
    for batch in batches:
        errors, messages = [], []
        for call_id, name, arguments, content, status in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content", "status")), strict=True):
            if status == "orphan":
                errors.append([])
                messages.append(canonical({"id": call_id, "result": content}))
                continue
            wrong = []
            try:
                value = json.loads(arguments, parse_constant=_no_constant) if arguments is not None else None
                text = canonical(value)
                if name not in tools:
                    wrong.append("$: unknown tool")
                else:
                    wrong += map(_escaped, validate(value, tools[name]))
            except (ValueError, RecursionError):
                value, text = None, canonical(arguments)
                wrong.append("$: arguments are not JSON")
            errors.append(wrong)
            messages.append('{"arguments":' + text + ',"id":' + canonical(call_id) + ',"name":' + canonical(name) + ',"result":' + canonical(content) + "}")
        rest = [c for c in batch.schema.names if c not in ("name", "arguments", "content")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(errors, pa.list_(pa.string())), pa.array(messages, pa.string())], [*rest, "errors", "message"])


def _doubled(steps: DataFrame) -> DataFrame:
    """Each call takes over what its next step knows, and steps twice as far: after k times it knows the 2^k calls along its steps."""
    there = steps.select("conv", F.col("call_id").alias("next"), F.col("at").alias("low"), F.col("next").alias("after_next"))
    met = steps.join(there, ["conv", "next"], "left")
    return met.select("conv", "call_id", "turn", F.greatest("at", "low").alias("at"), F.col("after_next").alias("next"), (F.col("raised") | F.coalesce(F.col("low") > F.col("at"), F.lit(False))).alias("raised"))


def order_keys(calls: DataFrame) -> DataFrame:
    """(conv, call_id, at, depth, cycle) of calls (conv, call_id, turn, after), ids being unique in a conversation."""
    nodes = cut(calls.select("conv", "call_id", "turn", F.col("turn").alias("at")))
    edges = calls.select("conv", "call_id", F.explode(F.array_distinct("after")).alias("before")).where("before is not null")
    edges = cut(edges.join(nodes.select("conv", F.col("call_id").alias("before")), ["conv", "before"]))
    before = lambda *columns: nodes.select("conv", F.col("call_id").alias("before"), *columns)
    while True:
        # Of the calls before a call, the one that is held back longest is its next step.
        longest = edges.join(before("at"), ["conv", "before"]).groupBy("conv", "call_id").agg(F.max(F.struct(F.col("at").alias("low"), F.col("before").alias("next"))).alias("step"))
        steps = cut(nodes.join(longest, ["conv", "call_id"], "left").select("conv", "call_id", "turn", F.greatest("at", "step.low").alias("at"), "step.next", F.coalesce(F.col("step.low") > F.col("at"), F.lit(False)).alias("raised")))
        uncut(nodes)
        if steps.where("raised").isEmpty():
            nodes = steps
            break
        while not steps.where("raised").isEmpty():
            old, steps = steps, cut(_doubled(_doubled(steps.withColumn("raised", F.lit(False)))))
            uncut(old)
        nodes = steps
    # Edges whose two ends are held back to the same turn: only these make a call deeper.
    tight = cut(edges.join(before(F.col("at").alias("held")), ["conv", "before"]).join(nodes.select("conv", "call_id", "at"), ["conv", "call_id"]).where("held = at").select("conv", "call_id", "before"))
    peeled, depth, left = None, 0, tight.select("conv", "call_id").distinct().count()
    while left:
        depth += 1
        waiting = tight.select("conv", "call_id").distinct()
        still = cut(tight.join(waiting.withColumnRenamed("call_id", "before"), ["conv", "before"], "left_semi").select("conv", "call_id", "before"))
        now = still.select("conv", "call_id").distinct()
        if (rest := now.count()) == left:
            break
        gone = waiting.join(now, ["conv", "call_id"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        old, peeled = peeled, cut(gone if peeled is None else peeled.unionByName(gone))
        uncut(tight, *([old] if old is not None else []))
        tight, left = still, rest
    stuck = tight.select("conv", "call_id").distinct().withColumns({"depth": F.lit(0).cast("long"), "cycle": F.lit(True)})
    told = stuck if peeled is None else stuck.unionByName(peeled.withColumn("cycle", F.lit(False)))
    out = nodes.join(told, ["conv", "call_id"], "left").withColumns({"cycle": F.coalesce("cycle", F.lit(False)), "depth": F.coalesce("depth", F.lit(0).cast("long"))})
    return out.select("conv", "call_id", F.when(F.col("cycle"), F.col("turn")).otherwise(F.col("at")).alias("at"), "depth", "cycle")


def _first_and_rest(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each (conv, call_id) and all others. Rows get numbers that are stored with them, so that one of equal rows is the first."""
    held = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    salt = F.pmod("uid", F.lit(SALTS)).alias("salt")
    low = held.select("conv", "call_id", salt, F.struct(*order, "uid").alias("place")).groupBy("conv", "call_id", "salt").agg(F.min("place").alias("low"))
    low = low.groupBy("conv", "call_id").agg(F.min("low")["uid"].alias("first"), F.collect_list("salt").alias("salts"))
    marked = held.select("*", salt).join(low.select("conv", "call_id", "first", F.explode("salts").alias("salt")), ["conv", "call_id", "salt"])
    marked = cut(marked.select(*rows.columns, (F.col("uid") == F.col("first")).alias("is_first")))
    uncut(held)
    return marked.where("is_first").drop("is_first"), marked.where("not is_first").drop("is_first")


def link_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """calls: conv_id, call_id, turn, name, arguments (JSON text), after (ids of calls before it); results: conv_id, call_id, turn, content.

    Returns conv_id, call_id, seq (place in the conversation, from 1), status, errors and message."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    tie = F.xxhash64("name", "arguments")
    call = calls.select(conv.alias("conv"), "conv_id", "call_id", turn.alias("turn"), "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"), tie.alias("tie"))
    first, later = _first_and_rest(call.where("call_id is not null"), "turn", "tie")
    result = results.select(conv.alias("conv"), "conv_id", "call_id", turn.alias("turn"), "content")
    answer, extra = _first_and_rest(result.where("call_id is not null"), "turn", "content")
    # Later calls of an id and later results of an id stand alone; a call's first row takes the first result.
    taken = answer.select("conv", "call_id", "content", F.lit("linked").alias("status"))
    unclaimed = answer.join(first.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
    first = first.join(taken, ["conv", "call_id"], "left").withColumn("status", F.coalesce("status", F.lit("unanswered")))
    empty = lambda kind: F.lit(None).cast(kind)
    as_rows = lambda df, name, arguments, content, status: df.select("conv", "conv_id", "call_id", "turn", name, arguments, content, F.array().cast("array<string>").alias("after"), F.xxhash64(*[c for c in ("name", "arguments", "content") if c in df.columns]).alias("tie"), F.lit(status).alias("status"))
    nothing = empty("string").alias("content")
    rest = as_rows(later, F.col("name"), F.col("arguments"), nothing, "repeated")
    rest = rest.unionByName(as_rows(call.where("call_id is null"), F.col("name"), F.col("arguments"), nothing, "unnamed"))
    shown = lambda df: df.select("conv", "conv_id", "call_id", "turn", "content")
    lost = shown(unclaimed).unionByName(shown(extra)).unionByName(shown(result.where("call_id is null")))
    rest = rest.unionByName(as_rows(lost, empty("string").alias("name"), empty("string").alias("arguments"), F.col("content"), "orphan"))
    keys = order_keys(first.select("conv", "call_id", "turn", "after"))
    rows = first.join(keys, ["conv", "call_id"]).withColumn("status", F.when(F.col("cycle"), "cycle").otherwise(F.col("status"))).drop("cycle", "after")
    rows = cut(rows.unionByName(rest.drop("after").withColumns({"at": F.col("turn"), "depth": F.lit(0).cast("long")})).withColumn("range", F.floor(F.col("at") / RANGE)))
    counts = rows.groupBy("conv", "range").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("skip"))
    within = Window.partitionBy("conv", "range").orderBy("at", "depth", "turn", F.col("call_id").asc_nulls_last(), "status", "tie")
    placed = rows.withColumn("k", F.row_number().over(within)).join(offsets, ["conv", "range"]).withColumn("seq", F.col("k") + F.col("skip"))
    ready = placed.select(F.col("conv_id").cast("string").alias("conv_id"), "call_id", "seq", "status", "name", "arguments", "content")
    out = ready.mapInArrow(lambda it: _write(it, tools), "conv_id string, call_id string, seq long, status string, errors array<string>, message string")
    return out.withColumn("conv_id", F.col("conv_id").cast(calls.schema["conv_id"].dataType))


TOOLS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 12}, "limit": {"type": "integer", "minimum": 1, "maximum": 400}}},
    "lookup": {"type": "object", "required": ["key", "limit"], "properties": {"key": {"type": "string", "pattern": r"^\w"}, "limit": {"type": "integer"}}},
    "compute": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "maxLength": 60}, "limit": {"type": "number", "maximum": 500}}},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as turns of a conversation: an assistant's turn is a call that sends its whole text, a user's turn is the result of the call before it, and a turn of
    any other role, or none, is a result turn-<role>-<turn>, which no call claims. Which tool and which calls come before follows from the texts and turns;
    every fourth call waits for the one after it."""
    name_of = F.array(*map(F.lit, [*TOOLS, "unknown"]))
    text = F.coalesce(F.col("text"), F.lit(""))
    pick = F.crc32(text.cast("binary"))
    place = F.floor(F.col("turn") / 2) % 4
    key = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    arguments: Column = F.to_json(F.struct(text.alias("query"), F.when(pick % 5 != 0, F.length(text)).alias("limit"), F.when(pick % 3 == 0, F.substring_index(text, " ", 1)).alias("key")))
    arguments = F.when(pick % 50 == 7, F.substring(arguments, F.lit(1), F.length(arguments) - 1)).otherwise(arguments)
    after = F.when(place == 1, F.array(key(F.col("turn") + 2))).when(place == 2, F.array().cast("array<string>")).otherwise(F.array(key(F.col("turn") - 2)))
    calls = conversations.where("role = 'assistant'").select("conv_id", key(F.col("turn")).alias("call_id"), "turn", F.get(name_of, (pick % 4).cast("int")).alias("name"), arguments.alias("arguments"), after.alias("after"))
    role = F.coalesce("role", F.lit(""))
    answered = F.when(role == "user", key(F.col("turn") - 1)).otherwise(F.concat(F.lit("turn-"), role, F.lit("-"), F.col("turn").cast("string")))
    results = conversations.where(role != "assistant").select("conv_id", answered.alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*calls_of(table(spark, sf_dir, "conversations")), TOOLS)
