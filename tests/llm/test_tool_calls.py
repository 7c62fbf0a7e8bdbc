import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quaverlake.llm import tool_calls
from quaverlake.llm.shared import table
from quaverlake.llm.tool_calls import TOOLS, calls_of, canonical, link_calls, op1_tool_calls, order_keys, validate

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def brute(calls, results):
    """Statuses, and each conversation's calls in topological order nearest to the turns."""
    out = {}
    for c in calls:
        out.setdefault((c.conv_id, c.call_id), c)
    ids = {k: sorted(((r.turn, r.content) for r in results if (r.conv_id, r.call_id) == k), key=str) for k in out}
    keys = {}

    def key(k):
        if k not in keys:
            above = [key((k[0], b)) for b in out[k].after or [] if (k[0], b) in out]
            keys[k] = max([(out[k].turn, 0), *((a, d + 1) for a, d in above)])
        return keys[k]

    return {k: (key(k), "linked" if ids[k] else "unanswered") for k in out}


@pytest.mark.parametrize("value,text", [({"b": 1.0, "a": [True, None, "é\n"]}, '{"a":[true,null,"é\\n"],"b":1}'), (1e21, "1e+21"), (0.1, "0.1"), (1e-7, "1e-7"), (1.5e-6, "0.0000015"), (-0.0, "0"), ({"\U0001f600": 1, "דּ": 2}, '{"\U0001f600":1,"דּ":2}')])
def test_canonical(value, text):
    assert canonical(value) == text


def test_validate():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "b": {"type": "array", "items": {"enum": ["x", 1]}, "maxItems": 2}, "c": {"const": {"k": 1}}, "d": {"type": "string", "pattern": "^z", "minLength": 2}}}
    assert validate({"a": 2, "b": ["x", 1.0], "c": {"k": 1.0}, "d": "zz"}, s) == [] == validate({"a": None}, s)
    assert validate([], s) == ["$: not of type object"]
    assert validate({"b": ["y"] * 3, "c": 1, "d": "a", "e": 0}, s) == ["$.a: missing", "$.b: too many items", *[f"$.b[{i}]: not one of the values" for i in range(3)], "$.c: not the value", "$.d: too short", "$.d: does not match", "$.e: not allowed"]
    assert validate({"a": True}, s) == ["$.a: not of type integer|null"] and validate({"a": 1}, s) == ["$.a: below minimum"]


def test_orders_and_statuses(spark):
    calls = [
        (1, "a", 0, "search", '{"query": "long enough query"}', ["c"]), (1, "b", 1, "search", '{"query":"x"}', ["a", "zz"]), (1, "c", 2, "lookup", "{bad", None), (1, "d", 2, "nope", "{}", ["c"]),
        (1, "b", 5, "search", "{}", None), (1, None, 3, None, None, None), (2, "x", 0, "search", "[]", ["y"]), (2, "y", 1, "search", "{}", ["x"]), (2, "z", 2, "search", "{}", None), (None, "a", 0, "compute", '{"query": "q"}', None),
    ]
    results = [(1, "a", 1, "R"), (1, "a", 4, "late"), (1, "q", 9, "lost"), (2, "z", 3, None), (None, "a", 1, "n"), (None, None, 1, "m")]
    got = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.seq):
        by[r.conv_id].append((r.seq, r.call_id, r.status))
    assert [x[1:] for x in by[1]] == [("c", "unanswered"), ("a", "linked"), ("d", "unanswered"), ("b", "unanswered"), (None, "unnamed"), ("a", "orphan"), ("b", "repeated"), ("q", "orphan")]
    assert [x[1:] for x in by[2]] == [("x", "cycle"), ("y", "cycle"), ("z", "linked")]
    assert [x[1:] for x in by[None]] == [("a", "linked"), (None, "orphan")]
    assert all([x[0] for x in rows] == list(range(1, len(rows) + 1)) for rows in by.values())
    errors = {(r.conv_id, r.call_id, r.status): r.errors for r in got}
    assert errors[1, "c", "unanswered"] == ["$: arguments are not JSON"] and errors[1, "a", "linked"] == [] and errors[1, "d", "unanswered"] == ["$: unknown tool"]
    assert errors[2, "x", "cycle"] == ["$: not of type object"]
    text = {r.call_id: r.message for r in got if r.conv_id == 1 and r.status == "linked"}
    assert text["a"] == '{"arguments":{"query":"long enough query"},"id":"a","name":"search","result":"R"}'


def test_cycles_take_few_rounds(spark, monkeypatch):
    """Two calls that wait for each other, and one behind them, among ten thousand that follow the turns."""
    n, tables = 10_000, []
    real = tool_calls.cut
    monkeypatch.setattr(tool_calls, "cut", lambda df: tables.append(1) or real(df))
    after = {99: ["c100"], 100: ["c101"], 101: ["c100"]}
    calls = spark.createDataFrame([(1, f"c{i}", i, "compute", "{}", after.get(i, [f"c{i - 1}"] if i else None)) for i in range(n)], CALLS)
    got = order_keys(calls.withColumnRenamed("conv_id", "conv")).collect()
    assert {r.call_id for r in got if r.cycle} == {"c99", "c100", "c101"} and len(tables) < 14 and len(got) == n
    assert all((r.at, r.depth) == (int(r.call_id[1:]), 0) for r in got)


def test_rings_take_few_tables(spark, monkeypatch):
    """Rings whose calls wait for the one before and whose first waits for the last; a call behind a ring is held back with it."""
    tables = []
    real = tool_calls.cut
    monkeypatch.setattr(tool_calls, "cut", lambda df: tables.append(1) or real(df))
    for n in (2, 5, 16, 10_000):
        tables.clear()
        rows = [(1, f"c{i}", i, "compute", "{}", [f"c{(i - 1) % n}"]) for i in range(n)] + [(1, "behind", 0, "compute", "{}", ["c0", "early"]), (1, "early", 0, "compute", "{}", None), (2, "c0", 0, "compute", "{}", None)]
        got = {(r.conv, r.call_id): r for r in order_keys(spark.createDataFrame(rows, CALLS).withColumnRenamed("conv_id", "conv")).collect()}
        assert len(tables) < 20 and len(got) == n + 3
        assert {k for k, r in got.items() if r.cycle} == {(1, "behind"), *((1, f"c{i}") for i in range(n))}


@pytest.mark.parametrize("seed", range(3))
def test_random_orders(spark, seed):
    """Several calls before each, in any turns, without cycles: the keys are those of the definition."""
    rng = random.Random(seed)
    n = 60
    rank = rng.sample(range(n), n)
    calls = [Row(conv_id=1, call_id=f"c{i}", turn=rng.randrange(-1, 30), name="compute", arguments="{}", after=[f"c{rank[j]}" for j in rng.sample(range(k), min(k, rng.randrange(4)))]) for k, i in enumerate(rank)]
    got = order_keys(spark.createDataFrame(calls, CALLS).withColumnRenamed("conv_id", "conv")).collect()
    assert {(1, r.call_id): (r.at, r.depth) for r in got} == {k: key for k, (key, _) in brute(calls, []).items()} and not any(r.cycle for r in got)


def test_repeats_and_lone_surrogates(spark):
    calls = [(1, "a", 0, "search", r'{"query": "\ud800 is half of a pair", "\udfff": 1}', None)] * 3 + [(1, "a", 0, "search", "[]", None)] + [(1, "b", i % 3, "compute", "{}", None) for i in range(500)]
    results = [(1, "a", 1, "r")] * 2 + [(1, "b", 9, None), (1, "b", 9, "x")]
    got = link_calls(spark.createDataFrame(calls, CALLS).withColumn("n", F.lit(1)), spark.createDataFrame(results, RESULTS).withColumn("low", F.lit(1)), TOOLS).collect()
    count = Counter((r.call_id, r.status) for r in got)
    assert count == {("a", "linked"): 1, ("a", "repeated"): 3, ("a", "orphan"): 1, ("b", "linked"): 1, ("b", "repeated"): 499, ("b", "orphan"): 1}
    assert sorted(r.seq for r in got) == list(range(1, len(got) + 1))
    half = [r for r in got if "ud800" in r.message]
    assert len(half) == 3 and all(json.loads(r.message)["arguments"]["query"] == "\ud800 is half of a pair" for r in half) and half[0].errors == [r"$.\udfff: not allowed"]
    assert [json.loads(r.message)["result"] for r in got if r.call_id == "b" and r.status == "linked"] == [None]


def test_empty(spark):
    assert link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), TOOLS).collect() == []


def test_query_on_table(spark):
    d = "/root/testdata/sf0.01"
    calls, results = (x.collect() for x in calls_of(table(spark, d, "conversations")))
    got = op1_tool_calls(spark, d).collect()
    want = brute(calls, results)
    linked = [r for r in got if r.status != "orphan"]
    assert {(r.conv_id, r.call_id): r.status for r in linked} == {k: s for k, (_, s) in want.items()} and len(linked) == len(want)
    assert sum(r.status == "orphan" for r in got) == sum((r.conv_id, r.call_id) not in want for r in results)
    seq = {(r.conv_id, r.call_id): r.seq for r in linked}
    moved = 0
    for c in calls:
        for b in c.after:
            if (c.conv_id, b) in seq:
                assert seq[c.conv_id, b] < seq[c.conv_id, c.call_id]
                moved += int(b.split("-")[1]) > c.turn
    assert moved
    order = defaultdict(list)
    for k, s in sorted(seq.items(), key=lambda x: x[1]):
        order[k[0]].append(want[k][0])
    assert all(keys == sorted(keys) for keys in order.values())
    assert all(r.message == canonical(json.loads(r.message)) for r in got)
    sent = {(c.conv_id, c.call_id): c for c in calls}
    answered = {(r.conv_id, r.call_id): r.content for r in sorted(results, key=lambda r: (r.turn, str(r.content)), reverse=True)}
    for r in linked:
        c, m = sent[r.conv_id, r.call_id], json.loads(r.message)
        try:
            arguments = json.loads(c.arguments)
        except ValueError:
            arguments = c.arguments
        assert m == {"arguments": arguments, "id": c.call_id, "name": c.name, "result": answered.get((c.conv_id, c.call_id))}
    assert {e.split(": ")[1] for r in got for e in r.errors} >= {"arguments are not JSON", "unknown tool", "missing", "too long"}


def _whole(message):
    """(id, texts) of a message: the arguments' text, also where they are no JSON, and the result."""
    m = json.loads(message)
    sent = m.get("arguments")
    return m["id"], sent["query"] if isinstance(sent, dict) else json.loads(sent + "}")["query"] if sent else None, m["result"]


def test_each_turn_is_whole_in_a_message(spark):
    d = "/root/testdata/sf0.01"
    sent, answered = defaultdict(list), defaultdict(list)
    for r in op1_tool_calls(spark, d).collect():
        i, text, result = _whole(r.message)
        sent[r.conv_id, i].append(text)
        answered[r.conv_id, i].append(result)
    turns = table(spark, d, "conversations").collect()
    assert len({t.role for t in turns}) == 3
    for t in turns:
        if t.role == "assistant":
            assert t.text in sent[t.conv_id, f"call-{t.turn}"]
        else:
            assert t.text in answered[t.conv_id, f"call-{t.turn - 1}" if t.role == "user" else f"turn-{t.role}-{t.turn}"]


def test_turns_of_other_roles(spark):
    long = "one two three four five six seven eight nine ten"
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", long), (1, 3, "tool", "t"), (1, 4, None, "n"), (None, 0, "system", None), (1, None, "system", "when")]
    got = link_calls(*calls_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), TOOLS).collect()
    assert {(r.conv_id, r.call_id, r.status) for r in got} == {
        (1, "turn-system-0", "orphan"), (1, "call-0", "orphan"), (1, "call-2", "unanswered"), (1, "turn-tool-3", "orphan"), (1, "turn--4", "orphan"), (None, "turn-system-0", "orphan"), (1, None, "orphan"),
    }
    assert len(got) == len(turns)
    assert _whole(next(r.message for r in got if r.call_id == "call-2"))[1] == long
    assert {json.loads(r.message)["result"] for r in got if r.status == "orphan"} == {"be kind", "hi", "t", "n", None, "when"}
