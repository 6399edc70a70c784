import json

import pytest

from taleweft.llm import chat

from ..oracle import assert_same, connect

SCHEMAS = {"add": {"required": ["x"], "properties": {"x": {"type": "integer"}, "y": {"type": ["number", "null"]}}, "additionalProperties": False}, "pick": {"properties": {"way": {"type": "string", "enum": ["up", "down"]}}}}


def call(*calls):
    return json.dumps({"content": None, "tool_calls": [dict(zip(("id", "name", "arguments", "after"), c, strict=False)) for c in calls]})


def result(id_, content="r"):
    return json.dumps({"tool_call_id": id_, "content": content})


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r["conv_id"], r["turn"]): r for r in chat.link(df, SCHEMAS, **kw).collect()}


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", 'say "hi" / \\ é\n'),
        (1, 1, "assistant", call(("a", "add", {"y": 2, "x": 1}), ("b", "add", '{"x": "no"}', ["a"]), ("c", "pick", {"way": "up"}, ["b", "a"]), ("d", "other", "{bad"))),
        (1, 2, "tool", result("b")), (1, 3, "tool", result("a")), (1, 4, "tool", result("a")), (1, 5, "tool", result("zz")),
        (1, 6, "assistant", call(("a", "pick", {"way": "left"}), ("e", "add", {"x": 1, "z": 1}))),
        (2, 0, "tool", result("p")), (2, 1, "assistant", call(("p", "add", {"x": 1, "y": None}))),
    ]
    got = run(spark, rows)
    told = {c["id"]: (c["status"], c["level"], c["valid"]) for c in got[1, 1]["calls"]}
    assert told == {"a": ("linked", 0, True), "b": ("linked", 1, False), "c": ("unanswered", 2, True), "d": ("unanswered", 0, None)}
    assert [(c["id"], c["status"], c["valid"]) for c in got[1, 6]["calls"]] == [("a", "repeated", False), ("e", "unanswered", False)]
    assert [got[1, t]["status"] for t in (2, 3, 4, 5)] == ["linked", "linked", "repeated", "orphan"]
    assert got[1, 3]["result_of"] == 1 and got[2, 0]["result_of"] == 1
    assert got[2, 1]["place"] < got[2, 0]["place"]  # the result comes first in the log, but after its call in order
    assert got[1, 0]["line"] == '{"content":"say \\"hi\\" / \\\\ é\\n","role":"user"}'
    line = json.loads(got[1, 1]["line"])
    assert line["tool_calls"][0] == {"arguments": {"x": 1, "y": 2}, "id": "a", "name": "add"} and line["tool_calls"][1]["arguments"] == {"raw": "{bad"}
    assert [c["id"] for c in line["tool_calls"]] == ["a", "d", "b", "c"]  # by level
    assert got[1, 1]["line"] == json.dumps(line, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert json.loads(got[1, 2]["line"]) == {"content": "r", "name": "add", "role": "tool", "tool_call_id": "b"}


def test_cycles_have_no_level(spark):
    got = run(spark, [(1, 0, "assistant", call(("a", "add", {}, ["b"]), ("b", "add", {}, ["a"]), ("c", "add", {}, ["b"]), ("d", "add", {}, ["nowhere"])))])
    assert {c["id"]: c["level"] for c in got[1, 0]["calls"]} == {"a": None, "b": None, "c": None, "d": 0}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "assistant", ""), (1, 1, "assistant", '{"tool_calls": []}'), (1, 2, "tool", "{}"), (1, 3, "assistant", "{not json"), (None, 0, "assistant", call(("a", "add", {"x": 1}))), (None, 1, "tool", result("a")), (1, 4, "assistant", call((None, "add", None)))]
    df = spark.createDataFrame(rows + rows[1:2], "conv_id long, turn long, role string, text string").withColumn("line", chat.F.lit("old"))
    out = chat.link(df, SCHEMAS).collect()
    assert len(out) == 9
    assert {r["kind"] for r in out if r["conv_id"] == 1 and r["turn"] < 4} == {"message"}
    assert [r["status"] for r in out if r["kind"] == "result"] == ["orphan"]
    assert chat.link(df.filter("false")).count() == 0


def test_query_equals_its_sql(spark, data):
    assert_same(chat.op10_tool_calls(spark, data), connect(data), chat.OP10_SQL)


def test_main_path_has_no_python(spark, data):
    plan = chat.op10_tool_calls(spark, data)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def log(rng, conv, n):
    """A conversation whose calls wait for earlier, later and missing ones, with repeated ids and results."""
    rows, ids = [], [f"c{i}" for i in range(n)]
    args = [{"query": "q"}, {"limit": 3, "query": "q é"}, {"query": 1}, {"url": "u", "method": "GET"}, {"url": "u", "method": "PUT", "z": [1, "a"]}, {"expression": "1", "precision": None}, {"x": 1}, "{bad", None, "[1]"]
    for turn in range(n):
        kind = rng.random()
        if kind < 0.2:
            rows.append((conv, turn, "user", rng.choice(["hello", "", "{", 'say "x"\n', None])))
        elif kind < 0.6:
            made = [(rng.choice([*ids, None]), rng.choice(["search", "fetch", "calculate", "other"]), rng.choice(args), rng.sample(ids, rng.choice([0, 0, 1, 1, 2])) or None) for _ in range(rng.randint(1, 3))]
            rows.append((conv, turn, "assistant", call(*made)))
        else:
            rows.append((conv, turn, "tool", result(rng.choice([*ids, "zz"]), rng.choice(["r", None]))))
    return rows


def brute(rows):
    """(levels of calls, order of messages) of one conversation, by definition."""
    first, answer = {}, {}
    for _, turn, role, text in rows:
        m = json.loads(text) if text and text.startswith('{"') else {}
        for n, c in enumerate(m.get("tool_calls", [])) if role == "assistant" else ():
            if c["id"] is not None and c["id"] not in first:
                first[c["id"]] = (turn, n, [x for x in c.get("after") or []])
        if role == "tool":
            answer.setdefault(m["tool_call_id"], turn)
    waits = {i: {x for x in a if x in first} for i, (_, _, a) in first.items()}

    def level(i, open_=()):
        if i in open_:
            return None
        found = [level(x, (*open_, i)) for x in waits[i]]
        return None if None in found else max((x + 1 for x in found), default=0)

    return first, answer, waits, {i: level(i) for i in first}


def test_levels_and_order_by_definition(spark):
    import random

    rng = random.Random(3)
    for conv in range(6):
        rows = log(rng, conv, 9)
        got = run(spark, rows)
        first, answer, waits, levels = brute(rows)
        told = {c["id"]: c["level"] for r in got.values() for c in r["calls"] or () if c["id"] and c["status"] != "repeated"}
        assert told == levels
        order = [r["turn"] for r in sorted(got.values(), key=lambda r: r["place"])]
        on = {}
        for i, found in waits.items():
            on.setdefault(first[i][0], set()).update(first[x][0] for x in found if first[x][0] != first[i][0])

        def cyclic(turn, open_=()):
            return turn in open_ or any(cyclic(x, (*open_, turn)) for x in on.get(turn, ()))

        for i, found in waits.items():
            if not cyclic(first[i][0]):
                for x in found:
                    if first[x][0] != first[i][0]:
                        assert order.index(first[x][0]) < order.index(first[i][0])
                        assert x not in answer or order.index(answer[x]) < order.index(first[i][0])
        for i, turn in answer.items():
            if i in first:
                assert order.index(first[i][0]) < order.index(turn)


def test_a_long_chain_takes_few_steps(spark):
    import time

    n = 600
    calls = [(f"k{i}", "search", {"query": "q"}, [f"k{i + 1}"] if i + 1 < n else None) for i in range(n)]  # each waits for the next one
    began = time.perf_counter()
    got = run(spark, [(1, 0, "assistant", call(*calls)), (2, 0, "assistant", call(("k1", "search", {}, ["k1"])))])
    assert [c["level"] for c in got[1, 0]["calls"]] == list(range(n - 1, -1, -1)) and got[2, 0]["calls"][0]["level"] is None
    assert [c["id"] for c in json.loads(got[1, 0]["line"])["tool_calls"]] == [f"k{i}" for i in range(n - 1, -1, -1)]
    assert time.perf_counter() - began < 90


def test_very_long_texts(spark):
    body = "x" * 3_000_000
    got = run(spark, [(1, 0, "user", body), (1, 1, "assistant", call(("a", "add", {"x": 1, "y": 2.5, "z": body}))), (1, 2, "tool", result("a", body))])
    assert got[1, 0]["line"] == json.dumps({"content": body, "role": "user"}, separators=(",", ":"))
    assert len(got[1, 2]["line"]) > len(body) and got[1, 1]["calls"][0]["valid"] is False


def test_sql_gives_the_same_for_calls(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(8)
    rows = [r for conv in range(30) for r in log(rng, conv, rng.randint(1, 10))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert_same(chat.op10_tool_calls(spark, str(tmp_path)), con, chat.OP10_SQL)


@pytest.fixture(autouse=True)
def _quiet(spark):
    spark.sparkContext.setLogLevel("ERROR")
