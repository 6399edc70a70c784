"""Chat formatting with tool calls linked to their results, in DataFrame functions only.

An assistant message whose text is a JSON object with ``tool_calls`` (a list of ``id``,
``name``, ``arguments`` and, if it waits for other calls, ``after``: their ids) makes calls;
a message of role ``tool`` whose text is an object with ``tool_call_id`` gives a result. Any
other text is a plain message. Calls and results are joined on conversation and id, calls
are ordered topologically (a call after the calls it waits for, a result after its call),
arguments are checked against schemas, and each message becomes one canonical JSON line:
keys sorted, no spaces, calls in topological order, results carry the name of what they answer.

A row stays a message, so that no conversation has to fit a row or a task. All that meets by
key is combined first (the first call and the first result of an id), so a key of any size
is split over tasks. Levels take a few joins for each doubling of the longest chain: pairs
that are 2^k steps apart are found from those 2^(k-1) apart, and the level of a call is then
read off from the greatest k down.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_hash, stored, without

MESSAGE = "struct<content: string, tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>, tool_call_id: string>"
#: JSON schema types by the names that Spark gives the types of a variant.
KINDS = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def _valid(name: Column, arguments: Column, schemas: dict[str, dict[str, Any]]) -> Column:
    """True or false by the schema of the name; null for an unknown name."""
    value = F.try_parse_json(arguments)
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    out = F.lit(None).cast("boolean")
    for tool, schema in schemas.items():
        properties = schema.get("properties", {})
        ok = fields.isNotNull()
        for key in schema.get("required", []):
            ok &= F.coalesce(F.map_contains_key(fields, key), F.lit(False))
        for key, rule in properties.items():
            kinds = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
            pattern = "^(" + "|".join(KINDS[k] for k in kinds) + ")$"
            given = F.coalesce(F.map_contains_key(fields, key), F.lit(False))
            ok &= ~given | F.coalesce(F.schema_of_variant(fields[key]).rlike(pattern), F.lit("null" in kinds))
            if "enum" in rule:
                ok &= ~given | F.coalesce(F.to_json(fields[key]).isin([json.dumps(x, ensure_ascii=False) for x in rule["enum"]]), F.lit(False))
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(k) for k in properties]) if properties else F.array().cast("array<string>")
            ok &= F.coalesce(F.size(F.array_except(F.map_keys(fields), known)) == 0, F.lit(False))
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, id, level, time) of ``nodes`` (conv, id, time) by ``edges`` (conv, id, on, since).

    The level is the length of the longest chain behind a node, the time the latest of its own
    and of the times and ``since`` (of the edges) along all chains. Nodes on or behind a cycle
    have a null level and their own time. As a chain of n steps holds chains of all fewer, the
    length is found bit by bit.
    """
    steps = [stored(edges.groupBy("__conv", "__id", "__on").agg(F.max("__since").alias("__since")))]
    if steps[0].isEmpty():
        return nodes.withColumn("__level", F.lit(0))
    most = edges.select("__conv", "__id").distinct().groupBy("__conv").count().agg(F.max("count")).first()[0]
    latest = nodes  # of all that is fewer than 2^k steps behind
    while True:
        last = steps[-1]
        behind = last.join(latest.select("__conv", F.col("__id").alias("__on"), F.col("__time").alias("__then")), ["__conv", "__on"])
        behind = behind.groupBy("__conv", "__id").agg(F.max(F.greatest("__then", "__since")).alias("__then"))
        latest = stored(latest.join(behind, ["__conv", "__id"], "left").withColumn("__time", F.greatest("__time", "__then")).drop("__then"))
        if 1 << (len(steps) - 1) > most:
            break  # as many steps as that are a cycle's
        further = last.select("__conv", F.col("__id").alias("__on"), F.col("__on").alias("__far"), F.col("__since").alias("__also"))
        twice = last.join(further, ["__conv", "__on"]).groupBy("__conv", "__id", F.col("__far").alias("__on")).agg(F.max(F.greatest("__since", "__also")).alias("__since"))
        twice = stored(twice)
        if twice.isEmpty():
            break
        steps.append(twice)
    endless = None
    if 1 << (len(steps) - 1) > most:
        endless = stored(steps.pop().select("__conv", "__id").distinct())
    at = nodes.select("__conv", "__id", F.col("__id").alias("__on"), F.lit(0).alias("__level"))
    for k in range(len(steps) - 1, -1, -1):
        on = steps[k].select("__conv", F.col("__id").alias("__on"), F.col("__on").alias("__far"))
        moved = at.join(on, ["__conv", "__on"]).select("__conv", "__id", F.col("__far").alias("__on"), (F.col("__level") + (1 << k)).alias("__level")).distinct()
        at = stored(moved.unionByName(at.join(moved, ["__conv", "__id"], "left_anti")))
    found = latest.join(at.select("__conv", "__id", "__level").distinct(), ["__conv", "__id"])
    if endless is None:
        return found
    found = found.join(endless.withColumn("__endless", F.lit(True)), ["__conv", "__id"], "left").join(nodes.withColumnRenamed("__time", "__own"), ["__conv", "__id"])
    return found.select("__conv", "__id", F.when(F.col("__endless").isNull(), F.col("__level")).alias("__level"), F.when(F.col("__endless"), F.col("__own")).otherwise(F.col("__time")).alias("__time"))


def link(messages: DataFrame, schemas: dict[str, dict[str, Any]] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """All rows of ``messages`` without the text, with

    * ``kind``: message, calls, result;
    * ``calls``: array of struct(id, name, status, level, valid): status is linked, unanswered or
      repeated (an id is the first call's that has it), level is the topological level (null on
      a cycle), valid follows the schema of the name (null without one, false for arguments
      that aren't a JSON object);
    * ``result_of``: turn of the call that a result answers; ``status`` of a result: linked,
      repeated, or orphan (no such call);
    * ``place`` (array): sorts messages so that results follow their calls, and calls the
      results and calls they wait for; else messages keep their turns (as do messages of calls
      that wait for each other in a cycle);
    * ``line``: canonical JSON; calls are in order of their level (those on a cycle last).

    Null texts are null content; null conversations never link; null ids neither. Repeated
    rows are all kept. Input columns of the result's names are replaced.
    """
    names = ("kind", "calls", "result_of", "status", "place", "line")
    kept = without(messages, *names)
    base = kept.select(
        F.struct(*[f"`{c}`" for c in kept.columns if c.lower() != text.lower()]).alias("__row"), row_hash(kept, 11).alias("__key"), F.col(conv).cast("string").alias("__conv"),
        F.col(turn).cast("long").alias("__turn"), F.col(role).cast("string").alias("__role"), F.col(text).alias("__text"),
    )
    parsed = base.withColumn("__m", F.when(F.ltrim("__text").startswith("{") & F.try_parse_json("__text").isNotNull(), F.from_json("__text", MESSAGE)))
    is_calls = F.coalesce((F.col("__role") == "assistant") & (F.size("__m.tool_calls") > 0), F.lit(False))
    is_result = F.coalesce((F.col("__role") == "tool") & F.col("__m.tool_call_id").isNotNull(), F.lit(False))
    parsed = parsed.withColumn("__kind", F.when(is_calls, "calls").when(is_result, "result").otherwise("message"))

    asked = parsed.filter("__kind = 'calls'").select("__key", "__conv", "__turn", F.posexplode("__m.tool_calls").alias("__n", "__call"))
    asked = asked.select("__key", "__conv", "__turn", "__n", F.col("__call.id").alias("__id"), F.col("__call.name").alias("__name"), F.col("__call.arguments").alias("__args"), F.col("__call.after").alias("__after"))
    asked = asked.dropDuplicates(["__key", "__n"])  # equal rows make one call
    at = F.struct("__turn", "__key", "__n")
    firsts = stored(asked.filter("__id IS NOT NULL AND __conv IS NOT NULL").groupBy("__conv", "__id").agg(F.min(at).alias("__first"), F.min_by("__name", at).alias("__first_name"), F.min_by("__after", at).alias("__first_after")))
    answered = parsed.filter("__kind = 'result' AND __conv IS NOT NULL").groupBy("__conv", F.col("__m.tool_call_id").alias("__id")).agg(F.min(F.struct("__turn", "__key")).alias("__answer"))
    pairs = stored(firsts.join(answered, ["__conv", "__id"], "left"))
    waits = firsts.select("__conv", "__id", F.col("__first.__turn").alias("__turn"), F.col("__first.__key").alias("__key"), F.explode("__first_after").alias("__on"))
    met = pairs.select("__conv", F.col("__id").alias("__on"), F.col("__first.__key").alias("__to"), F.coalesce("__answer.__turn", "__first.__turn").alias("__since"))
    edges = stored(waits.join(met, ["__conv", "__on"]))
    timed = pairs.select("__conv", "__id", F.col("__first.__turn").alias("__time"))
    levels = _levels(timed, edges.select("__conv", "__id", "__on", "__since")).select("__conv", "__id", "__level")
    linked = pairs.join(levels, ["__conv", "__id"], "left")
    # the same for messages, each of which makes one or more calls
    said = pairs.select("__conv", F.col("__first.__key").alias("__id"), F.col("__first.__turn").alias("__time")).distinct()
    places = _levels(said, edges.filter("__key <> __to").select("__conv", F.col("__key").alias("__id"), F.col("__to").alias("__on"), "__since"))
    places = stored(places.select(F.col("__id").alias("__said"), F.coalesce("__level", F.lit(0)).alias("__rank"), "__time"))

    valid = _valid(F.col("__name"), F.col("__args"), schemas or {})
    own = F.coalesce(F.col("__first") == at, F.lit(False))
    status = F.when(~own, "repeated").when(F.col("__answer").isNotNull(), "linked").otherwise("unanswered")
    status = F.when(F.col("__first").isNull(), "unanswered").otherwise(status)
    level = F.when(own, F.col("__level"))
    canonical = lambda x: F.when(x.isNotNull(), F.coalesce(F.to_json(F.try_parse_json(x)), F.to_json(F.struct(x.alias("raw")))))
    pair = lambda key, value: F.concat(F.lit(f'"{key}":'), F.coalesce(_quoted(value), F.lit("null")))
    call_line = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("__args")), F.lit("null")), F.lit(","), pair("id", F.col("__id")), F.lit(","), pair("name", F.col("__name")), F.lit("}"))
    late = F.when(F.col("__id").isNull() | F.col("__conv").isNull(), 0).otherwise(F.coalesce(level, F.lit((1 << 31) - 1)))
    told = F.struct(F.col("__n").alias("n"), F.col("__id").alias("id"), F.col("__name").alias("name"), status.alias("status"), level.alias("level"), valid.alias("valid"), late.alias("late"), call_line.alias("line"))
    per_message = asked.join(linked, ["__conv", "__id"], "left").groupBy("__key").agg(F.sort_array(F.collect_list(told)).alias("__told"))
    per_message = per_message.join(places, F.col("__key") == F.col("__said"), "left")

    rows = parsed.join(per_message, "__key", "left")
    by_result = pairs.select(F.col("__conv").alias("__c"), F.col("__id").alias("__i"), F.col("__first.__turn").alias("__call_turn"), F.col("__first.__key").alias("__s"), "__answer", "__first_name")
    by_result = by_result.join(places.select(F.col("__said").alias("__s"), F.col("__rank").alias("__call_rank"), F.col("__time").alias("__call_time")), "__s", "left")
    asks = F.when(F.col("__kind") == "result", F.col("__m.tool_call_id"))
    rows = rows.join(by_result, (F.col("__conv") == F.col("__c")) & (asks == F.col("__i")), "left")
    mine = F.coalesce(F.col("__answer") == F.struct("__turn", "__key"), F.lit(False))
    result_status = F.when(F.col("__kind") == "result", F.when(F.col("__i").isNull(), "orphan").when(mine, "linked").otherwise("repeated"))
    content = F.when(F.col("__kind") == "message", F.col("__text")).otherwise(F.col("__m.content"))
    in_order = F.transform(F.array_sort(F.transform("__told", lambda t: F.struct(t["late"].alias("late"), t["n"].alias("n"), t["line"].alias("line")))), lambda t: t["line"])
    calls_json = F.concat(F.lit("["), F.array_join(in_order, ","), F.lit("]"))
    line = F.concat(
        F.lit("{"), pair("content", content), F.when(F.col("__kind") == "result", F.concat(F.lit(","), pair("name", F.col("__first_name")))).otherwise(F.lit("")),
        F.lit(","), pair("role", F.col("__role")),
        F.when(F.col("__kind") == "result", F.concat(F.lit(","), pair("tool_call_id", F.col("__m.tool_call_id")))).otherwise(F.lit("")),
        F.when(F.col("__kind") == "calls", F.concat(F.lit(',"tool_calls":'), calls_json)).otherwise(F.lit("")), F.lit("}"),
    )
    linked_here = F.coalesce(result_status == "linked", F.lit(False))
    after = F.greatest("__turn", F.when(F.col("__kind") == "calls", F.col("__time")), F.when(linked_here, F.col("__call_time")))
    rank = F.coalesce(F.when(F.col("__kind") == "calls", F.col("__rank")), F.when(linked_here, F.col("__call_rank")), F.lit(0)).cast("long")
    place = F.array(after, rank, F.when(F.col("__kind") == "result", 1).otherwise(0).cast("long"), F.col("__turn"))
    calls = F.transform("__told", lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name"), t["status"].alias("status"), t["level"].alias("level"), t["valid"].alias("valid")))
    return rows.select("__row.*", F.col("__kind").alias("kind"), calls.alias("calls"), F.when(F.col("__kind") == "result", F.col("__call_turn")).alias("result_of"), result_status.alias("status"), place.alias("place"), line.alias("line"))


def _quoted(value: Column) -> Column:
    """A JSON string, null for null."""
    whole = F.to_json(F.struct(value.alias("v")))  # {"v":...}
    return F.when(value.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


#: Tools that the registered query knows; a call of another name is neither valid nor invalid.
TOOLS: dict[str, dict[str, Any]] = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "additionalProperties": False},
    "fetch": {"required": ["url"], "properties": {"url": {"type": "string"}, "method": {"type": "string", "enum": ["GET", "HEAD"]}}},
    "calculate": {"required": ["expression"], "properties": {"expression": {"type": "string"}, "precision": {"type": ["integer", "null"]}}, "additionalProperties": False},
}


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of conversations as a canonical line, with its calls, links, levels and checks.

    Nulls and ties as in link().
    """
    out = link(spark.read.parquet(f"{sf_dir}/conversations.parquet"), TOOLS)
    count = lambda found: F.coalesce(F.size(F.filter("calls", found)), F.lit(0)).cast("long")
    return out.select(
        "conv_id", "turn", "role", "kind", count(lambda c: F.lit(True)).alias("n_calls"), count(lambda c: c["status"] == "linked").alias("n_linked"), count(lambda c: c["valid"]).alias("n_valid"),
        count(lambda c: ~c["valid"]).alias("n_invalid"), F.array_join(F.transform("calls", lambda c: F.coalesce(c["level"].cast("string"), F.lit("-"))), ",").alias("levels"), "status", "result_of",
        F.array_join(F.col("place").cast("array<string>"), ":").alias("place"), "line",
    )


OP10_SQL = r"""
WITH RECURSIVE msg AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN ltrim(text) LIKE '{%' AND json_valid(text) THEN text::JSON END AS m
  FROM conversations
), typed AS (
  SELECT *, CASE WHEN role = 'assistant' AND json_array_length(m, '$.tool_calls') > 0 THEN 'calls'
                 WHEN role = 'tool' AND (m ->> '$.tool_call_id') IS NOT NULL THEN 'result'
                 ELSE 'message' END AS kind
  FROM msg
), listed AS (
  SELECT conv_id, turn, unnest(from_json(m -> '$.tool_calls', '["JSON"]')) AS c, generate_subscripts(from_json(m -> '$.tool_calls', '["JSON"]'), 1) - 1 AS n FROM typed WHERE kind = 'calls'
), asked AS (
  SELECT conv_id, turn, n, c ->> '$.id' AS id, c ->> '$.name' AS name, c -> '$.after' AS after_, c ->> '$.arguments' AS given,
         CASE WHEN json_valid(c ->> '$.arguments') THEN (c ->> '$.arguments')::JSON END AS args
  FROM listed
), first AS (
  SELECT * FROM asked WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, n) = 1
), answered AS (
  SELECT conv_id, m ->> '$.tool_call_id' AS id, min(turn) AS answer_turn FROM typed WHERE kind = 'result' GROUP BY ALL
), pair AS (
  SELECT f.*, a.answer_turn FROM first f LEFT JOIN answered a USING (conv_id, id)
), wait AS (
  SELECT w.conv_id, w.id, w.turn, w.on_, p.turn AS to_turn, coalesce(p.answer_turn, p.turn) AS since
  FROM (SELECT conv_id, id, turn, unnest(from_json(after_, '["VARCHAR"]')) AS on_ FROM first WHERE json_type(after_) = 'ARRAY') w JOIN pair p ON p.conv_id = w.conv_id AND p.id = w.on_
), size AS (
  SELECT conv_id, count(*) AS most FROM first GROUP BY 1
), chain AS (
  SELECT conv_id, id, id AS at, 0 AS steps FROM first
  UNION SELECT c.conv_id, c.id, w.on_, c.steps + 1 FROM chain c JOIN wait w ON w.conv_id = c.conv_id AND w.id = c.at JOIN size s ON s.conv_id = c.conv_id WHERE c.steps <= s.most
), leveled AS (
  SELECT conv_id, id, CASE WHEN max(steps) > any_value(most) THEN NULL ELSE max(steps) END AS level FROM chain JOIN size USING (conv_id) GROUP BY ALL
), apart AS (
  SELECT DISTINCT conv_id, turn, to_turn, since FROM wait WHERE turn <> to_turn
), story AS (
  SELECT DISTINCT conv_id, turn, turn AS at, 0 AS steps, turn AS time FROM first
  UNION SELECT c.conv_id, c.turn, w.to_turn, c.steps + 1, greatest(c.time, w.since, w.to_turn) FROM story c JOIN apart w ON w.conv_id = c.conv_id AND w.turn = c.at JOIN size s ON s.conv_id = c.conv_id WHERE c.steps <= s.most
), placed AS (
  SELECT conv_id, turn, CASE WHEN max(steps) > any_value(most) THEN 0 ELSE max(steps) END AS rank, CASE WHEN max(steps) > any_value(most) THEN turn ELSE max(time) END AS time
  FROM story JOIN size USING (conv_id) GROUP BY conv_id, turn
), kinds AS (
  SELECT conv_id, turn, n, list_transform(json_keys(args), lambda k: {'k': k, 't': json_type(json_extract(args, '$."' || k || '"')), 'v': json_extract(args, '$."' || k || '"')::VARCHAR}) AS f
  FROM asked WHERE json_type(args) = 'OBJECT'
), judged AS (
  SELECT a.*, CASE a.name
    WHEN 'search' THEN coalesce(len(list_filter(f, lambda x: x.k = 'query')) = 1 AND len(list_filter(f, lambda x: NOT ((x.k = 'query' AND x.t = 'VARCHAR') OR (x.k = 'limit' AND x.t IN ('BIGINT', 'UBIGINT'))))) = 0, false)
    WHEN 'fetch' THEN coalesce(len(list_filter(f, lambda x: x.k = 'url')) = 1 AND len(list_filter(f, lambda x: (x.k = 'url' AND x.t <> 'VARCHAR') OR (x.k = 'method' AND x.v NOT IN ('"GET"', '"HEAD"')))) = 0, false)
    WHEN 'calculate' THEN coalesce(len(list_filter(f, lambda x: x.k = 'expression')) = 1 AND len(list_filter(f, lambda x: NOT ((x.k = 'expression' AND x.t = 'VARCHAR') OR (x.k = 'precision' AND x.t IN ('BIGINT', 'UBIGINT', 'NULL'))))) = 0, false)
    END AS valid,
    CASE WHEN given IS NULL THEN 'null' WHEN args IS NULL THEN '{"raw":' || to_json(given)::VARCHAR || '}' WHEN f IS NULL THEN args::VARCHAR
         ELSE '{' || array_to_string(list_transform(list_sort(f), lambda x: to_json(x.k)::VARCHAR || ':' || x.v), ',') || '}' END AS canonical
  FROM asked a LEFT JOIN kinds k USING (conv_id, turn, n)
), told AS (
  SELECT j.*, CASE WHEN p.turn = j.turn AND p.n = j.n THEN l.level END AS level, coalesce(p.turn = j.turn AND p.n = j.n, false) AS own, p.answer_turn
  FROM judged j LEFT JOIN pair p ON p.conv_id = j.conv_id AND p.id = j.id LEFT JOIN leveled l ON l.conv_id = j.conv_id AND l.id = j.id
), per AS (
  SELECT conv_id, turn, count(*) AS n_calls, count(*) FILTER (own AND answer_turn IS NOT NULL) AS n_linked, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid,
         string_agg(coalesce(level::VARCHAR, '-'), ',' ORDER BY n) AS levels,
         string_agg('{"arguments":' || canonical || ',"id":' || coalesce(to_json(id)::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || '}', ',' ORDER BY CASE WHEN id IS NULL THEN 0 ELSE coalesce(level, 2147483647) END, n) AS calls
  FROM told GROUP BY ALL
), out AS (
  SELECT t.*, n.*, p.turn AS call_turn, p.name AS call_name, p.answer_turn, own.rank AS own_rank, own.time AS own_time, of_.rank AS call_rank, of_.time AS call_time,
         CASE WHEN t.kind = 'result' THEN CASE WHEN p.id IS NULL THEN 'orphan' WHEN p.answer_turn = t.turn THEN 'linked' ELSE 'repeated' END END AS state,
         CASE WHEN t.kind = 'message' THEN t.text ELSE t.m ->> '$.content' END AS content
  FROM typed t LEFT JOIN per n ON n.conv_id = t.conv_id AND n.turn = t.turn AND t.kind = 'calls'
  LEFT JOIN pair p ON t.kind = 'result' AND p.conv_id = t.conv_id AND p.id = t.m ->> '$.tool_call_id'
  LEFT JOIN placed own ON t.kind = 'calls' AND own.conv_id = t.conv_id AND own.turn = t.turn
  LEFT JOIN placed of_ ON of_.conv_id = p.conv_id AND of_.turn = p.turn AND p.answer_turn = t.turn
)
SELECT conv_id, turn, role, kind, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(n_valid, 0)::BIGINT AS n_valid, coalesce(n_invalid, 0)::BIGINT AS n_invalid,
       levels, state AS status, call_turn AS result_of,
       greatest(turn, coalesce(own_time, turn), coalesce(call_time, turn)) || ':' || coalesce(own_rank, call_rank, 0) || ':' || CASE WHEN kind = 'result' THEN 1 ELSE 0 END || ':' || turn AS place,
       '{"content":' || coalesce(to_json(content)::VARCHAR, 'null') || CASE WHEN kind = 'result' THEN ',"name":' || coalesce(to_json(call_name)::VARCHAR, 'null') ELSE '' END || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null')
         || CASE kind WHEN 'result' THEN ',"tool_call_id":' || to_json(m ->> '$.tool_call_id')::VARCHAR WHEN 'calls' THEN ',"tool_calls":[' || calls || ']' ELSE '' END || '}' AS line
FROM out
"""
