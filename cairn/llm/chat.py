"""Operator 4, chat formatting: tool calls linked to their results.

Messages may be JSON objects with `tool_calls` (id, name, arguments) or with `tool_call_id`, or both. Calls and results are
hash-joined by conversation and identifier. A message has one call at most that it answers, so the links are chains; they are put in
topological order by pointer jumping, in as many rounds as the longest chain has binary digits. Arguments are checked against
the tools' schemas and every message becomes one canonical JSON line (sorted keys, no blanks). Lines carry their order, so no
conversation is ever gathered in a task.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.shared import cut, cut_small, table

#: JSON schemas of the tools that the query knows, by name.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def clean(text: str) -> str:
    """`text` with U+FFFD for each half of a surrogate pair that stands alone, which has no UTF-8."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(value) -> str:
    return clean(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def loads(text: str):
    """The JSON value; ValueError also for numbers that are not finite, in whatever spelling."""

    def number(digits: str) -> float:
        value = float(digits)
        if not math.isfinite(value):
            raise ValueError(digits)
        return value

    return json.loads(text, parse_float=number, parse_constant=number)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in `value` breaks a JSON schema of type, properties, required, additionalProperties, items and enum."""
    kind = schema.get("type")
    number = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)
    if kind in ("number", "integer"):
        if not number or kind == "integer" and value != int(value):
            return [f"{at}: not {kind}"]
    elif kind is not None and not isinstance(value, _TYPES[kind]):
        return [f"{at}: not {kind}"]
    out = [f"{at}: not listed"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


def parse_message(text: str | None, tools: dict) -> dict:
    """content, calls [{id, name, arguments, errors}] and result_of of a message; a text that is no such object is plain content."""
    plain = {"content": text or "", "calls": [], "result_of": None}
    if not text or not text.lstrip().startswith("{"):
        return plain
    try:
        value = loads(text)
        if not isinstance(value, dict) or not ("tool_calls" in value or "tool_call_id" in value):
            return plain
        content, own = value.get("content"), value.get("tool_call_id")
        out = {"content": clean(content) if isinstance(content, str) else "" if content is None else canonical(content), "calls": [], "result_of": clean(own) if isinstance(own, str) else None}
        calls = value.get("tool_calls")
        for call in calls if isinstance(calls, list) else []:
            call = call if isinstance(call, dict) else {}
            inner = call.get("function") if isinstance(call.get("function"), dict) else call
            name, arguments = inner.get("name"), inner.get("arguments", {})
            name = clean(name) if isinstance(name, str) else ""
            errors = []
            if isinstance(arguments, str):
                try:
                    arguments = loads(arguments)
                except (ValueError, RecursionError):
                    errors = ["$: not JSON"]
            if not errors:
                errors = violations(arguments, tools[name]) if name in tools else ["unknown tool"]
            out["calls"].append({"id": clean(call["id"]) if isinstance(call.get("id"), str) else None, "name": name, "arguments": canonical(arguments), "errors": [clean(e) for e in errors]})
        return out
    except (ValueError, RecursionError):
        return plain


def chain_order(links: DataFrame) -> DataFrame:
    """(id, order_turn, order_step, cyclic) of links (id, turn, parent, parent_turn): each id once, parent is another message, a link itself or not.

    Down a chain, a message keeps its turn if that is later than all before it, else it stands at the latest of them, one step further for each
    message since. A stretch of a chain is its latest turn, the steps since and its length, and stretches are joined two by two. Links on a
    cycle do not count: those messages keep their turn, and what hangs on them is ordered from there.
    """
    links = cut_small(links)

    def join(first, then):
        later = then["most"] > first["most"]
        return F.struct(F.when(later, then["most"]).otherwise(first["most"]).alias("most"), F.when(later, then["steps"]).otherwise(first["steps"] + then["length"]).alias("steps"), (first["length"] + then["length"]).alias("length"))

    def one(turn):
        return F.struct(turn.alias("most"), F.lit(0).alias("steps"), F.lit(1).alias("length"))

    def jump(rows: DataFrame) -> DataFrame:
        """Pointers doubled until none is left, or none can be but on cycles."""
        known = rows.select(F.col("id").alias("known"))
        rows = rows.join(known, rows.parent == known.known, "left")
        own, root = one(F.col("turn")), one(F.col("parent_turn"))
        rows = cut_small(rows.select("id", F.col("known").alias("next"), F.when(F.col("known").isNull(), join(root, own)).otherwise(own).alias("part")))
        for _ in range(rows.count().bit_length() + 1):
            if rows.where("next is not null").isEmpty():
                break
            ahead = rows.select(F.col("id").alias("next"), F.struct("next", "part").alias("ahead"))
            rows = rows.join(ahead, "next", "left")
            rows = cut_small(rows.select("id", F.col("ahead.next").alias("next"), F.when(F.col("ahead").isNotNull(), join(F.col("ahead.part"), F.col("part"))).otherwise(F.col("part")).alias("part")))
        return rows

    rows = jump(links)
    cycle = rows.where("next is not null").select(F.col("next").alias("id")).distinct()
    if not cycle.isEmpty():
        cycle = cut_small(cycle)
        rows = jump(links.join(cycle, "id", "left_anti")).unionByName(links.join(cycle, "id", "left_semi").select("id", F.lit(None).cast("long").alias("next"), one(F.col("turn")).alias("part")))
    return rows.join(cycle.withColumn("cyclic", F.lit(True)), "id", "left").select("id", F.col("part.most").alias("order_turn"), F.col("part.steps").alias("order_step"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def chat_lines(messages: DataFrame, tools: dict = TOOLS, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row of `messages`: conv_id, turn, role, order_turn, order_step, link, n_calls, n_bad_calls, n_unanswered, line.

    (conv_id, order_turn, order_step, turn) is the order of the lines: every linked result comes behind its call, also down chains of messages
    that are both. link is null for ordinary messages, `linked` for a result with its call, `cycle` for one that answers what hangs on itself (it
    keeps its turn), `orphan` for one without a call. A call id used twice in a conversation belongs to the earliest turn. A result at or before
    its call's place moves behind it. Null roles and texts count as empty, null turns come first, a null conversation id is a
    conversation without links. Repeated rows are messages of their own. JSON with numbers that are not finite is plain text; halves of surrogate
    pairs become U+FFFD. An empty table gives an empty result; other columns play no part.
    """
    rows = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))

    def run(batches):
        import pyarrow as pa

        call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("errors", pa.list_(pa.string()))])
        for batch in batches:
            found = [parse_message(t.as_py(), tools) for t in batch.column(3)]
            more = [pa.array([f["content"] for f in found], pa.string()), pa.array([f["calls"] for f in found], pa.list_(call)), pa.array([f["result_of"] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], ["conv_id", "turn", "role", "content", "calls", "result_of"])

    schema = "conv_id long, turn long, role string, content string, calls array<struct<id string, name string, arguments string, errors array<string>>>, result_of string"
    # Parsed once, and written down, so that the numbers of the messages hold.
    parsed = cut(rows.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id()))
    at = F.coalesce("turn", F.lit(-(2**63)))
    calls = parsed.where("size(calls) > 0 and conv_id is not null").select("conv_id", at.alias("turn"), F.xxhash64("role", "content").alias("tie"), "id", F.explode("calls").alias("c")).where("c.id is not null")
    calls = calls.groupBy("conv_id", F.col("c.id").alias("call_id")).agg(F.min(F.struct("turn", "tie", F.col("c.name").alias("name"), "id")).alias("call"))
    results = parsed.where("result_of is not null").select("conv_id", F.col("result_of").alias("call_id"), "id", at.alias("turn"))
    linked = cut_small(results.join(calls, ["conv_id", "call_id"]).select("id", "turn", F.col("call.id").alias("parent"), F.col("call.turn").alias("parent_turn"), F.col("call.name").alias("name")))
    order = chain_order(linked.select("id", "turn", "parent", "parent_turn")).join(linked.select("id", "name"), "id")
    answered = results.select("conv_id", "call_id").distinct()
    open_ = calls.join(answered, ["conv_id", "call_id"], "left_anti").groupBy(F.col("call.id").alias("id")).agg(F.count("*").alias("n_unanswered"))
    # Few messages call or answer; the others skip the joins.
    plain = parsed.where("result_of is null and size(calls) = 0").withColumns({"order_turn": at, "order_step": F.lit(0), "cyclic": F.lit(False), "name": F.lit(None).cast("string"), "n_unanswered": F.lit(0).cast("long")})
    tied = parsed.where("result_of is not null or size(calls) > 0").join(order, "id", "left").join(open_, "id", "left")
    every = plain.unionByName(tied.withColumns({"order_turn": F.coalesce("order_turn", at), "order_step": F.coalesce("order_step", F.lit(0))}))
    bad = F.size(F.filter("calls", lambda c: F.size(c["errors"]) > 0))
    out = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    line = F.to_json(F.struct(
        F.col("content"), F.col("name"), F.coalesce("role", F.lit("")).alias("role"), F.col("result_of").alias("tool_call_id"), F.when(F.size("calls") > 0, out).alias("tool_calls"),
    ))
    link = F.when(F.col("cyclic"), "cycle").when(F.col("name").isNotNull(), "linked").when(F.col("result_of").isNotNull(), "orphan")
    return every.select(
        "conv_id", "turn", "role", F.nullif("order_turn", F.lit(-(2**63))).alias("order_turn"), "order_step", link.alias("link"),
        F.size("calls").alias("n_calls"), bad.alias("n_bad_calls"), F.coalesce("n_unanswered", F.lit(0).cast("long")).alias("n_unanswered"), line.alias("line"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_lines(table(spark, sf_dir, "conversations"))


#: For tables whose messages are plain texts, as the given ones are.
ORACLE = """
SELECT conv_id, turn, role, turn AS order_turn, 0 AS order_step, CAST(NULL AS VARCHAR) AS link, 0 AS n_calls, 0 AS n_bad_calls,
       CAST(0 AS BIGINT) AS n_unanswered,
       CAST(to_json({'content': coalesce(text, ''), 'role': coalesce(role, '')}) AS VARCHAR) AS line
FROM conversations
"""


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as an agent's: of each four turns the second calls a tool, the third answers it and the fourth answers the next call ahead of it."""
    t = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 4 == 1, F.concat(F.lit('{"content":null,"tool_calls":[{"id":"c'), t, F.lit('","name":"search","arguments":{"query":"q","limit":'), F.when(F.col("turn") % 8 == 1, "2").otherwise('"x"'), F.lit("}}]}")))
    text = text.when(F.col("turn") % 4 == 2, F.concat(F.lit('{"content":"r","tool_call_id":"c'), (F.col("turn") - 1).cast("string"), F.lit('"}')))
    text = text.when(F.col("turn") % 4 == 3, F.concat(F.lit('{"content":"s","tool_call_id":"c'), (F.col("turn") + 2).cast("string"), F.lit('"}')))
    rows = table(spark, sf_dir, "conversations").withColumn("text", text.otherwise("plain"))
    return chat_lines(rows).drop("line")


#: Calls and results by the rule of the turns; ids and turns meet in a join, as chains are one link long.
TOOL_ORACLE = """
WITH m AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 2 THEN turn - 1 WHEN 3 THEN turn + 2 END AS call FROM conversations),
c AS (SELECT DISTINCT conv_id, turn AS call FROM conversations WHERE turn % 4 = 1),
a AS (SELECT DISTINCT conv_id, call, true AS answered FROM m WHERE call IS NOT NULL),
f AS (SELECT conv_id, turn, count(*) AS n FROM conversations WHERE turn % 4 = 1 GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, CASE WHEN c.call >= m.turn THEN c.call ELSE m.turn END::BIGINT AS order_turn, CASE WHEN c.call >= m.turn THEN 1 ELSE 0 END AS order_step,
       CASE WHEN c.call IS NOT NULL THEN 'linked' WHEN m.call IS NOT NULL THEN 'orphan' END AS link, CASE WHEN m.turn % 4 = 1 THEN 1 ELSE 0 END AS n_calls,
       CASE WHEN m.turn % 8 = 5 THEN 1 ELSE 0 END AS n_bad_calls, CASE WHEN m.turn % 4 = 1 AND answered IS NULL THEN 1 ELSE 0 END::BIGINT AS n_unanswered
FROM m LEFT JOIN c USING (conv_id, call) LEFT JOIN a ON a.conv_id = m.conv_id AND a.call = m.turn
"""
