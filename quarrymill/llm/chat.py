"""Tool calls in chats: calls and results linked, put in order, checked against schemas, and written as canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.base import arrow_schema, cut, table

#: Turns whose events one task numbers.
STRETCH = 4096
LATE = 1 << 62
#: Links of a conversation that one task puts in order; conversations with more are put in order round by round over all tasks.
LINKS = 100_000
NODE = "c long, kind string, id string, k long, d int, cyclic boolean"
EVENT = "conv_id long, turn long, kind string, id string, name string, body string, after array<string>"


def _number(x: float | int) -> str:
    """A JSON number as ECMAScript writes it; whole numbers keep all digits."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    if 1e-6 <= abs(x) < 1e21:
        return format(Decimal(repr(x)), "f")
    digits, _, exponent = repr(x).partition("e")
    return f"{digits.removesuffix('.0')}e{int(exponent):+d}"


def canonical(value: Any) -> str:
    """JSON without blanks, keys in order of their UTF-16 units, only the escapes that must be."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return _number(value)


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key twice")
    return out


def _no(text: str) -> Any:
    raise ValueError(f"{text} is no JSON number")


def parse(text: str) -> Any:
    """Strict JSON: no key twice, no NaN or infinity."""
    return json.loads(text, object_pairs_hook=_object, parse_constant=_no)


TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, (int, float)) and (kind == "number" or value == int(value))
    return isinstance(value, TYPES[kind])


def errors(value: Any, schema: dict[str, Any], at: str = "$") -> list[str]:
    """What is wrong with a value under a JSON schema: type, enum, bounds, lengths, properties, required, additionalProperties, items."""
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    out = [f"{at}: not one of the values allowed"] if "enum" in schema and not any(canonical(value) == canonical(v) for v in schema["enum"]) else []
    if _is(value, "number"):
        out += [f"{at}: below {low}" for low in [schema.get("minimum", value)] if value < low]
        out += [f"{at}: above {high}" for high in [schema.get("maximum", value)] if value > high]
    if isinstance(value, (str, list)):
        name = "Length" if isinstance(value, str) else "Items"
        out += [f"{at}: too short"] * (len(value) < schema.get(f"min{name}", 0)) + [f"{at}: too long"] * (len(value) > schema.get(f"max{name}", len(value)))
    if isinstance(value, list) and "items" in schema:
        out += [e for i, v in enumerate(value) for e in errors(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            more = own.get(k, schema.get("additionalProperties", True))
            out += [f"{at}.{k}: not allowed"] if more is False else [] if more is True else errors(v, more, f"{at}.{k}")
    return out


def checked(kind: str, id_: str | None, name: str | None, body: str | None, schemas: dict[str, dict]) -> tuple[bool, str, str]:
    """Whether an event is valid, what is wrong, and its canonical JSON. Only calls can be invalid: arguments that are no
    JSON, no known tool's, or break its schema; such arguments that are no JSON are written as a string."""
    if kind != "call":
        return True, "", canonical({"call_id": id_, "content": body, "type": "result"} if kind == "result" else {"content": body, "role": name, "type": "message"})
    try:
        arguments = parse(body or "")
        wrong = errors(arguments, schemas[name]) if name in schemas else [f"no tool {name}"]
        text = canonical({"arguments": arguments, "id": id_, "name": name, "type": "call"})
    except (ValueError, RecursionError) as e:
        arguments, wrong = body, [f"$: not JSON ({type(e).__name__})"]
        text = canonical({"arguments": body, "id": id_, "name": name, "type": "call"})
    return not wrong, "; ".join(wrong), text


def settled(t: list[int], before: list[int], after: list[int]) -> list[tuple[int, int, bool]]:
    """(k, d, cyclic) of nodes with turns t under links before -> after: a node's key is the greatest of its own (t, 0) and of
    (k, d + 1) of those before it. Who waits for a circle is never free; it keeps (t, 0) and is cyclic."""
    following: list[list[int]] = [[] for _ in t]
    waits, keys = [0] * len(t), [(x, 0) for x in t]
    for a, b in zip(before, after):
        following[a].append(b)
        waits[b] += 1
    free = [i for i, n in enumerate(waits) if not n]
    done = [False] * len(t)
    while free:
        i = free.pop()
        done[i] = True
        for j in following[i]:
            keys[j] = max(keys[j], (keys[i][0], keys[i][1] + 1))
            waits[j] -= 1
            if not waits[j]:
                free.append(j)
    return [(*k, False) if ok else (x, 0, True) for k, ok, x in zip(keys, done, t)]


def _in_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """settled() for each conversation, as NODE."""
    arrow = arrow_schema(nodes.sparkSession, NODE)

    def run(own: pa.Table, links: pa.Table) -> pa.Table:
        c, kind, id_, t = (own.column(n).to_pylist() for n in ("c", "kind", "id", "t"))
        at = {x: i for i, x in enumerate(zip(kind, id_))}
        before, after = ([at[x] for x in zip(links.column(a).to_pylist(), links.column(b).to_pylist())] for a, b in (("pk", "pid"), ("kind", "id")))
        found = settled(t, before, after)
        return pa.table([pa.array(x, f.type) for x, f in zip((c, kind, id_, *zip(*found)), arrow)], schema=arrow) if found else arrow.empty_table()

    return cut(nodes).groupBy("c").cogroup(cut(edges).groupBy("c")).applyInArrow(run, NODE)


def _in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same over all tasks: whoever waits for nobody is free, and tells those after it; as many rounds as the longest chain has links."""
    key = ["c", "kind", "id"]
    todo, left, done = cut(nodes.select(*key, "t", F.col("t").alias("k"), F.lit(0).alias("d"))), cut(edges), []
    while True:
        free = cut(todo.join(left.select(*key).distinct(), key, "left_anti").select(*key, "k", "d"))
        if free.isEmpty():
            break
        done.append(free.withColumn("cyclic", F.lit(False)))
        if len(done) == 16:  # else the plan would grow with the rounds
            done = [cut(reduce(DataFrame.unionByName, done))]
        who = free.select("c", F.col("kind").alias("pk"), F.col("id").alias("pid"), F.col("k").alias("fk"), (F.col("d") + 1).alias("fd"))
        told = left.join(who, ["c", "pk", "pid"]).groupBy(*key).agg(F.max(F.struct("fk", "fd")).alias("n"))
        todo = todo.join(free.select(*key), key, "left_anti").join(told, key, "left")
        later = F.col("n").isNotNull() & (F.struct(F.col("n.fk").alias("k"), F.col("n.fd").alias("d")) > F.struct("k", "d"))
        todo = cut(todo.select(*key, "t", F.when(later, F.col("n.fk")).otherwise(F.col("k")).alias("k"), F.when(later, F.col("n.fd")).otherwise(F.col("d")).alias("d")))
        left = cut(left.join(who.select("c", "pk", "pid"), ["c", "pk", "pid"], "left_anti"))
    done.append(todo.select(*key, F.col("t").alias("k"), F.lit(0).alias("d"), F.lit(True).alias("cyclic")))
    return reduce(DataFrame.unionByName, done)


def placed(nodes: DataFrame, edges: DataFrame, links: int = LINKS) -> DataFrame:
    """Who must move, or is cyclic, as NODE. nodes: (c, kind, id, t); edges: (c, pk, pid, kind, id), what comes before what.

    Where no link runs back in time, as in most conversations, turns are the order and there is no circle. Others are put in order
    by settled(), in one task each if they have few links, else over all tasks; there is no limit to chains either way.
    """
    by = lambda kind, id_, t: nodes.select("c", F.col("kind").alias(kind), F.col("id").alias(id_), F.col("t").alias(t))
    edges = edges.join(by("pk", "pid", "pt"), ["c", "pk", "pid"]).join(by("kind", "id", "st"), ["c", "kind", "id"])
    size = cut(edges.groupBy("c").agg(F.count("*").alias("size"), F.max(F.col("pt") >= F.col("st")).alias("back")).where("back").select("c", "size"))
    if size.isEmpty():
        return nodes.sparkSession.createDataFrame([], NODE)
    key, found = ["c", "pk", "pid", "kind", "id"], None
    for which in (f"size <= {links}", f"size > {links}"):
        few = size.where(which).select("c")
        if not few.isEmpty():
            out = (_in_tasks if "<=" in which else _in_rounds)(nodes.join(few, "c", "left_semi"), edges.join(few, "c", "left_semi").select(*key))
            found = out if found is None else found.unionByName(out)
    moved = found.join(nodes, ["c", "kind", "id"]).where("k <> t or d > 0 or cyclic")
    return cut(moved.select("c", "kind", "id", "k", "d", "cyclic"))


def linked(events: DataFrame, schemas: dict[str, dict], links: int = LINKS) -> DataFrame:
    """(conv_id, position, turn, kind, id, linked, call_turn, cyclic, valid, errors, json), a row for each event.

    events: see EVENT. A `call` has an id, a tool's name, arguments as JSON, and ids it comes `after`; a `result` names its
    call by id; a `message` has its role as name. Results meet calls in a join on (conv_id, id); where calls share an id the
    one with the least turn counts; a result without a call, and a call without a result, has linked = false. Positions are
    gapless from 0 in each conversation, by turn, but a result never stands before its call, nor a call before the results it
    comes after, however long the chain. Whoever waits in a circle, or for one, keeps to its turn and is marked cyclic. Null turns come last; a null conv_id is a
    conversation of its own; null ids link nothing; repeated rows stay. Conversations are numbered in stretches of turns, so
    no large one is ever in one task as a whole. Bodies of any length are read whole; an empty table gives no rows; other columns of
    events are not read.
    """
    spark = events.sparkSession
    own = events.select(F.coalesce("conv_id", F.lit(-LATE)).alias("c"), "conv_id", "turn", F.coalesce("turn", F.lit(LATE)).alias("t"), "kind", "id", "name", "body", "after")
    calls = own.where("kind = 'call' and id is not null").groupBy("c", "id").agg(F.min("t").alias("call_t"))
    answered = own.where("kind = 'result' and id is not null").select("c", "id").distinct().withColumn("answered", F.lit(True))
    own = own.join(calls, ["c", "id"], "left").join(answered, ["c", "id"], "left")
    own = own.withColumn("linked", F.when(F.col("kind") == "call", F.coalesce("answered", F.lit(False))).when(F.col("kind") == "result", F.col("call_t").isNotNull()))
    nodes = own.where("kind <> 'message' and id is not null").groupBy("c", "kind", "id").agg(F.min("t").alias("t"))
    edges = own.where("kind = 'result' and call_t is not null").select("c", F.lit("call").alias("pk"), F.col("id").alias("pid"), F.lit("result").alias("kind"), "id").unionByName(
        own.where("kind = 'call' and id is not null").select("c", F.lit("result").alias("pk"), F.explode("after").alias("pid"), F.lit("call").alias("kind"), "id")
    )
    late = placed(cut(nodes), cut(edges.where("pid is not null").distinct()), links)
    own = own.join(late, ["c", "kind", "id"], "left")
    own = own.withColumns({"k": F.greatest(F.coalesce("k", "t"), "t"), "d": F.coalesce("d", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))}).withColumn("part", F.expr(f"k div {STRETCH}"))
    count = own.groupBy("c", "part").count()
    start = count.withColumn("start", F.coalesce(F.sum("count").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = own.withColumn("i", F.row_number().over(Window.partitionBy("c", "part").orderBy("k", "d", "t", "kind", "id", "name", "body"))).join(start, ["c", "part"])
    numbered = numbered.select("conv_id", (F.col("start") + F.col("i") - 1).alias("position"), "turn", "kind", "id", F.coalesce("linked", F.lit(False)).alias("linked"), F.when(F.col("call_t") < LATE, F.col("call_t")).alias("call_turn"), "cyclic", "name", "body")
    schema = "conv_id long, position long, turn long, kind string, id string, linked boolean, call_turn long, cyclic boolean, valid boolean, errors string, json string"
    arrow = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, id_, name, body = (b.column(n).to_pylist() for n in ("kind", "id", "name", "body"))
            out = [checked(*x, schemas) for x in zip(kind, id_, name, body)]
            more = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(8)], *[pa.array(c, f.type) for c, f in zip(more, list(arrow)[8:])]], schema=arrow)

    return numbered.mapInArrow(run, schema)


#: The tool that a user's turn calls in the query below.
REPLY = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}}


def turns(conversations: DataFrame) -> DataFrame:
    """Events of plain conversations: a user's turn calls the tool `reply` with the prompt, after the call two turns before;
    the assistant's next turn is its result; other turns are messages."""
    text = F.coalesce("text", F.lit(""))
    call, result = F.col("role") == "user", F.col("role") == "assistant"
    quoted = F.to_json(F.struct(text.alias("prompt"), "turn"))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"),
        F.when(call, F.concat(F.lit("call-"), "turn")).when(result, F.concat(F.lit("call-"), F.col("turn") - 1)).alias("id"),
        F.when(call, F.lit("reply")).when(~result | result.isNull(), F.col("role")).alias("name"),
        F.when(call, quoted).otherwise(text).alias("body"),
        F.when(call, F.array(F.concat(F.lit("call-"), F.col("turn") - 2))).alias("after"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, a row for each turn: see turns and linked."""
    return linked(turns(table(spark, sf_dir, "conversations")), REPLY)


OP7_SQL = """
WITH e AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'call-' || turn WHEN 'assistant' THEN 'call-' || (turn - 1) END AS id, role, coalesce(text, '') AS text
  FROM conversations
), calls AS (SELECT conv_id, id, min(turn) AS call_turn FROM e WHERE kind = 'call' GROUP BY 1, 2),
results AS (SELECT DISTINCT conv_id, id FROM e WHERE kind = 'result')
SELECT e.conv_id, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.turn) - 1 AS position, e.turn, e.kind, e.id,
  CASE e.kind WHEN 'call' THEN r.id IS NOT NULL WHEN 'result' THEN c.id IS NOT NULL ELSE false END AS linked,
  c.call_turn, false AS cyclic, NOT (e.kind = 'call' AND e.text = '') AS valid,
  CASE WHEN e.kind = 'call' AND e.text = '' THEN '$.prompt: too short' ELSE '' END AS errors,
  CASE e.kind
    WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(e.text)::VARCHAR || ',"turn":' || e.turn || '},"id":"' || e.id || '","name":"reply","type":"call"}'
    WHEN 'result' THEN '{"call_id":"' || e.id || '","content":' || to_json(e.text)::VARCHAR || ',"type":"result"}'
    ELSE '{"content":' || to_json(e.text)::VARCHAR || ',"role":' || to_json(e.role)::VARCHAR || ',"type":"message"}' END AS json
FROM e LEFT JOIN calls c ON e.conv_id = c.conv_id AND e.id = c.id LEFT JOIN results r ON e.conv_id = r.conv_id AND e.id = r.id
"""
