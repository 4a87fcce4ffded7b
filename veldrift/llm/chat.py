"""Chat formatting: tool calls are linked to their results, ordered, validated and written as canonical JSON.

A message calls tools if its text is a JSON object with ``tool_calls`` (a list) or is one call itself: ``id``, ``name``,
``arguments`` (these two alone or in ``function``) and optionally ``after``, the identifiers of calls whose results it
needs. A message of role ``tool`` is a result if its text is a JSON object with ``tool_call_id``. Calls and results are
joined by conversation and identifier. ``as_calls`` turns plain conversations into such messages.

Order is topological: by depth (a call after the calls it names, a result after its call), then turn, then place. Depths
come from joins, not from a walk over a conversation: chains of single dependencies double the length of their links in
each round, and only calls that wait for several others go level by level. So no task holds a conversation, and a row is
one message, call or result.

Defined results: null or plain text is an ordinary message, and so is what is not strict JSON: NaN and Infinity, numbers
beyond double precision's range, nesting deeper than Python's reader goes. Of repeated keys the last counts; a lone
surrogate stays an escape. Of calls or results with the same identifier the first by turn is linked and the others are
marked; calls in a cycle or behind one have depth null and status ``cycle``; repeated rows are repeated; an empty table
gives no rows.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: JSON types of a schema as Python types.
TYPES = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None),
}

PART = "kind string, item int, call_id string, name string, after array<string>, valid boolean, problems string, json string"


SURROGATE = re.compile("[\ud800-\udfff]")


def writable(text: str) -> str:
    """A text with its lone surrogates, which UTF-8 cannot hold, as escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces and no escapes but the needed ones."""
    return writable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def strict(text: str) -> Any:
    """The value of a JSON text; a ValueError for constants that JSON does not have."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def alike(a: Any, b: Any) -> bool:
    """Equal as JSON: true is not 1, but 1.0 is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(alike, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(alike(a[k], b[k]) for k in a)
    return a == b


def problems(arguments: Any, schema: Any, at: str = "$") -> list[str]:
    """What is wrong with arguments under a JSON schema (type, required, properties, items, enum)."""
    if not isinstance(schema, dict):
        return []
    kind = schema.get("type")
    kinds = [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str) and k in TYPES]
    whole = int(arguments) if isinstance(arguments, float) and arguments.is_integer() else arguments
    is_kind = lambda k: isinstance(whole if k == "integer" else arguments, TYPES[k]) and not (k in ("integer", "number") and isinstance(arguments, bool))
    out = [] if not kinds or any(map(is_kind, kinds)) else [f"{at}: not of type {' or '.join(kinds)}"]
    if isinstance(schema.get("enum"), list) and not any(alike(arguments, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(arguments, dict):
        needed, known = schema.get("required"), schema.get("properties")
        out += [f"{at}.{k}: missing" for k in (needed if isinstance(needed, list) else []) if isinstance(k, str) and k not in arguments]
        for k, v in sorted(arguments.items()):
            out += problems(v, known.get(k) if isinstance(known, dict) else None, f"{at}.{k}")
    if isinstance(arguments, list) and "items" in schema:
        for i, v in enumerate(arguments):
            out += problems(v, schema["items"], f"{at}[{i}]")
    return out


def _object(text: str | None) -> dict | None:
    """A text's JSON object, if it is one."""
    try:
        data = strict(text) if text and text.lstrip()[:1] == "{" else None
    except (ValueError, RecursionError):
        return None
    return data if isinstance(data, dict) else None


def stated_schemas(texts: Iterable[str]) -> dict[str, Any]:
    """Tools that system messages state: JSON objects with ``tools``, a list of {name, parameters}, alone or in the
    common form {type, function: {name, parameters}}. The first statement of a name counts."""
    out: dict[str, Any] = {}
    for text in texts:
        tools = (_object(text) or {}).get("tools")
        for tool in tools if isinstance(tools, list) else []:
            tool = tool.get("function", tool) if isinstance(tool, dict) else None
            if isinstance(tool, dict) and isinstance(tool.get("name"), str):
                out.setdefault(tool["name"], tool.get("parameters"))
    return out


def parts_of(role: str | None, text: str | None, schemas: dict[str, Any], stated: bool = False) -> list[dict]:
    """A message's parts: its content and calls, its result, or the message itself. ``stated``: a tool without a schema
    is unknown even if there are no schemas."""
    try:
        return _parts(role, text, _object(text), schemas, stated)
    except (ValueError, RecursionError):  # what can be read but not written: infinite numbers, deep nesting
        return _parts(role, text, None, schemas, stated)


def _parts(role: str | None, text: str | None, data: dict | None, schemas: dict[str, Any], stated: bool) -> list[dict]:
    if role == "tool" and data is not None and isinstance(data.get("tool_call_id"), str):
        body = {"role": "tool", "tool_call_id": data["tool_call_id"], "content": data.get("content")}
        return [_part("result", 0, data["tool_call_id"], json_=canonical(body))]
    calls = None
    if data is not None:
        alone = {"id", "name", "arguments"} <= set(data) or ("id" in data and isinstance(data.get("function"), dict))
        calls = data.get("tool_calls", [data] if alone else None)
    has_id = lambda c: isinstance(c, dict) and isinstance(c.get("id"), str)
    if not isinstance(calls, list) or not any(map(has_id, calls)):
        return [_part("message", 0, json_=canonical({"role": role, "content": text}))]
    out = []
    if data.get("content") not in (None, ""):
        out.append(_part("message", -1, json_=canonical({"role": role, "content": data["content"]})))
    for i, c in enumerate(calls):
        if not has_id(c):
            out.append(_part("call", i, found=["no id"], json_=canonical({"role": role, "tool_call": c})))
            continue
        of = c["function"] if isinstance(c.get("function"), dict) else c
        args, name = of.get("arguments"), of.get("name")
        found: list[str] = []
        if isinstance(args, str):
            try:
                args = strict(args)
            except (ValueError, RecursionError):
                found = ["$: not JSON"]
        if not isinstance(name, str):
            found, name = [*found, "no name"], None
        elif (schemas or stated) and name not in schemas:
            found.append("unknown tool")
        found += problems(args, schemas.get(name))
        after = [x for x in c.get("after") or [] if isinstance(x, str)] if isinstance(c.get("after"), list) else []
        body = {"role": role, "tool_call": {"id": c["id"], "name": name, "arguments": args}}
        out.append(_part("call", i, c["id"], name, after, found, canonical(body)))
    return out


def _part(kind: str, item: int, call_id: str | None = None, name: str | None = None, after: list[str] | None = None, found: list[str] | None = None, json_: str = "") -> dict:
    found = found or []
    plain = lambda t: None if t is None else writable(t)
    return {
        "kind": kind, "item": item, "call_id": plain(call_id), "name": plain(name), "after": [writable(x) for x in after or []],
        "valid": not found, "problems": writable("; ".join(found)), "json": json_,
    }


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None, stated: bool = False) -> DataFrame:
    """One row per message, call or result: conv_id, turn, item, role, kind, call_id, name, depth, status, valid,
    problems, json. Reading a conversation by (depth, turn, item) puts every call before what needs it.

    status: ``message``; of calls ``linked``, ``no_result``, ``repeated_id`` or ``cycle``; of results ``linked``,
    ``no_call``, ``repeated_id`` or ``early`` (before its call's turn, linked all the same); of calls without a text
    identifier ``no_id``. A content beside calls is a message of item -1.

    ``stated``: a conversation's system messages state its tools (``stated_schemas``), beside ``schemas``; any other is
    an unknown tool.
    """
    schemas = schemas or {}

    @F.pandas_udf(f"array<struct<{', '.join(f'{f.split()[0]}:{f.split()[1]}' for f in PART.split(', '))}>>")
    def parts(roles: pd.Series, texts: pd.Series, tools: pd.Series) -> pd.Series:
        read: dict[tuple, dict] = {}
        out = []
        for r, t, said in zip(roles, texts, tools, strict=True):
            key = () if said is None else tuple(said)
            if key not in read:
                read[key] = stated_schemas(key) | schemas
            out.append(parts_of(r, t, read[key], stated))
        return pd.Series(out)

    # A null conversation is one like any other.
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    messages = messages.select(conv, "conv_id", "turn", "role", "text")
    m = messages.withColumn("tools", F.lit(None).cast("array<string>"))
    if stated:
        said = messages.filter((F.col("role") == "system") & F.ltrim("text").startswith("{") & F.col("text").contains('"tools"'))
        said = said.groupBy("conv").agg(F.array_sort(F.collect_set(F.struct("turn", "text"))).alias("s")).select("conv", F.col("s.text").alias("said"))
        said = stored(said, "tools")
        if not said.isEmpty():
            held = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
            asks = m.filter(held).drop("tools").join(said, "conv", "left").withColumnRenamed("said", "tools")
            m = m.filter(~held).unionByName(asks)
    place = ["conv", "conv_id", "turn", "role"]
    rows = m.select(*place, F.explode(parts("role", "text", "tools")).alias("p")).select(*place, "p.*")
    rows = stored(rows, "parts")
    plain = rows.filter("kind = 'message' or call_id is null").select(
        "conv_id", "turn", "item", "role", "kind", "call_id", "name", F.lit(0).alias("depth"), F.when(F.col("kind") == "call", "no_id").otherwise("message").alias("status"), "valid", "problems", "json"
    )
    linked = rows.filter("kind <> 'message' and call_id is not null")
    if linked.isEmpty():
        return plain
    order = W.partitionBy("conv", "kind", "call_id").orderBy("turn", "item", "json")
    linked = stored(linked.withColumn("nth", F.row_number().over(order)), "linked")
    calls = linked.filter("kind = 'call' and nth = 1").select("conv", "call_id", F.col("turn").alias("call_turn"), "after")
    results = linked.filter("kind = 'result' and nth = 1").select("conv", "call_id", F.lit(True).alias("answered"))
    depths = call_depths(calls.select(F.col("conv").alias("conv_id"), "call_id", "after")).withColumnRenamed("conv_id", "conv")
    key = ["conv", "call_id"]
    out = linked.join(calls.drop("after"), key, "left").join(results, key, "left").join(depths, key, "left")
    call = F.col("kind") == "call"
    status = (
        F.when(F.col("nth") > 1, "repeated_id")
        .when(call & F.col("call_depth").isNull(), "cycle")
        .when(call, F.when(F.col("answered"), "linked").otherwise("no_result"))
        .when(F.col("call_turn").isNull(), "no_call")
        .when(F.col("turn") < F.col("call_turn"), "early")
        .otherwise("linked")
    )
    depth = F.when(call, F.col("call_depth")).otherwise(F.coalesce(F.col("call_depth") + 1, F.lit(0)))
    return plain.unionByName(
        out.select("conv_id", "turn", "item", "role", "kind", "call_id", "name", depth.cast("int").alias("depth"), status.alias("status"), "valid", "problems", "json")
    )


def conversation_json(formatted: DataFrame, rows: int = 1000) -> DataFrame:
    """Canonical JSON arrays of ``format_chats``' rows: (conv_id, part, json, n), in order of depth, turn and item.

    A part holds ``rows`` consecutive rows of a conversation's order, so parts one after another are that order, and no
    task gathers a long conversation: rows are numbered within ranges of the order, and a small table has the numbers
    before each range.
    """
    by = ["none", "conv_id", "late", "turn", "item", "json"]
    d = formatted.withColumns({"none": F.col("conv_id").isNull(), "late": F.coalesce("depth", F.lit(2**30))}).select(*by)
    d = stored(d.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    of = ["none", "conv_id"]
    sums = d.groupBy("range", *of).agg(F.count(F.lit(1)).alias("n"))
    several = W.partitionBy(*of).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(several), F.lit(0))).filter("before > 0").drop("n")  # conversations cut by ranges
    d = d.withColumn("at", F.row_number().over(W.partitionBy("range", *of).orderBy("late", "turn", "item", "json")))
    match = (d["range"] == before["range"]) & d["conv_id"].eqNullSafe(before["conv_id"])
    d = d.join(before, match, "left").select(d["conv_id"], "at", "json", ((d["at"] - 1 + F.coalesce("before", F.lit(0))) / rows).cast("long").alias("part"))
    grouped = d.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "json"))).alias("rows"))
    joined = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("]"))
    return grouped.select("conv_id", "part", joined.alias("json"), F.size("rows").alias("n"))


#: The tool of ``as_calls``.
REPLY = {"reply": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}}}


def as_calls(messages: DataFrame) -> DataFrame:
    """Plain conversations as calls of the tool ``reply`` (``REPLY``), for tables that hold no calls of their own.

    A turn of the assistant is a call, named by conversation and turn, whose arguments are its text and turn; it comes
    after the call two turns before. Any other turn but the first is the result of the call one turn before. A message
    that is a JSON object already stays as it is, and so does the first turn of another role.
    """
    name = lambda turn: F.concat_ws("-", F.lit("reply"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    body = F.struct(name(turn).alias("id"), F.lit("reply").alias("name"), F.struct("text", "turn").alias("arguments"), F.array(name(turn - 2)).alias("after"))
    call = F.to_json(body, {"ignoreNullFields": "false"})
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content")), {"ignoreNullFields": "false"})
    own = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    kind = F.when(own | turn.isNull(), "own").when(F.col("role") == "assistant", "call").when(turn > 0, "result").otherwise("own")
    m = messages.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    text = F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(F.col("text"))
    return m.select("conv_id", "turn", F.when(F.col("kind") == "result", "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def call_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, call_depth): twice the longest chain of calls that a call comes after; calls in or behind a
    cycle are absent."""
    ids = calls.select("conv_id", "call_id")
    edges = stored(
        calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before"))
        .join(calls.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi"),
        "edges",
    )
    key = ["conv_id", "call_id"]
    waits = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("up"))
    # Calls after one other: links to it, doubled until they reach a call after none or several.
    single = stored(waits.filter("n = 1").drop("n"), "single")
    known = single.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("live"))
    links = stored(single.join(known, ["conv_id", "up"], "left").select(*key, "up", F.lit(1).cast("long").alias("far"), F.coalesce("live", F.lit(False)).alias("live")), "links")
    ended = links.filter("not live")
    total, reach = single.count(), 1
    while reach <= total and not links.filter("live").isEmpty():
        ahead = links.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("live").alias("live2"))
        moved = links.filter("live").join(ahead, ["conv_id", "up"]).select(*key, F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), F.col("live2").alias("live"))
        links = stored(moved.unionByName(links.filter("not live")), "links")
        ended, reach = links.filter("not live"), 2 * reach
    # Calls after several: level by level, over the ends of the chains that they wait for.
    several = edges.join(waits.filter("n > 1").select(*key), key, "left_semi")
    chain = ended.select("conv_id", F.col("call_id").alias("before"), "up", "far")
    several = several.join(chain, ["conv_id", "before"], "left").select(*key, F.coalesce("up", "before").alias("before"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    several = stored(several.groupBy(*key, "before").agg(F.max("far").alias("far")), "several")
    done = stored(ids.join(edges, key, "left_anti").withColumn("depth", F.lit(0).cast("long")), "depths")
    left = several
    for level in itertools.count(1):
        if left.isEmpty():
            break
        met = left.join(done.select("conv_id", F.col("call_id").alias("before"), "depth"), ["conv_id", "before"], "left")
        ready = met.groupBy(*key).agg(F.max(F.col("depth") + F.col("far")).alias("depth"), F.count("depth").alias("known"), F.count(F.lit(1)).alias("all"))
        ready = stored(ready.filter("known = all").select(*key, "depth"), "ready")
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        left = left.join(ready.select(*key), key, "left_anti")
        if level % 8 == 0:
            done, left = stored(done, "depths"), stored(left, "several")
    end = done.select("conv_id", F.col("call_id").alias("up"), "depth")
    chained = ended.join(end, ["conv_id", "up"]).select(*key, (F.col("depth") + F.col("far")).alias("depth"))
    return done.unionByName(chained).select(*key, (2 * F.col("depth")).cast("int").alias("call_depth"))
