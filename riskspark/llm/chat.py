"""Chat formatting with tool-call linking (operator 10).

Input: messages (conv_id, turn, role, text, tool_calls, tool_call_id).  ``tool_calls`` is a JSON array of
{"id", "name", "arguments", "after"}, arguments being a JSON object or its text and ``after`` the ids of
calls that must come first; rows of role ``tool`` answer the call named by ``tool_call_id``.

Calls and results meet by a hash join on (conversation, identifier).  Calls are ordered topologically by
joins on the identifiers alone, chains by pointer jumping (see ``levels``), so no conversation is gathered
in one task and rounds follow the logarithm of a chain's length.  Arguments are checked against the tool's JSON schema, and
every message and call becomes one line of canonical JSON (sorted keys, no spaces).

Results, one row per message and per call: conv_id, kind, turn, idx, level, call_id, status, errors, json.
  message  status ``ok``; ``bad_calls`` if tool_calls is not a JSON array; for role tool ``linked``,
           ``orphan`` (no such call) or ``extra`` (the call was answered before, by (turn, text))
  call     status ``linked``, ``unanswered``, ``duplicate`` (its id was used before in the conversation; it
           takes no result) or ``cycle`` (placed nowhere: level null, as is all that waits for it)
Arguments that are no JSON (NaN, Infinity and numbers beyond a double included) are an error and stay text;
lone surrogates stay escaped.  A predecessor that does not exist is an error of the call, not a wait.  Null conversation ids are one
conversation, null turns sort first, null roles and texts stay null in the JSON, a null call id never links.
Repeated rows: equal messages give equal lines; a repeated call is a duplicate.  Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_copies, stored

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


_LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """Lone surrogates, which no UTF-8 text can hold, written as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Sorted keys, no spaces, plain UTF-8; NaN and infinities are no JSON and raise ValueError."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_json(text: str):
    raise ValueError(f"not JSON: {text}")


def _number(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _no_json(text)


def parsed(text: str):
    """Value of a JSON text; NaN, Infinity and numbers beyond a double raise ValueError."""
    return json.loads(text, parse_constant=_no_json, parse_float=_number)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema`` (type, enum, required, properties, additionalProperties, items,
    minimum, maximum, minLength, maxLength)."""
    kind = schema.get("type")
    if kind:
        ok = isinstance(value, _TYPES[kind]) and not (kind in ("integer", "number") and isinstance(value, bool))
        if kind == "integer" and isinstance(value, float) and value.is_integer():
            ok = True
        if not ok:
            return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below the minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above the maximum")
    return out


def check_call(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[list[str], object]:
    """(errors, parsed arguments or None)."""
    try:
        value = parsed(arguments) if arguments is not None else {}
        if isinstance(value, str):  # arguments given as JSON text
            value = parsed(value)
    except (ValueError, RecursionError):
        return ["$: not JSON"], None
    if name not in schemas:
        return ["unknown tool"], value
    return violations(value, schemas[name]), value


def _calls(messages: DataFrame) -> DataFrame:
    kind = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
    return (messages.withColumn("parsed", F.from_json("tool_calls", kind))
            .select("conv_id", "turn", F.posexplode("parsed").alias("idx", "c"))
            .select("conv_id", "turn", "idx", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
                    F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after")))


def _same(a: str, b: str, *names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return cond


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of ``calls(conv_id, call_id, after)`` with unique ids per conversation, the
    level being the longest way from a call that waits for none; calls on or behind a cycle are left out.

    A call that waits for one call has a level of max(base, level of that call + step).  Such rules compose,
    so pointer jumping follows a chain of n calls in log2(n) stored rounds.  What then waits for several
    unplaced calls takes another phase: placed calls turn into the base, followed chains into longer steps.
    Phases follow how deep such joins nest.  A phase without a call that waits for none ends the work; a
    pointer that still jumps after log2(all pointers) rounds is on or behind a cycle."""
    nodes = calls.select("conv_id", F.col("call_id").alias("known"))
    waits = calls.select("conv_id", "call_id", F.explode_outer("after").alias("named")).alias("e")
    graph = stored(waits.join(nodes.alias("n"), F.col("e.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("e.named") == F.col("n.known")), "left")
                   .select("e.conv_id", "e.call_id", F.col("n.known").alias("dep"), F.lit(1).cast("long").alias("step"),
                           F.lit(0).cast("long").alias("base")).distinct(), "chat-graph")
    placed = []
    while not graph.isEmpty():
        node = graph.groupBy("conv_id", "call_id").agg(
            F.count("dep").alias("n"), F.max("dep").alias("to"), F.coalesce(F.max(F.when(F.col("dep").isNotNull(), F.col("step"))), F.lit(0)).alias("step"),
            F.max("base").alias("base"))
        rules = stored(node.filter("n < 2").select("conv_id", "call_id", "to", "step", "base", F.col("to").isNull().alias("final")), "chat-rules")
        total, moving, roots = _progress(rules)
        if not roots:
            break
        for _ in range(total.bit_length() + 1):
            if not moving:
                break
            rules = stored(_jump(rules), "chat-rules")
            _, moving, _ = _progress(rules)
        placed.append(rules.filter("final and to is null").select("conv_id", "call_id", F.col("base").cast("int").alias("level")))
        several = graph.join(node.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")),
                             F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left_semi").alias("g")
        followed = several.join(rules.filter("final").alias("r"), _points("g.dep"), "left").select(
            "g.conv_id", "g.call_id", F.when(F.col("r.call_id").isNull(), F.col("g.dep")).otherwise(F.col("r.to")).alias("dep"),
            (F.col("g.step") + F.coalesce("r.step", F.lit(0))).alias("step"),
            F.greatest("g.base", F.col("r.base") + F.col("g.step")).alias("base"))
        blocked = rules.filter("final and to is not null").select("conv_id", "call_id", F.col("to").alias("dep"), "step", "base")
        graph = stored(followed.unionByName(blocked).groupBy("conv_id", "call_id", "dep").agg(F.max("step").alias("step"), F.max("base").alias("base")),
                       "chat-graph")
    out = calls.select("conv_id", "call_id", F.lit(0).alias("level")).limit(0)
    for p in placed:
        out = out.unionByName(p)
    return out


def _points(to: str) -> Column:
    """``to`` names the rule ``r`` of the same conversation."""
    return F.col(to.split(".")[0] + ".conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col(to) == F.col("r.call_id"))


def _progress(rules: DataFrame) -> tuple[int, int, int]:
    """(rules, those that still move, those that wait for nothing)."""
    row = rules.agg(F.count(F.lit(1)), F.count_if(~F.col("final")), F.count_if(F.col("to").isNull())).first()
    return row[0], row[1], row[2]


def _jump(rules: DataFrame) -> DataFrame:
    """Every moving rule composed with the rule it points to; without one there (a call that waits for
    several, or a cycle found before) it is final as it is."""
    moving = rules.filter("not final").alias("m").join(rules.alias("r"), _points("m.to"), "left")
    there = F.col("r.call_id").isNotNull()
    return rules.filter("final").unionByName(moving.select(
        "m.conv_id", "m.call_id", F.when(there, F.col("r.to")).otherwise(F.col("m.to")).alias("to"),
        (F.col("m.step") + F.coalesce("r.step", F.lit(0))).alias("step"),
        F.greatest("m.base", F.col("r.base") + F.col("m.step")).alias("base"),
        F.when(there, F.col("r.final")).otherwise(F.lit(True)).alias("final")))


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """See the module's text."""
    m = messages.select("conv_id", "turn", "role", "text", "tool_calls", "tool_call_id")
    # a stored copy of what the joins need, so the parsing runs once
    calls = stored(_calls(m), "chat-calls")
    named = calls.filter(F.col("call_id").isNotNull())
    # the first use of an id by a pre-aggregated minimum, not by a window over a possibly hot id
    first = named.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "idx", "name", "arguments", "after")).alias("f"), F.count(F.lit(1)).alias("uses"))
    owners = stored(first.select("conv_id", "call_id", "f.*", "uses"), "chat-owners")
    results = m.filter(F.col("role") == "tool").select("conv_id", F.col("tool_call_id").alias("call_id"), "turn", "text")
    answered = (results.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id")
                .agg(F.min(F.struct("turn", "text")).alias("r")))
    level = levels(owners)
    linked = (owners.alias("o").join(answered.alias("a"), _same("o", "a", "conv_id", "call_id"), "left")
              .join(level.alias("l"), _same("o", "l", "conv_id", "call_id"), "left")
              .select("o.conv_id", "o.turn", "o.idx", "o.call_id", "o.name", "o.arguments", "o.after", "l.level",
                      F.col("a.r.text").alias("result"),
                      F.when(F.col("l.level").isNull(), "cycle").when(F.col("a.r").isNull(), "unanswered").otherwise("linked").alias("status")))
    again = (calls.alias("c").join(owners.filter("uses > 1").alias("o"), _same("c", "o", "conv_id", "call_id"))
             .select("c.*", _same("c", "o", "turn", "idx", "name", "arguments").alias("own")))
    copies = (again.groupBy("conv_id", "turn", "idx", "call_id", "name", "arguments", "after", "own").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("n", F.col("n") - F.col("own").cast("long")).filter("n > 0"))
    copies = spread_copies(copies, "n", "copy")
    duplicate = copies.select("conv_id", "turn", "idx", "call_id", "name", "arguments", "after", F.lit(None).cast("int").alias("level"),
                              F.lit(None).cast("string").alias("result"), F.lit("duplicate").alias("status"))
    nameless = calls.filter(F.col("call_id").isNull()).select(
        "conv_id", "turn", "idx", "call_id", "name", "arguments", "after", F.lit(0).alias("level"),
        F.lit(None).cast("string").alias("result"), F.lit("unanswered").alias("status"))
    missing = (owners.select("conv_id", "call_id", F.explode("after").alias("dep")).distinct().alias("e")
               .join(owners.alias("o"), F.col("e.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("e.dep") == F.col("o.call_id")), "left_anti")
               .groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("dep")).alias("missing")))
    every = linked.unionByName(duplicate).unionByName(nameless)
    every = (every.alias("c").join(missing.alias("x"), _same("c", "x", "conv_id", "call_id") & (F.col("c.status") != "duplicate"), "left")
             .select("c.*", F.col("x.missing").alias("missing")))

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            errors, out = [], []
            for r in f.itertuples(index=False):
                wrong, value = check_call(r.name, r.arguments, schemas)
                missing_ids = list(r.missing) if r.missing is not None else []
                wrong = wrong + [f"after {d}: no such call" for d in missing_ids]
                after = sorted(set(r.after)) if r.after is not None else []
                body = {"after": after, "arguments": value if value is not None else r.arguments, "id": r.call_id, "name": r.name,
                        "result": r.result, "status": r.status, "type": "call", "valid": not wrong}
                errors.append([escaped(w) for w in wrong])
                out.append(canonical(body))
            f = f.assign(errors=errors, json=out, kind="call")
            yield f[["conv_id", "kind", "turn", "idx", "level", "call_id", "status", "errors", "json"]]

    t = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    schema = (f"conv_id {t['conv_id']}, kind string, turn {t['turn']}, idx int, level int, call_id string, status string, "
              "errors array<string>, json string")
    call_rows = every.mapInPandas(lines, schema)

    tool = F.col("m.role").eqNullSafe(F.lit("tool"))
    firsts = answered.select("conv_id", "call_id", "r")
    status = (F.when(tool & F.col("o.call_id").isNull(), "orphan")
              .when(tool & ~(F.struct("m.turn", "m.text").eqNullSafe(F.col("a.r"))), "extra").when(tool, "linked")
              .when(F.col("m.tool_calls").isNotNull() & F.from_json("m.tool_calls", "array<string>").isNull(), "bad_calls").otherwise("ok"))
    said = (m.alias("m").join(owners.select("conv_id", "call_id").alias("o"), tool & F.col("m.conv_id").eqNullSafe(F.col("o.conv_id"))
                              & (F.col("m.tool_call_id") == F.col("o.call_id")), "left")
            .join(firsts.alias("a"), tool & F.col("m.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("m.tool_call_id") == F.col("a.call_id")), "left")
            .select("m.conv_id", "m.turn", "m.role", "m.text", "m.tool_call_id", status.alias("status")))
    # keys in sorted order; to_json escapes like the canonical form and keeps non-ASCII characters
    body = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"), F.col("status").alias("status"),
                              F.col("tool_call_id").alias("tool_call_id"), F.lit("message").alias("type")), {"ignoreNullFields": "false"})
    message_rows = said.select("conv_id", F.lit("message").alias("kind"), "turn", F.lit(None).cast("int").alias("idx"),
                               F.lit(None).cast("int").alias("level"), F.col("tool_call_id").alias("call_id"), "status",
                               F.expr("cast(array() as array<string>)").alias("errors"), body.alias("json"))
    return message_rows.unionByName(call_rows)
