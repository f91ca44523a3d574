"""Tool-call linking and canonical JSON for chat tables, in DataFrame functions only.

Rows are turns (conv_id, turn, role, text). A turn whose text is a JSON object with ``tool_calls`` makes calls
``{"id", "name", "arguments", "depends_on"}``; a turn of role ``tool`` whose text is a JSON object with
``tool_call_id`` is a result. Calls and results are hash-joined by conversation and identifier, ordered so that
each stands after what it depends on, arguments are checked against schemas, and every part becomes JSON with
sorted keys and no blanks. Work is by part, never by conversation, so one huge conversation spreads out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Schemas of the tools that the production query knows, as JSON Schema reduced to objects of typed fields.
TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"properties": {"url": {"type": "string"}, "headers": {"type": "object"}}, "required": ["url"], "additionalProperties": False},
    "calculate": {"properties": {"expression": {"type": "string"}, "precision": {"type": "number"}}, "required": ["expression"], "additionalProperties": True},
    "run": {"properties": {"command": {"type": "array"}, "background": {"type": "boolean"}}, "required": ["command"], "additionalProperties": False},
}
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$"}


def argument_errors(name: Column, args: Column, tools: dict) -> Column:
    """Sorted array of what is wrong with a call's arguments; empty if they fit the tool's schema."""
    fields = F.try_variant_get(args, "$", "map<string,variant>")
    out = F.when(name.isNull(), F.array(F.lit("no name"))).otherwise(F.array(F.lit("unknown tool")))
    for tool, schema in sorted(tools.items()):
        checks = []
        for field, rule in schema.get("properties", {}).items():
            value = F.element_at(fields, field)
            kind = F.schema_of_variant(value)
            checks.append(F.when(value.isNotNull() & ~kind.rlike(_TYPES[rule["type"]]), F.lit(f"{field}: not {rule['type']}")))
            if "enum" in rule:
                checks.append(F.when(value.isNotNull() & ~F.to_json(value).isin([F.lit(x) for x in rule["enum"]]), F.lit(f"{field}: not allowed")))
        for field in schema.get("required", []):
            checks.append(F.when(~F.coalesce(F.map_contains_key(fields, field), F.lit(False)), F.lit(f"{field}: missing")))
        errors = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.map_keys(fields), F.array(*[F.lit(x) for x in schema.get("properties", {})]).cast("array<string>"))
            errors = F.concat(errors, F.coalesce(F.transform(extra, lambda k: F.concat(k, F.lit(": unknown"))), F.array().cast("array<string>")))
        whole = F.when(fields.isNull(), F.array(F.lit("arguments: not object"))).otherwise(F.array_sort(errors))
        out = F.when(name == tool, whole).otherwise(out)
    return out


def parts(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns taken apart: one row per plain message, call and result."""
    t = F.col(text)
    looks = t.startswith("{") | t.rlike(r"^\s+\{")
    # A turn's key tells equal rows apart only by their content; repeated rows stay repeated.
    base = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), t.alias("text"), F.when(looks, F.try_parse_json(t)).alias("v"))
    calls = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    result_id = F.try_variant_get("v", "$.tool_call_id", "string")
    base = base.withColumns({"calls": F.when(F.coalesce(F.col("role") != "tool", F.lit(True)), calls), "result_id": F.when(F.col("role") == "tool", result_id)})
    content = F.coalesce(F.try_variant_get("v", "$.content", "string"), F.when(F.col("calls").isNull() & F.col("result_id").isNull(), F.col("text")))
    plain = base.where("calls is null and result_id is null or calls is not null and try_variant_get(v, '$.content', 'string') is not null")
    plain = plain.select("conv", "turn", "role", F.lit(-1).alias("idx"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("payload"), content.alias("content"), F.lit(None).cast("array<string>").alias("needs"))
    made = base.where("calls is not null").select("conv", "turn", "role", F.posexplode("calls").alias("idx", "c"))
    args = F.try_variant_get("c", "$.arguments", "variant")
    # Arguments may come as an object or as a string of JSON.
    args = F.when(F.schema_of_variant(args) == "STRING", F.try_parse_json(F.try_variant_get("c", "$.arguments", "string"))).otherwise(args)
    made = made.select("conv", "turn", "role", "idx", F.lit("call").alias("kind"), F.try_variant_get("c", "$.id", "string").alias("call_id"), F.try_variant_get("c", "$.name", "string").alias("name"), args.alias("payload"), F.lit(None).cast("string").alias("content"), F.array_distinct(F.try_variant_get("c", "$.depends_on", "array<string>")).alias("needs"))
    answers = base.where("result_id is not null").select("conv", "turn", "role", F.lit(0).alias("idx"), F.lit("result").alias("kind"), F.col("result_id").alias("call_id"), F.lit(None).cast("string").alias("name"), F.try_variant_get("v", "$.content", "variant").alias("payload"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("array<string>").alias("needs"))
    return plain.union(made).union(answers)


def _levels(calls: DataFrame) -> DataFrame:
    """Rows (conv, call_id, level, at): depth below the calls without needs, and the latest turn among it and its needs.

    Kahn's peeling, one round per level: a call is ready when all its needs have a level. Calls on a cycle, or
    behind one, get none. A need that names no call of the conversation is ignored.
    """
    first = calls.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "idx")).alias("own"), F.flatten(F.collect_set(F.coalesce("needs", F.array().cast("array<string>")))).alias("needs"))
    first = scratch.table(first.select("conv", "call_id", F.col("own.turn").alias("turn"), "needs"), "chat-calls")
    needs = first.select("conv", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
    known = first.select("conv", F.col("call_id").alias("need"))
    needs = scratch.table(needs.join(known, ["conv", "need"], "left_semi"), "chat-needs")
    done = first.join(needs, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(0).alias("level"), F.col("turn").alias("at"))
    if needs.isEmpty():
        return done
    done = scratch.table(done, "chat-levels")
    before = -1
    while (now := done.count()) != before:
        before = now
        got = needs.join(done.select("conv", F.col("call_id").alias("need"), "level", "at"), ["conv", "need"], "left")
        ready = got.groupBy("conv", "call_id").agg((F.max("level") + 1).alias("level"), F.max("at").alias("need_at"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        ready = ready.join(done, ["conv", "call_id"], "left_anti").join(first.select("conv", "call_id", "turn"), ["conv", "call_id"])
        done = scratch.table(done.union(ready.select("conv", "call_id", "level", F.greatest("turn", "need_at"))), "chat-levels")
    return done


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tools: dict | None = None) -> DataFrame:
    """One row per message, call and result: conv, position, turn, role, kind, call_id, name, link, valid, errors, json.

    ``position`` counts from 1 within the conversation, in an order in which a result follows its call and a call
    follows what it depends on. ``link`` is ``linked``; ``unanswered`` (a call without result); ``orphan`` (a result
    without call); ``repeated`` (its identifier came earlier in the conversation); ``cycle`` (a call whose needs never
    end, put last); null for messages. A call or result without identifier is unanswered or an orphan. Text that is not
    JSON, has none of the two fields, or is null, is a plain message; null content is written as null. Null
    conversations are one conversation. Equal rows stay apart; an empty table gives an empty result.
    """
    tools = TOOLS if tools is None else tools
    p = scratch.table(parts(turns, conv, turn, role, text), "chat-parts")
    plain = p.where("kind = 'message'").select("*", F.lit(None).cast("string").alias("link"), F.lit(0).alias("level"), F.col("turn").alias("at"))
    tooled = p.where("kind <> 'message'")
    if not tooled.isEmpty():
        tooled = tooled.withColumn("conv_key", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("null")))
        named = tooled.where("call_id is not null")
        owner = scratch.table(named.groupBy("conv_key", "call_id").agg(*[F.min(F.when(F.col("kind") == k, F.struct("turn", "idx"))).alias(k) for k in ("call", "result")]), "chat-owners")
        levels = scratch.table(_levels(named.where("kind = 'call'").withColumn("conv", F.col("conv_key"))), "chat-level").withColumnRenamed("conv", "conv_key")
        tooled = tooled.join(owner, ["conv_key", "call_id"], "left").join(levels, ["conv_key", "call_id"], "left")
        is_call = F.col("kind") == "call"
        own = F.when(is_call, F.col("call")).otherwise(F.col("result"))
        link = (
            F.when(F.col("call_id").isNull(), F.when(is_call, "unanswered").otherwise("orphan"))
            .when(F.struct("turn", "idx") != own, "repeated")
            .when(~is_call & F.col("call").isNull(), "orphan")
            .when(F.col("call").isNotNull() & F.col("level").isNull(), "cycle")
            .when(F.col("result").isNull(), "unanswered")
            .otherwise("linked")
        )
        tooled = tooled.withColumn("link", link)
        deep = F.coalesce(F.col("level") * 2 + F.when(is_call, 0).otherwise(1), F.lit(0))
        placed = F.col("link").isin("linked", "unanswered") & F.col("level").isNotNull()
        last = F.when(F.col("link") == "cycle", F.lit((1 << 62)).cast("long"))
        tooled = tooled.select(*p.columns, "link", F.when(placed, deep).otherwise(F.when(is_call, 0).otherwise(1)).alias("level"), F.coalesce(last, F.when(placed, F.col("at")), F.col("turn")).alias("at"))
        plain = plain.union(tooled)
    name_errors = argument_errors(F.col("name"), F.col("payload"), tools)
    errors = F.when(F.col("kind") == "call", name_errors)
    body = (
        F.when(F.col("kind") == "call", F.to_json(F.struct(F.col("payload").alias("arguments"), F.col("call_id").alias("id"), "name", "role", F.lit("call").alias("type")), {"ignoreNullFields": "false"}))
        .when(F.col("kind") == "result", F.to_json(F.struct(F.col("payload").alias("content"), "role", F.col("call_id").alias("tool_call_id"), F.lit("result").alias("type")), {"ignoreNullFields": "false"}))
        .otherwise(F.to_json(F.struct("content", "role", F.lit("message").alias("type")), {"ignoreNullFields": "false"}))
    )
    out = plain.select("conv", "turn", "role", "kind", "call_id", "name", "link", errors.alias("errors"), body.alias("json"), "at", "level", "idx")
    out = scratch.ranked(out, ["conv"], ["at", "level", "turn", "idx", "json"], "position")
    return out.select(
        F.col("conv").alias(conv), F.col("position").cast("long").alias("position"), F.col("turn").alias(turn), F.col("role").alias(role), "kind", "call_id", "name", "link",
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), "json",
    )
