"""Tool-call linking: calls and results joined by identifier, ordered, validated, and serialised.

:func:`link` takes two tables.  ``calls``: conv_id, call_id, turn, name,
arguments (JSON text) and after (the call_id whose result it uses, or null).
``results``: conv_id, call_id, turn and content.  It returns one row per call
and per result:

* both sides are joined by (conv_id, call_id), so a conversation's rows are
  spread over tasks by call, however long the conversation is;
* a call's depth is the number of calls before it on its chain of ``after``
  references, found by pointer doubling (each round halves what is left of
  every chain); ``level`` is twice the depth for a call and one more for its
  result, so ordering by (level, turn) is topological;
* arguments are validated against the tool's schema (type, enum, required,
  properties, additionalProperties, items, bounds of numbers and lengths);
* ``message`` is canonical JSON: keys sorted, no spaces, no escapes but those
  that JSON needs.

``error`` names the first fault of a row: ``duplicate call``, ``cycle``,
``unknown tool``, ``bad json``, a schema fault (path and reason), ``missing
result``, ``missing dependency``; for results ``missing call`` or ``duplicate
result``.  Faulty rows are kept.  ``level`` is null for rows on or behind a
cycle and for results without a call; a chain that starts at a missing call
counts from there.

Defined cases: null identifiers never link; null arguments are bad JSON, and so
are numbers beyond a double, nesting too deep to read and lone surrogates, whose
text stays in the message as it is; null content is null in the message; texts
of any length are carried whole; repeated rows are duplicates of each other;
rows of empty tables link nothing; other columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import discard, stage

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def fault(value, schema: dict, path: str = "$") -> str | None:
    """The first reason for which a value breaks a schema."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("number", "integer"):
        if not number or (kind == "integer" and value != int(value)):
            return f"{path}: not {kind}"
    elif kind and not isinstance(value, KINDS[kind]):
        return f"{path}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if number and ("minimum" in schema and value < schema["minimum"] or
                   "maximum" in schema and value > schema["maximum"]):
        return f"{path}: out of bounds"
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(low, 0) <= len(value) <= schema.get(high, len(value)):
            return f"{path}: bad length"
    if isinstance(value, list) and "items" in schema:
        return next((e for k, v in enumerate(value) if (e := fault(v, schema["items"], f"{path}[{k}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                return f"{path}.{k}: missing"
        for k in sorted(value):
            if k not in known and schema.get("additionalProperties") is False:
                return f"{path}.{k}: not allowed"
            if k in known and (e := fault(value[k], known[k], f"{path}.{k}")):
                return e
    return None


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("not a finite number")
    return value


def _strict(text: str | None):
    def no_constant(name):
        raise ValueError(name)

    return json.loads(text or "", parse_constant=no_constant, parse_float=_finite)


def call_message(row: dict, schemas: dict[str, dict]) -> tuple[str | None, str]:
    """The fault of a call's arguments, and its message; arguments that cannot be written as JSON stay text."""
    def told(arguments) -> str:
        text = canonical({"role": "assistant", "after": row["after"], "tool_call": {
            "id": row["call_id"], "name": row["name"], "arguments": arguments}})
        text.encode()  # lone surrogates have no UTF-8 form
        return text

    try:
        arguments = _strict(row["body"])
        found = "unknown tool" if row["name"] not in schemas else fault(arguments, schemas[row["name"]])
        return found, told(arguments)
    except (ValueError, RecursionError):
        return "bad json", told(row["body"])


def depths(calls: DataFrame, longest: int) -> DataFrame:
    """conv_id, call_id, depth (null on or behind a cycle) of distinct calls; ``after`` may name no call."""
    now = calls.select("conv_id", "call_id", F.col("after").alias("up"))
    own = calls.select("conv_id", F.col("call_id").alias("up")).withColumn("there", F.lit(True))
    now = now.join(own, ["conv_id", "up"], "left").select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("up")).alias("up"),
        F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    now, path = stage(now, "calls-depth")
    for _ in range(max(0, longest - 1).bit_length()):
        if not now.where("up is not null").limit(1).count():
            break
        ends = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"),
                          F.col("depth").alias("more"))
        moved = now.where("up is not null").join(ends, ["conv_id", "up"]) \
            .select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        nxt, nxt_path = stage(now.where("up is null").unionByName(moved), "calls-depth")
        discard(calls.sparkSession, path)
        now, path = nxt, nxt_path
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, kind (call or result), turn, level, linked, error and message of every row."""
    calls = calls.selectExpr("cast(conv_id as long) conv_id", "cast(call_id as string) call_id",
                             "cast(turn as long) turn", "cast(name as string) name",
                             "cast(arguments as string) arguments", "cast(after as string) after")
    results = results.selectExpr("cast(conv_id as long) conv_id", "cast(call_id as string) call_id",
                                 "cast(turn as long) turn", "cast(content as string) content")
    keys = ["conv_id", "call_id"]
    known = calls.where("conv_id is not null and call_id is not null").groupBy(*keys) \
        .agg(F.count("*").alias("n_calls"), F.min("after").alias("after"))
    known, _ = stage(known, "calls")
    longest = known.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    there = results.groupBy(*keys).agg(F.count("*").alias("n_results"))
    ids = known.join(depths(known, longest), keys).join(there, keys, "left") \
        .select(*keys, "n_calls", F.coalesce("n_results", F.lit(0)).alias("n_results"), "depth")
    ids, _ = stage(ids, "calls-linked")
    targets = ids.select("conv_id", F.col("call_id").alias("after")).withColumn("found", F.lit(True))

    one = calls.join(ids, keys, "left").join(targets, ["conv_id", "after"], "left").select(
        *keys, F.lit("call").alias("kind"), "turn", (2 * F.col("depth")).alias("level"),
        F.coalesce(F.col("n_results") > 0, F.lit(False)).alias("linked"),
        F.when(F.col("n_calls") > 1, "duplicate call")
        .when(F.col("n_calls").isNotNull() & F.col("depth").isNull(), "cycle").alias("before"),
        F.when(F.coalesce("n_results", F.lit(0)) == 0, "missing result")
        .when(F.col("after").isNotNull() & F.col("found").isNull(), "missing dependency").alias("later"),
        "name", F.col("arguments").alias("body"), "after")
    two = results.join(ids, keys, "left").select(
        *keys, F.lit("result").alias("kind"), "turn", (2 * F.col("depth") + 1).alias("level"),
        F.col("n_calls").isNotNull().alias("linked"),
        F.when(F.col("n_calls").isNull(), "missing call").when(F.col("n_results") > 1, "duplicate result")
        .alias("before"), F.lit(None).cast("string").alias("later"), F.lit(None).cast("string").alias("name"),
        F.col("content").alias("body"), F.lit(None).cast("string").alias("after"))

    def run(batches):
        for b in batches:
            errors, messages = [], []
            for r in b.to_pylist():
                error = r["before"]
                if r["kind"] == "result":
                    message = canonical({"role": "tool", "tool_call_id": r["call_id"], "content": r["body"]})
                else:
                    found, message = call_message(r, schemas)
                    error = error or found or r["later"]
                errors.append(error)
                messages.append(message)
            keep = b.select(["conv_id", "call_id", "kind", "turn", "level", "linked"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(errors, pa.string()),
                                              pa.array(messages, pa.string())], [*keep.schema.names, "error", "message"])

    return one.unionByName(two).mapInArrow(run, "conv_id long, call_id string, kind string, turn long, level long, "
                                                "linked boolean, error string, message string")


#: tools of the derived calls, and their schemas
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
        "query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 1000},
        "uses": {"type": "string"}}},
    "open": {"type": "object", "required": ["page"], "additionalProperties": False, "properties": {
        "page": {"type": "integer", "minimum": 0}, "text": {"type": "string"}, "uses": {"type": "string"}}},
}


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


IS_CALL, IS_RESULT = "role <=> 'assistant'", "role <=> 'user' and coalesce(turn > 0, false)"


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations imply: an assistant turn calls, the user turn behind it answers.

    A call's id is its turn in the conversation, its arguments are its whole
    text and the text's length.  It uses the result of the assistant turn two
    turns before.  Texts of an even length search, with the length as limit (so
    longer ones than 1000 are out of bounds); the others open a page.
    """
    rows = _turns(conversations)
    first = F.when(F.col("turn") >= 3, F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string")))
    even = F.length("text") % 2 == 0
    calls = rows.where(IS_CALL).select(
        "conv_id", "turn", F.concat(F.lit("call-"), F.col("turn").cast("string")).alias("call_id"),
        F.when(even, "search").otherwise("open").alias("name"),
        F.when(even, F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit"),
                                        first.alias("uses"))))
        .otherwise(F.to_json(F.struct(F.length("text").alias("page"), "text", first.alias("uses")))).alias("arguments"),
        first.alias("after"))
    results = rows.where(IS_RESULT).select(
        "conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("text").alias("content"))
    return calls, results


def plain_messages(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) that neither call nor answer, as canonical messages in the form of :func:`link`."""

    def run(batches):
        for b in batches:
            told = [canonical({"role": r, "content": t}) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(),
                                                                         strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(told, pa.string())],
                                             ["conv_id", "turn", "message"])

    told = rows.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, message string")
    none = F.lit(None)
    return told.select("conv_id", none.cast("string").alias("call_id"), F.lit("message").alias("kind"), "turn",
                       none.cast("long").alias("level"), F.lit(False).alias("linked"),
                       none.cast("string").alias("error"), "message")


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """:func:`link` over the calls and results that whole conversations imply, and all their other turns as messages.

    Every turn gives one row, and its message holds its whole text.
    """
    calls, results = derived_calls(conversations)
    others = _turns(conversations).where(f"not ({IS_CALL}) and not ({IS_RESULT})")
    return link(calls, results, SCHEMAS).unionByName(plain_messages(others))
