"""Interactions from spans: two attribute conventions normalised into one row, or a reason to skip."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import let
from ..functions.text import once
from ..schemas import CONTENT_FIELD, INFERENCE, INTERACTION_COLUMNS, MESSAGE, MESSAGES, PART
from ..sources.otlp import json_string

CONTEXT_MESSAGES, CONTEXT_CHARS = 4, 1000
ASSOCIATION = "traceloop.association.properties."
SYSTEM, INPUT, OUTPUT = "gen_ai.system_instructions", "gen_ai.input.messages", "gen_ai.output.messages"
INDEXED = r"^gen_ai\.(prompt|completion)\.(\d+)\.(role|content|finish_reason|tool_calls\.(\d+)\.arguments)$"


SKIP_REASONS = ("self_telemetry", "not_inference", "no_content")


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


@once(StringType())
def listed(s: pd.Series) -> pd.Series:
    """A messages attribute (a list, or a JSON string of one) as the JSON text of a list of objects whose parts have their
    content as text; null if it is no list. Python's JSON, as its spacing is part of the text."""

    def part(p):
        field = CONTENT_FIELD.get(p.get("type")) if isinstance(p, dict) and isinstance(p.get("type"), str) else None
        if not field:
            return None
        v = p.get(field)
        return {"type": p["type"], "text": v if isinstance(v, str) else "" if v is None else dumps(v)}

    def one(t):
        try:
            v = json.loads(t) if t is not None else None
            v = json.loads(v) if isinstance(v, str) else v
        except (ValueError, RecursionError):  # nested too deeply is no list of messages
            return None
        if not isinstance(v, list):
            return None
        out = []
        for x in v:
            if isinstance(x, dict):
                parts = x.get("parts")
                reason = x.get("finish_reason")
                out.append({"role": str(x.get("role") or "unknown"), "has_parts": "parts" in x, "parts": [q for p in (parts if isinstance(parts, list) else []) if (q := part(p))], "own": part(x), "finish_reason": reason if isinstance(reason, str) and reason else None})
        return dumps(out)

    return s.map(one)


PIECE = "struct<type:string,text:string>"
ITEMS = f"array<struct<role:string,has_parts:boolean,parts:array<{PIECE}>,own:{PIECE},finish_reason:string>>"


def message(role: Column, pieces: Column) -> Column:
    """Joins non-empty pieces by a line feed and keeps where each is; a lone text part has no parts. Null if none is left."""
    some = F.filter(pieces, lambda p: F.coalesce(p["text"], F.lit("")) != "")

    def build(ps: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PART}>").alias("parts"))

        def step(a: Column, p: Column) -> Column:
            end = a["at"] + F.length(p["text"])
            return F.struct((end + 1).alias("at"), F.array_append(a["parts"], F.struct(p["type"].alias("type"), a["at"].alias("start"), end.alias("end"))).alias("parts"))

        parts = F.aggregate(ps, zero, step, lambda a: a["parts"])
        lone = (F.size(ps) == 1) & (ps[0]["type"] == "text")
        text = F.array_join(F.transform(ps, lambda p: p["text"]), "\n")
        return F.when(F.size(ps) > 0, F.struct(role.alias("role"), text.alias("text"), F.when(lone, F.array().cast(f"array<{PART}>")).otherwise(parts).alias("parts")).cast(MESSAGE))

    return let(some, build)


def kept(messages: Column) -> Column:
    return F.filter(messages, lambda m: m.isNotNull())


def standard_messages(items: Column) -> Column:
    return kept(F.transform(items, lambda x: message(x["role"], x["parts"])))


def system_instructions(items: Column) -> Column:
    """A list of parts is one message; a list of messages is tolerated, each as a system message."""
    whole = F.exists(items, lambda x: x["has_parts"])
    many = F.transform(standard_messages(items), lambda m: F.struct(F.lit("system").alias("role"), m["text"].alias("text"), m["parts"].alias("parts")).cast(MESSAGE))
    one = kept(F.array(message(F.lit("system"), F.filter(F.transform(items, lambda x: x["own"]), lambda p: p.isNotNull()))))
    return F.when(whole, many).otherwise(one)


def turn_start(messages: Column) -> Column:
    """Messages up to and with the last assistant's."""
    return F.coalesce(F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i + 1))), F.lit(0))


def new_in_turn(messages: Column) -> Column:
    return F.slice(messages, turn_start(messages) + 1, F.greatest(F.size(messages), F.lit(1)))


def text_of(m: Column, *types: str) -> Column:
    """The text of a message's parts of these types."""
    parts = F.transform(F.filter(m["parts"], lambda p: p["type"].isin(*types)), lambda p: F.substr(m["text"], p["start"] + 1, p["end"] - p["start"]))
    return F.when(F.size(m["parts"]) == 0, m["text"] if "text" in types else F.lit("")).otherwise(F.array_join(parts, "\n"))


def context_before_turn(messages: Column) -> Column:
    """The last four user or assistant texts before the turn, each cut to 1,000 characters."""
    earlier = F.slice(messages, 1, turn_start(messages))
    texts = F.transform(F.filter(earlier, lambda m: m["role"].isin("user", "assistant")), lambda m: F.struct(m["role"].alias("role"), F.substr(text_of(m, "text"), F.lit(1), F.lit(CONTEXT_CHARS)).alias("text"), F.array().cast(f"array<{PART}>").alias("parts")).cast(MESSAGE))
    return let(F.filter(texts, lambda m: m["text"] != ""), lambda c: F.when(F.size(c) <= CONTEXT_MESSAGES, c).otherwise(F.slice(c, -CONTEXT_MESSAGES, CONTEXT_MESSAGES)))


def with_role(messages: Column, system: bool) -> Column:
    return F.filter(messages, lambda m: (m["role"] == "system") if system else (m["role"] != "system"))


def indexed_entries(attributes: Column) -> Column:
    """Entries of the indexed convention: kind, n, field, k (of a tool call) and value, sorted."""
    e = F.transform(
        F.filter(F.map_entries(attributes), lambda x: F.regexp_like(x["key"], F.lit(INDEXED))),
        lambda x: F.struct(
            F.regexp_extract(x["key"], INDEXED, 1).alias("kind"),
            F.regexp_extract(x["key"], INDEXED, 2).cast("int").alias("n"),
            F.when(x["key"].endswith(".arguments"), "tool_call").otherwise(F.regexp_extract(x["key"], INDEXED, 3)).alias("field"),
            F.coalesce(F.nullif(F.regexp_extract(x["key"], INDEXED, 4), F.lit("")).cast("int"), F.lit(-1)).alias("k"),
            x["value"].alias("value"),
        ),
    )
    return F.array_sort(e)


def indexed_messages(entries: Column, kind: str) -> Column:
    """Messages of one kind by index; tool calls after the content, by their own index. entries' contents are texts."""
    own = F.filter(entries, lambda e: e["kind"] == kind)

    def of(n: Column) -> Column:
        at = lambda field: F.filter(own, lambda e: (e["n"] == n) & (e["field"] == field))
        pieces = F.concat(
            F.transform(at("content"), lambda e: F.struct(F.lit("text").alias("type"), e["value"].alias("text"))),
            F.transform(at("tool_call"), lambda e: F.struct(F.lit("tool_call").alias("type"), e["value"].alias("text"))),
        )
        role = F.coalesce(F.nullif(F.get(at("role"), F.lit(0))["value"], F.lit("")), F.lit("unknown"))
        return message(role, pieces)

    return kept(F.transform(F.array_sort(F.array_distinct(F.transform(own, lambda e: e["n"]))), of))


def strings(values: Column) -> Column:
    return F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "")


def interactions(spans: DataFrame, own_service: str | None = None) -> DataFrame:
    """Each span (columns of sources.otlp.SPAN_COLUMNS) as an interaction with a skip_reason, null if it is to be evaluated.

    Self telemetry is told first, then operations that aren't inference, then missing content. The first convention wins
    if any of its keys is there. Absent attributes are null.
    """
    a = F.col("attributes")
    get = lambda k: json_string(F.try_element_at(a, F.lit(k)))
    has = lambda k: F.map_contains_key(a, k)
    df = spans.withColumn("attributes", F.coalesce(a, F.create_map().cast("map<string,string>")))
    items = lambda k: F.coalesce(F.from_json(listed(F.try_element_at(a, F.lit(k))), ITEMS), F.array().cast(ITEMS))
    df = df.withColumns({"_system": items(SYSTEM), "_input": items(INPUT), "_output": items(OUTPUT), "_standard": has(SYSTEM) | has(INPUT) | has(OUTPUT), "_entries": indexed_entries(a)})
    # contents of the indexed convention become texts in one batch call: a map is rebuilt around the texts
    joined = F.to_json(F.transform("_entries", lambda e: e["value"]))
    df = df.withColumn("_texts", F.from_json(indexed_texts(joined), "array<string>"))
    df = df.withColumn("_entries", F.zip_with("_entries", "_texts", lambda e, t: F.struct(e["kind"].alias("kind"), e["n"].alias("n"), e["field"].alias("field"), e["k"].alias("k"), t.alias("value"))))
    df = df.withColumns({"_in": F.when(F.col("_standard"), standard_messages(F.col("_input"))).otherwise(indexed_messages(F.col("_entries"), "prompt")), "_out": F.when(F.col("_standard"), standard_messages(F.col("_output"))).otherwise(indexed_messages(F.col("_entries"), "completion"))})
    operation = F.coalesce(get("gen_ai.operation.name"), F.when(get("llm.request.type") == "chat", "chat").when(get("llm.request.type") == "completion", "text_completion"))
    reasons = F.try_element_at(a, F.lit("gen_ai.response.finish_reasons"))
    given = F.when(reasons.startswith('"'), F.array(json_string(reasons))).otherwise(F.transform(F.coalesce(F.try_variant_get(F.try_parse_json(reasons), "$", "array<variant>"), F.array().cast("array<variant>")), lambda v: json_string(F.to_json(v))))
    told = F.when(F.col("_standard"), F.transform("_output", lambda x: x["finish_reason"])).otherwise(F.transform(F.filter("_entries", lambda e: (e["kind"] == "completion") & (e["field"] == "finish_reason")), lambda e: e["value"]))
    schema = get("gen_ai.request.structured_output_schema")
    parsed = F.try_parse_json(schema)
    properties = F.map_filter(a, lambda k, v: k.startswith(ASSOCIATION) & (F.length(k) > len(ASSOCIATION)) & ~F.substr(v, F.lit(1), F.lit(1)).isin("[", "{") & (v != "null"))
    df = df.withColumns(
        {
            "operation": operation,
            "system_instructions": F.concat(F.when(F.col("_standard"), system_instructions(F.col("_system"))).otherwise(F.array().cast(MESSAGES)), with_role(F.col("_in"), True)),
            "_turns": with_role(F.col("_in"), False),
            "finish_reasons": F.when(F.size(strings(given)) > 0, strings(given)).otherwise(strings(told)),
            "output_type": F.coalesce(get("gen_ai.output.type"), F.when(parsed.isNotNull(), F.when(F.coalesce(F.try_variant_get(parsed, "$.type", "string") == "text", F.lit(False)), "text").otherwise("json"))),
            "association_properties": F.transform_values(F.transform_keys(properties, lambda k, v: F.substr(k, F.lit(len(ASSOCIATION) + 1))), lambda k, v: F.when(v.startswith('"'), F.try_variant_get(F.try_parse_json(v), "$", "string")).otherwise(v)),
            "provider_name": F.coalesce(get("gen_ai.provider.name"), get("gen_ai.system")),
            "request_model": get("gen_ai.request.model"),
            "response_id": get("gen_ai.response.id"),
        }
    )
    df = df.withColumns({"input_messages": new_in_turn(F.col("_turns")), "context_messages": context_before_turn(F.col("_turns")), "output_messages": F.col("_out"), "operation_name": F.coalesce("operation", F.lit("chat"))})
    nothing = (F.size("system_instructions") + F.size("input_messages") + F.size("output_messages")) == 0
    no_content = ~F.col("_standard") & ~F.exists("_entries", lambda e: e["field"].isin("content", "tool_call"))
    skip = F.when(F.lit(own_service is not None) & F.coalesce(F.col("service_name") == F.lit(own_service), F.lit(False)), "self_telemetry")
    skip = skip.when(F.col("operation").isNotNull() & ~F.col("operation").isin(*INFERENCE), "not_inference")
    skip = skip.when(no_content, F.when(F.col("operation").isNotNull(), "no_content").otherwise("not_inference")).when(nothing, "no_content")
    return df.withColumn("skip_reason", skip).select(*INTERACTION_COLUMNS, "skip_reason")


@once(StringType())
def indexed_texts(s: pd.Series) -> pd.Series:
    """A JSON list of indexed attributes' JSON texts as a list of their plain texts."""

    def content(t):
        try:
            v = json.loads(t) if t is not None else None
        except (ValueError, RecursionError):  # what can't be read stays as it is
            return t
        if not isinstance(v, str):
            return "" if v is None else dumps(v)
        if v.lstrip().startswith("[{"):
            try:
                parts = json.loads(v.lstrip())
            except (ValueError, RecursionError):
                return v
            if isinstance(parts, list) and all(isinstance(p, dict) for p in parts):
                return "\n".join(str(p.get("text", "")) for p in parts if p.get("type") == "text")
        return v

    return s.map(lambda t: json.dumps([content(x) for x in json.loads(t)]) if t is not None else "[]")
