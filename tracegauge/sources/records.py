"""Interactions given as records: JSON lines, or labelled sets of them.

A record is {"input", "output", "context"?, "id"?}: input and output are a text or a list of texts, context a list of {role, text}
with the roles user and assistant. A line that isn't such a record is kept, with its error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MESSAGES, PART

SERVICE = "records"
ROLES = ("user", "assistant")


def texts_of(value: Column) -> Column:
    """A text, or a list of texts, as a list; null for anything else."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    one = F.array(F.try_variant_get(value, "$", "string"))
    many = F.when(F.forall(listed, is_text), F.transform(listed, lambda v: F.try_variant_get(v, "$", "string")))
    return F.when(is_text(value), one).otherwise(many)


def messages(role: Column | str, texts: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.transform(texts, lambda t: F.struct(role.alias("role"), t.alias("text"), F.array().cast(f"array<{PART}>").alias("parts"))).cast(MESSAGES)


def read_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with `record` (a variant) and `error` (null for a good one). Blank lines are left out."""
    df = lines.where(F.trim(line) != "").withColumn("record", F.try_parse_json(line))
    field = lambda name: F.try_variant_get("record", f"$.{name}", "variant")
    df = df.withColumns({"_input": field("input"), "_output": field("output"), "_context": field("context")})
    context = F.try_variant_get("_context", "$", "array<variant>")
    good = F.forall(context, lambda x: F.coalesce(F.try_variant_get(x, "$.role", "string").isin(*ROLES), F.lit(False)))
    absent = F.col("_context").isNull() | F.is_variant_null("_context")
    error = (
        F.when(F.col("record").isNull(), "not JSON")
        .when(~F.schema_of_variant("record").startswith("OBJECT"), "not an object")
        .when(F.col("_input").isNull(), "missing input")
        .when(F.col("_output").isNull(), "missing output")
        .when(texts_of(F.col("_input")).isNull(), "input is not a text or a list of texts")
        .when(texts_of(F.col("_output")).isNull(), "output is not a text or a list of texts")
        .when(~absent & ~F.coalesce(good, F.lit(False)), "context needs a role (user or assistant) and a text")
    )
    return df.withColumn("error", error)


def record_interactions(records: DataFrame, key: Column) -> DataFrame:
    """Interactions of the good records; key (a number of the record) makes their ids."""
    df = records.where("error is null")
    context = F.coalesce(F.try_variant_get("_context", "$", "array<variant>"), F.array().cast("array<variant>"))
    turns = F.transform(context, lambda x: F.struct(F.try_variant_get(x, "$.role", "string").alias("role"), F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")).alias("text"), F.array().cast(f"array<{PART}>").alias("parts"))).cast(MESSAGES)
    number = F.lower(F.hex(key.cast("long")))
    none = F.lit(None).cast("string")
    return df.select(
        F.lpad(number, 32, "0").alias("trace_id"),
        F.lpad(number, 16, "0").alias("span_id"),
        none.alias("parent_span_id"),
        F.lit(1).alias("trace_flags"),
        F.lit(SERVICE).alias("service_name"),
        F.lit("chat").alias("operation_name"),
        none.alias("provider_name"),
        none.alias("request_model"),
        F.try_variant_get("record", "$.id", "string").alias("response_id"),
        F.array().cast(MESSAGES).alias("system_instructions"),
        messages("user", texts_of(F.col("_input"))).alias("input_messages"),
        messages("assistant", texts_of(F.col("_output"))).alias("output_messages"),
        turns.alias("context_messages"),
        F.create_map().cast("map<string,string>").alias("association_properties"),
        none.alias("output_type"),
        F.array().cast("array<string>").alias("finish_reasons"),
    )


def record_spans(records: DataFrame, key: Column) -> DataFrame:
    """The good records as spans (sources.otlp.SPAN_COLUMNS), as a traced service would have sent them: what was said before is the beginning of the
    input, an answer of several texts is several choices, and a labelled record's id, lang, label and score are association properties."""
    df = records.where("error is null")
    get = lambda name, kind="string": F.try_variant_get("record", f"$.{name}", kind)
    context = F.coalesce(F.try_variant_get("_context", "$", "array<variant>"), F.array().cast("array<variant>"))
    said = lambda role, text: F.struct(role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("content"))).alias("parts"))
    before = F.transform(context, lambda x: said(F.try_variant_get(x, "$.role", "string"), F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))))
    asked = F.transform(texts_of(F.col("_input")), lambda t: said(F.lit("user"), t))
    answers = F.transform(texts_of(F.col("_output")), lambda t: said(F.lit("assistant"), t))
    number = F.lower(F.hex(key.cast("long")))
    # JSON leaves a null field out
    text = lambda c: F.get(F.regexp_extract_all(F.to_json(F.struct(c.alias("v"))), F.lit(r'(?s)^\{"v":(.*)\}$'), F.lit(1)), F.lit(0))
    own = {"gen_ai.operation.name": F.lit('"chat"'), "gen_ai.input.messages": F.to_json(F.concat(before, asked)), "gen_ai.output.messages": F.to_json(answers), "gen_ai.response.id": text(get("id"))}
    own |= {f"traceloop.association.properties.synthetic.{c}": text(get(c, kind)) for c, kind in (("id", "string"), ("lang", "string"), ("label", "string"), ("score", "double"))}
    attributes = F.map_filter(F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    none = F.lit(None).cast("string")
    return df.select(F.lpad(number, 32, "0").alias("trace_id"), F.lpad(number, 16, "0").alias("span_id"), none.alias("parent_span_id"), F.lit(1).alias("trace_flags"), F.lit("chat").alias("name"), F.lit(SERVICE).alias("service_name"), attributes.alias("attributes"))


def inline_record(input_text: Column, output_text: Column, context: Column) -> Column:
    """A record as a JSON line, of texts and an array of `ROLE:TEXT`."""
    turns = F.transform(context, lambda c: F.struct(F.substring_index(c, ":", 1).alias("role"), F.substr(c, F.instr(c, ":") + 1, F.length(c)).alias("text")))
    return F.to_json(F.struct(input_text.alias("input"), output_text.alias("output"), turns.alias("context")))


def labelled(records: DataFrame) -> DataFrame:
    """id, lang, label and score of the good records of a labelled set, whose labels are pass or fail."""
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return records.where("error is null").select(get("id", "string"), get("lang", "string"), get("label", "string"), get("score", "double")).where("label in ('pass', 'fail')")
