"""Spans from OTLP export requests, as JSON text or protobuf bytes; the request gate.

Both readers give the columns of schemas.SPAN_COLUMNS: ids as hexadecimal text, attributes as a map of JSON texts.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..functions.text import once
from ..schemas import INFERENCE

SPAN_COLUMNS = "trace_id string, span_id string, parent_span_id string, trace_flags int, name string, service_name string, attributes map<string,string>"
ANY = {"stringValue": str, "boolValue": bool, "intValue": int, "doubleValue": float, "bytesValue": str}


def any_value(v):
    """The plain value of an OTLP AnyValue in its JSON form; null for none."""
    for key, kind in ANY.items():
        if key in v:
            return kind(v[key])
    if "arrayValue" in v:
        return [any_value(x) for x in v["arrayValue"].get("values", [])]
    if "kvlistValue" in v:
        return {x["key"]: any_value(x.get("value") or {}) for x in v["kvlistValue"].get("values", [])}
    return None


def plain_attributes(listed: str | None) -> dict[str, str]:
    """Name to JSON text; the last of a repeated name wins."""
    return {x["key"]: json.dumps(any_value(x.get("value") or {}), ensure_ascii=False) for x in json.loads(listed or "[]") or [] if "key" in x}


@once(MapType(StringType(), StringType()))
def attribute_map(s: pd.Series) -> pd.Series:
    return s.map(plain_attributes)


def hex_id(v: Column) -> Column:
    """OTLP/JSON writes ids in hexadecimal; the protobuf mapping's base64 is read too. Empty means none."""
    as_hex = F.regexp_like(v, F.lit("^([0-9a-fA-F]{16}|[0-9a-fA-F]{32})$"))
    return F.nullif(F.lower(F.when(as_hex, v).otherwise(F.hex(F.try_to_binary(v, F.lit("base64"))))), F.lit(""))


def spans_of_json(requests: DataFrame, column: str = "value") -> DataFrame:
    """One row for each span of requests (JSON text). Text that isn't JSON gives no rows."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    rows = requests.select(F.try_parse_json(column).alias("v")).where("v is not null")
    rows = rows.select(F.explode(get("v", "$.resourceSpans", "array<variant>")).alias("r"))
    rows = rows.select(F.to_json(get("r", "$.resource.attributes", "variant")).alias("resource"), F.explode(get("r", "$.scopeSpans", "array<variant>")).alias("s"))
    rows = rows.select("resource", F.explode(get("s", "$.spans", "array<variant>")).alias("s"))
    rows = rows.select(
        hex_id(get("s", "$.traceId", "string")).alias("trace_id"),
        hex_id(get("s", "$.spanId", "string")).alias("span_id"),
        hex_id(get("s", "$.parentSpanId", "string")).alias("parent_span_id"),
        (F.coalesce(get("s", "$.flags", "long"), F.lit(0)).bitwiseAND(255)).cast("int").alias("trace_flags"),
        get("s", "$.name", "string").alias("name"),
        attribute_map("resource").alias("resource"),
        attribute_map(F.to_json(get("s", "$.attributes", "variant"))).alias("attributes"),
    )
    return rows.select("trace_id", "span_id", "parent_span_id", "trace_flags", "name", json_string(F.col("resource")["service.name"]).alias("service_name"), "attributes")


def json_string(v: Column) -> Column:
    """The string in a JSON text, or null if it is another type or empty."""
    return F.when(v.startswith('"'), F.nullif(F.try_variant_get(F.try_parse_json(v), "$", "string"), F.lit("")))


def gunzip(data: bytes, limit: int) -> bytes:
    """At most limit bytes of output are made. Raises ValueError beyond it, or for bad or cut-off data."""
    try:
        z = zlib.decompressobj(wbits=31)
        out = z.decompress(data, limit + 1)
    except zlib.error as e:
        raise ValueError("bad encoding") from e
    if len(out) > limit:
        raise ValueError("too large")
    if not z.eof:
        raise ValueError("bad encoding")
    return out


# Messages and fields of the export formats that are read or written (name, number, type; * for repeated ones).
FORMAT = {
    "AnyValue": "string_value 1 string, bool_value 2 bool, int_value 3 int64, double_value 4 double, array_value 5 ArrayValue, kvlist_value 6 KeyValueList, bytes_value 7 bytes",
    "ArrayValue": "values 1 AnyValue*",
    "KeyValueList": "values 1 KeyValue*",
    "KeyValue": "key 1 string, value 2 AnyValue",
    "Resource": "attributes 1 KeyValue*",
    "Status": "message 2 string, code 3 int32",
    "Span": "trace_id 1 bytes, span_id 2 bytes, parent_span_id 4 bytes, name 5 string, kind 6 int32, start_time_unix_nano 7 fixed64, end_time_unix_nano 8 fixed64, attributes 9 KeyValue*, status 15 Status, flags 16 fixed32",
    "ScopeSpans": "spans 2 Span*",
    "ResourceSpans": "resource 1 Resource, scope_spans 2 ScopeSpans*",
    "ExportTraceServiceRequest": "resource_spans 1 ResourceSpans*",
    "LogRecord": "time_unix_nano 1 fixed64, severity_number 2 int32, severity_text 3 string, body 5 AnyValue, attributes 6 KeyValue*, flags 8 fixed32, trace_id 9 bytes, span_id 10 bytes, event_name 12 string",
    "ScopeLogs": "log_records 2 LogRecord*",
    "ResourceLogs": "resource 1 Resource, scope_logs 2 ScopeLogs*",
    "ExportLogsServiceRequest": "resource_logs 1 ResourceLogs*",
    "NumberDataPoint": "start_time_unix_nano 2 fixed64, time_unix_nano 3 fixed64, as_int 6 sfixed64, attributes 7 KeyValue*",
    "Sum": "data_points 1 NumberDataPoint*, aggregation_temporality 2 int32, is_monotonic 3 bool",
    "HistogramDataPoint": "start_time_unix_nano 2 fixed64, time_unix_nano 3 fixed64, count 4 fixed64, sum 5 double, bucket_counts 6 fixed64*, explicit_bounds 7 double*, attributes 9 KeyValue*",
    "Histogram": "data_points 1 HistogramDataPoint*, aggregation_temporality 2 int32",
    "Metric": "name 1 string, description 2 string, unit 3 string, sum 7 Sum, histogram 9 Histogram",
    "ScopeMetrics": "metrics 2 Metric*",
    "ResourceMetrics": "resource 1 Resource, scope_metrics 2 ScopeMetrics*",
    "ExportMetricsServiceRequest": "resource_metrics 1 ResourceMetrics*",
}


@cache
def request_class(name: str = "ExportTraceServiceRequest"):
    """The protobuf class of a request. Needs the protobuf library, which nothing else here does."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="traces.proto", package="traces", syntax="proto3")
    for message, fields in FORMAT.items():
        m = file.message_type.add(name=message)
        if message == "AnyValue":
            m.oneof_decl.add(name="value")
        for field, number, kind in (f.split() for f in fields.split(", ")):
            f = m.field.add(name=field, number=int(number), label=kinds.LABEL_REPEATED if kind.endswith("*") else kinds.LABEL_OPTIONAL)
            if message == "AnyValue":
                f.oneof_index = 0
            if kind.rstrip("*") in FORMAT:
                f.type, f.type_name = kinds.TYPE_MESSAGE, f".traces.{kind.rstrip('*')}"
            else:
                f.type = kinds.Type.Value(f"TYPE_{kind.rstrip('*').upper()}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"traces.{name}"))


def plain_value(v):
    """The plain value of an AnyValue message; null for none."""
    kind = v.WhichOneof("value")
    if kind == "array_value":
        return [plain_value(x) for x in v.array_value.values]
    if kind == "kvlist_value":
        return {x.key: plain_value(x.value) for x in v.kvlist_value.values}
    if kind == "bytes_value":
        return base64.b64encode(v.bytes_value).decode()
    return getattr(v, kind) if kind else None


def decode_request(body: bytes) -> list[tuple]:
    """Rows of SPAN_COLUMNS of an ExportTraceServiceRequest. Raises ValueError for what isn't one."""
    from google.protobuf.message import DecodeError

    try:
        request = request_class().FromString(body)
    except DecodeError as e:
        raise ValueError("not a request") from e
    out = []
    for r in request.resource_spans:
        service = {a.key: plain_value(a.value) for a in r.resource.attributes}.get("service.name")
        service = service if isinstance(service, str) and service else None
        for s in (s for scope in r.scope_spans for s in scope.spans):
            attributes = {a.key: json.dumps(plain_value(a.value), ensure_ascii=False) for a in s.attributes}
            ids = [x.hex() or None for x in (s.trace_id, s.span_id, s.parent_span_id)]
            out.append((*ids, s.flags & 255, s.name, service, attributes))
    return out


def id_of(text: object) -> str | None:
    """An id as hexadecimal text, from that or from base64; null if it is empty or neither."""
    if not isinstance(text, str) or not text:
        return None
    if len(text) in (16, 32) and all(c in "0123456789abcdefABCDEF" for c in text):
        return text.lower()
    try:
        return base64.b64decode(text, validate=True).hex() or None
    except ValueError:
        return None


def decode_json(line: str | bytes) -> list[tuple]:
    """Rows of SPAN_COLUMNS of a request as JSON text. Raises ValueError for what isn't one."""
    try:
        request = json.loads(line)
        out = []
        for r in request["resourceSpans"]:
            service = {x["key"]: any_value(x.get("value") or {}) for x in (r.get("resource") or {}).get("attributes") or [] if "key" in x}.get("service.name")
            service = service if isinstance(service, str) and service else None
            for s in (s for scope in r.get("scopeSpans") or [] for s in scope.get("spans") or []):
                own = {x["key"]: json.dumps(any_value(x.get("value") or {}), ensure_ascii=False) for x in s.get("attributes") or [] if "key" in x}
                out.append((*(id_of(s.get(k)) for k in ("traceId", "spanId", "parentSpanId")), int(s.get("flags") or 0) & 255, s.get("name"), service, own))
        return out
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as e:
        raise ValueError("not a request") from e


def read_json(requests: DataFrame, column: str = "value", limit: int = 16 << 20) -> DataFrame:
    """One row for each span of requests (JSON text), and one for each request that gives none as it is `too large` or `not a request`: its
    `error` says which. Null and blank requests are left out."""
    names = [c.split()[0] for c in SPAN_COLUMNS.replace("map<string,string>", "map").split(", ")]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for body in frame["body"]:
                try:
                    if body is None:
                        raise ValueError("too large")
                    rows += [(*r, None) for r in decode_json(body)]
                except ValueError as e:
                    rows.append((None,) * len(names) + (str(e),))
            yield pd.DataFrame(rows, columns=[*names, "error"]).astype({"trace_flags": "Int32"})

    body = F.when(F.octet_length(column) <= limit, F.col(column))
    return requests.where(F.trim(column) != "").select(body.alias("body")).mapInPandas(decode, f"{SPAN_COLUMNS}, error string")


def read_protobuf(requests: DataFrame, column: str = "body", gzip: str | None = None, limit: int = 16 << 20) -> DataFrame:
    """One row for each span of requests (bytes; compressed where the boolean column gzip says so), and one for each request that
    gives none as it is `too large`, has a `bad encoding` or is `not a request`: its `error` says which. Null requests are left out."""
    names = [c.split()[0] for c in SPAN_COLUMNS.replace("map<string,string>", "map").split(", ")]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for body, packed in zip(frame["body"], frame["packed"], strict=True):
                try:
                    if body is None:
                        raise ValueError("too large")
                    rows += [(*r, None) for r in decode_request(gunzip(bytes(body), limit) if packed else bytes(body))]
                except ValueError as e:
                    rows.append((None,) * len(names) + (str(e),))
            yield pd.DataFrame(rows, columns=[*names, "error"]).astype({"trace_flags": "Int32"})

    packed = F.coalesce(F.col(gzip), F.lit(False)) if gzip else F.lit(False)
    # larger ones needn't go to Python
    body = F.when(F.length(column) <= limit, F.col(column))
    rows = requests.where(F.col(column).isNotNull()).select(body.alias("body"), packed.alias("packed"))
    return rows.mapInPandas(decode, f"{SPAN_COLUMNS}, error string")


def spans_of_protobuf(requests: DataFrame, column: str = "body", gzip: str | None = None, limit: int = 16 << 20) -> DataFrame:
    """The spans of `read_protobuf`, without requests that can't be read."""
    return read_protobuf(requests, column, gzip, limit).where("error is null").drop("error")


def inference_spans(spans: DataFrame) -> DataFrame:
    """Spans worth evaluating, before anything is extracted: of an inference operation, or with indexed content."""
    a = F.col("attributes")
    return spans.where(F.coalesce(a["gen_ai.operation.name"].isin(*map(json.dumps, INFERENCE)), F.lit(False)) | a["gen_ai.prompt.0.content"].isNotNull())


def gate(authorized: Column, accepting: Column, content_type: Column, encoding: Column, size: Column, limit: int = 16 << 20) -> Column:
    """The HTTP status a request is refused with, or null: authorisation, shutdown, type, encoding, size, in this order."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return (
        F.when(~F.coalesce(authorized, F.lit(False)), 401)
        .when(~F.coalesce(accepting, F.lit(True)), 503)
        .when(kind != "application/x-protobuf", 415)
        .when(~F.lower(F.coalesce(encoding, F.lit("identity"))).isin("identity", "gzip", ""), 415)
        .when(size > limit, 413)
    )
