import json

from pyspark.sql import functions as F

from tracegauge.operators.extract import interactions
from tracegauge.sources.otlp import gate, inference_spans, read_protobuf, spans_of_json, spans_of_protobuf

TRACE, SPAN, PARENT = "0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331", "00f067aa0ba902b7"


def any_of(v):
    if isinstance(v, bool):
        return {"boolValue": v}
    if isinstance(v, str):
        return {"stringValue": v}
    if isinstance(v, int):
        return {"intValue": str(v)}
    if isinstance(v, float):
        return {"doubleValue": v}
    if isinstance(v, list):
        return {"arrayValue": {"values": [any_of(x) for x in v]}}
    if isinstance(v, dict):
        return {"kvlistValue": {"values": [{"key": k, "value": any_of(x)} for k, x in v.items()]}}
    return {}


def request(*spans, service="shop"):
    """spans: dicts of attributes."""
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": any_of(service)}] if service else []}, "scopeSpans": [{"spans": [{"traceId": TRACE, "spanId": SPAN, "parentSpanId": PARENT, "flags": 0x301, "name": "chat", "attributes": [{"key": k, "value": any_of(v)} for k, v in s.items()]} for s in spans]}]}]})


def extract(spark, *spans, **more):
    df = spark.createDataFrame([(request(*spans),)], "value string")
    return interactions(spans_of_json(df), **more).collect()


def part(text, kind="text", field="content"):
    return {"type": kind, field: text}


def msg(role, *texts):
    return {"role": role, "parts": [part(t) for t in texts]}


def plain(messages):
    return [(m.role, m.text) for m in messages]


BASE = {"gen_ai.operation.name": "chat", "gen_ai.provider.name": "p", "gen_ai.request.model": "m"}


def test_standard_parts_and_ids(spark):
    out = {"role": "assistant", "parts": [part("resposta"), part("penso", "reasoning"), part({"b": 1, "a": "é"}, "tool_call", "arguments"), {"type": "blob", "content": "x"}, part(None)]}
    for value in ([out], json.dumps([out])):
        [r] = extract(spark, BASE | {"gen_ai.output.messages": value, "gen_ai.system": "q", "traceloop.association.properties.scenario": "pix", "traceloop.association.properties.attempt": 2, "traceloop.association.properties.list": [1]})
        assert (r.trace_id, r.span_id, r.parent_span_id, r.trace_flags, r.service_name, r.skip_reason) == (TRACE, SPAN, PARENT, 1, "shop", None)
        [m] = r.output_messages
        assert m.text == 'resposta\npenso\n{"a": "é", "b": 1}' and [(p.type, p.start, p.end) for p in m.parts] == [("text", 0, 8), ("reasoning", 9, 14), ("tool_call", 15, 33)]
        assert (r.provider_name, r.request_model, r.association_properties) == ("p", "m", {"scenario": "pix", "attempt": "2"})


def test_turn_and_context(spark):
    history = [msg("system", "be brief"), msg("user", "a" * 1500), msg("assistant", "b"), msg("user", "c"), msg("assistant", "d"), msg("tool", "t"), msg("user", "e"), msg("assistant", "f"), msg("user", "new")]
    [r] = extract(spark, BASE | {"gen_ai.input.messages": history, "gen_ai.system_instructions": [part("sys")], "gen_ai.output.messages": [msg("assistant", "ok") | {"finish_reason": "stop"}]})
    assert plain(r.system_instructions) == [("system", "sys"), ("system", "be brief")] and plain(r.input_messages) == [("user", "new")]
    assert plain(r.context_messages) == [("user", "c"), ("assistant", "d"), ("user", "e"), ("assistant", "f")] and r.finish_reasons == ["stop"]
    [r] = extract(spark, BASE | {"gen_ai.input.messages": [msg("user", "a" * 1500), msg("assistant", "b"), msg("user", "n")]})
    assert [len(m.text) for m in r.context_messages] == [1000, 1]


def test_indexed_convention_equals_standard(spark):
    indexed = {"llm.request.type": "chat", "gen_ai.completion.0.role": "assistant", "gen_ai.completion.0.content": "fine", "gen_ai.completion.0.finish_reason": "stop", "gen_ai.prompt.name": "x"}
    for i in range(12):
        indexed |= {f"gen_ai.prompt.{i}.role": "user", f"gen_ai.prompt.{i}.content": f"q{i}"}
    indexed["gen_ai.prompt.3.content"] = json.dumps([{"type": "text", "text": "q3"}, {"type": "image_url"}])
    standard = BASE | {"gen_ai.input.messages": [msg("user", f"q{i}") for i in range(12)], "gen_ai.output.messages": [msg("assistant", "fine") | {"finish_reason": "stop"}]}
    a, b = extract(spark, indexed, standard)
    for c in ("input_messages", "output_messages", "finish_reasons", "operation_name", "context_messages"):
        assert a[c] == b[c], c
    [r] = extract(spark, {"gen_ai.completion.0.tool_calls.10.arguments": "z", "gen_ai.completion.0.tool_calls.2.arguments": "y"})
    assert r.operation_name == "chat" and r.output_messages[0].text == "y\nz" and r.output_messages[0].role == "unknown"


def test_skip_reasons(spark):
    rows = extract(spark, {"gen_ai.operation.name": "embeddings"}, {"gen_ai.operation.name": "execute_tool"}, {"http.method": "GET"}, BASE, BASE | {"gen_ai.output.messages": [{"role": "a", "parts": [{"type": "blob"}]}]}, {"gen_ai.prompt.name": "t"}, BASE | {"gen_ai.input.messages": "not json", "gen_ai.prompt.0.content": "x"}, BASE | {"gen_ai.input.messages": [1, None, msg("user", "x")]})
    assert [r.skip_reason for r in rows] == ["not_inference"] * 3 + ["no_content"] * 2 + ["not_inference", "no_content", None]
    assert extract(spark, {"gen_ai.operation.name": "embeddings"}, own_service="shop")[0].skip_reason == "self_telemetry"


def test_output_type_and_finish_reasons(spark):
    own = {"gen_ai.input.messages": [msg("user", "x")]}
    rows = extract(spark, *(BASE | own | x for x in ({"gen_ai.output.type": "json"}, {"gen_ai.request.structured_output_schema": '{"type":"object"}'}, {"gen_ai.request.structured_output_schema": '{"type":"text"}'}, {"gen_ai.request.structured_output_schema": "{"}, {"gen_ai.response.finish_reasons": "stop"}, {"gen_ai.response.finish_reasons": ["", "length", 3]}, {"gen_ai.response.finish_reasons": []})))
    assert [r.output_type for r in rows] == ["json", "json", "text", None, None, None, None]
    assert [r.finish_reasons for r in rows[4:]] == [["stop"], ["length"], []]


def encoded(n, v):
    size = b""
    k = len(v)
    while True:
        size += bytes([k & 127 | (128 if k > 127 else 0)])
        k >>= 7
        if not k:
            return bytes([n << 3 | 2]) + size + v


def test_protobuf(spark):
    import gzip

    def pair(k, v):
        return encoded(1, k.encode()) + encoded(2, encoded(1, v.encode()))

    span = encoded(1, bytes.fromhex(TRACE)) + encoded(2, bytes.fromhex(SPAN)) + encoded(5, b"chat") + encoded(9, pair("gen_ai.operation.name", "chat")) + encoded(9, pair("gen_ai.input.messages", json.dumps([msg("user", "olá")])))
    body = encoded(1, encoded(1, encoded(1, pair("service.name", "shop"))) + encoded(2, encoded(2, span)))
    df = spark.createDataFrame([(bytearray(body), False), (bytearray(gzip.compress(body)), True), (bytearray(gzip.compress(body)[:-9]), True), (bytearray(b"\xff\xff"), False), (None, False)], "body binary, packed boolean")
    rows = interactions(spans_of_protobuf(df, gzip="packed")).collect()
    assert [(r.trace_id, r.parent_span_id, r.service_name, plain(r.input_messages)) for r in rows] == [(TRACE, None, "shop", [("user", "olá")])] * 2
    assert sorted(r.error for r in read_protobuf(df, gzip="packed").where("error is not null").collect()) == ["bad encoding", "not a request"]
    assert spans_of_protobuf(df, gzip="packed", limit=20).count() == 0
    assert sorted(r.error for r in read_protobuf(df, gzip="packed", limit=20).collect()) == ["not a request"] + ["too large"] * 3


def test_protobuf_values():
    """Every kind of value, and the same kinds in JSON requests."""
    from tracegauge.sources.otlp import any_value, plain_value, request_class

    request = request_class()()
    scope = request.resource_spans.add().scope_spans.add()
    a = scope.spans.add().attributes
    a.add(key="s").value.string_value = ""
    a.add(key="b").value.bool_value = False
    a.add(key="i").value.int_value = -3
    a.add(key="d").value.double_value = 0.5
    a.add(key="y").value.bytes_value = b"\x00\x01"
    a.add(key="l").value.array_value.values.add().int_value = 7
    a.add(key="n")
    pair = a.add(key="k").value.kvlist_value.values.add(key="z")
    pair.value.string_value = "é"
    back = request_class().FromString(request.SerializeToString()).resource_spans[0].scope_spans[0].spans[0]
    got = {x.key: plain_value(x.value) for x in back.attributes}
    assert got == {"s": "", "b": False, "i": -3, "d": 0.5, "y": "AAE=", "l": [7], "n": None, "k": {"z": "é"}}
    assert all(any_value(any_of(v)) == v for k, v in got.items() if k != "y")


def test_inference_spans(spark):
    spans = [BASE, {"gen_ai.operation.name": "embeddings"}, {"gen_ai.prompt.0.content": "x"}, {"gen_ai.operation.name": "embeddings", "gen_ai.prompt.0.content": ""}, {"http.method": "GET"}]
    df = spans_of_json(spark.createDataFrame([(request(*spans),)], "value string"))
    assert inference_spans(df).count() == 3


def test_gate(spark):
    rows = [(True, True, "application/x-protobuf", None, 5, None), (False, False, "x", "y", 99, 401), (True, False, "x", "y", 99, 503), (True, True, "application/json", None, 5, 415), (True, True, "application/x-protobuf; q=1", "br", 5, 415), (True, True, "application/x-protobuf", "gzip", 99, 413)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c string, d string, e int, want int")
    assert all(r.got == r.want for r in df.withColumn("got", gate(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"), limit=50)).collect())
