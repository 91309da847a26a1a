"""The data source of export requests: planning, rejects, streams that go on, and what is written read back."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from test_evaluate import rows_of, talk
from test_extract import msg, request

from tracegauge.config import Settings
from tracegauge.operators import emit
from tracegauge.operators.runner import evaluate
from tracegauge.schemas import SCORE_BOUNDS
from tracegauge.sources import otlp_files
from tracegauge.sources.otlp import decode_json, read_json, request_class, spans_of_json
from tracegauge.streaming import topology

OWN = ["trace_id", "span_id", "parent_span_id", "trace_flags", "name", "service_name", "attributes"]


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(otlp_files.OtlpFiles)


def line(i, service="shop", **more):
    return request({"gen_ai.operation.name": "chat", "n": i, "x": [1, {"a": None, "b": 1.5, "c": True}], "é": "ü\n"} | more, service=service).replace("b7ad6b7169203331", f"{i:016x}")


def rows(df):
    return sorted(map(tuple, df.select(*OWN).withColumn("attributes", F.to_json("attributes")).collect()), key=repr)


def put(at, name, *lines):
    data = "".join(x + "\n" for x in lines).encode()
    (at / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)


def test_all_kinds_of_files_and_rejects(spark, tmp_path):
    put(tmp_path, "a.jsonl", line(1), "", "no json", line(2))
    put(tmp_path, "b.jsonl.gz", line(3), "[1]", '{"resourceSpans": 5}', "[" * 100_000)
    (tmp_path / "c.pb").write_bytes(otlp_files.as_protobuf(json.loads(line(4)), "traces"))
    (tmp_path / "d.pb.gz").write_bytes(b"no gzip")
    (tmp_path / "e.pb").write_bytes(b"\xff\xff\xff")
    put(tmp_path, "_hidden.jsonl", line(5))
    (tmp_path / "other.csv").write_text("x")
    put(tmp_path, "f.json", line(6, more="y" * 300_000))
    got = spark.read.format("otlp").option("maxRequestBytes", 150_000).load(str(tmp_path))
    good = got.where("error is null")
    lines = spark.createDataFrame([(line(i),) for i in (1, 2, 3, 4)], "value string")
    assert rows(good) == rows(spans_of_json(lines))
    bad = sorted((r.file.rpartition("/")[2], r.error) for r in got.where("error is not null").collect())
    assert bad == [("a.jsonl", "not a request"), *[("b.jsonl.gz", "not a request")] * 3, ("d.pb.gz", "bad encoding"), ("e.pb", "not a request"), ("f.json", "too large")]


def test_planning_by_size_reads_each_line_once(spark, tmp_path):
    put(tmp_path, "a.jsonl", *(line(i) for i in range(50)))
    for i in range(50, 60):
        put(tmp_path, f"b{i}.jsonl", line(i))
    for size in (100, 777, 5000, 10_000_000):
        df = spark.read.format("otlp").option("partitionBytes", size).load(str(tmp_path))
        assert sorted(int(r.span_id, 16) for r in df.collect()) == list(range(60))
    files = [("a.jsonl", 1000), ("b.jsonl.gz", 1000), ("c.jsonl", 10), ("d.jsonl", 10), ("e.jsonl", 0)]
    assert [p.pieces for p in otlp_files.planned(files, 400)] == [[("a.jsonl", 0, 400)], [("a.jsonl", 400, 800)], [("a.jsonl", 800, 1000)], [("b.jsonl.gz", 0, 1000)], [("c.jsonl", 0, 10), ("d.jsonl", 0, 10), ("e.jsonl", 0, 0)]]
    assert spark.read.format("otlp").load(str(tmp_path / "none")).count() == 0


def test_json_requests_with_rejects_equal_the_columns_form(spark):
    lines = spark.createDataFrame([(line(1),), (line(2, service=""),), (None,), (" ",), ("{",), ("7",)], "value string")
    got = read_json(lines)
    assert rows(got.where("error is null")) == rows(spans_of_json(lines)) and got.where("error = 'not a request'").count() == 2
    assert read_json(lines, limit=10).where("error = 'too large'").count() == 2


def test_stream_goes_on_and_feeds_evaluations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s, out = Settings(), str(tmp_path / "out")
    source = lambda: spark.readStream.format("otlp").option("path", str(tmp_path / "in")).option("log", str(tmp_path / "log")).load()
    said = lambda i: request(talk("CPF 529.982.247-25", "ok")).replace("b7ad6b7169203331", f"{i:016x}")
    put(tmp_path / "in", "b.jsonl", said(1), "broken")
    topology.evaluate_stream(source(), s, out).awaitTermination()
    put(tmp_path / "in", "a.jsonl", said(2))  # sorts before what has been read
    topology.evaluate_stream(source(), s, out).awaitTermination()
    topology.evaluate_stream(source(), s, out).awaitTermination()
    assert sorted(r.span_id for r in spark.read.parquet(f"{out}/interactions").collect()) == [f"{i:016x}" for i in (1, 2)]
    assert spark.read.parquet(f"{out}/events").count() == 4


@pytest.mark.parametrize("encoding", ["json", "protobuf"])
@pytest.mark.parametrize("packed", ["true", "false"])
def test_spans_round_trip(spark, tmp_path, encoding, packed):
    spans = spans_of_json(spark.createDataFrame([(line(i, service=s),) for i, s in enumerate(["shop", "bank", "", "shop"] * 5)], "value string"))
    write = lambda mode: spans.repartition(3).write.format("otlp").mode(mode).option("encoding", encoding).option("gzip", packed).option("requestRows", 2).save(str(tmp_path / "x"))
    write("append")
    back = spark.read.format("otlp").load(str(tmp_path / "x"))
    assert back.where("error is not null").count() == 0 and rows(back) == rows(spans)
    write("overwrite")
    assert rows(spark.read.format("otlp").load(str(tmp_path / "x"))) == rows(spans)


def test_events_spans_and_metrics_as_requests(spark, tmp_path):
    s = Settings()
    e = evaluate(rows_of(spark, talk("CPF 529.982.247-25", "ok")), s)
    emit.events(e).write.format("otlp").mode("append").option("signal", "logs").option("encoding", "protobuf").option("service", "evaluator").save(str(tmp_path / "logs"))
    emit.evaluation_spans(e).write.format("otlp").mode("append").option("attributes", "plain").save(str(tmp_path / "spans"))
    emit.points(emit.score_histogram(e, s), "gen_ai.evaluation.score", emit.COMMON_KEYS, SCORE_BOUNDS).write.format("otlp").mode("append").option("signal", "metrics").option("encoding", "protobuf").save(str(tmp_path / "metrics"))
    emit.points(emit.evaluation_counts(e, s), "llm_eval.evaluations", [*emit.COMMON_KEYS, "label"]).write.format("otlp").mode("append").option("signal", "metrics").save(str(tmp_path / "counts"))
    files = lambda name: sorted(p for p in (tmp_path / name).iterdir() if p.is_file())
    logs = [x for p in files("logs") for r in request_class("ExportLogsServiceRequest").FromString(p.read_bytes()).resource_logs for x in r.scope_logs[0].log_records]
    assert sorted((x.severity_text, x.severity_number) for x in logs) == [("INFO", 9), ("WARN", 13)] and {x.event_name for x in logs} == {"gen_ai.evaluation.result"} and len(logs[0].trace_id) == 16
    spans = spark.read.format("otlp").load(str(tmp_path / "spans"))
    assert sorted(r.name for r in spans.collect()) == ["evaluate pii_detection", "evaluate secret_detection"]
    points = [p for f in files("metrics") for r in request_class("ExportMetricsServiceRequest").FromString(f.read_bytes()).resource_metrics for m in r.scope_metrics[0].metrics for p in m.histogram.data_points]
    assert sorted((p.count, p.sum, list(p.bucket_counts)) for p in points) == [(1, 0.0, [1] + [0] * 10), (1, 1.0, [0] * 9 + [1, 0])] and list(points[0].explicit_bounds) == SCORE_BOUNDS
    counts = [json.loads(x) for p in files("counts") for x in p.read_text().splitlines()]
    sums = [m["sum"]["dataPoints"][0]["asInt"] for c in counts for r in c["resourceMetrics"] for m in r["scopeMetrics"][0]["metrics"]]
    assert sums == [1, 1]
    everything = b"".join(p.read_bytes() for n in ("logs", "metrics", "counts", "spans") for p in files(n))
    assert b"529.982" not in everything


def test_a_batch_that_is_committed_again_leaves_no_duplicates(tmp_path):
    from pyspark.sql import Row

    row = Row("trace_id", "span_id", "name", "service_name", "attributes")("0" * 31 + "1", "0" * 15 + "1", "chat", "shop", {"a": "1"})
    w = otlp_files.StreamWriter({"path": str(tmp_path)})
    first, second, lost = w.write(iter([row])), w.write(iter([row])), w.write(iter([row, row]))
    w.commit([first], 7)
    w.commit([second, None], 7)
    w.abort([lost, None], 8)
    own = otlp_files.Files(str(tmp_path)).listed()
    assert len(own) == 1 and "/batch=7/" in own[0][0]
    assert [r[1] for r in decode_json(open(own[0][0]).read())] == ["0" * 15 + "1"]


def test_stream_written_and_read_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = lambda: spans_of_json(spark.readStream.text(str(tmp_path / "in")))
    run = lambda: source().writeStream.format("otlp").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    put(tmp_path / "in", "a.txt", line(1), line(2))
    run()
    put(tmp_path / "in", "b.txt", line(3))
    run()
    back = spark.read.format("otlp").load(str(tmp_path / "out"))
    assert rows(back) == rows(spans_of_json(spark.createDataFrame([(line(i),) for i in (1, 2, 3)], "value string")))
    assert msg("a") and {p.name for p in (tmp_path / "out").glob("batch=*")} == {"batch=0", "batch=1"}
