"""Streams against their batch forms, over several micro-batches and after restarts."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues
from test_evaluate import Scripted, talk
from test_extract import request

from tracegauge.config import Settings
from tracegauge.operators import emit, stateful
from tracegauge.operators.evaluators import in_python
from tracegauge.streaming import state, topology

START = 1_700_000_000
NOW = {"availableNow": True}


def moment(s):
    return datetime.datetime.fromtimestamp(START + s)


def files_of(spark, rows, schema, at, parts):
    """rows (sorted by time) as one file for each micro-batch, shuffled within it."""
    rnd = random.Random(1)
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        own = rows[i : i + size]
        rnd.shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(at)


def source(spark, schema, at):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def test_repeats_equal_the_batch_form_after_restarts(spark, tmp_path):
    rnd, schema = random.Random(4), "k string, m map<string,string>, at timestamp"
    rows = sorted([(rnd.choice(["a", "b", "c", None]), {"i": str(i)}, moment(rnd.randrange(100))) for i in range(120)] + [("t", {}, moment(x)) for x in (5, 14, 15, 24, 25, 25)], key=lambda r: r[2])
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: topology.written(state.marked_repeats(source(spark, schema, at), ["k"], "at", 10, "1 hour"), out, NOW).awaitTermination()
    files_of(spark, rows[:60], schema, at, 2)
    run()
    files_of(spark, rows[60:], schema, at, 2)
    run()
    timed = spark.createDataFrame(rows, schema).withColumn("t", F.unix_micros("at") / 1e6)
    want = stateful.repeats(timed, ["k"], "t", 10).groupBy("k", "at").agg(F.count_if("duplicate").alias("n"), F.count("*").alias("all"))
    got = spark.read.parquet(out).groupBy("k", "at").agg(F.count_if("duplicate").alias("n"), F.count("*").alias("all"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    own = sorted((r.at, r.duplicate) for r in spark.read.parquet(out).where("k = 't'").collect())
    assert own == [(moment(s), d) for s, d in ((5, False), (14, True), (15, False), (24, True), (25, False), (25, True))]


def test_state_is_cleared_and_the_key_accepted_anew(spark, tmp_path):
    schema, at, out = "k string, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    for s in (10, 15, 4000, 4005, 9000):
        files_of(spark, [("a", moment(s))], schema, at, 1)
    topology.written(state.marked_repeats(source(spark, schema, at), ["k"], "at", 10, "1 minute"), out, NOW).awaitTermination()
    assert sorted((r.at, r.duplicate) for r in spark.read.parquet(out).collect()) == [(moment(s), d) for s, d in ((10, False), (15, True), (4000, False), (4005, True), (9000, False))]


def test_health_equals_the_batch_form(spark, tmp_path):
    rnd, schema = random.Random(7), "k string, at timestamp, label string, error string"
    rows = sorted(((rnd.choice("ab"), moment(i), "pass", rnd.choice(["timeout", "timeout", "E", None])) for i in range(150)), key=lambda r: r[1])
    rows.append(("a", moment(100_000), "pass", None))
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    said, bad = F.coalesce("error", "label"), F.col("error").isNotNull()
    run = lambda: topology.written(state.health(source(spark, schema, at), ["k"], "at", F.lit(""), said, bad, interval_s=60), out, NOW).awaitTermination()
    files_of(spark, rows[:80], schema, at, 3)
    run()
    files_of(spark, rows[80:], schema, at, 3)
    run()
    changes = spark.read.parquet(out)
    batch = spark.createDataFrame(rows, schema)
    want = stateful.failing(batch, ["k"], ["at"], bad)
    assert sorted(map(tuple, state.runs(changes, ["k"]).collect())) == sorted(map(tuple, want.collect()))
    # one summary for each interval that has ended, and all rows are in them
    told = {(r.k, r.since // 1_000_000): (r.summary, r.troubled) for r in changes.where("kind = 'summary'").collect()}
    expected = {}
    for k, t, label, error in rows[:-1]:
        own = expected.setdefault((k, int(t.timestamp()) // 60 * 60), {})
        own[error or label] = own.get(error or label, 0) + 1
    assert told == {k: (", ".join(f"{o}={n}" for o, n in sorted(v.items())), set(v) != {"pass"}) for k, v in expected.items()}


class Judge(Scripted):
    def complete(self, conversation):
        return super().complete(conversation | {"request": ["3"]})


def with_ids(line, i):
    return line.replace("b7ad6b7169203331", f"{i:016x}")


def test_topology_counts_once_over_restarts(spark, tmp_path, caplog):
    names = ("pii_detection", "secret_detection", "relevance", "fragile")

    def fragile(interaction):
        if "CPF" in str(interaction["input_messages"]):
            raise LookupError
        return {"score": 0.5, "label": "pass"}

    s = Settings(evaluators=names, sample_rates=dict.fromkeys(names, 1.0), timeout_s=60.0)
    caplog.set_level("INFO", "tracegauge")
    counts = topology.Counts()
    spark.streams.addListener(counts)
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for k in range(2):
        for i in (2 * k, 2 * k + 1, 0):  # the span 0 comes again
            line = with_ids(request(talk("CPF 529.982.247-25" if i % 2 else "hello", "ok")), i + 1)
            (tmp_path / "in" / f"{k}{i}.txt").write_text(line + "\n")
        (tmp_path / "in" / f"{k}x.txt").write_text("no request\n")
        running = topology.evaluate_stream(spark.readStream.text(str(tmp_path / "in")), s, out, Judge, [in_python("fragile", fragile)])
        running.awaitTermination()
        health = running.health()
        assert {n.rpartition("-")[0] for n in health} == {"interactions", "evaluations", "events", "spans", "judge_spans", "health", "metrics"} and not any(h["failed"] or h["active"] for h in health.values())
    spark.streams.removeListener(counts)
    e = spark.read.parquet(f"{out}/evaluations")
    assert e.count() == 16 and spark.read.parquet(f"{out}/events").count() == 16 and spark.read.parquet(f"{out}/spans").count() == 16
    assert e.where("result.error_type = 'LookupError'").count() == 2
    keys = ["evaluator_name", "label", "error_type"]
    got = topology.metrics_now(spark, out).groupBy(*keys).agg(F.sum("n"), F.sum("scores")).collect()
    plain = e.groupBy("evaluator_name", "result.label", "result.error_type").agg(F.count("*"), F.count("result.score")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)
    hist = {r.evaluator_name: r.buckets for r in topology.metrics_now(spark, out).where("label is not null").groupBy("evaluator_name", "label").agg(F.array(*[F.sum(F.col("buckets")[i]) for i in range(11)]).alias("buckets")).where("evaluator_name = 'secret_detection'").collect()}
    batch = {r.evaluator_name: r.buckets for r in emit.score_histogram(e, s).where("evaluator_name = 'secret_detection'").groupBy("evaluator_name").agg(F.array(*[F.sum(F.col("buckets")[i]) for i in range(11)]).alias("buckets")).collect()}
    assert hist == batch
    assert "received=" in caplog.text and not any(x in caplog.text for x in ("529.982", "hello", "CPF")) and len(counts.rates) == 7
    total = counts.total()
    assert (total["received"], total["duplicate"], total["evaluated"], total["no_content"]) == (5, 1, 4, 0)


@pytest.mark.parametrize("own", [None, "some.Store"])
def test_the_sessions_store_comes_back(spark, own):
    before = spark.conf.get(state.STORE, None)
    if own:
        spark.conf.set(state.STORE, own)
    with state.keyed_state(spark):
        assert spark.conf.get(state.STORE) == state.ROCKS
    assert spark.conf.get(state.STORE, None) == (own or before)
    if before is None:
        spark.conf.unset(state.STORE)


class Held:
    """A state handle that counts its calls."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                handle.calls += 1
                return handle.values.get(name)

            def update(self, value):
                handle.calls += 1
                handle.values[name] = value

            def clear(self):
                handle.calls += 1
                handle.values.pop(name, None)

        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_health_takes_few_calls_for_many_intervals():
    rows = [("k", None, minute * 60_000_000 + i, "", (minute + i) % 3 == 0, "ab"[i % 2]) for minute in range(100) for i in range(4)]
    held, health = Held(), state.Health(2, 60_000_000)
    health.init(held)
    for part in (rows[200:], rows[:200]):  # the second batch has the earlier intervals
        list(health.handleInputRows(("k",), iter([pd.DataFrame(part[:7]), pd.DataFrame(part[7:])]), TimerValues(-1, -1)))
    assert held.calls <= 12 and held.timers == {60_000}
    held.timers.clear()
    got = pd.concat(health.handleExpiredTimer(("k",), TimerValues(-1, 3_000_000), None))
    assert got["since"].tolist() == [m * 60_000_000 for m in range(50)] and set(got["summary"]) == {"a=2, b=2"} and held.timers == {51 * 60_000}
    held.timers.clear()
    assert len(pd.concat(health.handleExpiredTimer(("k",), TimerValues(-1, 6_000_000), None))) == 50 and not held.timers and "intervals" not in held.values


def test_health_keeps_keys_as_they_are(spark, tmp_path):
    keys = [(None, "x"), (2**53 + 1, None), (2**53, 'a"ü'), (None, None)]
    rows = sorted(((*keys[i % 4], moment(i), i % 7 > 1) for i in range(200)), key=lambda r: r[2])
    schema, at, out = "k long, name string, at timestamp, bad boolean", str(tmp_path / "in"), str(tmp_path / "out")
    files_of(spark, rows, schema, at, 2)
    changes = state.health(source(spark, schema, at), ["k", "name"], "at", F.lit(None), F.lit("x"), F.col("bad"), interval_s=None)
    topology.written(changes, out, NOW).awaitTermination()
    got = spark.read.parquet(out)
    want = stateful.failing(spark.createDataFrame(rows, schema), ["k", "name"], ["at"], F.col("bad"))
    assert sorted(map(tuple, state.runs(got, ["k", "name"]).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and want.count() > 8
    assert {r.kind for r in got.select("kind").distinct().collect()} == {"failing", "recovered"}
