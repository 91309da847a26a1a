"""What is chosen before it is prepared, batches and judges by their own lengths, failures and times of single rows."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from test_evaluate import rows_of, run, talk
from test_extract import BASE, msg, request

from tracegauge.config import Settings
from tracegauge.functions.text import guarded
from tracegauge.operators import deadlines, emit
from tracegauge.operators.evaluators import batched, in_python
from tracegauge.operators.extract import interactions
from tracegauge.operators.judges import Check, Reply, described, is_valid, judge_check, object_in
from tracegauge.operators.runner import evaluate
from tracegauge.sources.otlp import spans_of_json

DEEP = 200_000


def test_only_chosen_rows_are_evaluated(spark, tmp_path):
    seen = str(tmp_path)

    def counting(i):
        open(f"{seen}/{i['trace_id']}", "w").close()
        return {"score": 1.0, "label": "pass"}

    lines = [(request(talk("x" if i % 3 else "never", "y")).replace("0af7651916cd43dd8448eb211c80319c", f"{i * 0x9E3779B97F4A7C15 % (1 << 64):032x}"),) for i in range(200)]
    rows = interactions(spans_of_json(spark.createDataFrame(lines, "value string")))
    mine = in_python("counting", counting, applies=lambda: F.col("input_messages")[0]["text"] == "x")
    s = Settings(evaluators=("counting", "pii_detection"), sample_rates={"counting": 0.1, "pii_detection": 0.5}, timeout_s=60.0)
    done = evaluate(rows, s, [mine]).collect()
    told = {r.trace_id for r in done if r.evaluator_name == "counting"}
    assert {p.name for p in tmp_path.iterdir()} == told and 0 < len(told) < 40
    assert told <= {r.trace_id for r in done if r.evaluator_name == "pii_detection"} and sum(r.evaluator_name == "pii_detection" for r in done) < 150


def test_batches_by_key_and_length(spark):
    def answer(names, i):
        text = "".join(m["text"] for m in i["output_messages"])
        if text.startswith("short"):
            return [{"score": 0.0}]
        if text.startswith("raise"):
            raise OSError
        return [{"score": len(text), "label": "pass", "explanation": ",".join(names), "attributes": {"n": len(names)}} for _ in names]

    more = [batched("a", "one", answer, 10), batched("b", "one", answer, 10), batched("c", "one", answer, 20), batched("d", "two", answer), batched("e", "two", answer, applies=lambda: F.size("input_messages") == 0)]
    out = run(spark, talk("x", "o" * 30), *"abcde", more=more)
    assert {n: (r.result.score, r.result.explanation, r.truncated) for n, r in out.items()} == {"a": (10.0, "a,b", True), "b": (10.0, "a,b", True), "c": (20.0, "c", True), "d": (30.0, "d", False)}
    assert all(r.duration_ns > 0 for r in out.values()) and out["a"].result.attributes == {"llm_eval.n": "2"}
    wrong = run(spark, talk("x", "short"), "a", "b", "d", more=more)
    assert (wrong["a"].result.error_type, wrong["b"].result.error_type, wrong["d"].result.score) == ("batch_length", "batch_length", 0.0)
    assert {r.result.error_type for r in run(spark, talk("x", "raise"), "a", "d", more=more).values()} == {"OSError"}
    out = run(spark, talk("x", "yes"), "a", "d", more=more, service="bank", exceptions={"bank": ("a",)})
    assert (out["a"].result.label, out["a"].result.score, out["d"].result.label) == ("exempt", None, "pass")


SCHEMA = {
    "type": "object",
    "required": ["score", "reason"],
    "properties": {
        "score": {"type": "integer", "minimum": 0, "maximum": 10, "description": "how polite it is"},
        "reason": {"type": "string"},
        "quotes": {"type": "array", "items": {"type": "object", "properties": {"text": {"type": "string"}, "tone": {"type": "string", "enum": ["kind", "rude"]}}, "required": ["text"]}},
    },
}


class Tutor:
    """Says what it was told, and how long the answer was that it saw."""

    def complete(self, conversation):
        n = len("".join(conversation["response"]))
        if "polite" in conversation["instructions"]:
            return Reply(json.dumps({"score": 7, "reason": f"{n}", "quotes": [{"text": "x", "tone": "odd" if n == 13 else "kind"}]}))
        return Reply(json.dumps({"score": 4, "reason": f"{n}"}))

    def decide(self, questions, conversation):
        return Reply(answers=dict.fromkeys(questions, min(1.0, len("".join(conversation["response"])) / 100)))


def always():
    return F.lit(True)


def test_judges_with_lengths_and_schemas_of_their_own(spark):
    more = [judge_check("polite", Check("rating", 6, 0, 10, "Rate how polite the answer is.", SCHEMA), always, max_chars=500), judge_check("near", Check("yes", 0.5), always, max_chars=20), judge_check("far", Check("yes", 0.5), always, max_chars=80), judge_check("also", Check("rating", 3), always, max_chars=500)]
    out = run(spark, talk("x", "o" * 700), "polite", "near", "far", "also", "relevance", more=more, client=Tutor)
    assert (out["polite"].result.score, out["polite"].result.label, out["polite"].result.explanation, out["polite"].truncated) == (0.7, "pass", "500", True)
    assert (out["near"].result.score, out["far"].result.score) == (pytest.approx(0.8), pytest.approx(0.2)) and out["near"].truncated and out["far"].result.label == "fail"
    assert (out["relevance"].result.explanation, out["relevance"].truncated) == ("700", False) and out["also"].result.explanation == "500"
    assert all(len(r.judge_calls) == 1 for r in out.values())  # two ratings are two requests, also of one length
    bad = run(spark, talk("x", "o" * 13), "polite", more=more, client=Tutor)["polite"]
    assert bad.result.error_type == "judge_invalid_output"


def test_schemas_in_words():
    assert described(SCHEMA).splitlines() == ["- score: integer, 0..10: how polite it is", "- reason: string", "- quotes (optional): array", "  - each: object", "    - text: string", '    - tone (optional): string, one of "kind", "rude"']
    good = {"score": 3, "reason": "x", "quotes": [{"text": "a", "tone": "rude"}]}
    assert is_valid(good, SCHEMA) and is_valid(object_in(f"Sure: {json.dumps(good)} done"), SCHEMA)
    assert not any(is_valid(v, SCHEMA) for v in ({"score": 3}, good | {"quotes": [{"tone": "rude"}]}, good | {"quotes": [{"text": "a", "tone": "odd"}]}, good | {"quotes": {}}))
    assert object_in('{"a":' * DEEP + "}") is None


def test_nested_texts_crash_nothing(spark):
    class Deep:
        def complete(self, conversation):
            return Reply('{"score":' * DEEP + "}")

        def decide(self, questions, conversation):
            return Reply()

    nested = "[" * DEEP
    spans = [talk("x", "a@b.co"), BASE | {"gen_ai.output.messages": nested}, BASE | {"gen_ai.completion.0.content": "[{" + nested}, talk("x", nested, **{"gen_ai.output.type": "json"}), BASE | {"gen_ai.response.finish_reasons": nested, "gen_ai.request.structured_output_schema": nested, "gen_ai.output.messages": [msg("assistant", "{}")]}]
    names = ("pii_detection", "secret_detection", "refusal", "system_prompt_leak", "output_format", "relevance")
    s = Settings(evaluators=names, sample_rates=dict.fromkeys(names, 1.0), timeout_s=60.0)
    rows = rows_of(spark, *spans)
    done = evaluate(rows, s, client=Deep).collect()
    assert sum(r.evaluator_name == "pii_detection" and r.result.label == "fail" for r in done) == 1
    assert {r.result.error_type for r in done if r.evaluator_name == "relevance"} == {"judge_invalid_output"}
    assert ["nested too deeply" in r.result.explanation for r in done if r.evaluator_name == "output_format"].count(True) == 1
    assert emit.events(evaluate(rows, s, client=Deep)).count() == len(done)


def test_a_row_that_raises_is_an_error_of_its_own(spark):
    def f(x):
        if x == 2:
            raise MemoryError
        return x * 10

    df = spark.createDataFrame([(1,), (2,), (None,), (3,)], "x int")
    rows = [r.o for r in df.select(guarded(LongType(), f)("x").alias("o")).collect()]
    assert [(r.value, r.error) for r in rows] == [(10, None), (None, "MemoryError"), (None, None), (30, None)] and [r.ns is None for r in rows] == [False, False, True, False]


def test_times_of_built_in_evaluators(spark):
    s = Settings(evaluators=("pii_detection", "refusal"))
    done = evaluate(rows_of(spark, talk("x", "y"), talk("z", "w")), s).cache()
    assert all(r.duration_ns > 0 for r in done.collect())
    assert sorted((r.evaluator_name, r.n, sum(r.buckets)) for r in emit.duration_histogram(done).collect()) == [("pii_detection", 2, 2), ("refusal", 2, 2)]


def test_calls_that_never_return_are_bounded(monkeypatch):
    monkeypatch.setattr(deadlines, "MOST_STUCK", 3)
    monkeypatch.setattr(deadlines.Workers, "stuck", [])
    free = threading.Event()
    w = deadlines.Workers(2)
    before = threading.active_count()
    began = time.time()
    got = [w.outcome(w.submit(lambda: free.wait(60)), 0.05)[1] for _ in range(20)]
    assert got == ["timeout"] * 3 + [deadlines.STUCK] * 17 and time.time() - began < 5 and threading.active_count() <= before + 4
    free.set()
    time.sleep(0.2)
    assert w.outcome(w.submit(lambda: 5), 5) == (5, None)
    w.close(2)
