"""Evaluation events, child spans, judge-call spans and metrics, from evaluations. Every text that leaves is sanitised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.detect import REDACTED, find, sanitize, sanitize_each
from ..functions.text import apart
from ..schemas import CALL_BOUNDS, DURATION_BOUNDS, FAIL, SCORE_BOUNDS, TOKEN_BOUNDS

ASSOCIATION = "traceloop.association.properties."


def severity(label: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "ERROR").when(label == FAIL, "WARN").otherwise("INFO")


def events(evaluations: DataFrame) -> DataFrame:
    """One event for each evaluation: identity, severity, attributes (a map of texts, absent ones left out), redactions."""
    r = F.col("result")
    fixed = {
        "gen_ai.evaluation.name": F.col("evaluator_name"), "gen_ai.operation.name": F.col("operation_name"), "llm_eval.evaluation.type": F.col("evaluator_kind"),
        "gen_ai.evaluation.score.value": r["score"].cast("string"), "gen_ai.evaluation.score.label": r["label"], "gen_ai.evaluation.explanation": r["explanation"], "gen_ai.response.id": F.col("response_id"),
        "gen_ai.provider.name": F.col("provider_name"), "gen_ai.request.model": F.col("request_model"), "error.type": r["error_type"], "llm_eval.source.service.name": F.col("service_name"),
        "llm_eval.content.truncated": F.when(F.col("truncated"), "true"),
    }
    own = F.create_map(*(y for k, v in fixed.items() for y in (F.lit(k), v)))
    copied = F.transform_keys("association_properties", lambda k, v: F.concat(F.lit(ASSOCIATION), k))
    # evaluators may add their own names only
    added = F.map_filter(r["attributes"], lambda k, v: k.startswith("llm_eval."))
    entries = F.filter(F.concat(F.map_entries(own), F.map_entries(copied), F.map_entries(added)), lambda e: e["value"].isNotNull())
    df = apart(evaluations, "_entries", entries)
    # a score is a number whatever it looks like
    score = lambda e: e["key"] == "gen_ai.evaluation.score.value"
    df = apart(df, "_values", F.transform("_entries", lambda e: F.when(~score(e), e["value"])))
    df = apart(df, "_values", sanitize_each("_values"))
    df = df.withColumn("_clean", F.zip_with("_entries", "_values", lambda e, v: F.struct(e["key"].alias("key"), F.coalesce(v, e["value"]).alias("value"))))
    count = F.aggregate(F.zip_with("_entries", "_clean", lambda a, b: ((b["value"] == REDACTED) & (a["value"] != REDACTED)).cast("int")), F.lit(0), lambda a, x: a + x)
    return df.select("trace_id", F.col("span_id").alias("parent_span_id"), "trace_flags", F.lit("gen_ai.evaluation.result").alias("event_name"), severity(r["label"], r["error_type"]).alias("severity"), F.map_from_entries("_clean").alias("attributes"), count.alias("redactions"))


def span_id_of(*parts: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(*parts)), 16, "0"))


def evaluation_spans(evaluations: DataFrame) -> DataFrame:
    """An `evaluate {name}` child span for each evaluation; its id is a hash, so a repeated write is the same span."""
    e = events(evaluations)
    name = F.col("attributes")["gen_ai.evaluation.name"]
    return e.select("trace_id", span_id_of(F.col("trace_id"), F.col("parent_span_id"), name).alias("span_id"), "parent_span_id", F.concat(F.lit("evaluate "), name).alias("name"), F.lit("INTERNAL").alias("kind"), F.when(F.col("severity") == "ERROR", "ERROR").otherwise("UNSET").alias("status"), "attributes")


def judge_spans(evaluations: DataFrame) -> DataFrame:
    """A client span for each judge call, without content."""
    c = evaluations.select("trace_id", F.col("span_id").alias("evaluated_span_id"), "evaluator_name", F.explode("judge_calls").alias("c"))
    parent = span_id_of(F.col("trace_id"), F.col("evaluated_span_id"), F.col("evaluator_name"))
    return c.select("trace_id", span_id_of(parent, F.lit("call")).alias("span_id"), parent.alias("parent_span_id"), F.concat_ws(" ", "c.operation_name", "c.request_model").alias("name"), F.lit("CLIENT").alias("kind"), F.when(F.col("c.error_type").isNotNull(), "ERROR").otherwise("UNSET").alias("status"), "c.*")


def bucket_counts(value: Column, bounds: list[float]) -> list[Column]:
    """Counts of buckets: upper bounds inclusive, the last open."""
    buckets = []
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        inside = (F.lit(True) if lo is None else value > lo) & (F.lit(True) if hi is None else value <= hi)
        buckets.append(F.count_if(inside & value.isNotNull()))
    return buckets


def histogram(df: DataFrame, keys: Sequence[str | Column], value: Column, bounds: list[float]) -> DataFrame:
    """n, total and cumulative-free counts of buckets of each group."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.array(*bucket_counts(value, bounds)).alias("buckets"))


COMMON_KEYS = ["evaluator_name", "evaluator_kind", "service_name", "provider_name", "request_model", "association"]


def with_common_keys(evaluations: DataFrame, settings: Settings) -> DataFrame:
    """evaluations with the metrics' common keys, sanitised as events are: names, and the association properties (those of
    association_exclude left out) as JSON."""
    own = F.array_sort(F.map_entries(F.map_filter("association_properties", lambda k, v: ~k.isin(*settings.association_exclude))))
    df = apart(evaluations, "_own", own)
    df = apart(df, "_values", F.concat(F.array("service_name", "provider_name", "request_model"), F.transform("_own", lambda e: e["value"])))
    df = apart(df, "_values", sanitize_each("_values"))
    names = {c: F.col("_values")[i] for i, c in enumerate(("service_name", "provider_name", "request_model"))}
    association = F.to_json(F.map_from_arrays(F.transform("_own", lambda e: e["key"]), F.slice("_values", 4, F.size("_own"))))
    return df.withColumns(names | {"association": association}).drop("_own", "_values")


def evaluation_counts(evaluations: DataFrame, settings: Settings) -> DataFrame:
    return with_common_keys(evaluations, settings).groupBy(*COMMON_KEYS, F.col("result.label").alias("label"), F.col("result.error_type").alias("error_type")).agg(F.count("*").alias("n"))


def score_histogram(evaluations: DataFrame, settings: Settings) -> DataFrame:
    """Scores by the common keys; exempt results and errors have none."""
    return histogram(with_common_keys(evaluations.where("result.score is not null"), settings), COMMON_KEYS, F.col("result.score"), SCORE_BOUNDS)


def points(metric: DataFrame, name: str, keys: Sequence[str], bounds: list[float] | None = None) -> DataFrame:
    """Rows of a count or histogram as points of a metric of that name, their keys as attributes: what the sources' writer takes."""
    own = F.map_filter(F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k).cast("string")))), lambda k, v: v.isNotNull())
    nanos = lambda at: (F.unix_micros(at) * 1000).alias
    times = [nanos("window.start")("start_ns"), nanos("window.end")("time_ns")] if "window" in metric.columns else [F.lit(None).cast("long").alias("start_ns"), (F.unix_micros(F.current_timestamp()) * 1000).alias("time_ns")]
    histogram_ = [] if bounds is None else ["total", "buckets", F.array(*map(F.lit, bounds)).alias("bounds")]
    return metric.select(F.lit(name).alias("name"), own.alias("attributes"), *times, "n", *histogram_)


def redaction_counts(events_: DataFrame) -> DataFrame:
    """Redacted values by evaluator, of events."""
    return events_.groupBy(F.col("attributes")["gen_ai.evaluation.name"].alias("evaluator_name")).agg(F.sum("redactions").alias("redactions"))


def duration_histogram(evaluations: DataFrame) -> DataFrame:
    """Seconds that evaluations took in Python or with the judge. Columns are evaluated within the scan and have no time of their own."""
    timed = evaluations.where("duration_ns is not null")
    return histogram(timed, ["evaluator_name", F.col("result.error_type").alias("error_type")], F.col("duration_ns") / 1e9, DURATION_BOUNDS)


def call_metrics(evaluations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histograms of tokens (by token type) and of durations of the judge's calls."""
    c = evaluations.select("evaluator_name", F.explode("judge_calls").alias("c")).select("evaluator_name", "c.*")
    keys = ["operation_name", "provider_name", "request_model", "response_model", "server_address", "server_port", "evaluator_name"]
    tokens = c.select(*keys, F.explode(F.array(F.struct(F.lit("input").alias("token_type"), F.col("input_tokens").alias("tokens")), F.struct(F.lit("output").alias("token_type"), F.col("output_tokens").alias("tokens")))).alias("t")).select(*keys, "t.*").where("tokens is not null")
    return histogram(tokens, [*keys, "token_type"], F.col("tokens"), TOKEN_BOUNDS), histogram(c, [*keys, "error_type"], (F.col("end_ns") - F.col("start_ns")) / 1e9, CALL_BOUNDS)


def skip_counts(interactions: DataFrame) -> DataFrame:
    """Spans by skip_reason; the null reason counts those to be evaluated."""
    return interactions.groupBy("skip_reason").agg(F.count("*").alias("n"))


def interval_summary(evaluations: DataFrame) -> DataFrame:
    """One line for each evaluator, `fail=1, pass=2`, and whether something is wrong."""
    n = evaluations.groupBy("evaluator_name", F.coalesce("result.error_type", "result.label").alias("outcome"), F.col("result.error_type").isNotNull().alias("bad")).agg(F.count("*").alias("n"))
    return n.groupBy("evaluator_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat("outcome", F.lit("="), F.col("n").cast("string")))), ", ").alias("summary"), F.max("bad").alias("troubled"))


def result_lines(evaluations: DataFrame) -> DataFrame:
    """JSON lines of results, sanitised: what a command line prints."""
    r = F.col("result")
    df = apart(evaluations, "_said", r["explanation"])
    df = apart(df, "_said", sanitize("_said"))
    calls = F.transform("judge_calls", lambda c: F.struct(c["operation_name"].alias("operation"), F.coalesce(c["response_model"], c["request_model"]).alias("model"), c["input_tokens"].alias("input_tokens"), c["output_tokens"].alias("output_tokens"), c["error_type"].alias("error_type"), ((c["end_ns"] - c["start_ns"]) / 1_000_000).cast("long").alias("ms")))
    line = F.struct("trace_id", "span_id", F.col("response_id").alias("id"), F.col("evaluator_name").alias("evaluator"), r["score"].alias("score"), r["label"].alias("label"), F.col("_said").alias("explanation"), r["error_type"].alias("error_type"), "truncated", (F.col("duration_ns") / 1_000_000).cast("long").alias("ms"), calls.alias("judge_calls"))
    return df.select("trace_id", F.col("evaluator_name").alias("evaluator"), F.to_json(line).alias("value"))


def details(evaluations: DataFrame, labels: DataFrame) -> DataFrame:
    """JSON lines of labelled items (id, lang, label) with what their evaluation (response_id) said, whether it agrees, and its calls."""
    r = F.col("result")
    both = labels.join(evaluations.withColumnRenamed("response_id", "id"), "id", "left")
    return both.select(F.to_json(F.struct("id", "lang", F.col("label").alias("human"), F.col("evaluator_name").alias("evaluator"), r["label"].alias("label"), r["score"].alias("score"), (r["label"] == F.col("label")).alias("agrees"), r["error_type"].alias("error_type"), F.size("judge_calls").alias("calls"))).alias("value"))


def leaks(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text column still holds something sensitive; for tests of what is written."""
    return apart(df, "_found", find(column)).where(F.size("_found") > 0).drop("_found")
