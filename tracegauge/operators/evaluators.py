"""Evaluators: what they apply to and their result, as columns over interactions; their registry.

An evaluator's columns may be read only through `prepare`d helper columns, so that costly text functions run once a row, and only in rows
that are chosen. Python runs in guarded stages: what raises in one is an error result of that row and evaluator, and takes its time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial
from importlib.metadata import entry_points

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType

from ..config import Settings
from ..functions.detect import FINDING, found_in
from ..functions.columns import let
from ..functions.refusals import HEAD, refusal_language
from ..functions.text import LEAK, apart, error_in, four_places, guarded, leak_of, normalized, staged, two_decimals, words_in
from ..schemas import EXEMPT, FAIL, INTERACTION_COLUMNS, PASS, RESULT
from .deadlines import Workers
from .extract import text_of

LOCATIONS = {"system": "system_instructions", "input": "input_messages", "output": "output_messages"}
NGRAM, LEAST_SYSTEM_WORDS, LONGEST_RUN, MOST_COVERAGE = 8, 30, 20, 0.15
GROUP = "tracegauge.evaluators"
RESULT_TYPE = StructType([StructField("score", DoubleType()), StructField("label", StringType()), StructField("explanation", StringType()), StructField("attributes", MapType(StringType(), StringType())), StructField("error_type", StringType())])
ANSWERS = StructType([StructField("results", ArrayType(RESULT_TYPE)), StructField("ns", LongType())])
#: The error of a batch that answers for more or fewer evaluators than it was asked.
BATCH_LENGTH = "batch_length"


@dataclass(frozen=True)
class Evaluator:
    """applies and result are columns over the prepared interactions. prepare gets the rows that are chosen as a column: in others it needn't
    give anything. needs names columns that several evaluators share (SHARED); stages names guarded stages, whose errors and times are the evaluator's.

    ask marks one that a judge answers (see judges), answer one that Python answers for all evaluators of its batch_key and max_chars at once: it
    gets their names and the interaction, cut to max_chars, and returns a result for each, in order (see batched)."""

    name: str
    kind: str
    rate: float
    applies: Callable[[], Column]
    result: Callable[[Settings], Column] | None = None
    prepare: Callable[[DataFrame, Settings, Column], DataFrame] = field(default=lambda df, settings, chosen: df)
    max_chars: int | None = None
    ask: object = None
    needs: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    batch_key: str | None = None
    answer: Callable[[list[str], dict], list[dict]] | None = None
    check: object = None

    def error(self) -> Column:
        return F.coalesce(*(F.col(f"{s}_error") for s in self.stages), F.lit(None).cast("string"))

    def duration(self) -> Column:
        """Nanoseconds in Python; those of a shared stage count for each evaluator. Null for one of columns alone."""
        total = sum((F.coalesce(F.col(f"{s}_ns"), F.lit(0)) for s in self.stages), F.lit(0))
        return total.cast("long") if self.stages else F.lit(None).cast("long")


class EvaluatorLoadError(Exception):
    """An evaluator that isn't there, can't be made, or bears another name."""


def result(score=None, label=None, explanation=None, attributes=None, error=None) -> Column:
    null = lambda x, t: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(t)
    pairs = [y for k, v in (attributes or {}).items() for y in (F.lit(f"llm_eval.{k}"), v.cast("string"))]
    made = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(null(score, "double").alias("score"), null(label, "string").alias("label"), null(explanation, "string").alias("explanation"), made.alias("attributes"), null(error, "string").alias("error_type")).cast(RESULT)


def texts_by_location() -> Column:
    """All texts with where they are, in the order system, input, output."""

    def of(at: str, column: str) -> Column:
        return F.transform(column, lambda m: F.struct(F.lit(at).alias("location"), m["text"].alias("text")))

    return F.concat(*(of(at, c) for at, c in LOCATIONS.items()))


FIND = guarded(ArrayType(ArrayType(FINDING)), lambda texts: [None if t is None else found_in(t) for t in texts])
NORMALIZE = guarded(ArrayType(StringType()), lambda texts: [normalized(t or "") for t in texts])
JSON_ERRORS = guarded(ArrayType(StringType()), lambda texts: [error_in(t or "") for t in texts])


def with_findings(df: DataFrame, settings: Settings, chosen: Column) -> DataFrame:
    """df with all findings of each text, once for all evaluators that read them."""
    df = apart(df, "_texts", F.when(chosen, texts_by_location()))
    return staged(df, "_found", FIND, F.col("_texts.text"))


#: What several evaluators read.
SHARED = {"findings": with_findings}


def located(secret: bool) -> Column:
    """array<struct<kind, location>> of the findings, in order: credentials, or personal data."""

    def of(x: Column, found: Column) -> Column:
        return F.transform(F.filter(found, lambda f: f["secret"] == secret), lambda f: F.struct(f["kind"].alias("kind"), x["location"].alias("location")))

    return F.flatten(F.zip_with("_texts", "_found", of))


def summary(found: Column) -> Column:
    """`kind=n (location)` of findings, as first seen."""
    return let(found, lambda all_: F.array_join(F.transform(F.array_distinct(all_), lambda x: F.concat(x["kind"], F.lit("="), F.size(F.filter(all_, lambda y: y == x)).cast("string"), F.lit(" ("), x["location"], F.lit(")"))), ", "))


def findings_result(found: Column, attribute: str) -> Column:
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["kind"]))), ",")
    return F.when(F.size(found) > 0, result(0.0, FAIL, summary(found), {attribute: kinds})).otherwise(result(1.0, PASS, "no findings"))


def pii_findings(df: DataFrame, settings: Settings, chosen: Column) -> DataFrame:
    # overlaps are settled among all types before the types are chosen
    return df.withColumn("_pii", F.filter(located(False), lambda x: x["kind"].isin(*settings.pii_types)))


def texts(messages: str, *types: str) -> Column:
    return F.filter(F.transform(messages, lambda m: text_of(m, *types)), lambda t: t != "")


def refusal_columns(df: DataFrame, settings: Settings, chosen: Column) -> DataFrame:
    heads = F.transform(texts("output_messages", "text"), lambda t: F.substr(t, F.lit(1), F.lit(HEAD)))
    df = staged(df, "_heads", NORMALIZE, F.when(chosen, heads))
    return df.withColumn("_languages", F.filter(F.transform("_heads", refusal_language), lambda x: x.isNotNull()))


def refusal_result(settings: Settings) -> Column:
    filtered = F.size(F.filter("finish_reasons", lambda r: r == "content_filter"))
    languages = F.col("_languages")
    says = lambda n, source, more="": F.concat(F.lit("refusal="), n.cast("string"), F.lit(f" (output), source={source}{more}"))
    return (
        F.when(filtered > 0, result(0.0, FAIL, says(filtered, "finish_reason"), {"refusal.source": F.lit("finish_reason")}))
        .when(F.size(languages) > 0, result(0.0, FAIL, F.concat(says(F.size(languages), "phrase", ", lang="), languages[0]), {"refusal.source": F.lit("phrase"), "refusal.language": languages[0]}))
        .otherwise(result(1.0, PASS, "no refusal"))
    )


def leak_columns(words_of: Callable[[str], list[str]], rounded: Callable[[str], Column]) -> Callable[[DataFrame, Settings, Column], DataFrame]:
    def prepare(df: DataFrame, settings: Settings, chosen: Column) -> DataFrame:
        df = apart(df, "_outputs", F.when(chosen, texts("output_messages", "text", "tool_call")))
        system = F.array_join(F.transform("system_instructions", lambda m: m["text"]), " \n ")
        df = staged(df, "_leak", guarded(LEAK, leak_of(NGRAM, words_of)), F.when(F.col("_outputs").isNotNull(), F.struct(system.alias("system"), F.col("_outputs").alias("outputs"))))
        df = df.withColumns({"_run": F.col("_leak.run"), "_coverage": F.col("_leak.coverage"), "_uncovered": 1.0 - F.col("_leak.coverage")})
        return df.withColumns({"_coverage_text": two_decimals("_coverage"), "_coverage_4": rounded("_coverage"), "_leak_score": rounded("_uncovered")})

    return prepare


def leak_result(settings: Settings) -> Column:
    leaked = (F.col("_run") >= LONGEST_RUN) | (F.col("_coverage") > MOST_COVERAGE)
    says = F.concat(F.lit("coverage="), F.col("_coverage_text"), F.lit(", longest_run="), F.col("_run").cast("string"), F.lit(" words (output)"))
    return result(F.col("_leak_score"), F.when(leaked, FAIL).otherwise(PASS), says, {"prompt_leak.coverage": F.col("_coverage_4"), "prompt_leak.longest_run": F.col("_run")})


def leak_evaluator(words_of: Callable[[str], list[str]] = words_in, rounded: Callable[[str], Column] = four_places) -> Evaluator:
    """The evaluator of leaks, by words and rounding of one's own."""
    applies = lambda: F.col("_leak_error").isNotNull() | (F.col("_leak.words") >= LEAST_SYSTEM_WORDS) & (F.size("_outputs") > 0)
    return Evaluator("system_prompt_leak", "heuristic", 1.0, applies, leak_result, leak_columns(words_of, rounded), stages=("_leak",))


def has_text_part(m: Column) -> Column:
    return (F.size(m["parts"]) == 0) | F.exists(m["parts"], lambda p: p["type"] == "text")


def format_columns(df: DataFrame, settings: Settings, chosen: Column) -> DataFrame:
    own = F.transform(F.filter("output_messages", has_text_part), lambda m: text_of(m, "text"))
    df = staged(df, "_errors", JSON_ERRORS, F.when(chosen & F.coalesce(F.col("output_type") == "json", F.lit(False)), own))
    return df.withColumns({"_bad": F.filter("_errors", lambda e: e != ""), "_n": F.size("_errors")})


def format_result(settings: Settings) -> Column:
    bad, n = F.size("_bad"), F.col("_n")
    cut = F.array_contains("finish_reasons", "length")
    first = F.col("_bad")[0]
    kind = F.when(first == "empty", "empty").when(cut, "truncated").otherwise("syntax")
    says = F.concat(F.lit("invalid_json="), bad.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" (output): "), first, F.when(cut, ", finish_reason=length").otherwise(""))
    good = F.concat(F.lit("valid_json="), n.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" (output)"))
    return F.when(bad == 0, result(1.0, PASS, good)).otherwise(result((n - bad) / n, FAIL, says, {"output_format.error": kind}))


def exempted(r: Column) -> Column:
    """No score, the label exempt, what was found kept; errors stay as they are."""
    found = F.when((r["label"] == FAIL) & (r["explanation"] != ""), r["explanation"]).otherwise("no findings")
    out = F.struct(F.lit(None).cast("double").alias("score"), F.lit(EXEMPT).alias("label"), F.concat(F.lit("exempt service; "), found).alias("explanation"), r["attributes"].alias("attributes"), r["error_type"].alias("error_type"))
    return F.when(r["error_type"].isNull(), out.cast(RESULT)).otherwise(r)


def stripped(ts: Column) -> Column:
    return F.filter(F.transform(ts, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")


def user_texts() -> Column:
    return stripped(F.transform(F.filter("input_messages", lambda m: m["role"] == "user"), lambda m: text_of(m, "text")))


def response_texts() -> Column:
    return stripped(F.transform("output_messages", lambda m: text_of(m, "text")))


def calls_tools() -> Column:
    return F.exists("output_messages", lambda m: F.exists(m["parts"], lambda p: p["type"] == "tool_call"))


HEURISTICS = (
    Evaluator("pii_detection", "heuristic", 1.0, lambda: F.lit(True), lambda s: findings_result(F.col("_pii"), "pii.types"), pii_findings, needs=("findings",), stages=("_found",)),
    Evaluator("secret_detection", "heuristic", 1.0, lambda: F.lit(True), lambda s: findings_result(F.col("_secrets"), "secret.types"), lambda df, s, chosen: df.withColumn("_secrets", located(True)), needs=("findings",), stages=("_found",)),
    Evaluator("refusal", "heuristic", 1.0, lambda: (F.size("finish_reasons") > 0) | (F.size(texts("output_messages", "text")) > 0), refusal_result, refusal_columns, stages=("_heads",)),
    leak_evaluator(),
    Evaluator("output_format", "heuristic", 1.0, lambda: F.coalesce(F.col("output_type") == "json", F.lit(False)) & F.exists("output_messages", has_text_part), format_result, format_columns, stages=("_errors",)),
)


def answers_of(answer: Callable[[list[str], dict], list[dict]], limit: float):
    """A UDF of struct<names, line>: the results of `answer` for names and the interaction in line (JSON), or an error for each, and their
    nanoseconds. What raises is told by its name, what takes longer than limit is `timeout`."""

    def as_result(got: dict | None, error: str | None) -> dict:
        got = got or {}
        more = {f"llm_eval.{k}": str(v) for k, v in (got.get("attributes") or {}).items() if v is not None}
        score = got.get("score")
        return {"score": None if score is None else float(score), "label": got.get("label"), "explanation": got.get("explanation"), "attributes": list(more.items()), "error_type": error or got.get("error_type")}

    def answered(names: list[str], line: str) -> list[dict]:
        got = answer(names, json.loads(line))
        return [as_result(x, None) for x in got] if len(got) == len(names) else [as_result(None, BATCH_LENGTH)] * len(names)

    @F.arrow_udf(ANSWERS)
    def run(given: pa.Array) -> pa.Array:
        workers, out = Workers(1), []
        for x in given.to_pylist():
            if x is None or x["line"] is None:
                out.append(None)
                continue
            begun = time.perf_counter_ns()
            got, error = workers.outcome(workers.submit(partial(answered, x["names"], x["line"])), limit)
            out.append({"results": [as_result(None, error)] * len(x["names"]) if error else got, "ns": time.perf_counter_ns() - begun})
        workers.close(1)
        return pa.array(out, to_arrow_type(ANSWERS))

    return run.asNondeterministic()


def in_python(name: str, evaluate: Callable[[dict], dict], rate: float = 1.0, timeout_s: float = 0.0, applies: Callable[[], Column] = lambda: F.lit(True), kind: str = "heuristic") -> Evaluator:
    """An evaluator written in Python: `evaluate` takes an interaction as a dict and returns any of score, label, explanation and
    attributes. If it raises, the row's result is an error with the exception's name; after timeout_s (0: the settings') it is `timeout`.
    Other rows and evaluators are untouched. It is called only for rows that are chosen and apply."""

    def prepare(df: DataFrame, settings: Settings, chosen: Column) -> DataFrame:
        run = answers_of(lambda names, interaction: [evaluate(interaction)], timeout_s or settings.timeout_s)
        df = apart(df, f"_{name}", F.when(chosen & applies(), F.struct(F.array(F.lit(name)).alias("names"), F.to_json(F.struct(*INTERACTION_COLUMNS)).alias("line"))))
        df = apart(df, f"_{name}", run(f"_{name}"))
        return df.withColumns({f"_{name}_ns": F.col(f"_{name}.ns"), f"_{name}_error": F.lit(None).cast("string")})

    return Evaluator(name, kind, rate, applies, lambda settings: F.col(f"_{name}.results")[0].cast(RESULT), prepare, stages=(f"_{name}",))


def batched(name: str, batch_key: str, answer: Callable[[list[str], dict], list[dict]], max_chars: int | None = None, rate: float = 1.0, applies: Callable[[], Column] = lambda: F.lit(True), kind: str = "heuristic") -> Evaluator:
    """An evaluator that is answered together with others: all of one batch_key and max_chars that are chosen for an interaction are one call of
    `answer` with their names and the interaction, cut to max_chars. It returns a result for each name; another number is an error of each."""
    return Evaluator(name, kind, rate, applies, max_chars=max_chars, batch_key=batch_key, answer=answer)


def registry(names: Iterable[str], more: Iterable[Evaluator] = ()) -> list[Evaluator]:
    """The evaluators of these names, in order: ours, those given, or installed entry points of the group."""
    from .judges import JUDGES

    known = {e.name: e for e in (*HEURISTICS, *JUDGES, *more)}
    out = []
    for name in names:
        if name not in known:
            found = [p for p in entry_points(group=GROUP) if p.name == name]
            if not found:
                raise EvaluatorLoadError(f"no evaluator named {name}")
            try:
                known[name] = found[0].load()()
            except Exception as e:
                raise EvaluatorLoadError(f"{name} can't be loaded: {type(e).__name__}") from e
        if known[name].name != name:
            raise EvaluatorLoadError(f"{name} calls itself {known[name].name}")
        out.append(known[name])
    return out
