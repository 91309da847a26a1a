"""From interactions to evaluations: select, sample, exempt, cut to length, batch, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import apart, sampled
from ..schemas import CALL, IDENTITY_COLUMNS, INTERACTION_COLUMNS, MESSAGES, PART, RESULT
from .evaluators import SHARED, Evaluator, answers_of, exempted, registry, result
from .judges import OfflineJudge, call_judges, with_conversation, with_sides

EVALUATION = f"evaluator_name string, evaluator_kind string, result {RESULT}, truncated boolean, judge_calls array<{CALL}>, duration_ns long"
#: The length of texts that aren't cut.
UNCUT = 1 << 30


def cut(messages: Column, budget: Column) -> Column:
    """struct<left, out, cut>: messages within a budget of characters; offsets of parts are clipped."""
    zero = F.struct(budget.cast("int").alias("left"), F.array().cast(MESSAGES).alias("out"), F.lit(False).alias("cut"))

    def step(a: Column, m: Column) -> Column:
        n = F.least(F.length(m["text"]), a["left"])
        parts = F.transform(F.filter(m["parts"], lambda p: p["start"] < n), lambda p: F.struct(p["type"].alias("type"), p["start"].alias("start"), F.least(p["end"], n).alias("end")).cast(PART))
        one = F.struct(m["role"].alias("role"), F.substr(m["text"], F.lit(1), n).alias("text"), parts.alias("parts"))
        took = F.struct((a["left"] - n).alias("left"), F.array_append(a["out"], one).alias("out"), (a["cut"] | (F.length(m["text"]) > n)).alias("cut"))
        return F.when(a["left"] > 0, took).otherwise(F.struct(a["left"].alias("left"), a["out"].alias("out"), F.lit(True).alias("cut")))

    return F.aggregate(messages, zero, step)


def truncate(df: DataFrame, max_chars: int) -> DataFrame:
    """At most max_chars characters of output, then input, then system; context is left alone. Adds `truncated`."""
    df = df.withColumn("_o", cut(F.col("output_messages"), F.lit(max_chars)))
    df = df.withColumn("_i", cut(F.col("input_messages"), F.col("_o.left")))
    df = df.withColumn("_s", cut(F.col("system_instructions"), F.col("_i.left")))
    df = df.withColumns({"output_messages": F.col("_o.out"), "input_messages": F.col("_i.out"), "system_instructions": F.col("_s.out"), "truncated": F.col("_o.cut") | F.col("_i.cut") | F.col("_s.cut")})
    return df.drop("_o", "_i", "_s")


def is_exempt(name: str, settings: Settings) -> Column:
    services = [s for s, names in settings.exceptions.items() if name in names]
    return F.coalesce(F.col("service_name").isin(*services), F.lit(False)) if services else F.lit(False)


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def limits(evaluators: Iterable[Evaluator]) -> list[int]:
    """The lengths to which evaluators' texts are cut, each once."""
    return sorted({e.max_chars or UNCUT for e in evaluators})


def evaluate(interactions: DataFrame, settings: Settings, more: Iterable[Evaluator] = (), client: Callable[[], object] = OfflineJudge) -> DataFrame:
    """One row for each interaction and evaluator that is chosen for it, applies and samples its trace: the interaction's identity
    (no contents), the result, the judge's calls and the time it took in Python or with the judge.

    An exempt service's result has no score and the label exempt; judges aren't called for it and say so. Rows with a
    skip_reason are left out. Traces are sampled before anything is prepared for an evaluator. Judges and batches are grouped by what they are asked
    and by their max_chars, each group with texts cut for itself. No exchange takes place.
    """
    df = interactions.where("skip_reason is null") if "skip_reason" in interactions.columns else interactions
    chosen = registry(settings.evaluators, more)
    out = []
    keys = list(IDENTITY_COLUMNS)
    no_calls = F.array().cast(f"array<{CALL}>")
    on = {e.name: sampled(F.col("trace_id"), settings.rate(e.name, e.rate)) for e in chosen}
    exempt = lambda e, r: F.when(is_exempt(e.name, settings), exempted(r)).otherwise(r)
    own = [e for e in chosen if not e.ask and not e.answer]
    if own:
        d = df if any(settings.rate(e.name, e.rate) >= 1 for e in own) else df.where(any_of(on[e.name] for e in own))
        for need in dict.fromkeys(n for e in own for n in e.needs):
            d = SHARED[need](d, settings, any_of(on[e.name] for e in own if need in e.needs))
        d = reduce(lambda d, e: e.prepare(d, settings, on[e.name]), own, d)
        rows = []
        for e in own:
            failed = result(error=e.error())
            r = exempt(e, F.when(e.error().isNotNull(), failed).otherwise(e.result(settings)))
            rows.append(F.when(on[e.name] & e.applies(), F.struct(F.lit(e.name).alias("evaluator_name"), F.lit(e.kind).alias("evaluator_kind"), r.alias("result"), e.duration().alias("duration_ns"))))
        d = d.select(*keys, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x"))
        out.append(d.select(*keys, "x.evaluator_name", "x.evaluator_kind", "x.result", F.lit(False).alias("truncated"), no_calls.alias("judge_calls"), "x.duration_ns"))
    judges = [e for e in chosen if e.ask]
    for limit in limits(judges):
        out += judged(df, [e for e in judges if (e.max_chars or UNCUT) == limit], limit, on, settings, client)
    batches: dict[tuple[str, int], list[Evaluator]] = {}
    for e in chosen:
        if e.answer:
            batches.setdefault((e.batch_key, e.max_chars or UNCUT), []).append(e)
    for (_, limit), group in batches.items():
        row = lambda e: F.when(on[e.name] & e.applies(), F.lit(e.name))
        d = apart(df, "_names", F.filter(F.array(*map(row, group)), lambda x: x.isNotNull())).where(F.size("_names") > 0)
        d = truncate(d, limit)
        d = apart(d, "_asked", F.struct(F.col("_names").alias("names"), F.to_json(F.struct(*INTERACTION_COLUMNS)).alias("line")))
        d = apart(d, "_answers", answers_of(group[0].answer, settings.timeout_s)("_asked"))
        each = F.zip_with("_names", "_answers.results", lambda n, r: F.struct(n.alias("name"), r.cast(RESULT).alias("result")))
        d = d.select(*keys, "truncated", "service_name", F.col("_answers.ns").alias("duration_ns"), F.explode(each).alias("x"))
        of = lambda kind: F.try_element_at(F.create_map(*(F.lit(x) for e in group for x in (e.name, kind(e)))), F.col("x.name"))  # noqa: E731, B023
        r = F.col("x.result")
        for e in group:
            r = F.when((F.col("x.name") == e.name) & is_exempt(e.name, settings), exempted(F.col("x.result"))).otherwise(r)
        out.append(d.select(*keys, F.col("x.name").alias("evaluator_name"), of(lambda e: e.kind).alias("evaluator_kind"), r.alias("result"), "truncated", no_calls.alias("judge_calls"), "duration_ns"))
    return reduce(DataFrame.unionByName, out)


def judged(df: DataFrame, judges: list[Evaluator], limit: int, on: dict[str, Column], settings: Settings, client: Callable[[], object]) -> list[DataFrame]:
    """The evaluations of judges with one max_chars: those of exempt services, which aren't asked, and the others."""
    keys = list(IDENTITY_COLUMNS)
    row = lambda e: F.when(on[e.name] & e.applies(), F.struct(F.lit(e.name).alias("name"), F.lit(e.kind).alias("kind"), F.lit(e.ask).alias("ask"), is_exempt(e.name, settings).alias("exempt")))
    d = with_sides(df.where(any_of(on[e.name] for e in judges))).withColumn("_asked", F.filter(F.array(*map(row, judges)), lambda x: x.isNotNull())).where(F.size("_asked") > 0)
    skipped = d.select(*keys, F.explode(F.filter("_asked", lambda x: x["exempt"])).alias("x"))
    told = result(None, "exempt", "exempt service; not evaluated")
    out = [skipped.select(*keys, F.col("x.name").alias("evaluator_name"), F.col("x.kind").alias("evaluator_kind"), told.alias("result"), F.lit(False).alias("truncated"), F.array().cast(f"array<{CALL}>").alias("judge_calls"), F.lit(0).cast("long").alias("duration_ns"))]
    d = d.withColumn("_asked", F.filter("_asked", lambda x: ~x["exempt"])).where(F.size("_asked") > 0)
    d = with_conversation(truncate(d, limit), settings.judge_redact)
    # a rating is a request of its own, all decisions of a span are one
    ratings = F.transform(F.filter("_asked", lambda x: x["ask"] == "rating"), lambda x: F.array(x["name"]))
    decisions = F.transform(F.filter("_asked", lambda x: x["ask"] == "decision"), lambda x: x["name"])
    d = d.select(*keys, "truncated", "conversation", F.explode(F.concat(ratings, F.filter(F.array(decisions), lambda c: F.size(c) > 0))).alias("checks"))
    kinds = F.create_map(*(F.lit(x) for e in judges for x in (e.name, e.kind)))
    called = call_judges(d, [*keys, "truncated"], client, settings, {e.name: e.check for e in judges})
    return [*out, called.select(*keys, "evaluator_name", F.try_element_at(kinds, F.col("evaluator_name")).alias("evaluator_kind"), "result", "truncated", "judge_calls", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"))]
