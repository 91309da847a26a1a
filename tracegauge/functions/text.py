"""Text functions that Spark's own can't express, as Arrow UDFs, and the word n-gram and sampling columns."""

from __future__ import annotations

import json
import re
import time
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .columns import let


def once(kind):
    """A pandas UDF that the optimizer neither repeats nor moves: it runs once a row, in a projection of its own."""
    return lambda f: F.pandas_udf(f, kind).asNondeterministic()


def apart(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column whose expression isn't merged into what reads it (a value that differs by task keeps projections apart): a Python UDF
    over an expression with lambdas is left unevaluated otherwise. Holds in streams too."""
    return df.withColumn(name, F.when(F.spark_partition_id() >= 0, value))


#: Apostrophes that are read as '.
APOSTROPHES = {0x2019: "'", 0x2018: "'", 0x02BC: "'"}
SPACES = re.compile(r"\s+")
NOT_WORD = re.compile(r"[\W_]+")


def normalized(t: str) -> str:
    """Case folded, without accents, straight apostrophes, single spaces."""
    t = unicodedata.normalize("NFKD", t.translate(APOSTROPHES))
    return SPACES.sub(" ", "".join(c for c in t if not unicodedata.combining(c))).casefold()


def words_in(t: str) -> list[str]:
    """Words of the compatibility-normalised, case-folded text."""
    return NOT_WORD.sub(" ", unicodedata.normalize("NFKC", t).casefold()).split()


#: Letters whose lower case depends on their neighbours, or is two characters.
SINGLE = {0x0130: "i", 0x03A3: "σ"}


def plain_words_in(t: str) -> list[str]:
    """Words of the text as it is, each letter lowered by itself: as SQL's lower does, without the equal spellings of words_in."""
    return NOT_WORD.sub(" ", t if t.isascii() else t.translate(SINGLE)).lower().split()


def error_in(t: str) -> str:
    """'' if the text is valid JSON; else `empty`, or the parser's message with the place."""
    if not t.strip():
        return "empty"
    try:
        json.loads(t)
    except json.JSONDecodeError as e:
        return f"{e.msg.removesuffix(' at')} at char {e.pos}"
    except RecursionError:
        return "nested too deeply"
    return ""


@once(StringType())
def normalize(s: pd.Series) -> pd.Series:
    return s.map(normalized, na_action="ignore")


@once(ArrayType(StringType()))
def words(s: pd.Series) -> pd.Series:
    return s.map(words_in, na_action="ignore")


@once(ArrayType(StringType()))
def plain_words(s: pd.Series) -> pd.Series:
    return s.map(plain_words_in, na_action="ignore")


@once(StringType())
def json_error(s: pd.Series) -> pd.Series:
    return s.map(lambda t: error_in(t or "") or None)


@once(StringType())
def json_text(s: pd.Series) -> pd.Series:
    """A JSON text written again with sorted keys and spaces after separators, non-ASCII as it is."""

    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True)
        except (ValueError, RecursionError):
            return t

    return s.map(one)


@once(StringType())
def two_decimals(s: pd.Series) -> pd.Series:
    """Rounds the exact binary value, ties to even; Spark's formatting rounds halves up."""
    return s.map(lambda x: None if pd.isna(x) else f"{x:.2f}")


@once(DoubleType())
def four_places(s: pd.Series) -> pd.Series:
    return s.map(lambda x: round(x, 4), na_action="ignore")


def half_up(value: str) -> Column:
    """A positive column rounded to four places as SQL does: scaled first, halves up."""
    return F.round(F.col(value) * 10000) / 10000


def overlap(system: str, outputs: list[str], n: int, words_of: Callable[[str], list[str]] = words_in) -> tuple[int, float]:
    """The longest run of system's words that an output repeats, in runs of n words at least, and the share of system's distinct n-grams
    that outputs hold."""
    def grams_of(t: str) -> list[tuple[str, ...]]:
        w = words_of(t)
        return list(zip(*(w[k:] for k in range(n)), strict=False))

    known = set(grams_of(system))
    hit, best = set(), 0
    for t in outputs:
        run = 0
        for g in grams_of(t):
            run = run + 1 if g in known else 0
            if run:
                hit.add(g)
                best = max(best, run)
    return best + n - 1 if best else 0, len(hit) / len(known) if known else 0.0


LEAK = StructType([StructField("words", IntegerType()), StructField("run", IntegerType()), StructField("coverage", DoubleType())])


def leak_of(n: int, words_of: Callable[[str], list[str]] = words_in) -> Callable[[dict], dict]:
    """The overlap of a text (`system`) with an array of outputs (`outputs`), as LEAK."""

    def leak(x: dict) -> dict:
        system = x["system"] or ""
        run, coverage = overlap(system, [t or "" for t in x["outputs"] or []], n, words_of)
        return {"words": len(words_of(system)), "run": run, "coverage": coverage}

    return leak


def guarded(kind: DataType, f: Callable):
    """A UDF of f that gives struct<value, error, ns> for each row: what f makes of it, or the name of what it raises, and how long it took. Null
    rows aren't given to f."""
    schema = StructType([StructField("value", kind), StructField("error", StringType()), StructField("ns", LongType())])

    @F.arrow_udf(schema)
    def run(given: pa.Array) -> pa.Array:
        out = []
        for x in given.to_pylist():
            if x is None:
                out.append({"value": None, "error": None, "ns": None})
                continue
            begun, value, error = time.perf_counter_ns(), None, None
            try:
                value = f(x)
            except Exception as e:  # one row's failure is its own result
                error = type(e).__name__
            out.append({"value": value, "error": error, "ns": time.perf_counter_ns() - begun})
        return pa.array(out, to_arrow_type(schema))

    return run.asNondeterministic()


def staged(df: DataFrame, name: str, stage, given: Column) -> DataFrame:
    """df with a guarded stage of `given`: its value as `name`, `name`_error and `name`_ns."""
    df = apart(df, f"{name}_in", given)
    df = apart(df, f"{name}_out", stage(f"{name}_in"))
    return df.withColumns({name: F.col(f"{name}_out.value"), f"{name}_error": F.col(f"{name}_out.error"), f"{name}_ns": F.col(f"{name}_out.ns")}).drop(f"{name}_in", f"{name}_out")


def grams(ws: Column, n: int) -> Column:
    """Hashes of the n-grams of an array of words, in order."""
    return F.when(F.size(ws) >= n, let(ws, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))).otherwise(F.array().cast("array<bigint>"))


def threshold(rate: float) -> int:
    return round((1 - rate) * (1 << 56))


def sampling_number(trace_id: Column) -> Column:
    """The last seven bytes of a hexadecimal trace id; 0 if there is none."""
    return F.coalesce(F.conv(F.nullif(F.right(trace_id, F.lit(14)), F.lit("")), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def sampled(trace_id: Column, rate: float) -> Column:
    """Whether a trace is in the sample: all services agree, and a lower rate's sample lies in a higher one's."""
    return sampling_number(trace_id) >= F.lit(threshold(rate)).cast("bigint")
