"""Evaluators on records from the command line: one JSON line for each result.

    python -m tracegauge -i "a question" -o "an answer" -e pii_detection
    python -m tracegauge --jsonl records/ -e relevance -e refusal --to results/

The exit code is 0 if all went well, 1 if a result is an error, 2 if the call or a record is wrong (nothing is evaluated then). With --to
results are written by Spark's tasks into a folder; else they are printed in the records' order as they come, never held as a whole.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import emit
from .operators.evaluators import EvaluatorLoadError, registry
from .operators.runner import evaluate
from .sources.records import read_records, record_interactions

OK, ERRORS, USAGE = 0, 1, 2


class UsageError(Exception):
    pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracegauge", description=__doc__.splitlines()[0])
    one = p.add_argument_group("one record")
    one.add_argument("-i", "--input", help="what the user says")
    one.add_argument("-o", "--output", help="the answer to be evaluated")
    one.add_argument("-c", "--context", action="append", default=[], metavar="ROLE:TEXT", help="an earlier message, in order")
    p.add_argument("--jsonl", metavar="PATH", help="records, one a line: a file, a folder or a pattern")
    p.add_argument("-e", "--evaluator", action="append", metavar="NAME", help="may be repeated; relevance unless given")
    p.add_argument("--to", metavar="FOLDER", help="write results there instead of printing them")
    p.add_argument("--pretty", action="store_true", help="indent what is printed")
    return p


def lines_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The records' lines with their place: of a file, its part and line, which order as they stand."""
    if args.jsonl:
        if args.input or args.output or args.context:
            raise UsageError("--jsonl stands alone")
        lines = spark.read.text(args.jsonl)
    else:
        if args.input is None or args.output is None:
            raise UsageError("give --input and --output, or --jsonl")
        turns = [dict(zip(("role", "text"), c.split(":", 1), strict=False)) for c in args.context]
        lines = spark.createDataFrame([(json.dumps({"input": args.input, "output": args.output, "context": turns}),)], "value string")
    return lines.withColumn("place", F.monotonically_increasing_id())


def run(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> int:
    names = tuple(dict.fromkeys(args.evaluator or ["relevance"]))
    registry(names)
    records = read_records(lines_of(spark, args))
    wrong = records.where("error is not null").select("place", "error").orderBy("place").limit(1).collect()
    if wrong:
        raise UsageError(f"record {wrong[0].place & ((1 << 33) - 1)}: {wrong[0].error}")
    own = Settings(**(settings.__dict__ | {"evaluators": names, "sample_rates": dict.fromkeys(names, 1.0)}))
    done = evaluate(record_interactions(records, F.col("place")), own)
    # judges are asked once, whatever is read of the results
    done = done.persist()
    try:
        out = emit.result_lines(done)
        if args.to:
            out.select("value").write.mode("errorifexists").text(args.to)
        else:
            for r in out.orderBy("trace_id", "evaluator").toLocalIterator():
                print(json.dumps(json.loads(r.value), ensure_ascii=False, indent=2) if args.pretty else r.value)
        return OK if done.where("result.error_type is not null").isEmpty() else ERRORS
    finally:
        done.unpersist()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code in (0, None) else USAGE
    own = spark is None
    try:
        spark = spark or SparkSession.builder.appName("tracegauge").getOrCreate()
        return run(spark, args, Settings.from_env())
    except (UsageError, EvaluatorLoadError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except Exception as e:  # a path that isn't there, a setting that Spark refuses
        print(f"error: {type(e).__name__}: {str(e).splitlines()[0]}", file=sys.stderr)
        return USAGE
    finally:
        if own and spark is not None:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
