"""Streams from export requests to events, spans, metrics and health, each a query of its own between tables of a folder.

    requests -> interactions -> evaluations -> events, spans, judge_spans, metrics, health

The tables are written by Spark's file sink, whose log makes each micro-batch count once, and read on as streams; so a query may stop and
go on anywhere. Only duplicates, metrics and health keep state.
"""

from __future__ import annotations

import logging
import uuid
import zlib
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import Settings
from ..operators import emit
from ..operators.evaluators import Evaluator
from ..operators.extract import SKIP_REASONS, interactions
from ..operators.judges import OfflineJudge
from ..operators.runner import evaluate
from ..schemas import SCORE_BOUNDS
from ..sources.otlp import SPAN_COLUMNS, spans_of_json
from .state import health, keyed_state, marked_repeats


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def deduplicated(spans: DataFrame, ttl_s: int, at: str = "received") -> DataFrame:
    """The spans that repeat none accepted within the time to live."""
    return marked_repeats(spans, ["trace_id", "span_id"], at, ttl_s).where("not duplicate").drop("duplicate")


def observed(spans: DataFrame, settings: Settings) -> DataFrame:
    """Interactions to be evaluated of a stream of spans with `received`. Counts of what is received, repeated and skipped, and why, are
    observed on the way, in the same pass (see Counts)."""
    marked = marked_repeats(spans, ["trace_id", "span_id"], "received", settings.dedup_ttl_s)
    marked = marked.observe("spans", F.count("*").alias("received"), F.count_if("duplicate").alias("duplicate"))
    made = interactions(marked.where("not duplicate").drop("duplicate"), settings.service_name)
    made = made.observe("interactions", F.count_if(F.col("skip_reason").isNull()).alias("evaluated"), *(F.count_if(F.col("skip_reason") == r).alias(r) for r in SKIP_REASONS))
    return made.where("skip_reason is null").drop("skip_reason")


LOG = logging.getLogger("tracegauge")


class Counts(StreamingQueryListener):
    """What queries have observed so far, by name, and how fast they are; a micro-batch that is told again counts once. Each is logged, as
    counts and ids alone."""

    def __init__(self):
        self.seen: dict[tuple, dict] = {}
        self.rates: dict[str, tuple[float, float]] = {}
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        told = {}
        for name, row in p.observedMetrics.items():
            self.seen[str(p.id), p.batchId, name] = row.asDict()
            told |= {k: n for k, n in row.asDict().items() if n}
        self.rates[str(p.name or p.id)] = (p.inputRowsPerSecond, p.processedRowsPerSecond)
        LOG.info("query=%s batch=%d rows=%d %s", p.name or p.id, p.batchId, p.numInputRows, " ".join(f"{k}={n}" for k, n in sorted(told.items())))

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)
        if event.exception:
            # the exception's text may hold what was read
            LOG.error("query=%s failed: %s", event.id, event.errorClassOnException or "unknown")

    def total(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for row in list(self.seen.values()):
            for k, n in row.items():
                out[k] = out.get(k, 0) + (n or 0)
        return out


def metric_windows(evaluations: DataFrame, settings: Settings, at: str = "evaluated", late: str = "1 minute") -> DataFrame:
    """Evaluations, scores and redactions by window of metrics_window_s and the metrics' common keys, label and error. All columns are sums, so that
    windows, and states of a window, can be added up or replaced."""
    df = emit.with_common_keys(evaluations, settings).withWatermark(at, late)
    score = F.col("result.score")
    return df.groupBy(F.window(at, f"{settings.metrics_window_s} seconds"), *emit.COMMON_KEYS, F.col("result.label").alias("label"), F.col("result.error_type").alias("error_type")).agg(
        F.count("*").alias("n"), F.count(score).alias("scores"), F.sum(score).alias("total"), F.array(*emit.bucket_counts(score, SCORE_BOUNDS)).alias("buckets")
    )


def named(at: str) -> str:
    """A query's name: its table's, and what tells it from those of other folders."""
    return f"{at.rstrip('/').rpartition('/')[2]}-{zlib.crc32(at.encode()):08x}"


def written(stream: DataFrame, at: str, trigger: dict) -> StreamingQuery:
    """stream appended to a table by Spark's file sink."""
    with keyed_state(stream.sparkSession):
        return stream.writeStream.queryName(named(at)).format("parquet").option("path", at).option("checkpointLocation", f"{at}-checkpoint").trigger(**trigger).start()


def updated(stream: DataFrame, at: str, trigger: dict) -> StreamingQuery:
    """The changed rows of each micro-batch in a folder of its own, which a batch that runs again replaces."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/batch={n}")
    return stream.writeStream.queryName(named(at)).outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}-checkpoint").trigger(**trigger).start()


class Topology:
    """Queries that follow one another. With availableNow each starts when the one before has read all there is; otherwise all run at once."""

    def __init__(self, spark: SparkSession, starts: Iterable[Callable[[], StreamingQuery]], at_once: bool):
        self.spark, self.starts, self.at_once = spark, list(starts), at_once
        self.queries: list[StreamingQuery] = [s() for s in (self.starts if at_once else self.starts[:1])]

    def awaitTermination(self) -> None:
        if self.at_once:
            self.spark.streams.awaitAnyTermination()
            return
        self.queries[0].awaitTermination()
        for start in self.starts[1:]:
            self.queries.append(start())
            self.queries[-1].awaitTermination()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    def health(self) -> dict[str, dict]:
        """By query: whether it runs, has failed, its last micro-batch and how many rows it takes a second. Ready is what has read a batch."""
        out = {}
        for q in self.queries:
            p = q.lastProgress
            out[q.name or str(q.id)] = {"active": q.isActive, "failed": q.exception() is not None, "ready": p is not None, "batch": p.batchId if p else None, "rows_per_sec": p.processedRowsPerSecond if p else None}
        return out


def evaluate_stream(requests: DataFrame, settings: Settings, out: str, client: Callable[[], object] = OfflineJudge, more: Iterable[Evaluator] = (), trigger: dict | None = None) -> Topology:
    """requests: a stream of JSON export requests (`value`), or of spans as the sources give them. Tables are written under `out`: interactions,
    evaluations, events, spans (if settings say so), judge_spans, metrics and health."""
    spark, trigger = requests.sparkSession, trigger or {"availableNow": True}
    spans = requests if "span_id" in requests.columns else spans_of_json(requests.select("value"))
    if "error" in spans.columns:
        spans = spans.where("error is null")
    spans = spans.select(*(c.split()[0] for c in SPAN_COLUMNS.replace("map<string,string>", "map").split(", "))).withColumn("received", F.current_timestamp())
    found = observed(spans, settings)
    listed = {"interactions": found}
    listed["evaluations"] = evaluate(empty_like(found), settings, more, client).withColumn("evaluated", F.current_timestamp())
    schema = {name: df.schema for name, df in listed.items()}
    read = lambda name: spark.readStream.schema(schema[name]).parquet(f"{out}/{name}")
    evaluated = lambda: evaluate(read("interactions"), settings, more, client).withColumn("evaluated", F.current_timestamp())
    error = F.col("result.error_type")
    made = {
        "interactions": lambda: found,
        "evaluations": evaluated,
        "events": lambda: emit.events(read("evaluations")),
        "spans": lambda: emit.evaluation_spans(read("evaluations")),
        "judge_spans": lambda: emit.judge_spans(read("evaluations")),
        "health": lambda: health(read("evaluations"), ["evaluator_name"], "evaluated", F.concat_ws(":", "trace_id", "span_id"), F.coalesce(error, F.col("result.label")), error.isNotNull(), interval_s=settings.metrics_window_s),
    }
    if not settings.emit_spans:
        del made["spans"]

    starts = [partial(lambda name: written(made[name](), f"{out}/{name}", trigger), name) for name in made]
    starts.append(lambda: updated(metric_windows(read("evaluations"), settings), f"{out}/metrics", trigger))
    return Topology(spark, starts, "availableNow" not in trigger)


def empty_like(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)


def metrics_now(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each window in the metrics that evaluate_stream has written."""
    rows = spark.read.parquet(f"{out}/metrics")
    keys = ["window", *emit.COMMON_KEYS, "label", "error_type"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct("n", "scores", "total", "buckets"), "batch").alias("x")).select(*keys, "x.*")


def windowed_counts(stream: DataFrame, at: str, keys: list[str], size: str, late: str = "1 day") -> DataFrame:
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table read as a stream. A stream's source is a folder; a single file is its folder and a filter by name."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    is_file = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    single = len(is_file) == 1 and is_file[0].path.rstrip("/").endswith(name)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent) if single else spark.readStream.schema(schema).parquet(path)


def stream_counts(spark: SparkSession, path: str, at: str, keys: list[str], size: str) -> DataFrame:
    """Counts by window of a table read as a stream until it is read up; the last state of each window."""
    out = folder(spark, "counts")
    updated(windowed_counts(table_stream(spark, path), at, keys, size), out, {"availableNow": True}).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("window", *keys).agg(F.max_by("n", "batch").alias("n"))


def read_up(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its source is read up, as a table in the shared folder."""
    out = folder(stream.sparkSession, name)
    written(stream, out, {"availableNow": True}).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
