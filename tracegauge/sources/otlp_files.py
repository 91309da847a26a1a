"""Export requests in files as a data source of Spark's, for batches and streams, read and written.

    spark.dataSource.register(OtlpFiles)
    spark.readStream.format("otlp").option("path", at).option("log", log).load()
    stream.writeStream.format("otlp").option("path", at).option("signal", "logs")...

Files end in .jsonl, .json or .txt (a request a line) or .pb (one request), and in .gz if compressed. Files lie in any file system that
Arrow reads. A read row is a span, or a request that can't be read with its `error`.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .otlp import SPAN_COLUMNS, decode_json, decode_request, gunzip, request_class

NAME = "otlp"
LINES, WHOLE = (".jsonl", ".json", ".txt"), (".pb",)
#: Bytes of a read partition, and of a request, unless options say otherwise.
PARTITION, REQUEST = 64 << 20, 16 << 20
#: Rows of a written request.
REQUEST_ROWS = 1000
Piece = tuple[str, int, int]


@dataclass
class Files:
    """A folder or file in some file system."""

    at: str

    def __post_init__(self):
        self.system, self.path = fs.FileSystem.from_uri(self.at) if "://" in self.at else (fs.LocalFileSystem(), self.at)

    def listed(self) -> list[tuple[str, int]]:
        """(path, size) of all files, by name; those in folders or with names that begin with _ or . are none."""
        info = self.system.get_file_info(self.path)
        if info.type == fs.FileType.File:
            return [(info.path, info.size)]
        if info.type == fs.FileType.NotFound:
            return []
        own = self.system.get_file_info(fs.FileSelector(self.path, recursive=True))
        hidden = lambda p: any(x[:1] in "_." for x in p[len(self.path) :].strip("/").split("/"))
        return sorted((x.path, x.size) for x in own if x.type == fs.FileType.File and not hidden(x.path) and x.path.removesuffix(".gz").endswith(LINES + WHOLE))

    def read(self, path: str) -> bytes:
        with self.system.open_input_file(path) as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(path, compression=None) as f:
            f.write(data)

    def there(self, path: str) -> bool:
        return self.system.get_file_info(path).type != fs.FileType.NotFound


class Part(InputPartition):
    """Pieces (file, from, to) of about the size of a partition."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def planned(files: list[tuple[str, int]], size: int) -> list[Part]:
    """Files in partitions of about `size` bytes: small ones together; large ones of plain lines in several."""
    out, held, total = [], [], 0
    for path, n in files:
        step = size if path.endswith(LINES) else max(n, 1)
        for a in range(0, max(n, 1), step):
            b = min(n, a + step)
            if held and total + b - a > size:
                out.append(Part(held))
                held, total = [], 0
            held.append((path, a, b))
            total += b - a
    return [*out, Part(held)] if held else out


class Reading:
    """What both readers do."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.files = Files(options["path"])
        self.size, self.limit = int(options.get("partitionBytes", PARTITION)), int(options.get("maxRequestBytes", REQUEST))

    def bodies(self, piece: Piece) -> Iterator[bytes | ValueError]:
        """The requests of a piece. A line belongs to the piece in which it begins."""
        path, a, b = piece
        bare = path.removesuffix(".gz")
        if path != bare or bare.endswith(WHOLE):
            try:
                data = self.files.read(path)
                data = gunzip(data, self.limit if bare.endswith(WHOLE) else 1 << 40) if path != bare else data
            except ValueError as e:
                yield e
                return
            yield from ([data] if bare.endswith(WHOLE) else data.split(b"\n"))
            return
        with self.files.system.open_input_file(path) as raw:
            f = io.BufferedReader(raw)
            f.seek(max(a - 1, 0))
            if a:
                f.readline()
            while f.tell() < b and (line := f.readline()):
                yield line

    def read(self, partition: Part) -> Iterator[tuple]:
        none = (None,) * len(SPAN_COLUMNS.replace("map<string,string>", "map").split(", "))
        for piece in partition.pieces:
            decode = decode_request if piece[0].removesuffix(".gz").endswith(WHOLE) else decode_json
            for body in self.bodies(piece):
                try:
                    if isinstance(body, ValueError):
                        raise body
                    if decode is decode_json and not body.strip():
                        continue
                    if len(body) > self.limit:
                        raise ValueError("too large")
                    for row in decode(body):
                        yield (*row, None, piece[0])
                except ValueError as e:
                    yield (*none, str(e), piece[0])


class BatchReader(Reading, DataSourceReader):
    def partitions(self) -> list[Part]:
        return planned(self.files.listed(), self.size) or [Part([])]


class StreamReader(Reading, DataSourceStreamReader):
    """Offsets count entries of a log in the folder `log`: each lists files that none before it has. So a file counts once, whenever and with
    whatever time it appears, and a query that goes on finds the files of each offset again."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if "log" not in options:
            raise ValueError("option log: a folder for the list of files that have been read")
        self.log, self.most = Files(options["log"]), int(options.get("maxFilesPerTrigger", 1 << 31))
        self.known: set[str] = set()
        self.last = 0

    def entry(self, n: int) -> str:
        return f"{self.log.path}/{n:010d}.log"

    def entries(self, start: int, end: int) -> list[tuple[str, int]]:
        return [tuple(x) for n in range(start + 1, end + 1) for x in json.loads(self.log.read(self.entry(n)))]

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        while self.log.there(self.entry(self.last + 1)):
            self.known |= {p for p, _ in self.entries(self.last, self.last + 1)}
            self.last += 1
        new = [x for x in self.files.listed() if x[0] not in self.known][: self.most]
        if new:
            # written beside, then moved: an entry is there as a whole or not at all
            path = f"{self.log.path}/{uuid.uuid4().hex}.new"
            self.log.write(path, json.dumps(new).encode())
            self.log.system.move(path, self.entry(self.last + 1))
            self.known |= {p for p, _ in new}
            self.last += 1
        return {"n": self.last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return planned(self.entries(start["n"], end["n"]), self.size)


# Numbers of severities, kinds and status codes in the export format.
SEVERITY = {"INFO": 9, "WARN": 13, "ERROR": 17}
SPAN_KIND = {"INTERNAL": 1, "CLIENT": 3}
STATUS = {"UNSET": 0, "OK": 1, "ERROR": 2}
DELTA = 1


def any_of(value) -> dict:
    """An AnyValue in its JSON form."""
    if isinstance(value, bool):
        return {"boolValue": value}
    if isinstance(value, int):
        return {"intValue": str(value)}
    if isinstance(value, float):
        return {"doubleValue": value}
    if isinstance(value, list):
        return {"arrayValue": {"values": [any_of(x) for x in value]}}
    if isinstance(value, dict):
        return {"kvlistValue": {"values": pairs_of(value)}}
    return {} if value is None else {"stringValue": str(value)}


def pairs_of(values: dict) -> list[dict]:
    return [{"key": k, "value": any_of(v)} for k, v in values.items()]


def there(**fields) -> dict:
    return {k: v for k, v in fields.items() if v is not None}


def get(row: Row, name: str):
    return row[name] if name in row.__fields__ else None


def span_of(row: Row) -> dict:
    """A span: attributes are JSON texts as the source gives them, or (option `attributes` plain) plain texts."""
    return there(traceId=row["trace_id"], spanId=row["span_id"], parentSpanId=get(row, "parent_span_id"), name=get(row, "name"), flags=get(row, "trace_flags"), kind=SPAN_KIND.get(get(row, "kind")),
                 status=there(code=STATUS.get(get(row, "status"))) or None, startTimeUnixNano=get(row, "start_ns"), endTimeUnixNano=get(row, "end_ns"))


def log_of(row: Row) -> dict:
    """An event, as emit.events gives it."""
    return there(traceId=row["trace_id"], spanId=row["parent_span_id"], flags=get(row, "trace_flags"), severityText=row["severity"], severityNumber=SEVERITY.get(row["severity"]), eventName=row["event_name"], timeUnixNano=get(row, "time_ns"))


def metric_of(row: Row) -> dict:
    """A metric's point (name, attributes, start_ns, time_ns; n, and total, buckets and bounds for a histogram)."""
    point = there(attributes=pairs_of(row["attributes"] or {}), startTimeUnixNano=get(row, "start_ns"), timeUnixNano=get(row, "time_ns"))
    if get(row, "buckets") is None:
        return {"name": row["name"], "sum": {"aggregationTemporality": DELTA, "isMonotonic": True, "dataPoints": [point | {"asInt": row["n"]}]}}
    point |= there(count=row["n"], sum=get(row, "total"), bucketCounts=list(row["buckets"]), explicitBounds=list(row["bounds"]))
    return {"name": row["name"], "histogram": {"aggregationTemporality": DELTA, "dataPoints": [point]}}


#: By signal: the request's message, its lists from the resource down, and what makes an entry.
SIGNALS = {
    "traces": ("ExportTraceServiceRequest", ("resourceSpans", "scopeSpans", "spans"), span_of),
    "logs": ("ExportLogsServiceRequest", ("resourceLogs", "scopeLogs", "logRecords"), log_of),
    "metrics": ("ExportMetricsServiceRequest", ("resourceMetrics", "scopeMetrics", "metrics"), metric_of),
}
IDS = ("traceId", "spanId", "parentSpanId")


def as_protobuf(request: dict, signal: str) -> bytes:
    from google.protobuf.json_format import ParseDict

    message, (outer, inner, entries), _ = SIGNALS[signal]
    # ids are hexadecimal in JSON requests, where the protobuf mapping has base64
    binary = lambda e: e | {k: base64.b64encode(bytes.fromhex(e[k])).decode() for k in IDS if k in e}
    made = {outer: [{"resource": r["resource"], inner: [{entries: [binary(e) for e in s[entries]]} for s in r[inner]]} for r in request[outer]]}
    return ParseDict(made, request_class(message)()).SerializeToString()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writing:
    """Rows as requests, by service and in bounded numbers. A task writes into a hidden folder; a commit moves its files to their place."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.files = Files(options["path"])
        self.signal, self.encoding = options.get("signal", "traces"), options.get("encoding", "json")
        if self.signal not in SIGNALS or self.encoding not in ("json", "protobuf"):
            raise ValueError("signal is traces, logs or metrics; encoding is json or protobuf")
        self.packed, self.most = options.get("gzip", "false").lower() == "true", int(options.get("requestRows", REQUEST_ROWS))
        self.plain, self.service = options.get("attributes", "json" if self.signal == "traces" else "plain") == "plain", options.get("service")

    def entry(self, row: Row) -> dict:
        made = SIGNALS[self.signal][2](row)
        if self.signal != "metrics":
            made["attributes"] = pairs_of({k: v if self.plain else json.loads(v) for k, v in (row["attributes"] or {}).items()})
        return made

    def request(self, service: str | None, entries: list[dict]) -> bytes:
        outer, inner, own = SIGNALS[self.signal][1]
        made = {outer: [{"resource": {"attributes": pairs_of({"service.name": service} if service else {})}, inner: [{own: entries}]}]}
        return json.dumps(made, ensure_ascii=False).encode() if self.encoding == "json" else as_protobuf(made, self.signal)

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, held, files, lines = f"{self.files.path}/_temporary/{uuid.uuid4().hex}", {}, [], []

        def put(data: bytes, suffix: str) -> None:
            path = f"{folder}/part-{len(files):05d}-{uuid.uuid4().hex}{suffix}{'.gz' * self.packed}"
            self.files.write(path, gzip.compress(data, mtime=0) if self.packed else data)
            files.append(path)

        def flush(service: str | None) -> None:
            made = self.request(service, held.pop(service))
            if self.encoding == "json":
                lines.append(made)
            else:
                put(made, ".pb")

        for row in iterator:
            service = self.service or get(row, "service_name")
            held.setdefault(service, []).append(self.entry(row))
            if len(held[service]) >= self.most:
                flush(service)
            if sum(map(len, lines)) > PARTITION:
                put(b"\n".join(lines) + b"\n", ".jsonl")
                lines.clear()
        for service in list(held):
            flush(service)
        if lines:
            put(b"\n".join(lines) + b"\n", ".jsonl")
        return Written(files)

    def placed(self, messages: list[Written | None], folder: str) -> None:
        for path in (p for m in messages if m for p in m.files):
            self.files.system.create_dir(folder, recursive=True)
            self.files.system.move(path, f"{folder}/{path.rpartition('/')[2]}")

    def dropped(self, messages: list[Written | None]) -> None:
        for path in (p for m in messages if m for p in m.files):
            if self.files.there(path):
                self.files.system.delete_file(path)


class BatchWriter(Writing, DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options)
        self.overwrite = overwrite

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for path, _ in self.files.listed():
                self.files.system.delete_file(path)
        self.placed(messages, self.files.path)

    def abort(self, messages: list[Written | None]) -> None:
        self.dropped(messages)


class StreamWriter(Writing, DataSourceStreamWriter):
    """Each micro-batch has a folder; one that is committed again replaces what is there."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        folder = f"{self.files.path}/batch={batchId}"
        if self.files.there(folder):
            self.files.system.delete_dir(folder)
        self.placed(messages, folder)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.dropped(messages)


class OtlpFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"{SPAN_COLUMNS}, error string, file string"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)
