"""Secrets in whole texts, confirmed by their structure.

The base kinds are patterns alone. All others start from a candidate, a stretch of base64 or hexadecimal characters, which is decoded; it is
reported only if what comes out is built like a secret: a key whose nested DER lengths fit to the last byte and whose fields are those of a
private key, an OpenSSH key file, a signed token whose header and claims are JSON objects and whose signature has the length of its
algorithm, or a text in which a base kind is found. Decoded texts are looked at again, to a fixed depth.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import prepare

Span = tuple[int, int]

#: The base kinds. A match's last group must have so many characters.
BASE = {
    "assign": (re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 8),
    "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 16),
    "hex": (re.compile(r"([0-9a-f]+)"), 32),
}
#: What a text with an assignment has in it, in either case; a search for it is cheap.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Kinds in the order in which spans of one start stand.
KINDS = (*BASE, "token", "key", "sealed")
#: A stretch of base64, over several lines where it is wrapped; of hexadecimal digits; three or five parts with dots.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/]+)*={0,2}")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){16,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){16,}(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*){2,4}(?![A-Za-z0-9_-])")
LEAST_HEX = re.compile(r"[0-9a-f]{32,}")
BLANKS = re.compile(r"\s+")
#: How often a decoded text is looked at for encoded ones, and how deep the lengths of a key may be nested.
DEPTH, NESTED = 3, 8
#: Bytes of a signature by algorithm; of RSA's, the least.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_LEAST = 128
SSH = b"openssh-key-v1\0"
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: DER identifiers of curves and algorithms are short.
OID_MOST = 20


def decoded(text: str) -> bytes | None:
    """The bytes of a base64 text of either alphabet, padded or not; null if it is none."""
    bare = BLANKS.sub("", text).rstrip("=").translate({45: "+", 95: "/"})
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the contents, end) of the DER element at a place; null unless its length is minimal and fits."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + size]), at + size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end] exactly."""
    out = []
    while at < end:
        if not (x := element(data, at, end)):
            return None
        out.append(x)
        at = x[2]
    return out


def private_key(data: bytes, depth: int = 0) -> str | None:
    """The form of a DER private key (rsa, dsa, ec, pkcs8, encrypted-pkcs8), all lengths checked; null if it is none."""
    top = element(data, 0, len(data))
    if depth > NESTED or not top or top[0] != SEQUENCE or top[2] != len(data):
        return None
    parts = elements(data, top[1], top[2])
    if not parts:
        return None
    tags = [x[0] for x in parts]
    inside = lambda x: data[x[1] : x[2]]
    if tags[0] == INTEGER:
        version = inside(parts[0])
        if tags[1:3] == [SEQUENCE, OCTETS] and version in (b"\0", b"\1"):
            # the algorithm is named, and the key is an element of its own
            named = elements(data, *parts[1][1:])
            if named and named[0][0] == OID and named[0][2] - named[0][1] <= OID_MOST:
                own = inside(parts[2])
                inner = element(own, 0, len(own))
                if inner and inner[2] == len(own) and (inner[0] == OCTETS or private_key(own, depth + 1)):
                    return "pkcs8"
        if tags[1:2] == [OCTETS] and version == b"\1" and parts[1][2] - parts[1][1] in range(20, 67):
            return "ec" if all(t in (0xA0, 0xA1) for t in tags[2:]) else None
        if version == b"\0" and set(tags) == {INTEGER} and len(tags) in (6, 9):
            return {6: "dsa", 9: "rsa"}[len(tags)]
    elif tags == [SEQUENCE, OCTETS]:
        named = elements(data, *parts[0][1:])
        if named and [x[0] for x in named] == [OID, SEQUENCE] and named[0][2] - named[0][1] <= OID_MOST and elements(data, *named[1][1:]):
            return "encrypted-pkcs8"
    return None


def ssh_key(data: bytes) -> bool:
    """Whether an OpenSSH key file's nested lengths fit: cipher, derivation, its options, and as many public keys as it says, and the private part."""
    if not data.startswith(SSH):
        return False
    at, fields = len(SSH), []

    def text() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    fields = [text() for _ in range(3)]
    if None in fields or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    # a key takes eight bytes or more
    if not 1 <= keys <= len(data) // 8 or any(not text() for _ in range(keys)):
        return False
    own = text()
    return bool(own) and at == len(data)


def json_object(data: bytes | None) -> dict | None:
    try:
        made = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return made if isinstance(made, dict) else None


def token(text: str) -> str | None:
    """The algorithm of a signed (or sealed) token: a JSON header with one, JSON claims, and a signature of its length."""
    parts = text.split(".")
    head = json_object(decoded(parts[0]))
    name = head.get("alg") if head else None
    if not isinstance(name, str) or len(parts) not in (3, 5):
        return None
    if len(parts) == 5:
        return name if isinstance(head.get("enc"), str) and parts[3] and all(decoded(x) is not None for x in parts[1:]) else None
    signature = decoded(parts[2])
    if json_object(decoded(parts[1])) is None or signature is None:
        return None
    n = len(signature)
    if name in SIGNATURE:
        return name if n == SIGNATURE[name] else None
    if name[:2] in ("RS", "PS"):
        return name if n >= RSA_LEAST else None
    return name if bool(n) == (name.lower() != "none") else None


def base_spans(text: str) -> dict[str, list[Span]]:
    """The leftmost matches of each base kind that are long enough."""
    out: dict[str, list[Span]] = {k: [] for k in BASE}
    low = text.lower()
    if any(w in low for w in WORDS):
        pattern, least = BASE["assign"]
        out["assign"] = [m.span() for m in pattern.finditer(text) if len(m[1]) >= least]
    if "AKIA" in text:
        pattern, least = BASE["access"]
        out["access"] = [m.span() for m in pattern.finditer(text) if len(m[1]) >= least]
    # a run of 32 digits or more is a whole match, as matches are as long as they can be
    out["hex"] = [m.span() for m in LEAST_HEX.finditer(text)]
    return out


def form(data: bytes | None, depth: int) -> tuple[str, str] | None:
    """(kind, form) of decoded bytes; null if nothing in them is confirmed."""
    if not data:
        return None
    if data[0] == SEQUENCE and (name := private_key(data)):
        return "key", name
    if ssh_key(data):
        return "key", "openssh"
    try:
        text = data.decode("ascii")
    except UnicodeDecodeError:
        return None
    if not all(c.isprintable() or c in "\t\r\n" for c in text):
        return None
    base = base_spans(text)
    if base["assign"] or base["access"]:
        return "sealed", "assign" if base["assign"] else "access"
    if depth < DEPTH:
        inner = next((x for x in confirmed(text, depth + 1)), None)
        if inner:
            return "sealed", inner[3]
    return None


def stretches(text: str, start: int, end: int) -> Iterator[Span]:
    """A candidate as a whole; where it is wrapped, also without its last line, which may be a word that follows, and each line by itself."""
    yield start, end
    if "\n" not in text[start:end]:
        return
    yield start, start + len(text[start : text.rindex("\n", start, end)].rstrip())
    for line in re.finditer(r"[^\s]{20,}", text[start:end]):
        yield start + line.start(), start + line.end()


def confirmed(text: str, depth: int = 0) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, form) of the candidates whose structure is confirmed, by kind of candidate."""
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            if name := token(m[0]):
                yield "token", *m.span(), name
    for m in BASE64.finditer(text):
        for a, b in stretches(text, *m.span()):
            if found := form(decoded(text[a:b]), depth):
                yield found[0], a, b, found[1]
                if b == m.end() or "\n" in text[a:b]:
                    break
    for m in HEX.finditer(text):
        if found := form(bytes.fromhex(m[0]), depth):
            yield found[0], *m.span(), found[1]


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("form", StringType())]))


def spans_in(text: str) -> list[dict]:
    """All spans by start, then kind; of one kind none overlaps another, the first and longest stands. form: what confirmed it."""
    found = [(a, KINDS.index(k), b, "") for k, spans in base_spans(text).items() for a, b in spans]
    ends = dict.fromkeys(KINDS, 0)
    for k, a, b, name in sorted(confirmed(text), key=lambda x: (x[1], -x[2])):
        if a >= ends[k]:
            ends[k] = b
            found.append((a, KINDS.index(k), b, name))
    return [{"kind": KINDS[k], "start": a, "end": b, "form": name} for a, k, b, name in sorted(found)]


@F.arrow_udf(SPANS)
def spans_of(texts: pa.Array) -> pa.Array:
    return pa.array([spans_in(t or "") for t in texts.to_pylist()], to_arrow_type(SPANS))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, text and spans (kind, start, end in code points, form) of each row of documents.

    A null or empty text has no spans and stays as it is. Rows that repeat a doc_id are scanned by themselves; a null doc_id stays null. Texts of any length
    are read whole. Other columns are left out.
    """
    prepare(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("spans", spans_of(F.coalesce("text", F.lit(""))))


def secrets(documents: DataFrame) -> DataFrame:
    """Of each row: doc_id, the base kinds' counts, the hash of their spans, and all spans as `kind:start:end`. Cases: see scan."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scan(documents).select("doc_id", *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents' doc_id and text with each stretch of spans, overlapping ones as one, replaced by a mark. Cases: see scan."""

    def step(acc, s):
        apart = s["start"] >= acc["end"]
        piece = F.concat(acc["out"], F.when(apart, F.concat(F.substr(acc["text"], acc["end"] + 1, s["start"] - acc["end"]), F.lit(mark))).otherwise(F.lit("")))
        return F.struct(piece.alias("out"), F.greatest(acc["end"], s["end"]).alias("end"), acc["text"].alias("text"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"), F.col("text").alias("text"))
    done = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substr(a["text"], a["end"] + 1, F.length(a["text"]))))
    return scan(documents).select("doc_id", F.when(F.size("spans") > 0, done).otherwise(F.col("text")).alias("text"))
