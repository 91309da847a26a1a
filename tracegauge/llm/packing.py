"""Packing of token ids into sequences of a fixed capacity by harmonic classes.

Class j holds pieces longer than capacity / (j + 1) and no longer than capacity / j, so that any j of them fit one
sequence. Each worker fills the classes' sequences by itself, j pieces to each; only the pieces of its unfilled
sequences (fewer than j of each class) go on: to groups of POOL workers, from there to groups of POOL groups, and so on, so
that no group ever holds more than POOL * j pieces of class j, however many workers there are. At last, when fewer than j
pieces of each class are left in the whole input, one best-fit pass places that constant number of pieces.

A document may be cut: full sequences first, then pieces of exactly capacity // j tokens, whose classes fill without
padding, and a short tail.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

CAPACITY = 2048
END = 1
#: Exact cuts before the tail; workers, or groups of them, that pool their unfilled sequences.
CUTS, POOL = 2, 8
#: Words whose ids a worker keeps, and how many unknown ones are encoded together.
CACHE, RUN = 600_000, 512
#: Texts of these characters only are cut into words here; others go through the tokenizer as a whole. In this range one
#: rule lower-cases each character, no text changes under NFC, and white space is plain.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u017f]*")
#: The tokenizer's word pattern, its letter and digit classes written out for that range (after lower-casing).
LETTERS = "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\u017f"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9\\xb2\\xb3\\xb9\\xbc-\\xbe]|[^\\s{LETTERS}0-9\\xb2\\xb3\\xb9\\xbc-\\xbe]+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, kind int, worker int, nth long"


class Encoder:
    """Packed little-endian ids of a text; the ids of plain words are kept, as words recur."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        # the last id of each word, and no other, has the word-end mark
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, np.bool_)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """The words go through the tokenizer in runs, as one text; the word ends cut its ids into the words' own."""
        for i in range(0, len(words), RUN):
            run = words[i : i + RUN]
            ids = self.ids(" ".join(run))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(run):  # a tokenizer without such marks
                self.known.update((w, self.whole(w)) for w in run)
                continue
            packed, begin = ids.tobytes(), 0
            for w, end in zip(run, (4 * ends).tolist(), strict=True):
                self.known[w] = packed[begin:end]
                begin = end

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        plain = [bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        split = [WORD.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        self.learn([w for w in set().union(*split) if w not in known])
        for t, p, ws in zip(texts, plain, split, strict=True):
            yield b"".join(map(known.__getitem__, ws)) if p else self.whole(t)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    for _ in range(CUTS):
        if not n:
            break
        j = -(-capacity // n)  # the smallest class whose exact pieces are no longer than n
        while capacity // j > n:
            j += 1
        out.append((capacity // j, capacity // (capacity // j)))
        n -= capacity // j
    if n:
        out.append((n, capacity // n))
    return out


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents (doc_id, text) and their places in sequences of at most capacity tokens.

    A null or empty text has only the end id. Rows that repeat a doc_id are packed as documents of their own; a null
    doc_id stays null. Other columns are left out. An empty table gives no rows. tokenizer is a path that executors can
    read, as of a package that is installed on them.
    """
    prepare(documents.sparkSession)
    suffix = np.asarray([end], "<u4").tobytes()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = encoder(tokenizer), TaskContext.get().partitionId()
        opened: dict[int, list[list]] = {}
        made = nth = 0
        for batch in batches:
            rows: list[list] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += suffix
                total, at = len(ids) // 4, 0
                for length, kind in cuts(total, capacity):
                    row = [doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total, None, None, kind, worker, nth]
                    nth += 1
                    at += length
                    one = opened.setdefault(kind, [])
                    one.append(row)
                    if len(one) == kind:
                        offset = 0
                        for x in one:
                            x[5], x[6] = (1 << 59) | (worker << 36) | made, offset
                            offset += x[2]
                        made += 1
                        rows += one
                        opened[kind] = []
            if rows:
                yield batch_of(rows)
        if rows := [x for one in opened.values() for x in one]:
            yield batch_of(rows)

    pieces = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fill, PIECES), "pieces")
    names = pieces.columns[:7]
    done = [pieces.where("sequence_id is not null").select(names)]
    rest = pieces.where("sequence_id is null")
    level, pools = 1, (pieces.agg(F.max("worker")).first()[0] or 0) + 1
    while pools > 1:
        level, pools = level + 1, -(-pools // POOL)
        rest = rest.withColumn("pool", F.floor(F.col("worker") / POOL ** (level - 1)))
        w = Window.partitionBy("kind", "pool")
        rest = rest.withColumn("rank", F.row_number().over(w.orderBy("worker", "nth")) - 1).withColumn("bin", F.floor(F.col("rank") / F.col("kind")))
        rest = rest.withColumn("full", (F.col("bin") + 1) * F.col("kind") <= F.count(F.lit(1)).over(w))
        rest = rest.withColumn("offset", F.sum("length").over(Window.partitionBy("kind", "pool", "bin").orderBy("rank")) - F.col("length"))
        # 4 bits for the level, 12 for the class, 23 for the pool, 24 for the sequence in it
        sequence = F.lit(level << 59).bitwiseOR(F.shiftleft(F.col("kind").cast("long"), 47)).bitwiseOR(F.shiftleft(F.col("pool"), 24)).bitwiseOR(F.col("bin"))
        rest = materialize(rest.withColumn("sequence_id", F.when(F.col("full"), sequence)), f"pieces-{level}")
        done.append(rest.where("full").select(names))
        rest = rest.where("not full").drop("pool", "rank", "bin", "full")

    def best_fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (got := [f for f in frames if len(f)]):
            return
        left = pd.concat(got).sort_values(["length", "worker", "nth"], ascending=[False, True, True], ignore_index=True)
        free: list[tuple[int, int]] = []  # (free tokens, sequence), ascending
        where, made = [], 0
        for n in left["length"].tolist():
            i = bisect_left(free, (n, -1))
            room, sequence = free.pop(i) if i < len(free) else (capacity, made)
            made = max(made, sequence + 1)
            where.append((sequence, capacity - room))
            free.insert(bisect_left(free, (room - n, sequence)), (room - n, sequence))
        left["sequence_id"], left["offset"] = zip(*where, strict=True)
        yield left[names]

    # fewer than j pieces of each class j: a constant number, whatever the input
    done.append(rest.select(*names, "worker", "nth").coalesce(1).mapInPandas(best_fit, pieces.select(names).schema))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def batch_of(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "kind", "worker", "nth"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
