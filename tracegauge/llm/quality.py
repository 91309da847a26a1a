"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum takes linear time as
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, prepare, remainder

BUCKETS, FACTORS = 1 << 14, 4
#: About so many labelled documents are learned from; passes over them; rates and decay.
TRAIN_DOCUMENTS, EPOCHS, BATCH, RATE, DECAY = 8000, 12, 256, 0.05, 1e-3
CUT = 0.3
STATS = 16
LINES = re.compile(b"[^\\n]+")


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words (tf-scaled to unit length), then STATS statistics and metadata, each once."""
    t = (text or "").encode(errors="replace")
    words = t.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    distinct, tf = np.unique(h, return_counts=True)
    x = np.log1p(tf)
    x /= np.sqrt((x * x).sum()) or 1
    b = np.frombuffer(t, np.uint8)
    n, w = max(1, len(b)), max(1, len(words))
    kinds = np.bincount(b, minlength=256)
    share = lambda chars: kinds[list(chars)].sum() / n
    lines = LINES.findall(t)
    pairs = len(np.unique(h[:-1] * np.uint64(3) + h[1:])) / max(1, len(h) - 1)
    stats = [
        1.0,
        np.log1p(len(words)) / 8,
        len(distinct) / w,
        pairs,
        tf.max(initial=0) / w,
        kinds[65:91].sum() / max(1, kinds[65:91].sum() + kinds[97:123].sum()),
        10 * share(b"#*$%&|<>=_{}[]~^\\"),
        10 * share(b"!?"),
        5 * share(b".,;:"),
        5 * share(b"0123456789"),
        len(t) / w / 10,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 5,
        kinds[128:].sum() / n,
        float(len(words) < 10),
        np.log1p(max(0, n_chars if n_chars is not None else len(text or ""))) / 10,
    ]
    return np.concatenate([(distinct % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + np.arange(STATS)]), np.concatenate([x, stats]).astype(np.float32)


class Machine:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(BUCKETS + STATS)
        self.v = r.standard_normal((BUCKETS + STATS, FACTORS)) * 0.05

    def margin(self, i: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows that start at `at`: the margin, and the factors' sums."""
        vx = self.v[i] * x[:, None]
        sums = np.add.reduceat(vx, at)
        return self.bias + np.add.reduceat(self.w[i] * x, at) + 0.5 * (sums**2 - np.add.reduceat(vx**2, at)).sum(1), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        at = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        m, _ = self.margin(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), at)
        return 1 / (1 + np.exp(-np.clip(m, -50, 50)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adagrad on the logistic loss."""
        r, gw, gv = np.random.default_rng(1), np.full(self.w.shape, 1e-4), np.full(self.v.shape, 1e-4)
        p = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(p / (1 - p)))
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                b = order[k : k + BATCH]
                size = np.array([len(rows[j][0]) for j in b])
                i, x = (np.concatenate([rows[j][c] for j in b]) for c in (0, 1))
                m, sums = self.margin(i, x, np.cumsum([0, *size[:-1]]))
                d = np.repeat((1 / (1 + np.exp(-np.clip(m, -50, 50))) - y[b]) / len(b), size)
                own, place = np.unique(i, return_inverse=True)
                dw, dv = np.zeros(len(own)), np.zeros((len(own), FACTORS))
                np.add.at(dw, place, d * x)
                np.add.at(dv, place, d[:, None] * (x[:, None] * np.repeat(sums, size, axis=0) - self.v[i] * (x**2)[:, None]))
                dw, dv = dw + DECAY * self.w[own], dv + DECAY * self.v[own]
                gw[own] += dw**2
                gv[own] += dv**2
                self.w[own] -= RATE * dw / np.sqrt(gw[own])
                self.v[own] -= RATE * dv / np.sqrt(gv[own])


def measured(documents: DataFrame, keep: list[str], then, schema: str) -> DataFrame:
    """then(batch, features of its rows) for each batch of documents (text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield then(batch.select(keep), rows)

    return documents.mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Machine:
    """Learns from documents (doc_id, text, n_chars) with a non-null quality in labels (doc_id, quality), about `most` of
    the labels; a label that is repeated counts once. Features of these documents alone, of about `most` if more rows bear their ids,
    come to the driver."""
    some = bounded_sample(labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("quality")).distinct(), F.col("doc_id"), most)

    def out(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())], ["doc_id", "quality", "i", "x"])

    # the sampled labels are a bounded number of small rows
    labelled = bounded_sample(documents.join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text", "n_chars"), F.concat_ws(" ", "doc_id", "text"), 2 * most)
    got = measured(labelled, ["doc_id", "quality"], out, "doc_id long, quality int, i binary, x binary").toPandas().sort_values(["doc_id", "i"], ignore_index=True)
    machine = Machine()
    if len(got):
        machine.fit([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32)) for i, x in zip(got["i"], got["x"], strict=True)], got["quality"].to_numpy(float))
    return machine


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of documents (doc_id, text; n_chars if there), learned from the
    labels of documents whose crc32 of doc_id isn't `held` modulo `folds`.

    A null or empty text is scored by its statistics. A null n_chars counts as the text's length. A null doc_id counts as
    an empty id and has no label. Repeated rows are all scored. Without labels every score is 0.5. An empty table gives no
    rows. Other columns are left out.
    """
    spark = prepare(documents.sparkSession)
    n_chars = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))
    held_out = remainder(F.col("doc_id"), folds) == held
    machine = spark.sparkContext.broadcast(fit(rows.where(~held_out), labels.where(~held_out)))  # of fixed size

    def out(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        score = machine.value.score(rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = measured(rows, ["doc_id"], out, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
