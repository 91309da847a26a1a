"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are a Spark aggregation; the matrix of log-probabilities (buckets x languages) is broadcast,
and each batch of texts is scored as a sparse product: its n-grams' rows are gathered and summed by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded_sample, prepare, remainder

#: Lengths of n-grams, buckets, and the weight of one n-gram, as n-grams of several lengths overlap.
ORDERS, BUCKETS, WEIGHT = (1, 2, 3), 1 << 15, 1 / 3
#: About so many labelled documents are learned from.
TRAIN_DOCUMENTS = 20_000
#: Texts are scored together up to so many characters.
RUN_CHARS = 400_000
#: Word characters that may be letters; some of them (½, ²) are not.
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def grams(text: str) -> np.ndarray:
    """Buckets of the text's n-grams. Case is folded; all that isn't a letter counts as white space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 97) & (c <= 122) | (c >= 0xAA) & (c != 0xD7) & (c != 0xF7), c, np.uint32(32))
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])] if len(c) else c  # one space for many
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        h = h ^ (h >> np.uint32(15))
        if n in ORDERS:
            out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15))
    return np.concatenate(out).astype(np.uint16) if out else np.empty(0, np.uint16)


class Model:
    def __init__(self, languages: list[str], prior: np.ndarray, counts: np.ndarray):
        """counts: (language, bucket). Add-one smoothing."""
        self.languages = languages
        self.prior = np.log(prior / prior.sum()) if len(languages) else prior
        self.log = np.log(counts + 1.0) - np.log(counts.sum(1, keepdims=True) + BUCKETS) if len(languages) else counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        run: list[int] = []
        length = 0
        some = [i for i, t in enumerate(texts) if self.languages and t and has_letter(t)]
        for k, i in enumerate(some):
            run.append(i)
            length += len(texts[i])
            if length < RUN_CHARS and k + 1 < len(some):
                continue
            p = self.posterior([grams(texts[j]) for j in run])
            for j, best, row in zip(run, p.argmax(1), p, strict=True):
                said[j], score[j] = self.languages[best], float(row[best])
            run, length = [], 0
        return said, score

    def posterior(self, each: list[np.ndarray]) -> np.ndarray:
        """(text, language) of texts' buckets, none of which is empty."""
        at = np.cumsum([0, *(len(g) for g in each[:-1])])
        g = np.concatenate(each)
        total = np.stack([np.add.reduceat(row[g], at) for row in self.log], axis=1) * WEIGHT + self.prior
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(labelled: DataFrame, most: int = TRAIN_DOCUMENTS) -> Model:
    """Learns from rows (text, lang) with both, about `most` of them. Only the counts come to the driver: at most BUCKETS
    for each language."""
    rows = bounded_sample(labelled.where("text is not null and lang is not null").select("text", "lang"), F.col("text"), most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                if len(g := grams(text)):
                    sums[lang] += np.bincount(g, minlength=BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            # bucket -1: documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([*at.tolist(), -1], pa.int32()), pa.array([*s[at].tolist(), docs[lang]], pa.int64())], ["lang", "bucket", "n"])

    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(got["lang"]))
    row = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)
    bucket, n = got["bucket"].to_numpy(int), got["n"].to_numpy(float)
    prior, counts = np.zeros(len(languages)), np.zeros((len(languages), BUCKETS))
    prior[row[bucket < 0]] = n[bucket < 0]
    counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    return Model(languages, prior, counts)


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with lang_pred and lang_score added (columns of those names are replaced).

    A null text, or one without a letter, has `und` and a score of 0, as has every text if the model knows no language.
    Ties go to the language that sorts first. The score is the posterior probability.
    """
    spark = prepare(documents.sparkSession)
    known = spark.sparkContext.broadcast(model)  # BUCKETS numbers for each language
    rest = documents.drop("lang_pred", "lang_score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, p = known.value.predict(batch.column(text).to_pylist())
            yield batch.append_column("lang_pred", pa.array(said, pa.string())).append_column("lang_score", pa.array(p, pa.float64()))

    return rest.mapInArrow(score, StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]))


def predictions(documents: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of documents (doc_id, text, lang), learned from the rows whose
    crc32 of doc_id isn't `held` modulo `folds`. A null doc_id counts as an empty id. Repeated rows are all scored.
    An empty table gives no rows. Other columns are left out."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held_out: Column = remainder(F.col("doc_id"), folds) == held
    model = fit(rows.where(~held_out))
    return identify(rows.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
