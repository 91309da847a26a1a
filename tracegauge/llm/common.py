"""What the corpus operators share: the session's settings, the shared folder, bounded groups and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches to Python are bounded in rows and bytes, so that a run of very long texts cannot fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or, in local mode, a new one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read back. Later stages survive lost executors without
    running df's stages again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` rows of df, those with the smallest hash of key, or all if there are no more."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the rule that sets rows apart for held-out checks. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Hash values that stand for the rows that are looked up, at most: that many rows are broadcast.
LOOKUP = 1 << 20


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """rows whose key (not null) is not in gone (one column, distinct). Only rows whose key has its hash value in common with one of gone are
    moved; the rest stay where they are."""
    value = lambda c: F.pmod(F.xxhash64(c), F.lit(LOOKUP)).cast("int")
    k, v = fresh(rows, "key"), fresh(rows, "value")
    gone = gone.select(F.col(gone.columns[0]).alias(k))
    values = F.broadcast(gone.select(value(F.col(k)).alias(v)).distinct())
    keyed = rows.withColumn(k, key).withColumn(v, value(F.col(k)))
    clear = keyed.join(values, v, "left_anti")
    rest = keyed.join(values, v, "left_semi").join(gone, k, "left_anti")
    return clear.select(rows.columns).unionByName(rest.select(rows.columns))


#: A key is crowded with more than one in SHARE of all rows, and more than FEW: there are no more than SHARE such keys.
SHARE, FEW = 1024, 64


def crowded(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, parts) of the crowded keys of counts (key, n), and the number of parts into which to deal their rows; rows: the sum of n.
    At most SHARE keys, so that it can be broadcast whatever the input."""
    most = max(FEW, rows // SHARE)
    return counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))


def dealt_join(rows: DataFrame, side: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with side on key ("inner" or "left"). The rows of keys in hot (`crowded`) are dealt over tasks by the hash of `by`, and what side has for such
    a key goes to each of its parts: 2 * SHARE copies at most for each row that side has for a key."""
    hot = F.broadcast(hot.withColumnRenamed("parts", "_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = side.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def words(text: bytes | None) -> list[bytes]:
    """UTF-8 words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return text.lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of equal, non-null keys in frames that a partition sorted by them delivers."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        at = [0, *cut.tolist()]
        for a, b in zip(at, at[1:], strict=False):
            yield frame.iloc[a:b]
        rest = frame.iloc[at[-1] :]
    if rest is not None and len(rest):
        yield rest
