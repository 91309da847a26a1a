"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words under the ones of a fixed mask; the words under its zeros may differ. All seeds of the
benchmark and all seeds of the documents are joined; a document's seeds are tested against a fixed-size Bloom filter of
the benchmark's first, so that few of them take part in the join. A hit of item word t at document word p says that the
item lies along the diagonal p - t there. Along it, equal words count 1 and others -MISS: the best segment decides, so that
overlaps with substituted words are found, and single common phrases are not enough. An item of which SHARE of the words are
there, in order, within NEAR words of the diagonal, is found too: there neighbouring diagonals are joined. An item shorter
than all masks is found where all its words stand: a document's runs of as many words are seeds too, if there are such items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crowded, dealt_join, materialize, mix, prepare, without

#: Masks of five words each; items of fewer words have one seed, of all their words.
MASKS = ("11111", "1101011", "1011101", "11010101")
#: A segment needs such a score, or SHARE of the item's words if the item is shorter.
ENOUGH, MISS, SHARE = 10, 2, 0.75
#: Words put in or left out move what follows by up to so many places.
NEAR = 8
#: The filter has some SPARSE bits for each seed of the benchmark, so that few documents pass by chance (a text has thousands of seeds),
#: within these powers of two (at most 8 MB are broadcast).
SPARSE, BLOOM_BITS = 256, (20, 26)
BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_hashes(text: bytes | None) -> np.ndarray:
    """Of ASCII letters and digits (lower-cased) and all non-ASCII characters; what is between them separates words."""
    ws = text.lower().translate(BLANK).split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def seeds(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, place) of the seeds of each mask."""
    out = []
    for m, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        x = np.full(n, m + 1, np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
        out.append((mix(x), np.arange(n)))
    return out


def run_seeds(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of all runs of n words; of equal runs the first alone, as each says all that the others do."""
    x = np.full(max(0, len(h) - n + 1), n << 8, np.uint64)
    for k in range(n):
        x = mix((x ^ h[k : k + len(x)]) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(x, return_index=True)


def bloom_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, words, and seeds (h, t) of each distinct sequence of words; the smallest id stands for equal items."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [word_hashes(t) for t in batch.column("text").to_pylist()]
            listed = []
            for h in hashes:
                short = [run_seeds(h, len(h))] if 0 < len(h) < len(MASKS[0]) else []
                listed.append([{"h": int(x), "t": int(t)} for xs, ts in seeds(h) + short for x, t in zip(xs.view(np.int64), ts, strict=True)])
            words_ = pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), words_, pa.array(listed, pa.list_(pa.struct([("h", pa.int64()), ("t", pa.int32())])))], ["item_id", "words", "seeds"])

    items = benchmark.mapInArrow(of, "item_id long, words array<long>, seeds array<struct<h:long,t:int>>").where("size(words) > 0")
    return items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("seeds").alias("seeds"))


def aligned(a: np.ndarray, b: np.ndarray, off: int, least: int) -> tuple[int, int, int] | None:
    """(equal, words, first place) in a of the longest common subsequence of a and b that stays in the band where b's word i meets
    a's words i + off .. i + off + 2 * NEAR, if it has `least` words."""
    if np.isin(b, a).sum() < least:
        return None
    width = 2 * NEAR + 1
    at = np.arange(len(b))[:, None] + off + np.arange(width)
    same = (at >= 0) & (at < len(a)) & (a[np.clip(at, 0, len(a) - 1)] == b[:, None])
    best = np.zeros((len(b) + 1, width + 1), np.int32)
    for i in range(len(b)):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + same[i]), out=best[i + 1, :-1])
    n = int(best[-1, width - 1])
    if n < least:
        return None
    i, k, places = len(b), width - 1, []
    while best[i, k]:
        if best[i - 1, k + 1] == best[i, k]:
            i, k = i - 1, k + 1
        elif k and best[i, k - 1] == best[i, k]:
            k -= 1
        else:
            if same[i - 1, k]:
                places.append(int(at[i - 1, k]))
            i -= 1
    return n, places[0] - places[-1] + 1, places[-1]


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, n_equal, n_words, first_word, item_words): each pair of a document and an item with a segment
    that is good enough; of several, the best one (then the first). Without one, SHARE of the item's words near a diagonal. row is a hash of doc_id and text, by which texts that share a doc_id are told
    apart; rows that repeat both are one.

    documents: (doc_id, text); benchmark: (item_id, text). Null or empty texts have no words and no pair. Items with equal
    words are one item, named by their smallest id. A null doc_id or item_id stays null. Items shorter than the shortest
    mask are found where all their words stand. Other columns are left out.
    """
    spark = prepare(documents.sparkSession)
    binary = lambda df, i: df.select(F.col(i).cast("long").alias(i), F.col("text").cast("string").cast("binary").alias("text"))
    items = materialize(item_seeds(binary(benchmark, "item_id")), "items").withColumn("item", F.xxhash64("words"))
    hashed = items.select("item", F.explode("seeds").alias("s")).select("item", "s.h", "s.t")

    # lengths of items that have no mask, and the filter's size
    short = sorted(r[0] for r in items.where(F.size("words") < len(MASKS[0])).select(F.size("words")).distinct().collect())
    width = min(max(math.ceil(math.log2(SPARSE * hashed.count() + 1)), BLOOM_BITS[0]), BLOOM_BITS[1])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(bloom_places(h, width))).astype(np.int32))], ["at"])

    # no more places than the filter has bits
    at = hashed.select("h").mapInArrow(places, "at int").distinct().toPandas()["at"].to_numpy(np.int64)
    bits = np.zeros(1 << width, np.bool_)
    bits[at] = True
    bloom = spark.sparkContext.broadcast(np.packbits(bits))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.unpackbits(bloom.value).view(np.bool_)
        for batch in batches:
            keep, words_, found = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                h = word_hashes(text)
                own = []
                for x, p in seeds(h) + [run_seeds(h, n) for n in short]:
                    a, b = bloom_places(x, width)
                    ok = np.flatnonzero(bit[a])
                    ok = ok[bit[b[ok]]]
                    own += [{"h": int(v), "p": int(q)} for v, q in zip(x[ok].view(np.int64), p[ok], strict=True)]
                if own:
                    keep.append(i)
                    words_.append(h.view(np.int64))
                    found.append(own)
            some = batch.select(["row", "doc_id"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(words_, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32())])))], ["row", "doc_id", "words", "hits"])

    docs = binary(documents, "doc_id").withColumn("row", F.xxhash64("doc_id", "text"))
    docs = docs.mapInArrow(hits, "row long, doc_id long, words array<long>, hits array<struct<h:long,p:int>>").dropDuplicates(["row"])
    docs = materialize(docs, "hits")
    each = docs.select("row", F.explode("hits").alias("x")).select("row", "x.h", "x.p")
    # a phrase that very many documents share with an item is dealt over tasks
    seen = materialize(each.groupBy("h").agg(F.count("*").alias("n")), "seeds")
    near = dealt_join(each, hashed, "h", "row", crowded(seen, "h", seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    near = near.select("row", "item", (F.col("p") - F.col("t")).alias("diagonal")).distinct()
    # the document's words that lie along the item, and the item's that lie along the document
    pairs = near.join(docs.select("row", "doc_id", F.col("words").alias("doc_words")), "row").join(items.select("item", "item_id", "words"), "item")
    skip = F.greatest(-F.col("diagonal"), F.lit(0))
    pairs = pairs.select("row", "doc_id", "item", "item_id", "diagonal", skip.alias("skip"), F.size("words").alias("item_words"), F.slice("doc_words", F.greatest("diagonal", F.lit(0)) + 1, F.size("words") - skip).alias("a"), F.slice("words", skip + 1, F.size("words")).alias("b"),
        # the same with what is near, for the item as a whole
        F.greatest(F.col("diagonal") - NEAR, F.lit(0)).alias("wide_first"), F.slice("doc_words", F.greatest(F.col("diagonal") - NEAR, F.lit(0)) + 1, F.greatest(F.size("words") + F.col("diagonal") + NEAR, F.lit(0)) - F.greatest(F.col("diagonal") - NEAR, F.lit(0))).alias("wide"), "words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, (a, b, n, d, s, wide, item, wide_first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "item_words", "diagonal", "skip", "wide", "words", "wide_first")), strict=True)):
                size = min(len(a), len(b))
                same = np.array(a[:size]) == np.array(b[:size])
                total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISS))])
                low = np.minimum.accumulate(total)
                end = int((total - low).argmax())
                begin = int(total[: end + 1].argmin())
                if total[end] - total[begin] >= min(ENOUGH, np.ceil(SHARE * n)):
                    keep.append(i)
                    out.append((int(total[end] - total[begin]), int(same[begin:end].sum()), end - begin, d + s + begin))
                elif whole := aligned(np.array(wide, np.int64), np.array(item, np.int64), d - NEAR - wide_first, int(np.ceil(SHARE * n))):
                    # after all segments that are good enough by themselves
                    keep.append(i)
                    out.append((whole[0] - n - 1, whole[0], whole[1], wide_first + whole[2]))
            some = batch.select(["doc_id", "row", "item", "item_id", "item_words"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array([x[k] for x in out], pa.int64()) for k in range(4))], ["doc_id", "row", "item", "item_id", "item_words", "value", "n_equal", "n_words", "first_word"])

    judged = pairs.mapInArrow(judge, "doc_id long, row long, item long, item_id long, item_words int, value long, n_equal long, n_words long, first_word long")
    best = judged.groupBy("row", "doc_id", "item", "item_id", "item_words").agg(F.max(F.struct("value", (-F.col("first_word")).alias("back"), "n_equal", "n_words")).alias("x"))
    return best.select("doc_id", "row", "item_id", "x.n_equal", "x.n_words", (-F.col("x.back")).alias("first_word"), F.col("item_words").cast("long").alias("item_words"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the rows that contain a benchmark item; all columns stay."""
    bad = materialize(contaminated(documents, benchmark).select("row").distinct(), "contaminated")
    return without(documents, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")), bad)
