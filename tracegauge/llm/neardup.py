"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

1. Each document's set of word shingles gives SAMPLES MinHash samples (a fast similarity sketch: every sample is of one
   element, and two sets share a sample with probability equal to their Jaccard similarity), folded into an odd sketch:
   a parity bitmap whose XOR with another one has about as many bits as the sets' samples differ. BANDS bands of ROWS
   samples make buckets. A pair at the threshold of 0.8 shares no bucket with probability (1 - 0.8^6)^50 = 2.5e-7.
2. Documents with equal sets are one node from here on.
3. In each bucket every node is compared with the bucket's smallest only: odd sketches first, then the full sets.
4. Components of these links: tasks contract pieces of bounded size, and star rounds join the pieces. Buckets that still hold nodes of several components are compared in blocks of bounded size:
   sketch against sketch, then full sets. No bucket is capped and no pair is left out that could add a link between
   components; pairs within a component are not compared, and only links that join components are listed.

Rows of a crowded bucket, centre or node are dealt over many tasks wherever they are joined (`common.dealt_join`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOOKUP, crowded, dealt_join, fresh, groups, materialize, mix, prepare, without, words

ROWS, BANDS, BITS = 6, 50, 1024
SAMPLES = ROWS * BANDS
#: Odd-sketch estimates lie within 6 standard deviations of the truth: sketches below threshold - MARGIN can't be links.
MARGIN = 0.17
#: Nodes in a block (sketches alone are compared within and between blocks, so blocks may be large); cells of a matrix in one comparison.
BLOCK, CELLS = 2048, 1 << 23
#: Links that one task contracts.
PIECE = 1 << 16


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes (64 bits) of the text's shingles of so many words; of all its words if it has fewer."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), len(ws))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    out = h[: len(h) - size + 1]
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES MinHash samples of each non-empty set. In round i every element draws a bin and a value; the first round
    in which a bin is drawn fills it, by the least value. After SAMPLES rounds each element fills each bin that is left."""
    n, k = len(sets), SAMPLES
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * k, none, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    left = np.concatenate(sets) if n else np.empty(0, np.uint64)
    for i in range(2 * k):
        h = mix(left + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = (h >> np.uint64(33)) % np.uint64(k) if i < k else np.full(len(h), i - k, np.uint64)
        np.minimum.at(out, doc * k + bins.astype(np.int64), (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        open_ = (out.reshape(n, k) == none).any(axis=1)
        if not open_.any():
            break
        keep = open_[doc]
        if not keep.all():
            doc, left = doc[keep], left[keep]
    return out.reshape(n, k)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Packed parity bitmaps of rows of samples."""
    at = mix(s ^ (np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(BITS)
    count = np.zeros((len(s), BITS), np.uint8)
    np.add.at(count, (np.arange(len(s))[:, None], at.astype(np.int64)), 1)
    return np.packbits(count & 1, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity as odd sketches (packed rows) estimate it."""
    z = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * z / BITS, 1e-9))


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a fingerprint of the set), odd, bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            s = samples([sets[i] for i in some])
            bands = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + s[:, r::ROWS])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            odd = odd_sketch(s)
            row = dict(zip(some, range(len(some)), strict=True))
            full = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
            as_long = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    as_long([x & 0xFFFFFFFFFFFFFFFF for x in full]),
                    as_long([x >> 64 for x in full]),
                    pa.array([odd[row[i]].tobytes() if i in row else None for i in range(len(sets))], pa.binary()),
                    pa.array([bands[row[i]].view(np.int64) if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "odd", "bands"],
            )

    return documents.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, odd binary, bands array<long>")


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ids (doc_id, distinct). What has no id with its hash value goes before the exchange:
    no more than LOOKUP values are broadcast, whatever the number of ids."""
    value = F.pmod(F.xxhash64("doc_id"), F.lit(LOOKUP)).cast("int")
    some = rows.withColumn("_value", value).join(F.broadcast(ids.select(value.alias("_value")).distinct()), "_value", "left_semi").drop("_value")
    return some.join(ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, documents: DataFrame, size: int, percent: int, hot: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Only texts of documents in pairs
    are moved; the text of a, once for each of its partners, is about as long as the partner's. hot: the a of very many pairs."""
    need = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = materialize(only(documents, need), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_a = None, None
        for batch in batches:
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)):
                if ta != last:
                    last, set_a = ta, shingles(ta, size)
                set_b = shingles(tb, size)
                both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                if both and 100 * both >= percent * (len(set_a) + len(set_b) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    return dealt_join(pairs.select("a", "b").join(right, "b"), left, "a", "b", hot).sortWithinPartitions("a").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long").distinct()


def contracted(edges: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) with the components of edges (a, b), n of them, dealt evenly in pieces of about PIECE: each node of a piece, but the
    smallest, is linked with the smallest that it reaches within the piece."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if (x := top(x)) != (y := top(y)):
                    up[max(x, y)] = min(x, y)
        pairs = [(x, y) for x in list(up) if (y := top(x)) != x]
        for i in range(0, len(pairs), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs[i : i + BLOCK], strict=True)], ["a", "b"])

    return edges.repartition(1 + n // PIECE).mapInArrow(span, "a long, b long").distinct()


def stars(edges: DataFrame) -> tuple[bool, int]:
    """Whether edges (a, b) are stars, every node but the centres linked with one centre alone; and their number."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child")))
    each = ends.groupBy("node").agg(F.sum("child").alias("child"), F.min("child").alias("least"))
    odd, n = each.agg(F.coalesce(F.max((F.col("child") > 1) | (F.col("child") > 0) & (F.col("least") == 0)), F.lit(False)), F.coalesce(F.sum("child"), F.lit(0))).first()
    return not odd, n


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b): the smallest node that is reachable. Pieces of bounded size are contracted, then large-star
    and small-star rounds join what lies in several; each round's edges are a table in the shared folder, and no node's neighbours are collected
    or meet in one task."""
    edges = links.select("a", "b").where("a != b")
    edges = materialize(contracted(edges, edges.count()), "edges")
    while True:
        done, n = stars(edges)
        if done:
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = dealt_join(both.where("b > a"), least.drop("n"), "a", "b", crowded(least, "a", 2 * n)).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = dealt_join(down, least.drop("n"), "a", "b", crowded(least, "a", 2 * n))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = materialize(contracted(small, n), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def common_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[x[k]] and sets[y[k]]."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y, strict=True)])
    all_, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out, width = np.zeros(len(x), np.float32), max(1, CELLS // len(sets))
    for c in range(0, len(all_), width):
        at = (column >= c) & (column < c + width)
        m = np.zeros((len(sets), min(width, len(all_) - c)), np.float32)
        m[row[at], column[at] - c] = 1
        out += (m @ m.T)[x, y]
    return out


def possible(g: pd.DataFrame, cut: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's rows whose sketches may be those of a link between components. A pair is met in the first bucket that
    it shares, unless its smaller node is the bucket's smallest, which has been compared with all."""
    odd = np.frombuffer(b"".join(g["odd"]), np.uint8).reshape(len(g), -1)
    tags = np.frombuffer(b"".join(g["tags"]), np.uint32).reshape(len(g), -1)
    node, comp, n, side, band = (g[c].to_numpy() for c in ("node", "component", "n_shingles", "side", "band"))
    within, least = g["i"].iloc[0] == g["j"].iloc[0], g["a"].iloc[0]
    xs, ys = [], []
    for x in np.flatnonzero((side == 0) & (node != least)):
        y = np.flatnonzero(((node > node[x]) if within else (side == 1)) & (comp != comp[x]) & (node != least))
        y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
        y = y[similarity(odd[y], odd[x]) >= cut]
        y = y[~(tags[y, : band[x]] == tags[x, : band[x]]).any(axis=1)]
        xs.append(np.full(len(y), x))
        ys.append(y)
    x, y = (np.concatenate(v) if v else np.empty(0, int) for v in (xs, ys))
    return x, y


def candidates(batches: Iterator[pd.DataFrame], cut: float, percent: int) -> Iterator[pd.DataFrame]:
    """The rows of units (key, i, j), sorted, that are in a possible pair: only their texts need to be read."""
    for g in groups(batches, ["key", "i", "j"]):
        if len(g) > 1:
            used = np.unique(np.concatenate(possible(g, cut, percent)))
            if len(used):
                yield g.iloc[used]


def linked(batches: Iterator[pd.DataFrame], cut: float, size: int, percent: int) -> Iterator[pd.DataFrame]:
    """Links that join components, of the nodes in units (key, i, j), sorted: side 0 against side 1, or within side 0 if
    i = j. Of the links found, those that span the unit's components are returned."""
    for g in groups(batches, ["key", "i", "j"]):
        if len(g) < 2:
            continue
        x, y = possible(g, cut, percent)
        if not len(x):
            continue
        node, comp = g["node"].to_numpy(), g["component"].to_numpy()
        used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        sets = [shingles(t, size) for t in g["text"].iloc[used]]
        both = common_counts(sets, place[: len(x)], place[len(x) :])
        length = np.array([len(t) for t in sets])
        ok = (both > 0) & (100 * both >= percent * (length[place[: len(x)]] + length[place[len(x) :]] - both))
        up: dict = {}

        def top(c):
            while up.get(c, c) != c:
                c = up[c]
            return c

        out = []
        for i, j in zip(x[ok], y[ok], strict=True):
            if (c := top(comp[i])) != (d := top(comp[j])):
                up[max(c, d)] = min(c, d)
                out.append((min(node[i], node[j]), max(node[i], node[j])))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def units(placed: DataFrame) -> DataFrame:
    """Rows (key, i, j, side, band, a, node, component) for `linked`, of placed (key, band, size, a, node, component).

    A bucket is dealt into blocks of about BLOCK nodes, those of large components apart, and each pair of blocks but those
    of one component is a unit; a bucket of one component has none, one of two nodes has had its only pair compared."""
    own = placed.where("size > 2").groupBy("key", "component").agg(F.count("*").alias("own"))
    bucket = own.groupBy("key").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("own") < BLOCK, F.col("own")).otherwise(0)).alias("mixed")).where("parts > 1")
    own = own.join(bucket, "key").withColumn("large", F.col("own") >= BLOCK)
    deal = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    apart = own.where("large").select("key", "component", F.explode(F.sequence(F.lit(0), deal("own") - 1)).alias("d")).select("key", F.xxhash64("component", "d").alias("block"), F.col("component").alias("pure"))
    mixed = bucket.where("mixed > 0").select("key", F.explode(F.sequence(F.lit(0).cast("long"), deal("mixed").cast("long") - 1)).alias("block"), F.lit(None).cast("long").alias("pure"))
    blocks = apart.unionByName(mixed)
    both = blocks.select("key", F.col("block").alias("i"), F.col("pure").alias("p")).join(blocks.select("key", F.col("block").alias("j"), F.col("pure").alias("q")), "key")
    both = both.where("i <= j and not coalesce(p = q, false)").select("key", "i", "j")
    sides = both.select("key", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(both.where("i < j").select("key", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    place = F.pmod(F.xxhash64("node", "key"), F.when(F.col("large"), deal("own")).otherwise(deal("mixed")))
    dealt = placed.join(own, ["key", "component"]).withColumn("block", F.when(F.col("large"), F.xxhash64("component", place.cast("int"))).otherwise(place.cast("long")))
    return dealt.join(sides, ["key", "block"]).select("key", "i", "j", "side", "band", "a", "node", "component")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of documents (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id that is reachable, kept marks it. A null or empty text, or one without words, has an empty set and
    is linked with nothing. Rows that repeat a doc_id stand for one document that has all their texts' links. A row
    without doc_id is returned with a null component and kept = false. Other columns are left out.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = materialize(signatures(docs, size), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = materialize(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("odd").alias("odd")), "nodes")
    # buckets of two sets or more; a set stands by half of its fingerprint until few rows are left
    rows = some.select("set_a", F.posexplode("bands").alias("band", "key"))
    # a row of `some` stands in BANDS buckets
    n_rows = BANDS * some.count()
    shared = materialize(rows.groupBy("key").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"), "buckets")
    members = dealt_join(rows, shared.select("key"), "key", "set_a", crowded(shared, "key", n_rows)).distinct().join(nodes.select("set_a", "node"), "set_a").select("key", "band", "node")
    members = materialize(members, "shared")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"))
    members = materialize(dealt_join(members, sizes.withColumnRenamed("n", "size"), "key", "node", crowded(sizes, "key", members.count())), "members")
    info = nodes.select("node", "n_shingles", "odd")
    side = lambda x: info.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
    cut = percent / 100 - MARGIN

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        rows = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), BITS // 8)
        return pd.Series(similarity(rows(a), rows(b)))

    @F.pandas_udf("binary")
    def short(bands: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, np.int64).astype(np.uint32).tobytes() for x in bands])

    ratio = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    first = materialize(members.where("a != node").select("a", F.col("node").alias("b")).distinct(), "first")
    hot = crowded(first.groupBy("a").agg(F.count("*").alias("n")), "a", first.count())
    first = dealt_join(first.join(side("b"), "b"), side("a"), "a", "b", hot).where(ratio).where(estimate("odd_a", "odd_b") >= cut).select("a", "b").distinct()
    links = materialize(confirmed(materialize(first, "pairs"), docs, size, percent, hot), "links")
    found = materialize(components(links), "components")

    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    dealt = materialize(units(placed), "units")
    need = materialize(dealt.select(F.col("node").alias("doc_id")).distinct(), "ids")
    sketches = materialize(only(some.select("doc_id", "n_shingles", "odd", "bands"), need).select(F.col("doc_id").alias("node"), "n_shingles", "odd", short("bands").alias("tags")), "sketches")
    by_unit = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    # sketches first: texts are moved for nodes in possible pairs alone
    likely = by_unit(dealt.join(sketches, "node"))
    likely = materialize(likely.mapInPandas(lambda frames: candidates(frames, cut, percent), likely.schema), "likely")
    texts = only(docs, materialize(likely.select(F.col("node").alias("doc_id")).distinct(), "ids")).withColumnRenamed("doc_id", "node")
    more = by_unit(likely.join(texts, "node")).mapInPandas(lambda frames: linked(frames, cut, size, percent), "a long, b long").distinct()
    # equal sets of which a row bears another id are links too
    copies = some.join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).where("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = materialize(links.unionByName(more).unionByName(copies), "links")
    found = materialize(components(links), "components").withColumnRenamed("node", "doc_id")
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the row with the smallest doc_id, all columns. Of rows that repeat a doc_id one stays.
    Rows without a doc_id are in no group and stay."""
    gone = materialize(near_duplicates(documents, size, percent).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    n = fresh(documents, "n")
    twice = materialize(documents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n)).where(F.col(n) > 1).select("doc_id"), "twice")
    left = without(documents, F.col("doc_id").cast("long"), gone)
    if twice.isEmpty():
        return left
    return left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(documents.columns)
