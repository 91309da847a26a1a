import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracegauge.llm import common, neardup
from tracegauge.llm.neardup import near_duplicates, samples, shingles


def brute(rows, size=2, percent=80):
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [(i, grams(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None], 2):
        both = len(x & y)
        if both and 100 * both >= percent * (len(x) + len(y) - both):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return sorted(((i, len(s), top(i) if i is not None else None, i is not None and top(i) == i) for i, s in sets), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component long").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, **more).collect()), key=repr)


@pytest.mark.parametrize("block, few", [(neardup.BLOCK, common.FEW), (16, 1)])
def test_planted(spark, block, few, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(common, "FEW", few)  # with 1, all that several rows share is dealt over tasks
    rng = random.Random(7)
    rows, vocabulary = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one "), (6, "a b"), (7, "A\tb"), (8, "b a"), (None, "a b"), (9, "x y z"), (10, "É é"), (11, "é é")], [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(20, 320):  # one large group of near copies and its fringe
        w = list(base)
        for _ in range(rng.choice((2, 5, 6, 7, 8, 12))):
            w[rng.randrange(len(w))] = f"u{i}"
        rows.append((i, " ".join(w)))
    for i in range(400, 460):  # half of each shared
        rows.append((i, " ".join(base[:60] + [rng.choice(vocabulary) for _ in range(60)])))
    for i in range(500, 560):
        rows.append((i, " ".join(rng.choice(vocabulary[:6]) for _ in range(rng.randrange(1, 9)))))
    rows += [(600, rows[20][1]), (600, "other text"), (601, "other text"), (601, "other text")]
    assert run(spark, rows, size=2) == brute(rows)


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows, size=2) == brute(rows)
    assert run(spark, rows) == brute(rows, 5)


def test_empty(spark):
    assert run(spark, []) == []


def test_samples_estimate_similarity():
    rng = random.Random(1)
    a = [f"w{rng.random()}" for _ in range(900)]
    x, y = (shingles(" ".join(w).encode(), 1) for w in (a[:800], a[100:]))
    s = samples([x, y])
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.08


def test_crowded_keys_are_dealt(spark):
    rows = spark.range(3000).select((F.col("id") % 100 * (F.col("id") % 3 > 0).cast("int")).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, 1)], "k long, id long"))
    side = spark.createDataFrame([(k, k % 7) for k in range(0, 90)] + [(0, 8)], "k long, x long")
    counts = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    hot = common.crowded(counts, "k", 3000)
    assert [(r.k, r.parts) for r in hot.collect()] == [(0, -(-rows.where("k = 0").count() // common.FEW))]
    got = common.dealt_join(rows, side, "k", "id", hot)
    assert got.columns == ["k", "id", "x"] and sorted(got.collect()) == sorted(rows.join(side, "k").collect())


@pytest.mark.parametrize("piece, few, most", [(neardup.PIECE, common.FEW, 1), (40, 1, 99)])
def test_components_take_few_plans(spark, piece, few, most, monkeypatch):
    """Chains, stars and their mixtures; each round is a plan of many joins, which the driver keeps: links that fit a piece need none."""
    monkeypatch.setattr(neardup, "PIECE", piece)
    monkeypatch.setattr(common, "FEW", few)
    rng, rounds = random.Random(3), []
    write = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    chain = rng.sample(range(1000), 200)
    links = [*zip(chain, chain[1:], strict=False), *((2000, 2001 + i) for i in range(150)), (2100, 5000), (5000, 5001), (7, 7), (9000, 8000), (9000, 8000)]
    rng.shuffle(links)
    want = {i: min(chain) for i in chain} | {i: 2000 for i in (*range(2000, 2151), 5000, 5001)} | {8000: 8000, 9000: 8000}
    got = neardup.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(want.items()) and len(rounds) <= most and (most == 1 or len(rounds) > 1)
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
