"""The language model when all words that occur twice have a class by their neighbours."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from test_models import brute_base, odd_rows

from tracegauge.llm import lm
from tracegauge.llm.lm import language_model


def ws(t):
    return (t or "").encode().lower().split()


def length(w):
    return ("length", sum(len(w) > x for x in lm.LENGTHS))


def brute(rows, head, rest):
    """log10 P of each text. head, rest: the classes of the head's words and of the others that have one."""
    cls = head | rest
    of = lambda w: cls[w] if w in cls else length(w)
    train = [ws(t) for i, t in rows if crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    assert {w for w in c if c[w] > 1} == set(cls)
    two = Counter(p for t in train for p in zip(["end", *map(of, t)], [*map(of, t), "end"], strict=True))
    kinds = len(set(head.values())) + lm.TAILS + 1
    of_class, rare = Counter(), Counter()
    for w, n in c.items():
        of_class[of(w)] += n
        rare[of(w)] += w not in cls
    total = sum(two.values())
    to = {b: sum(n for (_, y), n in two.items() if y == b) for b in {b for _, b in two}}
    frm = {a: sum(n for (x, _), n in two.items() if x == a) for a in {a for a, _ in two}}

    def step(a, b):
        return math.log10((two[a, b] + lm.ALPHA * (to.get(b, 0) + 1) / (total + kinds)) / (frm.get(a, 0) + lm.ALPHA))

    def text(t):
        t = ws(t)
        out = sum(step(a, b) for a, b in zip(["end", *map(of, t)], [*map(of, t), "end"], strict=True))
        return out + sum(math.log10(c[w] / of_class[of(w)] if w in cls else (c[w] + lm.DELTA) / (of_class[of(w)] + lm.DELTA * (rare[of(w)] + 1))) for w in t)

    return {i: text(t) for i, t in rows}


@pytest.mark.parametrize(("head", "clustered"), [(300, 60), (100_000, 1000), (30, 60)])
def test_scores_by_brute_force(spark, sf_dir, head, clustered, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "CLUSTERED", clustered)
    models, tables = [], []
    refit = lm.refit
    monkeypatch.setattr(lm, "refit", lambda m, rest, h: (tables.append(rest), models.append(refit(m, rest, h)))[1] or models[-1])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()] + [(900, ""), (901, None), (902, "zzz unseen")]
    out = language_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least=2).collect()
    of_head = {w: int(models[0].cls[i]) for w, i in models[0].words.items()}
    of_rest = {bytes(r.word): r["class"] for r in tables[0].collect() if r.c > 1}
    assert len(of_head) <= head and (head == 100_000) == (not of_rest) and max(of_rest.values(), default=0) < models[0].n
    want, base = brute(rows, of_head, of_rest), brute_base(rows)[1]
    for r in out:
        assert r.score == pytest.approx(want[r.doc_id])
        tokens, known, plain = base[r.doc_id, dict(rows)[r.doc_id]]
        assert (r.n_tokens, r.n_known) == (tokens, known) and r.base_score == pytest.approx(plain)


def test_probabilities_add_up(spark, sf_dir, monkeypatch):
    """After each class, those of all training words, of one unseen word for each length and of the end make 1."""
    monkeypatch.setattr(lm, "HEAD", 200)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).selectExpr("cast(text as binary) as text").where("text is not null")
    counts = lm.counted(docs).cache()
    head = lm.frequent(counts.where("c > 1"), 200)
    m = lm.fit(docs, counts, head, 1000, 100)
    rest = lm.beyond(docs, m, 2).cache()
    m = lm.refit(m, rest, head)
    assert rest.count() + len(head) == counts.count() and rest.join(counts, "word").where(rest.c != counts.c).count() == 0
    for b in range(len(m.g)):
        p = 10 ** m.step[b, m.end_class] + sum(10 ** (m.step[b, m.cls[i]] + m.emit[i]) for i in m.words.values())
        for r in rest.collect():
            p += 10 ** m.step[b, r["class"]] * (r.c + m.plus[r["class"]]) / m.room[r["class"]]
        p += sum(10 ** m.step[b, k] * m.plus[k] / m.room[k] for k in range(m.n, m.n + lm.TAILS))
        assert p == pytest.approx(1)


def test_rare_words_join_their_like(spark, monkeypatch):
    """Words that stand where one kind of the head's words does get that kind's class, however many they are."""
    monkeypatch.setattr(lm, "HEAD", 8)
    a, b = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]
    common = [" ".join(x for j in range(30) for x in (a[(i + j) % 4], b[(i * j) % 4])) for i in range(40)]
    rare = [" ".join(x for j in range(3) for x in (f"ra{i}", b[j], a[j], f"rb{i}")) for i in range(50)]
    tables = []
    refit = lm.refit
    monkeypatch.setattr(lm, "refit", lambda m, rest, h: tables.append(rest) or refit(m, rest, h))
    monkeypatch.setattr(lm, "CLASSES", 2)
    monkeypatch.setattr(lm.exchange, "__defaults__", (2, lm.SWEEPS))
    language_model(spark.createDataFrame([(i, t) for i, t in enumerate(common + rare)], "doc_id long, text string"), least=2).count()
    kinds = {(bytes(r.word)[:2], r["class"]) for r in tables[0].collect() if bytes(r.word)[:1] == b"r"}
    assert len(kinds) == 2


def test_odd_rows(spark):
    rows, df = odd_rows(spark)
    n, want = brute_base(rows)
    out = language_model(df, least=2).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == sorted((repr(i), *want[i, t][:2], round(want[i, t][2], 4)) for i, t in rows)
    assert all(math.isfinite(r.score) and r.train_tokens == n for r in out)
    assert language_model(df.limit(0), least=2).count() == 0


def test_texts_are_read_three_times_alone(spark, monkeypatch):
    """To count words and rows, and to number the words: all later passes read the numbers."""
    monkeypatch.setattr(lm, "CLUSTERED", 20)
    monkeypatch.setattr(lm, "HEAD", 60)
    seen = spark.sparkContext.accumulator(0)

    def reading(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(40))) for i in range(50)], "doc_id long, text string").mapInPandas(reading, "doc_id long, text string")
    assert language_model(docs, least=2).count() == 50 and seen.value <= 3 * 50


def test_numbers(spark):
    """Numbers beyond two bytes, words that repeat, and texts without a word."""
    rows = [(i, t) for i, t in enumerate(["a b A c", "", None, "b c x yy y" * 3, "x a zzzz" * 400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(coalesce(text, '') as binary) as text")
    head = [f"h{i}".encode() for i in range(70_000)] + [b"a", b"b"]
    for r in lm.numbered(docs, head).collect():
        i = [a | b << 16 for a, b in zip(memoryview(bytes(r.low)).cast("H"), r.high, strict=True)]
        want = ws(dict(rows)[r.doc_id])
        at = iter(r["at"])
        assert [head[k] if k < len(head) else bytes(r.words[next(at)]) for k in i[:-1]] == want and i[-1] == len(head) + lm.TAILS
        assert len(set(r.words)) == len(r.words)


def test_planes():
    for x in ([], [0], [1, 255, 256, 70_000, 2**32 - 1]):
        assert lm.from_planes(lm.planes(np.array(x, np.int64))).tolist() == x
