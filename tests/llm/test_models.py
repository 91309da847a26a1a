"""Language identification, quality classifier and language model: held-out results, odd rows, exact base figures."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracegauge.llm import lm, quality
from tracegauge.llm.langid import BUCKETS, WEIGHT, fit, grams, identify, predictions
from tracegauge.llm.lm import exchange, language_model
from tracegauge.llm.quality import Machine, features, quality_scores

ODD = [None, "", " \n", "123 +-", "é", "A", "word " * 30000, "a\x00b", "😀 x".encode("utf-16", "surrogatepass").decode("utf-16")]


def crc(i):
    return zlib.crc32(str(i).encode()) if i is not None else zlib.crc32(b"")


def odd_rows(spark):
    rows = [*enumerate(ODD), (None, "some text"), (5, "A"), (5, "A")]
    return rows, spark.createDataFrame([(i, t, "en" if t else None, 1.0) for i, t in rows], "doc_id long, text string, lang string, score double").repartition(3)


def test_language(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = predictions(docs).collect()
    assert len(out) == len(lang) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_odd_rows(spark):
    rows, df = odd_rows(spark)
    out = predictions(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred == "und") for r in out) == sorted((i is None, i or 0, not any(c.isalpha() for c in t or "")) for i, t in rows)
    assert predictions(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(df, fit(df.limit(0))).collect()} == {"und"}
    assert identify(df, fit(df)).columns == [*df.columns, "lang_pred", "lang_score"]


def test_quality(spark, sf_dir):
    at = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality_scores(docs, labels).collect() if r.held_out and r.doc_id in quality]
    good, bad = ([r.score for r in held if quality[r.doc_id] == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.97
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (crc(r.doc_id) % 5 == 0) for r in held)


def test_quality_odd_rows(spark):
    rows, df = odd_rows(spark)
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2, i) for i in range(9)] + [(None, 1, 1), (5, 0, 0)], "doc_id long, quality int, score int")
    out = quality_scores(df.withColumn("n_chars", df.score.cast("long")), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {round(r.score, 6) for r in quality_scores(df, labels.limit(0)).collect()} and quality_scores(df.limit(0), labels).count() == 0


def test_factorisation_identity():
    r = np.random.default_rng(0)
    m = Machine()
    i, x = np.array([3, 7, 7000]), r.random(3)
    m.w[i] = r.random(3)
    want = m.bias + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert m.margin(i, x, np.array([0]))[0][0] == pytest.approx(want)


def brute_base(rows):
    ws = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if crc(i) % 5 != 1 for w in ws(t))
    n, v = sum(c.values()), len(c)
    return n, {(i, t): (len(ws(t)), sum(w in c for w in ws(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws(t))) for i, t in rows}


@pytest.mark.parametrize("head", [lm.HEAD, 50])
def test_language_model(spark, sf_dir, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "CLUSTERED", min(head, 300))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n, want = brute_base(list(texts.items()))
    out = language_model(docs).collect()
    for r in out:
        tokens, known, base = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, crc(r.doc_id) % 5 == 1)
        assert r.base_score == pytest.approx(base) and r.score < 0 and math.isfinite(r.score)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_odd_rows(spark):
    rows, df = odd_rows(spark)
    n, want = brute_base(rows)
    out = language_model(df).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == sorted((repr(i), *want[i, t][:2], round(want[i, t][2], 4)) for i, t in rows)
    assert all(math.isfinite(r.score) and r.train_tokens == n for r in out)
    assert language_model(df.limit(0)).count() == 0
    assert all(math.isfinite(r.score) for r in language_model(df.where("doc_id = 1 or doc_id is null")).collect())


def test_exchange_raises_likelihood():
    r = np.random.default_rng(2)
    kind = np.arange(40) % 2  # words of two kinds, of which one follows the other
    b = r.poisson(np.where(kind[:, None] != kind, 9, 1)).astype(float)
    cls = exchange(b, 40, classes=2)
    assert len(set(zip(kind, cls, strict=True))) == 2


def test_frequent_words_are_bounded(spark):
    df = spark.createDataFrame([(bytearray(f"w{i}".encode()), 1 + i // 3) for i in range(90)], "word binary, c long").repartition(5)
    got = lm.frequent(df, 20)
    counts = [c for _, c in got]
    assert 0 < len(got) <= 20 and counts == sorted(counts, reverse=True) and min(counts) > max(c for c in (1 + i // 3 for i in range(90)) if c not in counts)
    assert len(lm.frequent(df, 100)) == 90 and lm.frequent(df.limit(0), 5) == []
    # words of one count: as many as fit, always the same ones
    flat = spark.createDataFrame([(bytearray(f"w{i}".encode()), 7) for i in range(5000)] + [(bytearray(b"the"), 900)], "word binary, c long").repartition(5)
    got = lm.frequent(flat, 1000)
    assert 900 < len(got) <= 1000 and got[0] == (b"the", 900) and got == lm.frequent(flat.repartition(2), 1000)


def brute_model(rows, cls):
    """log10 P of each text by the class bigrams of the training rows, for the classes that the model gave its words."""
    ws = lambda t: (t or "").encode().lower().split()
    length = lambda w: ("length", sum(len(w) > x for x in lm.LENGTHS))
    of = lambda w: cls[w] if w in cls else length(w)
    train = [ws(t) for i, t in rows if crc(i) % 5 != 1]
    c = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["end", *map(of, t)], [*map(of, t), "end"], strict=True))
    kinds = sorted(set(cls.values())) + [("length", k) for k in range(lm.TAILS)] + ["end"]
    to, frm, of_class, rare = Counter(), Counter(), Counter(), Counter()
    for (a, b), n in two.items():
        frm[a] += n
        to[b] += n
    for w, n in c.items():
        of_class[of(w)] += n
        rare[of(w)] += w not in cls
    total = sum(two.values())

    def text(t):
        out, a = 0.0, "end"
        for w in [*ws(t), None]:
            b = "end" if w is None else of(w)
            share = (to[b] + 1) / (total + len(kinds))
            out += math.log10((two[a, b] + lm.ALPHA * share) / (frm[a] + lm.ALPHA))
            if w is not None:
                out += math.log10(c[w] / of_class[b] if w in cls else (c[w] + lm.DELTA) / (of_class[b] + lm.DELTA * (rare[b] + 1)))
            a = b
        return out

    return {(i, t): text(t) for i, t in rows}


@pytest.mark.parametrize(("head", "clustered"), [(400, 60), (100_000, 1000), (30, 60)])
def test_scores_by_brute_force(spark, sf_dir, head, clustered, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "CLUSTERED", clustered)
    kept = []
    fitted = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: kept.append(fitted(*a)) or kept[-1])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()] + [(900, ""), (901, None), (902, "zzz unseen")]
    out = language_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    classes = {w: int(kept[0].cls[i]) for w, i in kept[0].words.items()}
    assert len(classes) <= head and len(set(classes.values())) > 8
    want = brute_model(rows, classes)
    texts = dict(rows)
    for r in out:
        assert r.score == pytest.approx(want[r.doc_id, texts[r.doc_id]])


def test_gains_are_those_of_the_likelihood():
    """Of a word that is put into each class in turn; the neighbours' own totals change alike for every class."""
    r = np.random.default_rng(6)
    g = r.poisson(20, (5, 5)).astype(float)
    left, right = r.poisson(3, 5).astype(float), r.poisson(3, 5).astype(float)
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    want = []
    for a in range(3):
        want.append(f(g[:, a] + left) - f(g[:, a]) + f(g[a] + right) - f(g[a]) - f(g.sum(0)[a] + left.sum()) + f(g.sum(0)[a]) - f(g.sum(1)[a] + right.sum()) + f(g.sum(1)[a]))
    key = np.arange(10)
    got = lm.gains(g, 3, key, np.concatenate([left, right]), np.array([10]))
    assert got[0] == pytest.approx(want)


def test_further_words_join_their_like(spark):
    """Words that stand where one kind of the clustered words does get that kind's class."""
    r = np.random.default_rng(4)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    pick = lambda ws: ws[int(30 * r.random() ** 3)]
    texts = [" ".join(w for _ in range(20) for w in (pick(a), pick(b))) for _ in range(300)]
    df = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    counts = Counter(w.encode() for t in texts for w in t.split())
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    symbols = lm.Symbols({w: i for i, (w, _) in enumerate(head[:10])}, 10)
    m = lm.pairs(df, symbols)
    cls = lm.exchange(m, 10, classes=2)
    one = np.zeros((len(m), cls.max() + 1))
    one[np.arange(len(m)), cls] = 1
    classes = lm.Symbols({w: int(cls[i]) for i, (w, _) in enumerate(head[:10])}, 2)
    found = lm.further(df, [w for w, _ in head], 10, classes, one.T @ m @ one) | classes.known
    assert len(found) == 60 and len({(w[:1], c) for w, c in found.items()}) == 2


def brute_languages(train, texts):
    """Multinomial naive Bayes by loops over dictionaries."""
    counts, docs = {}, Counter()
    for text, lang in train:
        docs[lang] += 1
        counts.setdefault(lang, Counter()).update(grams(text).tolist())
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            yield "und", 0.0
            continue
        score = {}
        for lang, c in counts.items():
            total = math.log(docs[lang] / sum(docs.values()))
            for g in grams(text).tolist():
                total += WEIGHT * (math.log(c[g] + 1) - math.log(sum(c.values()) + BUCKETS))
            score[lang] = total
        top = max(sorted(score), key=score.get)
        yield top, 1 / sum(math.exp(s - score[top]) for s in score.values())


def test_languages_by_brute_force(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, (r.text or "")[:300], r.lang) for r in some] + [(i + 500, t, None) for i, t in enumerate(ODD) if t is None or len(t) < 1000] + [(600, "² ½ ①", "en"), (601, "² x", None)]
    out = {r.doc_id: r for r in predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    want = brute_languages([(t, lang) for i, t, lang in rows if lang and t is not None and crc(i) % 4 != 2], [t for _, t, _ in rows])
    for (i, _, _), (lang, p) in zip(rows, want, strict=True):
        assert (out[i].lang_pred, out[i].score) == (lang, pytest.approx(p))
    assert out[600].lang_pred == "und" and out[601].lang_pred != "und"


def brute_quality(machine, text, n_chars):
    i, x = features(text, n_chars)
    pair = sum(float(machine.v[i[a]] @ machine.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
    return 1 / (1 + math.exp(-min(50.0, max(-50.0, machine.bias + float(machine.w[i] @ x) + pair))))


def test_quality_by_brute_force(spark, sf_dir, monkeypatch):
    """All pairs of features one by one, on the machine that the query fitted."""
    kept = []
    fitted = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: kept.append(fitted(*a)) or kept[-1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = docs.withColumn("text", F.substring("text", 1, 300)).where("doc_id < 60")
    out = {r.doc_id: r for r in quality_scores(short, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    for r in short.collect():
        want = brute_quality(kept[0], r.text, r.n_chars)
        assert out[r.doc_id].score == pytest.approx(want, abs=1e-6) and out[r.doc_id].predicted == (out[r.doc_id].score >= 0.3)
