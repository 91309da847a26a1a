import random
import time

import numpy as np

from tracegauge.llm.pii import COST, KINDS, STEP, WINDOW, Tagger, all_spans, base_spans, codes, fit_tagger, model_spans, cut, places, spoil, spoilt, tags_of

RNG = random.Random(12)


def word():
    return "".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9)))


def card():
    d = [RNG.randrange(10) for _ in range(15)]
    total = sum(sum(divmod(2 * c, 10)) if i % 2 == 0 else c for i, c in enumerate(d))
    d = "".join(map(str, [*d, -total % 10]))
    return RNG.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])


MAKE = {
    "email": lambda: f"{word()}{RNG.choice(['.', '_', ''])}{RNG.randrange(99)}@{word()}.{RNG.choice(['com', 'org', 'example.net'])}",
    "ip": lambda: ".".join(str(RNG.randrange(256)) for _ in range(4)),
    "card": card,
    "phone": lambda: RNG.choice(["+1 ({}) 555-{}", "+44 {} 555 {}", "+49{}555{}"]).format(RNG.randrange(200, 999), RNG.randrange(1000, 9999)),
}
PLAIN = [lambda: f"in {RNG.randrange(1900, 2030)}", lambda: f"paid {RNG.randrange(9999)}.{RNG.randrange(10, 99)} for it", lambda: f"on {RNG.randrange(10, 30)}-{RNG.randrange(10, 13)}-{RNG.randrange(2000, 2030)}", lambda: f"order {RNG.randrange(10000, 999999)}", lambda: f"({RNG.randrange(50)})", lambda: "a @ b", lambda: f"v{RNG.randrange(9)}.{RNG.randrange(9)}"]


def sentence(middle):
    some = lambda: [word() for _ in range(RNG.randrange(3, 12))]
    before = " ".join([*some(), RNG.choice(PLAIN)() if RNG.random() < 0.5 else word(), *some()])
    return f"{before} {middle}", f" {' '.join(some())}", len(before) + 1


def test_held_out_spoilt_spans(spark):
    """Trained on other texts, the tagger finds spans that the patterns don't, and few others."""
    train = []
    for _ in range(1500):
        a, b, _ = sentence(MAKE[RNG.choice(KINDS)]() if RNG.random() < 0.6 else RNG.choice(PLAIN)())
        train.append(a + b)
    tagger = fit_tagger(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"))
    texts, want = [], []
    for _ in range(400):
        kind = RNG.choice(KINDS)
        if RNG.random() < 0.6:
            said = spoil(kind, MAKE[kind](), RNG)
            a, b, at = sentence(said)
            texts.append(a + b)
            want.append({(kind, at, at + len(said))})
        else:
            a, b, _ = sentence(RNG.choice(PLAIN)())
            texts.append(a + b)
            want.append(set())
    cover = lambda s, spans: any(s[1] < b and a < s[2] for _, a, b in spans)
    found = [base + more for base, more in all_spans(texts, tagger)]
    hit = sum(cover(s, f) for w, f in zip(want, found, strict=True) for s in w)
    right = sum(cover(s, w) for w, f in zip(want, found, strict=True) for s in f)
    exact = sum(s in f for w, f in zip(want, found, strict=True) for s in w)
    total = sum(map(len, want))
    print("recall", hit / total, "precision", right / max(1, sum(map(len, found))), "exact", exact / total)
    assert hit >= 0.9 * total and right >= 0.9 * sum(map(len, found)) and exact >= 0.75 * total


def brute(text, tagger):
    """Every window of the text, means over windows, one Viterbi pass over all places."""
    n = len(text)
    starts = range(0, max(n, 1), STEP)
    c = np.concatenate([codes(text), np.full(WINDOW, 129, np.int64)])
    inside = np.arange(n + WINDOW) < n
    total, times = np.zeros((n + WINDOW, len(COST[0]))), np.zeros(n + WINDOW)
    for a in starts:
        s = tagger.scores(c[None, a : a + WINDOW])[0][0]
        total[a : a + WINDOW] += s * inside[a : a + WINDOW, None]
        times[a : a + WINDOW] += 1
    s = total[:n] / times[:n, None]
    bits = places(text)
    s = np.where(COST[bits] < 0, -1e4, s)
    A = tagger.p["A"] + tagger.allowed
    best, back = s[0].copy() + A[0] * (bits[0] > 1), []
    for i in range(1, n):
        v = best[:, None] + A
        back.append(v.argmax(0))
        best = v.max(0) + s[i]
    tag = int((best + A[:, 0] * (bits[-1] > 1)).argmax())
    tags = [tag]
    for b in reversed(back):
        tags.append(tag := int(b[tag]))
    tags.reverse()
    out, i = [], 0
    while i < n:
        j = i + 1
        if tags[i]:
            k = (tags[i] - 1) // 2
            while j < n and tags[j] == 2 + 2 * k:
                j += 1
            a, b = i, j
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if set(text[a:b]) & set("0123456789@"):
                out.append((KINDS[k], a, b))
        i = j
    return out


def test_stretches_are_as_good_as_the_whole_text():
    tagger = Tagger(seed=5)
    tagger.p["c"][0] = -0.2  # an untrained network that marks much
    for _ in range(60):
        text = "".join(RNG.choice("a1@ .(+-é2b3\n" if RNG.random() < 0.7 else "abc def ") for _ in range(RNG.randrange(1, 300)))
        at, x, mask = cut(text)
        got = model_spans(text, at, *tagger.decode(x, mask)) if at else []
        assert got == brute(text, tagger), text


def test_many_texts_at_once():
    tagger = Tagger(seed=5)
    texts = [" ".join(RNG.choice(["a@b", "1.2", "+3 4", "word"]) for _ in range(RNG.randrange(40))) for _ in range(30)] + ["", "none"]
    one = [[t for t in all_spans([x], tagger)[0][1]] for x in texts]
    assert [more for _, more in all_spans(texts, tagger)] == one


def test_spoilt_spans_stand_where_they_are_said_to():
    for _ in range(200):
        a, b, _ = sentence(MAKE[RNG.choice(KINDS)]())
        new, spans = spoilt(a + b)
        assert spoilt(a + b) == (new, spans) and spans
        y = tags_of(new, spans)
        assert y.any() and all((places(new)[i] > 1) for i in np.flatnonzero(y))


def test_long_texts_take_linear_time():
    began = time.time()
    for t in ("7" * 1_000_000, "a" * 1_000_000 + "@", "+1" + " " * 1_000_000, "1." * 300_000, "a.b@" * 100_000):
        base_spans(t)
    assert time.time() - began < 20
    assert len(all_spans(["5" * 200_000 + " a@b.cd"], Tagger())[0][0]) == 1
