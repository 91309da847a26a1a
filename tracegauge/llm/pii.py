"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

Tags are O and, for each kind, first and inner character. The CRF allows email tags only within words that hold an @, and
the other kinds' only within runs of digits and their separators (places); everywhere else O is certain. The network reads
overlapping windows of text, those that cover such places; a place's scores are the mean over all windows that hold it,
and one Viterbi pass over the text decides. As O is certain between them, stretches of places can be decoded one by one
and windows without any can be left out: the tags are those of the whole text.

It learns from the patterns' spans, from the same spans spoilt (separators, lengths and marks that the patterns don't know) and
from windows without any.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract, of an email what follows the @. None goes over a character twice.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile("[0-9@]")
#: Words with an @; runs of digits and separators.
AT = re.compile(r"(?<!\S)[^\s@]*+@\S*+")
NUMBER = re.compile(r"[0-9(+][0-9().+\x20-]*+")
WINDOW, STEP = 64, 32
TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 10, 16
#: Bits of a place: in the text, may be part of an email, of a number; and what each combination costs each tag.
INSIDE, MAIL, DIGITS, NEVER = 1, 2, 4, -1e4
COST = np.full((8, TAGS), NEVER, np.float32)
COST[:, 0] = 0
COST[MAIL | INSIDE :: DIGITS, 1:3] = 0
COST[DIGITS | INSIDE :, 3:] = 0
#: The model is fitted on up to so many distinct windows with a pattern's span, as many with a spoilt one and as many without any,
#: each those with the smallest hash in all documents; so many epochs.
TRAIN_EACH, EPOCHS, BATCH, RATE = 1000, 12, 128, 0.03
#: Cells of a padded block of stretches that are decoded together.
CELLS = 1 << 18


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans by kind, then start."""
    out = []
    end, q = 0, text.find("@")
    while q >= 0:
        # what stands before the @, back to the last match or a character that can't be part of it
        a = q
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < q and (m := PATTERNS["email"].match(text, q + 1)):
            end = m.end()
            out.append(("email", a, end))
        q = text.find("@", q + 1)
    if not re.search("[0-9]", text):
        return out
    # a part of over 20 digits may be a small number behind zeros, so parts are compared as numbers
    out += [("ip", *m.span()) for m in PATTERNS["ip"].finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
    for m in PATTERNS["card"].finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PATTERNS["phone"].finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def codes(text: str) -> np.ndarray:
    """A small code for each character: printable ASCII by itself, white space, letters and the rest by class. Which
    digit it is doesn't matter."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(c < 128, c, 128).astype(np.int64)
    out[(c >= 48) & (c <= 57)] = 48
    out[(c >= 65) & (c <= 90)] = 65
    return out


def places(text: str) -> np.ndarray:
    """The bits of each place of the text."""
    out = np.full(len(text), INSIDE, np.uint8)
    if "@" in text:
        for m in AT.finditer(text):
            out[m.start() : m.end()] |= MAIL
    for m in NUMBER.finditer(text):
        if TRIGGER.search(text, *m.span()):
            out[m.start() : m.end()] |= DIGITS
    return out


def windows_at(text: str, bits: np.ndarray | None = None) -> list[int]:
    """Starts of all windows, one each STEP characters from the first on, that hold a place where a tag other than O may be."""
    hot = np.unique(np.flatnonzero((places(text) if bits is None else bits) > INSIDE) // STEP)
    all_ = np.unique(np.concatenate([hot - k for k in range(WINDOW // STEP)])) if len(hot) else hot
    return (all_[all_ >= 0] * STEP).tolist()


class Tagger:
    """Embedding, two LSTMs, linear scores and CRF transitions. All arrays are float32 over (batch, time, ...)."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": init(130, EMBED), "U": init(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(EMBED + HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        # an inner tag follows its own kind only
        self.allowed = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            first, inner = 1 + 2 * k, 2 + 2 * k
            self.allowed[:, inner] = NEVER
            self.allowed[first, inner] = self.allowed[inner, inner] = 0
        self.start = np.zeros(TAGS, np.float32)

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, t, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, tape, W, b = np.empty((n, t, HIDDEN), np.float32), [], self.p[f"W{d}"], self.p[f"b{d}"]
        xw = x @ W[:EMBED] + b
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = xw[:, i] + h @ W[EMBED:]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            a, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + a * g
            tc = np.tanh(c2)
            tape.append((i, h, c, a, f, o, g, tc))
            h, c = o * tc, c2
            out[:, i] = h
        return out, tape

    def lstm_back(self, x: np.ndarray, tape: list, dout: np.ndarray, d: str, grad: dict) -> np.ndarray:
        W, dx = self.p[f"W{d}"], np.zeros_like(x)
        dh = dc = np.zeros((len(x), HIDDEN), np.float32)
        for i, h, c, a, f, o, g, tc in reversed(tape):
            dh = dh + dout[:, i]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * a * (1 - a), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - g * g)], axis=1)
            grad[f"W{d}"][:EMBED] += x[:, i].T @ dz
            grad[f"W{d}"][EMBED:] += h.T @ dz
            grad[f"b{d}"] += dz.sum(0)
            back = dz @ W.T
            dx[:, i] += back[:, :EMBED]
            dh, dc = back[:, EMBED:], dc * f
        return dx

    def scores(self, x: np.ndarray):
        e = self.p["E"][x]
        (hf, tf), (hb, tb) = self.lstm(e, "f"), self.lstm(e, "b")
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["U"] + self.p["c"], (e, h, tf, tb)

    @staticmethod
    def barred(s: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores with what the places' bits forbid; a mask of booleans forbids nothing within the text."""
        bits = mask * (INSIDE | MAIL | DIGITS) if mask.dtype == bool else mask
        return np.where(COST[bits] < 0, NEVER, np.where((bits > 0)[:, :, None], s, 0)).astype(np.float32)

    def loss(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags y and its gradient, by the forward-backward algorithm."""
        s, (e, h, tf, tb) = self.scores(x)
        n, t, k = s.shape
        A = self.p["A"] + self.allowed
        lse = lambda v, ax: np.log(np.exp(v - v.max(ax, keepdims=True)).sum(ax)) + v.max(ax)
        s = self.barred(s, mask)
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for i in range(1, t):
            alpha[:, i] = lse(alpha[:, i - 1][:, :, None] + A, 1) + s[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = lse(A[None] + (s[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = s[rows, np.arange(t), y].sum(1) + A[y[:, :-1], y[:, 1:]].sum(1)
        grad = {name: np.zeros_like(v) for name, v in self.p.items()}
        ds = np.exp(alpha + beta - z[:, None, None])
        ds[rows, np.arange(t), y] -= 1
        for i in range(1, t):
            grad["A"] += np.exp(alpha[:, i - 1][:, :, None] + A + (s[:, i] + beta[:, i])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(grad["A"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        ds = (ds * (mask[:, :, None] > 0) / n).astype(np.float32)
        grad["A"] /= n
        grad["U"], grad["c"] = h.reshape(n * t, -1).T @ ds.reshape(n * t, k), ds.sum((0, 1))
        dh = ds @ self.p["U"].T
        de = self.lstm_back(e, tf, dh[:, :, :HIDDEN], "f", grad) + self.lstm_back(e, tb, dh[:, :, HIDDEN:], "b", grad)
        np.add.at(grad["E"], x, de)
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS) -> list[float]:
        """Adam over shuffled batches, with a falling rate. Returns the mean loss of each epoch."""
        r, told, step = np.random.default_rng(1), [], 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        steps = epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            total, order = 0.0, r.permutation(len(x))
            for at in range(0, len(order), BATCH):
                b = order[at : at + BATCH]
                loss, grad = self.loss(x[b], y[b], mask[b])
                total, step = total + loss * len(b), step + 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - RATE * (1.02 - step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            told.append(total / max(1, len(x)))
        return told

    def decode(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows' scores and the transitions, with what is forbidden."""
        return self.barred(self.scores(x)[0], mask), self.p["A"] + self.allowed


def viterbi(s: np.ndarray, length: np.ndarray, A: np.ndarray) -> np.ndarray:
    """The best tags of stretches (padded to one length) that O precedes and follows."""
    n, t, k = s.shape
    best, back = s[:, 0] + A[0], np.zeros((n, t, k), np.int8)
    last = best + A[:, 0]
    for i in range(1, t):
        v = best[:, :, None] + A
        back[:, i] = v.argmax(1)
        best = v.max(1) + s[:, i]
        last = np.where((length == i + 1)[:, None], best + A[:, 0], last)
    tags, rows, tag = np.zeros((n, t), np.int64), np.arange(n), last.argmax(1)
    for i in range(t - 1, -1, -1):
        here = i < length
        tags[:, i] = np.where(here, tag, 0)
        tag = np.where(here, back[rows, i, tag] if i else tag, tag)
    return tags


def cut(text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The text's windows: starts, codes, and bits of the places (0 beyond the text)."""
    bits = places(text)
    if not (at := windows_at(text, bits)):
        return at, np.empty((0, WINDOW), np.int64), np.empty((0, WINDOW), np.uint8)
    c = np.concatenate([codes(text), np.full(WINDOW, 129, np.int64)])
    where = np.array(at, np.int64)[:, None] + np.arange(WINDOW)
    return at, c[where], np.concatenate([bits, np.zeros(WINDOW, np.uint8)])[where]


def tags_of(text: str, spans: list[tuple[str, int, int]] | None = None) -> np.ndarray:
    """Tags of the text and a window's length beyond; of overlapping spans the one listed first counts."""
    y = np.zeros(len(text) + WINDOW, np.int64)
    for kind, a, b in reversed(base_spans(text) if spans is None else spans):
        k = 1 + 2 * KINDS.index(kind)
        y[a], y[a + 1 : b] = k, k + 1
    # what is left of a span after the one that covers its first character begins anew
    inner = (y > 0) & (y % 2 == 0)
    before = np.concatenate([[0], y[:-1]])
    y[inner & (before != y) & (before != y - 1)] -= 1
    return y


def spans_of(texts: list[str], starts: list[list[int]], scores: np.ndarray, A: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """The spans of texts, of the scores of their windows, one text's after the other's. Spaces at a span's ends are cut off, and a span
    needs a digit or an @."""
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])  # a place between any two texts
    at = np.concatenate([first[i] + np.array(a, np.int64) for i, a in enumerate(starts)])
    odd = np.concatenate([np.array(a, np.int64) // STEP % (WINDOW // STEP) for a in starts])
    # places where only O may be are as good as those beyond the text
    where = at[:, None] + np.arange(WINDOW)
    free = (scores[:, :, 1:] > NEVER / 2).any(2)
    spots = np.unique(where[free])
    total, times = np.zeros((len(spots), TAGS)), np.zeros(len(spots))
    for k in range(WINDOW // STEP):  # windows of one k don't overlap
        mine = (odd == k)[:, None] & free
        to = np.searchsorted(spots, where[mine])
        total[to] += scores[mine]
        times[to] += 1
    total /= times[:, None]
    cuts = np.flatnonzero(np.diff(spots, prepend=-2) > 1)
    length = np.diff(np.append(cuts, len(spots)))
    out: list[list] = [[] for _ in texts]
    order = np.argsort(length, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * length[order[j]] * TAGS <= CELLS:
            j += 1
        some = order[i:j]
        i = j
        t = int(length[some].max())
        pick = np.minimum(cuts[some][:, None] + np.arange(t), len(spots) - 1)
        tags = viterbi(total[pick], length[some], A)
        for r in np.flatnonzero(tags.any(1)):
            begin = int(spots[cuts[some[r]]])
            text = int(np.searchsorted(first, begin, side="right")) - 1
            out[text] += read(texts[text], begin - int(first[text]), tags[r].tolist())
    return [sorted(x, key=lambda s: s[1]) for x in out]


def read(text: str, begin: int, tags: list[int]) -> Iterator[tuple[str, int, int]]:
    i, n = 0, len(tags)
    while i < n:
        if not tags[i]:
            i += 1
            continue
        kind, j = (tags[i] - 1) // 2, i + 1
        while j < n and tags[j] == 2 + 2 * kind:
            j += 1
        a, b = begin + i, begin + j
        i = j
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if TRIGGER.search(text, a, b):
            yield KINDS[kind], a, b


def model_spans(text: str, at: list[int], scores: np.ndarray, A: np.ndarray) -> list[tuple[str, int, int]]:
    return spans_of([text], [at], scores, A)[0] if at else []


def spoil(kind: str, said: str, r: random.Random) -> str:
    """A span as it is met in texts but in none of the patterns."""
    if kind == "email":
        name, host = said.rsplit("@", 1)
        return f"{name}@{r.choice([host.split('.')[0], host.replace('.', '..', 1), host.replace('.', ',', 1), host.replace('.', '_.', 1)])}"
    if kind == "ip":
        return said.replace(".", r.choice([". ", " . ", " "]))
    if kind == "card":
        d = re.sub("[^0-9]", "", said)
        d = d[: r.choice([15, len(d), len(d)])]
        return r.choice(["  ", ".", " - ", " ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    d = said[1:]
    return r.choice([f"00{d}", f"00 {d}", d, f"0{d}", f"+{d.replace(' ', '  ')}", f"({d[:3]}) {d[3:]}"])


def spoilt(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its patterns' spans spoilt, and where they are now. The same text is always spoilt alike."""
    r, out, spans, end, n = random.Random(text), [], [], 0, 0
    for kind, a, b in sorted(base_spans(text), key=lambda s: s[1:]):
        if a < end:
            continue
        new = spoil(kind, text[a:b], r)
        n += a - end
        out += [text[end:a], new]
        spans.append((kind, n, n + len(new)))
        n, end = n + len(new), b
    return "".join([*out, text[end:]]), spans


PLAIN, MARKED, SPOILT = 0, 1, 2


def all_windows(documents: DataFrame, each: int) -> DataFrame:
    """(class, key, window) of up to `each` distinct windows of each class, without a span, with one, and with a spoilt one: of all documents'
    windows, those with the smallest hash of their text and tags. A task keeps no more than twice as many of its own at a time, and gives
    so many of each. A window is its codes, tags and places' bits."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[int, bytes]] = [{}, {}, {}]
        limit = [1 << 62] * 3

        def shrink(m: int) -> None:
            kept[m] = dict(sorted(kept[m].items())[:each])
            limit[m] = max(kept[m]) if len(kept[m]) == each else 1 << 62

        def take(text: str, y: np.ndarray, spoilt_: bool) -> None:
            at, c, bits = cut(text)
            for i, a in enumerate(at):
                ys = y[a : a + WINDOW].copy()
                # a span that begins before the window begins at the window's start
                if ys[0] and ys[0] % 2 == 0:
                    ys[0] -= 1
                m = SPOILT if spoilt_ else MARKED if ys.any() else PLAIN
                if spoilt_ and not ys.any():
                    continue
                tags = ys.astype(np.uint8).tobytes()
                key = int.from_bytes(hashlib.blake2b(text[a : a + WINDOW].encode(errors="replace") + tags, digest_size=7).digest())
                if key >= limit[m] or key in kept[m]:
                    continue
                kept[m][key] = c[i].astype(np.uint8).tobytes() + tags + bits[i].tobytes()
                if len(kept[m]) >= 2 * each:
                    shrink(m)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not (text and TRIGGER.search(text)):
                    continue
                spans = base_spans(text)
                take(text, tags_of(text, spans), False)
                if spans:
                    new, at = spoilt(text)
                    take(new, tags_of(new, at), True)
        for m in range(3):
            shrink(m)
        rows = [(m, k, w) for m in range(3) for k, w in kept[m].items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["class", "key", "window"])

    found = documents.select("text").where("text rlike '[0-9@]'").mapInArrow(labelled, "class int, key long, window binary")
    # equal windows of several tasks are one; all classes are read from one result
    found = materialize(found.groupBy("class", "key").agg(F.first("window").alias("window")), "windows")
    part = lambda m: found.where(F.col("class") == m).orderBy("key").limit(each)
    return part(PLAIN).unionByName(part(MARKED)).unionByName(part(SPOILT))


def training_windows(documents: DataFrame, each: int = TRAIN_EACH) -> DataFrame:
    """(key, marked, window) of the windows without and with a pattern's span."""
    return all_windows(documents, each).where(F.col("class") < SPOILT).select("key", (F.col("class") == MARKED).alias("marked"), "window")


def fit_tagger(documents: DataFrame, each: int = TRAIN_EACH) -> Tagger | None:
    """Trains on the windows of all classes (bounded: only three times `each` come to the driver). None if no document has a
    pattern's span."""
    got = sorted(all_windows(documents, each).collect(), key=lambda r: (r.key, r["class"]))
    if not any(r["class"] == MARKED for r in got):
        return None
    data = np.stack([np.frombuffer(r.window, np.uint8).reshape(3, WINDOW) for r in got])
    tagger = Tagger()
    tagger.fit(data[:, 0].astype(np.int64), data[:, 1].astype(np.int64), data[:, 2])
    return tagger


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """Of each text: the patterns' spans, and the model's spans that overlap none of them."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    if tagger:
        cuts = [cut(t) for t in texts]
        x = np.concatenate([c[1] for c in cuts]) if cuts else np.empty((0, WINDOW), np.int64)
        if len(x):
            mask = np.concatenate([c[2] for c in cuts])
            parts = [tagger.decode(x[i : i + 2048], mask[i : i + 2048]) for i in range(0, len(x), 2048)]
            for i, found in enumerate(spans_of(texts, [c[0] for c in cuts], np.concatenate([p[0] for p in parts]), parts[0][1])):
                ends = sorted((a, b) for _, a, b in base[i])
                more[i] = apart(found, ends)
    return list(zip(base, more, strict=True))


def apart(spans: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The spans (by start, none overlapping another) that overlap none of those taken (by start)."""
    reach = list(accumulate((b for _, b in taken), max))
    first = [a for a, _ in taken]
    return [s for s in spans if not (k := bisect_left(first, s[2])) or reach[k - 1] <= s[1]]


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def personal_data(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Of each row of documents (doc_id, text): n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, all
    spans, and the masked text.

    A null or empty text has no spans (and a masked text of ''). Rows that repeat a doc_id are documents of their own; a
    null doc_id stays null. Other columns are left out. Without any pattern's span in the table there is nothing to learn
    from, and the patterns' spans (none) are all. tagger: a fitted one, else one is fitted on these documents.
    """
    spark = prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tagger = tagger or fit_tagger(rows)
    model = spark.sparkContext.broadcast(tagger)  # some 5,000 weights

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [([], [])] * len(texts)
            hot = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
            for i, f in zip(hot, all_spans([texts[i] for i in hot], model.value), strict=True):
                found[i] = f
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                + [pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found])]
                + [pa.array([told(base + more) for base, more in found], pa.string())]
                + [pa.array([masked(t, base + more) for t, (base, more) in zip(texts, found, strict=True)], pa.string())],
                names,
            )

    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string")


def mask_documents(documents: DataFrame) -> DataFrame:
    """documents with each span of personal data in text masked, and n_chars, if there, of the new text. All columns and
    rows stay; a null text stays null."""
    spark = prepare(documents.sparkSession)
    model = spark.sparkContext.broadcast(fit_tagger(documents.select(F.col("text").cast("string").alias("text"))))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hot = [i for i, t in enumerate(texts) if t and TRIGGER.search(t)]
            for i, (base, more) in zip(hot, all_spans([texts[i] for i in hot], model.value), strict=True):
                texts[i] = masked(texts[i], base + more)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    out = documents.mapInArrow(mask, documents.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
