"""Language-model scoring by Brown's class-based bigrams.

Exchange clustering puts the CLUSTERED most frequent words into CLASSES classes, each word moved to where the class bigrams'
likelihood gains most. All further words of the head are then put, by the same gain of their own neighbours' counts, into these
classes by a Spark pass; with `least`, so are all training words beyond the head that occur that often, by another pass whose
outcome stays a table and grows with the vocabulary. All other words, which stand for unseen ones, are in classes by their length
in bytes, and the end of a text is a class of its own. P(text) is the product of P(class | class before), smoothed with the
classes' shares, and P(word | class), with room for words that training hasn't seen. Both classes of a transition are the words' own,
however rare the words are.

Word counts are a Spark aggregation and stay a table. At most the HEAD most frequent words are broadcast; with them texts
become, once, a table of numbers (three bytes a token) and of their other words, each once a text. All passes but the counting of words
read that table. The other words are joined with the table of words, and their classes are put into the text's sequence of classes.
Transitions are counted, and texts scored, on these sequences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crowded, dealt_join, materialize, prepare, remainder, words

CLUSTERED, CLASSES, SWEEPS = 1000, 32, 6
HEAD = 100_000
#: Parts of a histogram step of counts that doesn't fit as a whole.
PARTS = 1024
#: Upper bounds in bytes of the length classes, the last of which is open.
LENGTHS = (3, 5, 7, 9, 12, 16, 22)
#: Weight of the classes' shares in transitions; count of an unseen word.
ALPHA, DELTA = 20.0, 0.5
FLUSH = 200_000
#: Codes that are added up at a time; words whose counts of neighbours are moved together.
RUN, WORDS = 2_000_000, 128
TAILS = len(LENGTHS) + 1


def length_class(n: Column) -> Column:
    return sum(((n > x).cast("int") for x in LENGTHS), F.lit(0))


def counted(documents: DataFrame) -> DataFrame:
    """(word, c) of all words, lower-cased, of documents (text as binary). Each task adds up its own first, in bounded runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(words(text))
                if len(seen) > FLUSH:
                    yield table_of(seen)
                    seen = Counter()
        if seen:
            yield table_of(seen)

    def table_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

    return documents.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words (word, c), most frequent first, no more than `most`. Counts are looked up in a histogram of fixed size
    (sixteen steps for each doubling) first; of the first step that doesn't fit as a whole, words with a small hash are taken
    (by a second histogram of PARTS parts). So the driver gets these words only, whatever the number of partitions."""
    step, part = F.floor(F.log2("c") * 16).cast("int"), F.pmod(F.xxhash64("word"), F.lit(PARTS)).cast("int")

    def fitting(rows: DataFrame, by: Column, falling: bool, room: int) -> tuple[int | None, int | None]:
        """The last value of `by` up to which no more than room rows are, and the next one."""
        n, last = 0, None
        for r in rows.groupBy(by.alias("by")).agg(F.count("*").alias("n")).orderBy(F.desc("by") if falling else F.asc("by")).collect():
            n += r.n
            if n > room:
                return last, r.by
            last = r.by
        return last, None

    least, over = fitting(counts, step, True, most)
    kept = F.lit(False) if least is None else step >= least
    if over is not None:
        tied = counts.where(step == over)
        room = most - (0 if least is None else counts.where(kept).count())
        last, _ = fitting(tied, part, False, room)
        if last is not None:
            kept = kept | (step == over) & (part <= last)
    return sorted(((bytes(r.word), r.c) for r in counts.where(kept).collect()), key=lambda x: (-x[1], x[0]))


#: Stands for an end among words; no word has a space.
END = b" "


def flat_words(batch: pa.RecordBatch) -> list[bytes]:
    """The words of all texts of a batch, an end before the first and after each."""
    out = [END]
    for text in batch.column("text").to_pylist():
        out += words(text)
        out.append(END)
    return out


def looked_up(known: dict[bytes, int], ws: list[bytes], symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What known gives each word (-1: nothing), and its symbol: symbol[what is given], or its length class, from n on."""
    i = np.fromiter(map(known.get, ws, repeat(-1)), np.int64, len(ws))
    rest = np.flatnonzero(i < 0)
    s = symbol[i]
    s[rest] = n + np.searchsorted(LENGTHS, np.fromiter(map(len, map(ws.__getitem__, rest.tolist())), np.int64, len(rest)), side="left")
    return i, s


class Symbols:
    """Known words have symbols below n; then come the length classes; then the end."""

    def __init__(self, known: dict[bytes, int], n: int):
        self.known, self.n, self.end = known, n, n + TAILS
        self.with_end = known | {END: self.end}

    def of(self, ws: list[bytes]) -> np.ndarray:
        return looked_up(self.with_end, ws, np.arange(self.end + 1), self.n)[1]

    def by_number(self, head: list[bytes]) -> np.ndarray:
        """The symbol of each number that `numbered` gives."""
        return np.concatenate([self.of([*head]), np.arange(self.n, self.end + 1)]).astype(np.int64)


def numbered(documents: DataFrame, head: list[bytes]) -> DataFrame:
    """documents with low and high instead of text, the numbers of its tokens: of head's words their places, then length classes, then
    the end, which each text has last. Two bytes of each in low, the third in high, which is mostly 0. words: the text's words beyond the head, each once; at:
    which of them stands at each place of such a word."""
    n = len(head)
    sent = documents.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(head)} | {END: n + TAILS})
    others = [c for c in documents.columns if c != "text"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.arange(n + TAILS + 1)
        for batch in batches:
            ws = flat_words(batch)[1:]
            i, x = looked_up(sent.value, ws, symbol, n)
            rest, stop = np.flatnonzero(i < 0), np.flatnonzero(i == n + TAILS) + 1
            further: list[dict[bytes, int]] = [{} for _ in stop]
            text = np.searchsorted(stop, rest, side="right")
            which = [(of := further[t]).setdefault(ws[at], len(of)) for t, at in zip(text.tolist(), rest.tolist(), strict=True)]
            low, high = x.astype("<u2").tobytes(), (x >> 16).astype(np.uint8).tobytes()
            ends = [0, *stop.tolist()]
            words_ = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, further)]), pa.int32()), pa.array([w for f in further for w in f], pa.binary()))
            at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(stop)))]), pa.int32()), pa.array(which, pa.int32()))
            lows, highs = ([v[k * a : k * b] for a, b in zip(ends, ends[1:], strict=False)] for k, v in ((2, low), (1, high)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(lows, pa.binary()), pa.array(highs, pa.binary()), words_, at], [*others, "low", "high", "words", "at"])

    kinds = [f"{c} {documents.schema[c].dataType.simpleString()}" for c in others]
    return documents.select(*others, "text").mapInArrow(number, ", ".join([*kinds, "low binary, high binary, words array<binary>, at array<int>"]))


def in_numbers(documents: DataFrame, head: list[bytes]) -> DataFrame:
    """documents as `numbered` gives them, if they aren't yet."""
    return documents if "low" in documents.columns else numbered(documents, head)


def numbers(batch: pa.RecordBatch) -> np.ndarray:
    """The numbers of all tokens of a batch."""
    low, high = (b"".join(batch.column(c).to_pylist()) for c in ("low", "high"))
    return np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, np.uint8).astype(np.int64) << 16


def further_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each place of a word beyond the head its text, and which of all the words of the batch it has."""
    size = lambda c: pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64)
    many = size("words")
    text = np.repeat(np.arange(len(batch)), size("at"))
    return text, (np.cumsum(many) - many)[text] + batch.column("at").flatten().to_numpy(zero_copy_only=False)


def pairs(documents: DataFrame, symbols: Symbols, head: list[bytes] | None = None) -> np.ndarray:
    """Counts of neighbouring symbols; a text begins after, and stops with, an end. The square of the symbols' number, at most. documents:
    texts, or what `numbered` makes of them with head."""
    head = [*symbols.known] if head is None else head
    size, of = symbols.end + 1, documents.sparkSession.sparkContext.broadcast(symbols.by_number(head))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(size * size, np.int64)
        for batch in batches:
            x = np.append(size - 1, of.value[numbers(batch)])
            g += np.bincount(x[:-1] * size + x[1:], minlength=len(g))
        code = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(g[code], pa.int64())], ["code", "n"])

    got = in_numbers(documents, head).select("low", "high").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[got["code"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out.reshape(size, size)


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, their lowest bytes first, then the others, which are alike: they take little room when compressed."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def further(documents: DataFrame, head: list[bytes], done: int, classes: Symbols, g: np.ndarray) -> dict[bytes, int]:
    """The classes of the head's words from `done` on: of those below classes.n the one that gains most by the word's neighbours,
    as g counts the classes' bigrams. A word's counts are no more than twice the number of classes; those of WORDS words are moved together."""
    size, n, classes_n = classes.end + 1, len(head), classes.n
    of = documents.sparkSession.sparkContext.broadcast(classes.by_number(head))
    block = WORDS * 2 * size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = np.zeros((n - done) * 2 * size, np.int32), []

        def add():
            code, many = np.unique(np.concatenate(held), return_counts=True)
            seen[code] += many.astype(np.int32)
            held.clear()

        for batch in batches:
            i = np.append(n + TAILS, numbers(batch))
            x = of.value[i]
            at = np.flatnonzero((i >= done) & (i < n))
            code = (i[at] - done) * 2 * size
            held += [code + x[at - 1], code + size + x[at + 1]]
            if sum(map(len, held)) >= RUN:
                add()
        if held:
            add()
        code = np.flatnonzero(seen)
        cuts = [0, *(np.flatnonzero(np.diff(code // block)) + 1).tolist(), len(code)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                k = code[a] // block
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([planes(code[a:b] - k * block)], pa.binary()), pa.array([planes(seen[code[a:b]])], pa.binary())], ["block", "code", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c = None, np.zeros(block)

        def done_with() -> pa.RecordBatch:
            at = np.flatnonzero(c)
            word, many = np.unique(at // (2 * size), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(done + now * WORDS + word, pa.int32()), pa.array(gains(g, classes_n, at % (2 * size), c[at], many).argmax(1), pa.int32())], ["word", "class"])

        for batch in batches:
            for k, code, many in zip(*(batch.column(x).to_pylist() for x in ("block", "code", "n")), strict=True):
                if k != now:
                    if now is not None:
                        yield done_with()
                    now = k
                    c[:] = 0
                c[from_planes(code)] += from_planes(many)
        if now is not None:
            yield done_with()

    each = in_numbers(documents, head).select("low", "high").mapInArrow(count, "block int, code binary, n binary")
    got = each.repartition("block").sortWithinPartitions("block").mapInArrow(best, "word int, class int").toPandas()
    return {head[w]: int(c) for w, c in zip(got["word"], got["class"], strict=True)}


def gains(g: np.ndarray, classes: int, key: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(word, class): what the class bigrams' log-likelihood gains if the word joins the class. Words have n entries each, of which key is
    the class before them, or len(g) and more for the one behind them, and c the count."""
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    size, first = len(g), np.cumsum([0, *n[:-1]])
    both = np.concatenate([g[:, :classes], g.T[:, :classes]])  # rows: the neighbour's class, and where it stands
    gain = np.add.reduceat(f(both[key] + c[:, None]) - f(both[key]), first)
    for side, total in ((key < size, g.sum(0)[:classes]), (key >= size, g.sum(1)[:classes])):
        own = np.add.reduceat(np.where(side, c, 0), first)[:, None]
        gain -= f(total + own) - f(total)
    return gain


def exchange(b: np.ndarray, n: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol: the first n are moved to the class where the class bigrams' likelihood is greatest, one by
    one, until no move helps or `sweeps` passes are over; each of the others is a class of its own."""
    classes = max(1, min(classes, n))
    cls = np.concatenate([np.arange(n) % classes, classes + np.arange(len(b) - n)])
    k = classes + len(b) - n
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    one = np.zeros((len(b), k))
    one[np.arange(len(b)), cls] = 1
    g = one.T @ b @ one
    to, of = b.sum(1), b.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, own = cls[w], b[w, w]
            right = np.bincount(cls, b[w], k)
            left = np.bincount(cls, b[:, w], k)
            right[a] -= own
            left[a] -= own
            g[a] -= right
            g[:, a] -= left
            g[a, a] -= own
            rows, cols = g.sum(1), g.sum(0)
            f0, diag = f(g), np.diagonal(g)
            row = f(g + right) - f0
            col = f(g + left[:, None]) - f0
            d0 = np.diagonal(f0)
            gain = row.sum(1) - np.diagonal(row) + col.sum(0) - np.diagonal(col) + f(diag + right + left + own) - d0
            gain -= f(rows + to[w]) - f(rows) + f(cols + of[w]) - f(cols)
            best = int(gain[:classes].argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = a
            moved += best != a
            cls[w] = best
            g[best] += right
            g[:, best] += left
            g[best, best] += own
        if not moved:
            break
    return cls


class Model:
    """The head's words with, for each, its class, its unigram and emission log10; the classes' transitions (log10)."""

    def __init__(self, g: np.ndarray, classes: Symbols, head: list[tuple[bytes, int]], total: int, distinct: int, tails: dict[int, tuple[int, int]], more: np.ndarray | float = 0.0):
        """g: bigrams of classes, of which the head's words have those below classes.n; tails: of each length class the number of tokens and
        of words, the head's left out; more: by class, the tokens of words beyond the head."""
        k = len(g)
        self.g, self.n = g, classes.n
        self.step = transitions(g)
        self.end_class = classes.end
        self.words = {w: i for i, (w, _) in enumerate(head)}
        self.head = [w for w, _ in head]
        c = np.array([c for _, c in head], float)
        self.cls = classes.of([w for w, _ in head]) if head else np.empty(0, np.int64)
        self.total, self.distinct = total, distinct
        self.unigram = self.plain(c)
        self.of_class = np.bincount(self.cls, c, k) + more
        self.emit = np.log10(c) - np.log10(self.of_class[self.cls]) if head else c
        # a word of count c beyond the head has P(word | class) = (c + plus[class]) / room[class]
        self.plus = np.where(np.arange(k) < self.n, 0.0, DELTA)
        self.room = self.of_class.copy()
        self.room[self.n : self.end_class] = [t[0] + DELTA * (t[1] + 1) for t in (tails.get(t, (0, 0)) for t in range(TAILS))]
        self.room = np.maximum(self.room, DELTA)

    def plain(self, c):
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def symbols(self) -> Symbols:
        return Symbols({w: int(self.cls[i]) for w, i in self.words.items()}, self.n)


def transitions(g: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) by counts g, smoothed with the classes' shares."""
    share = (g.sum(0) + 1) / (g.sum() + len(g))
    return np.log10((g + ALPHA * share) / (g.sum(1, keepdims=True) + ALPHA))


def fit(train: DataFrame, counts: DataFrame, head: list[tuple[bytes, int]], total: int, distinct: int) -> Model:
    """The model of training texts (or what `numbered` makes of them with head), whose words' counts (word, c) are known; head: the most
    frequent of them."""
    listed = [w for w, _ in head]
    train = in_numbers(train, listed)
    some = listed[:CLUSTERED]
    symbols = Symbols({w: i for i, w in enumerate(some)}, len(some))
    b = pairs(train, symbols, listed)
    cls = exchange(b, symbols.n)
    k = int(cls.max()) + 1
    one = np.zeros((len(b), k))
    one[np.arange(len(b)), cls] = 1
    g = one.T @ b @ one
    classes = Symbols(dict(zip(some, cls[: symbols.n].tolist(), strict=True)), k - TAILS - 1)
    if len(listed) > len(some):
        classes = Symbols(classes.known | further(train, listed, len(some), classes, g), classes.n)
        g = pairs(train, classes, listed)
    of = lambda n: int(np.searchsorted(LENGTHS, n, side="left"))
    tails = {r.t: [r.n, r.v] for r in counts.groupBy(length_class(F.length("word")).alias("t")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    for w, c in head:
        tails[of(len(w))][0] -= c
        tails[of(len(w))][1] -= 1
    return Model(g, classes, head, total, distinct, {t: (n, v) for t, (n, v) in tails.items()})


def beyond(train: DataFrame, model: Model, least: int) -> DataFrame:
    """(word, c, class) of each training word that isn't in the head. Words that occur `least` times or more are in the class that gains
    most by their neighbours, for which those beyond the head count by their length; others are in that of their own length. A word has
    no more counts of neighbours than twice the number of classes."""
    size, n, g, end = len(model.g), model.n, model.g, len(model.head) + TAILS
    of = train.sparkSession.sparkContext.broadcast(model.symbols().by_number(model.head))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.append(end, numbers(batch))
            x = of.value[i]
            rest = np.flatnonzero((i >= end - TAILS) & (i < end))
            ws = batch.column("words").flatten().dictionary_encode()
            word = ws.indices.to_numpy(zero_copy_only=False).astype(np.int64)[further_words(batch)[1]]
            code, many = np.unique((word * size + x[rest - 1]) * size + x[rest + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([ws.dictionary.take(pa.array(code // (size * size), pa.int64())), pa.array(code // size % size, pa.int32()), pa.array(code % size, pa.int32()), pa.array(many, pa.int64())], ["word", "left", "right", "n"])

    def classes_of(ws: list[bytes], c: np.ndarray) -> pa.RecordBatch:
        total, cls = c[:, :size].sum(1), n + np.searchsorted(LENGTHS, [*map(len, ws)], side="left")
        often = total >= least
        if n and often.any():
            word, key = np.nonzero(c[often])
            cls[often] = gains(g, n, key, c[often][word, key].astype(float), np.bincount(word)).argmax(1)
        return pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array(total, pa.int64()), pa.array(cls, pa.int32())], ["word", "c", "class"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, c = [], np.zeros((0, 2 * size), np.int64)  # the word that the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            left, right, many = (batch.column(k).to_numpy().astype(np.int64) for k in ("left", "right", "n"))
            word = batch.column("word").dictionary_encode()
            at = word.indices.to_numpy().astype(np.int64) * 2 * size
            more = word.dictionary.to_pylist()
            new = np.zeros((len(more), 2 * size), np.int64)
            np.add.at(new.reshape(-1), np.concatenate([at + left, at + size + right]), np.concatenate([many, many]))
            if ws and ws[-1] == more[0]:
                new[0] += c[-1]
            else:
                more, new = ws + more, np.concatenate([c, new])
            if len(more) > 1:
                yield classes_of(more[:-1], new[:-1])
            ws, c = more[-1:], new[-1:]
        if ws:
            yield classes_of(ws, c)

    moved = in_numbers(train, model.head).select("low", "high", "words", "at").mapInArrow(around, "word binary, left int, right int, n long")
    return moved.repartition("word").sortWithinPartitions("word").mapInArrow(best, "word binary, c long, class int")


def refit(model: Model, rest: DataFrame, head: list[tuple[bytes, int]]) -> Model:
    """The model whose classes have the words beyond the head too, as `beyond` gives them; its transitions are still to be counted."""
    n = model.n
    more, tails = np.zeros(len(model.g)), {}
    for r in rest.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        if r["class"] < n:
            more[r["class"]] = r.c
        else:
            tails[r["class"] - n] = (r.c, r.v)
    return Model(model.g, model.symbols(), head, model.total, model.distinct, tails, more)


#: Of a text: its tokens, known ones, sums over tokens (unigram, emission), the tokens' classes, one byte each, the end's last.
TEXT = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, classes binary"


def classed(texts: DataFrame, model: Model, known_words: DataFrame, n_train: int) -> DataFrame:
    """TEXT of each of texts (row, doc_id, held_out, and what `numbered` gives). Words beyond the head are moved once for each text that has them
    and joined with known_words (word, c, class); without a class there, they keep that of their length. A word of very many texts is dealt over tasks."""
    spark = texts.sparkSession
    head, end = len(model.head), float(model.plain(float(n_train)))
    none = np.zeros(TAILS)
    by_number = (model.symbols().by_number(model.head), np.concatenate([model.unigram, none, [end]]), np.concatenate([model.emit, none, [0.0]]))
    sent = spark.sparkContext.broadcast((*by_number, model.plus, model.room, model.total, model.distinct))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, unigram, emit, plus, room, total, distinct = sent.value
        for batch in batches:
            i = numbers(batch)
            cls = of[i].astype(np.uint8)
            stop = np.flatnonzero(i == head + TAILS) + 1
            first = np.concatenate([[0], stop[:-1]]).astype(np.int64)
            tokens = stop - first
            over = lambda x: np.add.reduceat(x, first) if len(stop) else np.zeros(0, x.dtype)
            known, base, score = over(((i < head) | (i == head + TAILS) & (n_train > 0)).astype(np.int64)), over(unigram[i]), over(emit[i])
            found = batch.column("x")
            size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = found.flatten()
            field = lambda name, none: pc.fill_null(flat.field(name), none).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            place = np.repeat(start, size) + field("k", 0)
            c, own = np.zeros((2, len(place)), np.int64)
            c[place], own[place] = field("c", 0), field("class", -1)
            # places of words beyond the head, by text, and their words
            at = np.flatnonzero((i >= head) & (i < head + TAILS))
            text = np.repeat(np.arange(len(tokens)), tokens)[at]
            word = start[text] + batch.column("at").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            cls[at] = np.where(own[word] < 0, cls[at], own[word])
            add = lambda now, x: pa.array(now + np.bincount(text, x, len(tokens)).astype(now.dtype))
            plain = np.log10((c[word] + 0.5) / (total + 0.5 * (distinct + 1)))
            sums = [add(known, (c[word] > 0).astype(np.int64)), add(base, plain), add(score, np.log10((c[word] + plus[cls[at]]) / room[cls[at]]))]
            raw = cls.tobytes()
            each = [raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names[:3]), pa.array(tokens, pa.int64()), *sums, pa.array(each, pa.binary())], names)

    names = [x.split()[0] for x in TEXT.split(", ")]
    moved = texts.select("row", F.posexplode("words").alias("k", "word"))
    n_moved = texts.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    hot = crowded(moved.groupBy("word").agg(F.count("*").alias("n")), "word", n_moved)
    placed = dealt_join(moved, known_words.select("word", "c", "class"), "word", "row", hot, "left")
    placed = placed.groupBy("row").agg(F.collect_list(F.struct("k", "c", "class")).alias("x"))
    return texts.drop("words").join(placed, "row", "left").mapInArrow(put, TEXT)


def bigrams(texts: DataFrame, classes: int, end: int) -> np.ndarray:
    """Counts of neighbouring classes in texts (classes); each begins after an end. The square of the classes' number at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(classes * classes, np.int64)
        for batch in batches:
            before, cls = steps(batch, end)
            g += np.bincount(before * classes + cls, minlength=len(g))
        code = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(g[code], pa.int64())], ["code", "n"])

    out = np.zeros(classes * classes)
    for r in texts.select("classes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(classes, classes)


def steps(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens, and those before them. A text's last one is the end, which is before the next text's first."""
    cls = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8).astype(np.int64)
    return np.concatenate([[end], cls[:-1]]) if len(cls) else cls, cls


def language_model(documents: DataFrame, folds: int = 5, held: int = 1, least: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the model's probability) of each
    row of documents (doc_id, text), learned from those whose crc32 of doc_id isn't `held` modulo `folds`. With `least`, all
    training words that occur that often have a class by their neighbours, and rarer ones stand for the unseen at every size;
    without it, the HEAD most frequent words alone have one.

    A null or empty text has one token, its end. Rows that repeat a doc_id are documents of their own, each learned from.
    A null doc_id counts as an empty id. An empty table gives no rows; without a training row all counts are 0. Other
    columns are left out.
    """
    spark = prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id").cast("long"), folds) == held).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    train = rows.where("not held_out")
    counts = materialize(counted(train), "counts")
    n_train = train.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = sums[0] + n_train, sums[1] + (n_train > 0)
    head = frequent(counts.where(F.col("c") >= (least or 1)), HEAD)
    texts = materialize(numbered(rows.withColumn("row", F.monotonically_increasing_id()), [w for w, _ in head]), "read")
    train = texts.where("not held_out")
    model = fit(train, counts, head, total, distinct)
    known_words = counts.select("word", "c", F.lit(None).cast("int").alias("class"))
    if least:
        known_words = materialize(beyond(train, model, least), "classes")
        model = refit(model, known_words, head)
    texts = materialize(classed(texts, model, known_words, n_train), "classed")
    end = model.end_class
    step = transitions(bigrams(texts.where("not held_out"), len(model.g), end))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("n_tokens").to_numpy()
            score = batch.column("score").to_numpy()
            if len(tokens):
                score = score + np.add.reduceat(step[steps(batch, end)], np.cumsum(tokens) - tokens)
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(tokens), int(total))), batch.column("base_score"), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.mapInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
