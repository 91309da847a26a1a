import random
from functools import cache

from tracegauge.llm.decontam import clean, contaminated


def common(a, b):
    """Longest common subsequence by its definition."""

    @cache
    def of(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + of(i + 1, j + 1) if a[i] == b[j] else max(of(i + 1, j), of(i, j + 1))

    return of(0, 0)


def test_near_copies_of_whole_items(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    short, longer, far = ([word() for _ in range(n)] for n in (15, 18, 40))
    change = lambda ws, *at: [word() if k in at else w for k, w in enumerate(ws)]
    cases = {
        1: (change(short, 4, 9), True), 2: (change(longer, 4, 9, 14), True), 3: (short[:7] + [word()] + short[7:], True), 4: (longer[:9] + longer[10:], True),
        5: (longer[:9] + [word(), word()] + longer[9:], True), 6: (change(short, 2, 4, 7, 9, 11), False), 7: (short[:9], False), 8: (change(far, *range(9, 40, 2)), False),
        9: (short[:5] + [word() for _ in range(40)] + short[5:10], False), 10: (short[::-1], False),
    }
    rows = [(i, " ".join([word() for _ in range(rng.randrange(3, 30))] + x + [word() for _ in range(12)])) for i, (x, _) in cases.items()]
    rows += [(11, " ".join(change(short, 4, 9))), (12, " ".join(longer[1:9] + longer[10:]))]
    items = [(1, " ".join(short)), (2, " ".join(longer)), (3, " ".join(far))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    want = {i for i, (_, x) in cases.items() if x} | {11, 12}
    texts, sought = dict(rows), dict(items)
    assert {i for i, _ in got} == want == {i for i, t in rows for x in sought.values() if 4 * common(tuple(t.split()), tuple(x.split())) >= 3 * len(x.split())}
    for (i, k), r in got.items():
        ws, x = texts[i].split(), sought[k].split()
        part = ws[r.first_word : r.first_word + r.n_words]
        assert r.n_equal == common(tuple(part), tuple(x)) and part[0] in x and part[-1] in x
    assert {r.doc_id for r in clean(docs, bench).collect()} == texts.keys() - want
