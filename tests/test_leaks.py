"""Leaks of benchmark items as instructions, against brute force."""

import random

import __spark_entry__ as entry
from tracegauge.functions.text import words_in
from tracegauge.plans.queries import leaks


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            w, b = words_in(text or ""), words_in(item or "")
            known = {tuple(b[k : k + 8]) for k in range(len(b) - 7)}
            found, run, best = set(), 0, 0
            for k in range(len(w) - 7):
                g = tuple(w[k : k + 8])
                run = run + 1 if g in known else 0
                found |= {g} & known
                best = max(best, run)
            if found:
                out.add((d, i, len(found), best + 7))
    return out


def test_all_items_against_all_documents(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)] + [(40, "only seven words are in this one"), (41, None)]
    words = lambda i, a, b: " ".join(f"W{i}x{k}," for k in range(a, b))
    docs = [(n, f"some text {words(i, a := rng.randrange(15), a + rng.randrange(7, 15))} more {words((i + 1) % 40, 2, 12)} {words(i, 0, 9)} end") for n, i in enumerate(rng.sample(range(40), 30))]
    docs += [(100, None), (101, ""), (102, items[35][1] * 2), (None, items[12][1]), (103, items[40][1])]
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(3)
    got = leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(i >= 10 for _, i, *_ in want) and any(d is not None and i != d % 10 for d, i, *_ in want)


def test_query_has_pairs_of_every_item(spark, sf_dir):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = entry.queries()["prompt_leak_pairs"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == brute(docs, items) and any(r.item_id >= 10 for r in got)
