import random

from tests_support import brute_overlaps

from tracegauge.llm.decontam import clean, contaminated


def test_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if brute_overlaps(d.text, i.text)}
    assert got == want and want
    assert {r.doc_id for r in clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_substitutions_and_odd_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    item = [word() for _ in range(40)]
    fill = lambda n: [word() for _ in range(n)]

    def changed(every):
        return [w if (k + 2) % every else word() for k, w in enumerate(item)]

    rows = [(1, " ".join(fill(30) + item + fill(30))), (2, ", ".join(fill(5) + changed(6) + fill(9)).upper()), (3, " ".join(changed(9))), (4, " ".join(fill(200))), (5, " ".join(fill(20) + item[:9])), (6, " ".join(item[20:])), (7, None), (8, ""), (9, "one two"), (None, " ".join(item)), (9, "other words"), (9, "other words")]
    rows.append((10, " ".join(fill(20000) + item)))
    items = [(1, " ".join(item)), (2, " ".join(item).title()), (3, None), (4, "one two"), (5, ""), (None, "alone here " + " ".join(fill(12)))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(i, 1) for i in (1, 2, 3, 6, 10, None)] + [(9, 4)], key=repr)
    left = clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 7, 8, 9, 9]
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_in_longer_documents_and_clashing_names(spark):
    docs = [(1, "so alpha-beta it was"), (2, "alpha and beta"), (3, "GAMMA delta epsilon! zeta zeta"), (4, "gamma delta zeta"), (5, "one word here: omega"), (6, None), (7, "omega " * 500)]
    items = [(1, "alpha beta"), (2, "gamma delta epsilon zeta"), (3, "Omega"), (4, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, __row int, key int, value int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()) == [(1, 1), (3, 2), (5, 3), (7, 3)]
    left = clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 4, 6]
