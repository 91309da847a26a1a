"""Each stage on what the one before has kept, against brute force; then run() as a whole."""

import random
import re

import corpus_pipeline
from tests_support import brute_components, brute_leaks


def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    yield None, docs
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir).cache()
        yield name, docs


def test_stages_and_run(spark, sf_dir):
    seen = dict(stages(spark, sf_dir))
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in seen.items() if name != "packing"}
    columns = seen[None].columns
    assert all(seen[n].columns == columns for n in rows)
    assert rows["language"].keys() == {i for i, r in rows[None].items() if re.search(r"[^\W\d_]", r.text or "")}
    assert sum(r.lang == rows[None][i].lang for i, r in rows["language"].items()) >= 0.97 * len(rows["language"])
    groups = brute_components([(i, r.text) for i, r in rows["language"].items()], 2, 80)
    assert rows["near_duplicates"].keys() == {i for i, top in groups.items() if i == top}
    leaks = brute_leaks([(i, r.text) for i, r in rows["near_duplicates"].items()], [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert rows["decontamination"].keys() == rows["near_duplicates"].keys() - leaks
    assert rows["personal_data"].keys() == rows["decontamination"].keys()
    for i, r in rows["personal_data"].items():
        before = rows["decontamination"][i].text
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) and r.n_chars == len(r.text)
        assert r.text == before or re.search("[0-9@]", before)
    packed = seen["packing"].collect()
    assert {r.doc_id for r in packed} == rows["personal_data"].keys()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed)


def test_near_copies_are_caught(spark, sf_dir):
    """Of planted copies with up to 4 % of their words changed, put in or left out, no fewer than nine in ten go; what is left is every
    original, and all documents that have no copy."""
    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(3000)]
    rows, copies, alone = [], set(), set()
    for k in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        rows.append((10 * k, " ".join(base)))
        alone.add(10 * k)
        for c in range(1, rng.choice((1, 2, 4))):
            w = list(base)
            for _ in range(max(1, int(len(w) * rng.uniform(0, 0.04)))):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind != 1)] = [rng.choice(vocabulary)] if kind < 2 else []
            rows.append((10 * k + c, " ".join(w)))
            copies.add(10 * k + c)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()}
    assert alone <= left and len(copies & left) <= 0.1 * len(copies)


ODD = [(1, "plain words of a first text " * 9, "en"), (2, None, "en"), (None, "another text without an id " * 5, None), (3, "", "en"), (4, "²½ 123", None), (5, "mail to jo@example.org or +1 415 555 0101", "en"), (5, "mail to jo@example.org or +1 415 555 0101", "en"), (6, "word " * 60_000, "en"), (7, "x", None)]


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, and columns that bear the names of the operators' own."""
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 2, 3, 4) for i, t, lang in ODD], "doc_id long, text string, lang string, source string, n_chars long, __row int, __n int, key int, row int").repartition(3)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, df, sf_dir)
        assert out.columns == df.columns and f(spark, df.limit(0), sf_dir).count() == 0, name
        got = [r.doc_id for r in out.collect()]
        assert len(got) == {"language": len(got), "near_duplicates": len(ODD) - 1, "decontamination": len(ODD), "personal_data": len(ODD)}[name], name
        if name == "language":
            assert not {2, 3, 4} & set(got) and {1, 5} <= set(got)
        if name == "personal_data":
            texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
            assert texts[2] == (None, None) and texts[5][0] == "mail to <EMAIL> or <PHONE>" and texts[5][1] == len(texts[5][0])
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {i for i, _, _ in ODD}
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), sf_dir).count() == 0
