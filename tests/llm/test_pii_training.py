import numpy as np

from tracegauge.llm.pii import fit_tagger, training_windows


def shares(df, each):
    got = training_windows(df, each).collect()
    return sum(r.marked for r in got), sum(not r.marked for r in got), len({r.key for r in got}), got


def test_both_classes_at_every_size(spark):
    """Marked windows alone would fill the training set, and copies of one would crowd out the others."""
    marked = [(i, f"to user{i}@example.org") for i in range(3000)] + [(9000 + i, "again a@b.org") for i in range(500)]
    plain = [(5000 + i, f"paid {i} on that day") for i in range(700)]
    few = spark.createDataFrame(marked[:20] + plain[:30], "doc_id long, text string")
    m, u, n, _ = shares(few, 1000)
    assert (m, u) == (20, 30) and n == 50
    m, u, n, got = shares(spark.createDataFrame(marked + plain, "doc_id long, text string").repartition(5), 600)
    assert (m, u, n) == (600, 600, 1200)
    assert got == shares(spark.createDataFrame(plain + marked, "doc_id long, text string").repartition(2), 600)[3]
    for r in got:
        assert np.frombuffer(r.window, np.uint8).reshape(3, 64)[1].any() == r.marked


def test_rare_spans_are_found(spark):
    rows = [(i, f"item {i} of {i * 7} sold") for i in range(6000)] + [(7000, "the only one: jo@example.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert shares(df, 200)[:2] == (1, 200)
    assert fit_tagger(df.where("doc_id < 7000").limit(50)) is None
