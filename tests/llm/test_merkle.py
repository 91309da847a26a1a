"""The manifest against a plain recursion, on trees of one to four levels and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracegauge.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, pos string, node string, group string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    told = [None if x is None else str(x) for x in (*row[:4], text)]
    return h(*["-" if x is None else f"{len(x.encode())}:{x}" for x in told])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        first = i // 16 * 16
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])
        i //= 16


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, sorted."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources}
    trees = {s: levels([leaf(r, r[4]) for r in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            changed = r[4]
            if changed is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
                changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in changed)
            path = [*siblings(trees[s], i), *siblings(top, k)]
            at = leaf(r, changed)
            for left, right in path:
                at = h(left, at, right)
            root = top[-1][0]
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], root, h(*[x + y for x, y in path]), at, at == root))
    return sorted(out, key=str)


def got(spark, rows):
    made = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND)
    return sorted(map(tuple, merkle.checked(made).collect()), key=str)


def test_trees_of_several_levels(spark):
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "e": 256, "f": 257, "g": 4200, "é": 3, "Z": 33}
    rows = [(1000 * k + i, s, "en", i, f"Text {i} of {s}") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    assert got(spark, rows) == brute(rows)


def test_many_sources(spark):
    rows = [(i, f"s{i % 300}", None, None, f"T{i}") for i in range(700)]
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, None, "", 0, ""), (7, "", "en", 3, "ABC"), (7, "", "en", 3, "ABC"), (7, "", "en", 3, "B"), (35, "s", None, -1, "Ünïcode A\x00b"), (5, "s", "de", 1, "X" * 300_000)]
    assert got(spark, rows) == brute(rows)


def test_lone_row_and_empty_table(spark):
    rows = [(20, "a", "en", 1, "A")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_stored_levels_are_every_second_one(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    m = merkle.manifest(rows)
    assert [b.select(F.sum(F.size("nodes")), F.max(F.size("nodes"))).first()[:] for b in m.leaves.blocks] == [(5000, 256), (20, 20)]
    assert [t.count() for t in m.leaves.tops] == [0, 1]


@pytest.mark.parametrize("changed", ["other", None])
def test_a_changed_row_is_found(spark, changed):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(40)]
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    p = merkle.proofs(merkle.manifest(spark.createDataFrame(rows, kind)))
    later = spark.createDataFrame([(i, s, la, n, changed if i == 33 else t) for i, s, la, n, t in rows], kind).select("doc_id", merkle.leaf_of().alias("now"))
    wrong = p.join(later, "doc_id").where(merkle.folded(F.col("now"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [33]
