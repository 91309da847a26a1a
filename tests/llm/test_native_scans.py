"""Line frequency and licence scan against brute force."""

import re
from collections import Counter, defaultdict

import pytest

from tracegauge.llm.licenses import NOTICES, PHRASES, scan
from tracegauge.llm import linefreq
from tracegauge.llm.linefreq import quality_rules, without_common_lines

TEXTS = [
    None, "", " \n\t\x0b ", "one", "a b c d e", "a b c d e a b c d e", "x x x x x x x x x x x x", "a|b #c *d $e %f &g <h>", "same line\nsame line\n\nsame line\nother\n \n ",
    "All Rights Reserved. all-rights/reserved ALL RIGHTS reserved", "CC BY CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.", "licensed under our apache license version 2 0", "Released under the MIT License.", "ccé by cc byé É cc İ by", "general public\nlicense" * 3, "w " * 3000 + "cc by", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15",
    "shared line of text here\n" + "own words " * 20, "12 34\n" + " ".join(f"t{i}" for i in range(30)) + "\r\nend",
]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def split(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t) if w]


def brute_base(text):
    t = text or ""
    ws = split(t)
    grams = defaultdict(list)
    for i in range(len(ws) - 4):
        grams[tuple(ws[i : i + 5])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if split(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def brute_rules(rows, limit=50, least=10, percent=50):
    norm = lambda x: re.sub("[\x20\x09-\x0d]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    seen = Counter()
    for _, t, h in rows:
        seen.update({(h, y) for x in (t or "").split("\n") if (y := norm(x))})
    out = []
    for i, t, h in rows:
        base = brute_base(t)
        common = [y for x in (t or "").split("\n") if (y := norm(x)) and seen[h, y] > limit]
        left = base[0] - sum(len(y.split(" ")) for y in common)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        out.append((i, *base, len(common), left, failed, not failed and left >= least and 100 * left >= percent * base[0]))
    return sorted(out, key=repr)


def got_rules(df, **more):
    return sorted((tuple(r) for r in quality_rules(df, **more).collect()), key=repr)


def test_rules_on_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert got_rules(df) == brute_rules(rows)
    assert got_rules(df, limit=2) == brute_rules(rows, limit=2)


def test_rules_on_odd_rows(spark):
    rows = [(i, t, "h") for i, t in enumerate(TEXTS)] + [(None, "x y", None), (3, "one", "h"), (3, "one", "h")]
    rows += [(100 + i, "Common  Line here 7\nCommon line HERE 8\n" + " ".join(f"d{i}w{k}" for k in range(i)), "h") for i in range(20)]
    df = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, source string, line string").repartition(3)
    assert got_rules(df, limit=3) == brute_rules(rows, limit=3)
    assert quality_rules(df.limit(0)).count() == 0


def brute_left(rows, limit):
    norm = lambda x: re.sub("[\x20\x09-\x0d]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    seen = Counter()
    for _, t, h in rows:
        seen.update({(h, y) for x in (t or "").split("\n") if (y := norm(x))})
    return sorted(((i, h, t if t is None else "\n".join(x for x in t.split("\n") if seen[h, norm(x)] <= limit)) for i, t, h in rows), key=repr)


@pytest.mark.parametrize("broadcast", [linefreq.BROADCAST_ROWS, 0])
def test_lines_above_the_limit_go(spark, broadcast, monkeypatch):
    monkeypatch.setattr(linefreq, "BROADCAST_ROWS", broadcast)
    rows = [(i, t, "h") for i, t in enumerate(TEXTS)] + [(None, "x y", None), (3, "one", "h"), (3, "one", "h")]
    rows += [(100 + i, f"Common  Line here 7\n{i} own\n\nCommon line HERE 8\n" + "end " * i, "h" if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, source string, line string").repartition(3)
    assert sorted((tuple(r) for r in without_common_lines(df, limit=3).select("doc_id", "source", "text").collect()), key=repr) == brute_left(rows, 3)
    assert got_rules(df, limit=3) == brute_rules(rows, limit=3)
    assert without_common_lines(df.limit(0)).count() == 0


def brute_scan(text):
    ws = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or "")) if w]
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def got_scan(df):
    return [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan(df).collect()]


def test_scan_on_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(got_scan(df)) == sorted((r.doc_id, *brute_scan(r.text)) for r in df.collect())


def test_scan_on_odd_rows(spark):
    rows = [*enumerate(TEXTS), (None, "cc by"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").repartition(3)
    assert sorted(got_scan(df), key=repr) == sorted(((i, *brute_scan(t)) for i, t in rows), key=repr)
    assert scan(df.limit(0)).count() == 0
    for r in scan(df).collect():
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


@pytest.mark.parametrize("change", ["as it is", "word changed", "word added", "word left out"])
def test_notices(spark, change):
    rows = []
    for label, notices in NOTICES.items():
        for n in notices:
            ws = n.split()
            if change != "as it is" and len(ws) < 15:
                continue
            if change == "word changed":
                ws[7] = "zzz"
            if change == "word added":
                ws.insert(7, "zzz")
            if change == "word left out":
                del ws[7]
            rows.append((label, "before it " + " ".join(ws).title() + ". after it"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.labels.split(",") for r in scan(df).collect()}
    assert all(label in found[i] for i, (label, _) in enumerate(rows))
    assert scan(spark.createDataFrame([(1, "under the license of the copy and the use of the software")], "doc_id long, text string").drop("x")).first().labels == ""
