import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracegauge.llm.packing import CAPACITY, cuts, encoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n\t ", "a", "ÉTÉ d'été l'ami's 12³½", "ΑΣ Σ σς", "İstanbul İ", "éa <|endoftext|> x", "\xa0b\x85c\xadd", "don't WE'LL !!'s ''s", "漢字 kana カナ", "x" * 5000, "word " * 9000, "Ångstrom Ǆ", "a\x00b\x1cc"]


def check(rows, texts):
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, text in texts:
        want[i].append(np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == want.keys()
    for i, parts in by_doc.items():
        if len(want[i]) > 1:
            continue
        ids, at = want[i][0], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return sum(CAPACITY for _ in by_seq), sum(r.length for r in rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    room, used = check(pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert room <= used * 1.02 + CAPACITY


def test_odd_texts_and_ids(spark):
    texts = list(enumerate(ODD)) + [(None, "null id"), (3, "a")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, length int").repartition(3)
    rows = pack(docs, PATH).collect()
    check(rows, texts)
    assert sum(r.length for r in rows if r.doc_id == 3) == 4


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("text", ODD)
def test_encoder(text):
    want = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(next(encoder(PATH)([text or ""])), "<u4").tolist() == want


def test_cuts_fit_their_class():
    for n in range(1, 5000):
        parts = cuts(n)
        assert sum(x for x, _ in parts) == n
        assert all(CAPACITY // (j + 1) < x <= CAPACITY // j for x, j in parts)
