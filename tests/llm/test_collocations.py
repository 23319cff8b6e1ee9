"""Collocations against their SQL on texts that are hard to cut, and counts when hashes collide."""

import collections
import random
import re

import numpy as np
import pytest

from oratorio.llm import collocations as C
from tests.oracle import connect, rows_of, rows_of_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, phrase string, a int, words int, shard int"


def write(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "s", 0, "z", 1, 2, 3) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_texts_as_sql(spark, tmp_path, seed):
    r = random.Random(seed)
    words = ["new", "New", "york", "a", "a", "É", "é", "city", "x\x00y", "of", "the end", "'s", "日本", "_"]
    glue = [" ", " ", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", ". ", ", ", ";", "!?", ":"]
    text = lambda n: "".join(r.choice(words) + r.choice(glue) for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 5, 900])), r.choice(["en", "de", None, "und"])) for i in range(200)]
    rows += [(100, None, "en"), (101, "", None), (102, " \t.\n", "en"), (None, "a a a a a a", "en"), (103, "New York City " * 3000, "fr"), (103, "New York City " * 3000, "fr"), (104, "one two. three " * 40 + "one two three four " * 35, "fr")]
    d = write(spark, tmp_path, rows)
    got = rows_of(C.op13_collocations(spark, d))
    assert got == rows_of_sql(connect(d), C.OP13_SQL)
    assert len(got[1]) > 50


def test_empty_table(spark, tmp_path):
    assert C.op13_collocations(spark, write(spark, tmp_path, [(1, None, "en")])).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert C.op13_collocations(spark, f"{tmp_path}/none").count() == 0


def brute(texts, most=4):
    n = collections.Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\n-\r]", t.lower()):
            w = [x for x in re.split("[ \t]", piece) if x]
            for m in range(1, most + 1):
                n.update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    return n


def test_counts_are_exact_whatever_the_hashes_do(monkeypatch):
    """With hashes that mostly collide, every phrase is a candidate, many hide behind another's hash, and
    still every phrase is counted."""
    texts = ["a b a b c. a b, c d a", "b c d a b " * 5]
    every = np.arange(1 << C.BUCKET, dtype=np.uint64)[:16]
    monkeypatch.setattr(C, "_mixed", lambda x: (x >> np.uint64(7)) & np.uint64(3))
    found, words = C.count_phrases([t.encode() for t in texts], 1, every, 1, 4)
    want = brute(texts)
    assert words == sum(n for p, n in want.items() if " " not in p)
    assert {p.decode().strip(): n for p, n in found.items()} == want


def test_chunks_keep_pieces_whole():
    texts = [b"One  two.three\tfour", b"", b"..", b"five"]
    assert list(C.chunks(texts)) == [b" one two \n three four \n five "]
    assert list(C.chunks(texts, 1)) == [b" one two ", b" three four ", b" five "]
    start, end, hashes, valid = C.phrase_hashes(b" one two \n three one two ", 3, 3)
    assert [v.tolist() for v in valid] == [[True, True, False, True, True, True], [True, False, False, True, True], [False, False, False, True]]
    assert hashes[1][0] == hashes[1][4] and hashes[0][0] == hashes[0][4] and len(set(hashes[0].tolist())) == 4


def test_the_sketch_never_bounds_from_below(spark):
    """A phrase that is 30 times in all, once in each of 30 shards, is found; one that is 29 times is not."""
    rows = [(i, f"common pair here {i}. rare pair " if i < 29 else f"common pair here {i}", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.phrase: r.n for r in C.phrase_counts(docs).collect() if r.words}
    assert got == {"common": 30, "pair": 59, "here": 30, "common pair": 30, "pair here": 30, "common pair here": 30}
