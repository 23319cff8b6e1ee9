"""Broken answers, fallbacks, and suggestions that learn: hand-worked cases."""

import pytest

from oratorio.operators import answers as A

FENCE = "```"
GOOD = '[{"id": 1, "t": " one ", "c": "K"}, {"id": "2", "t": "two"}]'
CASES = {
    "plain": (GOOD, {1: ("one", "k"), 2: ("two", "?")}, {}),
    "fenced": (f"{FENCE}json\n{GOOD}\n{FENCE}", {1: ("one", "k"), 2: ("two", "?")}, {}),
    "prose": (f"Here it is: {GOOD} I hope so.", {1: ("one", "k"), 2: ("two", "?")}, {}),
    "nothing": (None, {1: (None, None), 2: (None, None)}, {"unreadable": 1}),
    "cut": ('[{"id": 1, "t": "one"}, {"id"', {1: (None, None), 2: (None, None)}, {"unreadable": 1}),
    "broken": ('[{"id": 1, "t": one}]', {1: (None, None), 2: (None, None)}, {"unreadable": 1}),
    "single quotes": ("[{'id': 1}]", {1: (None, None), 2: (None, None)}, {"unreadable": 1}),
    "empty": ("[]", {1: (None, None), 2: (None, None)}, {"missing": 2}),
    "repeated": ('[{"id": 1, "t": "a"}, {"id": 1, "t": "b", "c": "s"}]', {1: ("b", "s"), 2: (None, None)}, {"repeated": 1, "missing": 1}),
    "strange": ('[{"id": 1, "t": null}, 5, {"t": "x"}, {"id": "x"}, {"id": 9, "t": "y"}]', {1: ("", "?"), 2: (None, None)}, {"malformed": 2, "bad_id": 1, "unexpected": 1, "missing": 1}),
    "brackets inside": ('[{"id": 1, "t": "a ] b [ c"}, {"id": 2, "t": ""}]', {1: ("a ] b [ c", "?"), 2: ("", "?")}, {}),
}


@pytest.fixture(scope="module")
def read(spark):
    texts, problems = A.parsed(spark.createDataFrame([(n, c[0], [1, 2]) for n, c in CASES.items()], "window string, response string, ids array<bigint>"))
    return texts.collect(), problems.collect()


@pytest.mark.parametrize("name", CASES)
def test_answers(read, name):
    _, want, wrong = CASES[name]
    assert {r.id: (r.text, r.code) for r in read[0] if r.window == name} == want
    assert {r.problem: r.n for r in read[1] if r.window == name} == wrong


def test_fused_text_falls_back_by_rank(spark):
    records = spark.createDataFrame([(f"s{i}", "w", i) for i in range(1, 6)], "segment string, window string, id long")
    texts = spark.createDataFrame([("w", 1, "fused", "k"), ("w", 2, "", "u"), ("w", 3, None, None), ("w", 4, None, None)], "window string, id long, text string, code string")
    hyps = spark.createDataFrame([("s1", 1, "asr", "a"), ("s2", 2, "asr", "b2"), ("s2", 1, "asr", "b1"), ("s3", 1, "asr", "c"), ("s3", 5, "fusion", "older"), ("s4", 1, "asr", None)], "segment string, rank int, kind string, text string")
    got = {r.segment: (r.text, r.code, r.by) for r in A.fused(records, texts, hyps).collect()}
    assert got == {"s1": ("fused", "k", "fused"), "s2": ("b1", None, "recogniser"), "s3": ("older", None, "earlier"), "s4": ("", None, "recogniser"), "s5": ("", None, "none")}


def test_variants(spark):
    rows = spark.createDataFrame([("kura",), (" Kur ",), ("raa",), ("ko",), ("",), ("घर",), (None,)], "w string")
    assert [r.v for r in rows.select(A.variants(rows.w).alias("v")).collect()] == [["kura", "kuraa"], ["kur", "kura"], ["raa"], ["ko"], [], [], []]


CACHE = "word string, candidates array<string>, by string, hits long"


def test_a_second_run_reads_the_cache(spark):
    words = spark.createDataFrame([("Kur",), ("kur",), ("kura",), ("none",)], "word string")
    provider = spark.createDataFrame([("kur", 1, "कुर"), ("kur", 0, "कूर"), ("kura", 0, "कुरा"), ("kura", 1, "kura"), ("kura", 2, "कुर")], "form string, scheme int, candidate string")
    first = A.suggested(words, provider, spark.createDataFrame([], CACHE))
    assert {r.word: (r.candidates, r.by, r.hits) for r in first.collect()} == {"kur": (["कूर", "कुर", "कुरा"], "provider", 0), "kura": (["कुरा", "कुर"], "provider", 0)}
    again = A.suggested(words, provider.limit(0), first)
    assert {r.word: (r.candidates, r.hits) for r in again.collect()} == {"kur": (["कूर", "कुर", "कुरा"], 2), "kura": (["कुरा", "कुर"], 1)}
    chosen = spark.createDataFrame([("Kur", "कुरा", 1), ("kur", "कुर", 2), ("new", "नयाँ", 1), ("kura", "", 1)], "word string, chosen string, at int")
    after = {r.word: (r.candidates, r.by) for r in A.learned(first, chosen).collect()}
    assert after == {"kur": (["कुर", "कुरा", "कूर"], "provider"), "kura": (["कुरा", "कुर"], "provider"), "new": (["नयाँ"], "correction")}
    assert {r.word: r.candidates[0] for r in A.suggested(words, provider, A.learned(first, chosen)).collect()} == {"kur": "कुर", "kura": "कुरा"}
