"""Words on clocks and lanes against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from oratorio.operators import lanes as L
from oratorio.operators.texts import plain_token, slots_of

WORDS = "clip string, pos int, word string, start double, end double"


def brute_partners(ref, other):
    """The same choice by the whole table of costs, one cell at a time."""
    a, b = [plain_token(w) for w in ref], [plain_token(w) for w in other]
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    i, j, out = len(a), len(b), [None] * len(a)
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            out[i - 1] = j - 1 if a[i - 1] == b[j - 1] else None
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return out


def test_partners_are_those_of_the_whole_table():
    r = random.Random(5)
    for _ in range(400):
        ref, other = ([r.choice(["a", "B", "b,", "c", "d."]) for _ in range(r.randrange(9))] for _ in range(2))
        assert L.partners(ref, other) == brute_partners(ref, other), (ref, other)


def test_matched_words_carry_spans(spark):
    ref = spark.createDataFrame([("x", 0, "Team,", None, None), ("x", 1, "new", None, None), ("x", 2, "plan", None, None), ("y", 0, "alone", None, None)], WORDS)
    other = spark.createDataFrame([("x", 0, "team", 0.0, 0.4), ("x", 1, "old", 0.4, 0.8), ("x", 2, "plan.", 0.8, 1.5), ("z", 0, "team", 0.0, 1.0)], WORDS)
    got = {(r.clip, r.pos): (r.word, r.start, r.end) for r in L.matched(ref, other, "clip").collect()}
    assert got == {("x", 0): ("Team,", 0.0, 0.4), ("x", 1): ("new", None, None), ("x", 2): ("plan", 0.8, 1.5), ("y", 0): ("alone", None, None)}


def test_boundaries(spark):
    ref = spark.createDataFrame([("x", 0, "team", 0.0, 0.4), ("x", 1, "घर", 0.4, 0.9), ("x", 2, "gone", None, None), ("x", 3, "प", 1.0, 1.2)], WORDS)
    other = spark.createDataFrame([("x", 0, "Team", 0.05, 0.4), ("x", 1, "घर", 0.4, 1.0)], WORDS)
    got = [(r.pos, r.start_ms, r.end_ms, r.max_ms, r.switched, r.devanagari) for r in L.boundary_differences(ref, other, "clip").orderBy("pos").collect()]
    assert got == [(0, 50.0, 0.0, 50.0, True, False), (1, 0.0, 100.0, 100.0, True, True)]


def test_placed_words_take_times_of_what_they_replace(spark):
    texts = spark.createDataFrame([("x", "the big team won"), ("y", "no clock"), ("z", None)], "clip string, text string")
    seeds = spark.createDataFrame([("x", 0, "the", 0.0, 0.1), ("x", 1, "team", 0.1, 0.5), ("x", 2, "one", 0.5, None)], WORDS)
    got = [(r.clip, r.pos, r.word, r.start) for r in L.placed(texts, seeds, "clip").orderBy("clip", "pos").collect()]
    assert got == [("x", 0, "the", 0.0), ("x", 1, "big", None), ("x", 2, "team", 0.1), ("x", 3, "won", 0.5), ("y", 0, "no", None), ("y", 1, "clock", None)]


def brute_speaker(start, end, turns):
    if start is None or end is None:
        return None
    covered = {}
    for a, b, s in turns:
        share = min(end, b) - max(start, a) if end > start else float(a <= start < b)
        if share > 0:
            covered[s] = covered.get(s, 0.0) + share
    return min(covered, key=lambda s: (-round(covered[s], 9), s)) if covered else None


def test_speakers_by_coverage(spark):
    r = random.Random(6)
    words, turns = [], []
    for c in range(6):
        turns += [(f"c{c}", a := r.randrange(0, 200) / 10, a + r.randrange(1, 90) / 10, r.randrange(1, 4)) for _ in range(12)]
        for p in range(40):
            start = r.choice([None, r.randrange(0, 250) / 10])
            words.append((f"c{c}", p, "w", start, None if start is None else start + r.choice([0.0, 0.3, 2.0, 9.0])))
    out = L.by_turns(spark.createDataFrame(words, WORDS), spark.createDataFrame(turns, "clip string, turn_start double, turn_end double, speaker int"), ["clip"]).collect()
    assert len(out) == len(words)
    assert all(x.speaker == brute_speaker(x.start, x.end, [t[1:] for t in turns if t[0] == x.clip]) for x in out)


def test_lanes_choose_text_and_clock(spark):
    clips = spark.createDataFrame([("kept", 1, "s1"), ("rerun", 2, "s2"), ("label", 1, "s3"), ("unsure", 1, "s4"), ("untimed", 1, "s5"), ("empty", 1, None)], "clip string, run int, seed string")
    labels = spark.createDataFrame([("label", 1, 1, "edited", "old text"), ("label", 2, 1, "edited", "hello there"), ("unsure", 1, 1, "edited", "x"), ("unsure", 2, 2, "uncertain", "y")], "clip string, id int, created_at int, disposition string, text string")
    word = "struct<word:string,start:double,end:double,speaker:int,proposed:int,source:string>"
    saved = spark.createDataFrame([("kept", 1, 1, 1, [("mine", 0.0, 1.0, 2, 1, "typed")]), ("rerun", 1, 1, 1, [("gone", 0.0, 1.0, 2, 1, "typed")])], f"clip string, label int, run int, created_at int, words array<{word}>")
    names = {"s1": "kept", "s2": "rerun", "s3": "label", "s4": "unsure", "s5": "untimed"}
    hyps = spark.createDataFrame([(h, c, "fusion", "hello there") for h, c in names.items()] + [("a5", "untimed", "asr", "hello"), ("b5", "untimed", "asr", "hello there")], "hypothesis string, clip string, kind string, text string")
    spans = [(h, p, w, p * 1.0, p + 0.9) for h in ("s2", "s3", "s4", "b5") for p, w in enumerate(["hello", "there"])] + [("s5", 0, "hello", None, None), ("a5", 0, "hello", 5.0, 6.0)]
    turns = spark.createDataFrame([(c, 0.0, 1.0, 2) for c in names.values()] + [(c, 1.0, 3.0, 1) for c in names.values()], "clip string, turn_start double, turn_end double, speaker int")
    out = L.lanes(clips, labels, saved, hyps, spark.createDataFrame(spans, "hypothesis string, pos int, word string, start double, end double"), turns)
    got = {(r.clip, r.pos): (r.word, r.start, r.speaker, r.proposed, r.source, r.base) for r in out.collect()}
    assert got[("kept", 0)] == ("mine", 0.0, 2, 1, "typed", "speakers") and ("kept", 1) not in got
    for clip, base in (("rerun", "seed"), ("label", "label"), ("unsure", "seed"), ("untimed", "seed")):
        assert got[(clip, 0)] == ("hello", 0.0, 2, 2, "label", base) and got[(clip, 1)] == ("there", 1.0, 1, 1, "label", base), clip
    assert not any(c == "empty" for c, _ in got)


def brute_candidates(own, heard, same):
    words = [(s, p, w, a, b) for s, p, w, a, b in heard if a is not None] + [(L.OWN, p, w, a, b) for p, w, a, b in own if a is not None]
    spans, out = {(s, p): (a, b) for s, p, _, a, b in words}, []
    for slot in slots_of(words):
        if L.OWN in slot["words"]:
            continue
        said = sorted((s, plain_token(w), w, *spans[s, p]) for s, (p, w) in slot["words"].items())
        tokens = [t for _, t, *_ in said]
        best = max(tokens, key=lambda t: (tokens.count(t), -tokens.index(t)))
        if not best or tokens.count(best) < 2:
            continue
        own_of = [x for x in said if x[1] == best]
        _, _, word, a, b = own_of[0]
        if not any(x is not None and abs((x + y) / 2 - (a + b) / 2) <= 0.6 and same(w, word) for _, w, x, y in own):
            out.append((word, round(a, 3), round(b, 3), tuple(x[0] for x in own_of)))
    return sorted(out)


def test_candidates_against_a_plain_loop(spark):
    from oratorio.functions.fold import default_folder

    r, vocabulary = random.Random(7), ["go", "Go.", "home", "two", "2", "...", "stay"]
    own, heard = {}, {}
    for c in range(8):
        own[f"c{c}"] = [(p, r.choice(vocabulary), *(lambda a: (None, None) if a > 9 else (a, a + 0.3))(r.randrange(0, 110) / 10)) for p in range(6)]
        heard[f"c{c}"] = [(s, p, r.choice(vocabulary), a := r.randrange(0, 100) / 10, a + 0.3) for s in "abc" for p in range(12)]
    a = spark.createDataFrame([(c, *w) for c, ws in own.items() for w in ws], WORDS)
    b = spark.createDataFrame([(c, *w) for c, ws in heard.items() for w in ws], "clip string, system string, position int, word string, start double, end double")
    got = {}
    for x in L.candidates(a, b, "clip").collect():
        got.setdefault(x.clip, []).append((x.word, x.start, x.end, tuple(x.systems)))
    want = {c: w for c in own if (w := brute_candidates(own[c], heard[c], default_folder().same))}
    assert {c: sorted(v) for c, v in got.items()} == want and sum(map(len, want.values())) > 5


def test_respelled_only_where_the_words_spell_the_text(spark):
    spans = "array<struct<word:string,start:double,end:double>>"
    rows = [(1, [("companyले,", 0.0, 1.0), ("ok.", 1.0, 2.0)], "company ले ok"), (2, [("ok", 0.0, 1.0)], "okay"), (3, [("कम्पनी", 0.0, 1.0)], "the firm"), (4, None, "x"), (5, [], None)]
    out = L.respelled(spark.createDataFrame(rows, f"id int, spans {spans}, text string"), "spans", "text", F.create_map(F.lit("कम्पनी"), F.lit("the firm")))
    got = {r.id: None if r.words is None else [tuple(w) for w in r.words] for r in out.collect()}
    assert got == {1: [("company", 0.0, 1.0), ("ले", 0.0, 1.0), ("ok", 1.0, 2.0)], 2: None, 3: [("the", 0.0, 1.0), ("firm", 0.0, 1.0)], 4: None, 5: []}


@pytest.mark.parametrize(("words", "text", "kept"), [([("a", 0.0, 1.0)], "a.", True), ([("a", 0.0, None)], "a", False), ([("a", 0.0, 1.0)], "a b", False), ([], "", False)])
def test_seed_spans(spark, words, text, kept):
    df = spark.createDataFrame([(words, text)], "words array<struct<word:string,start:double,end:double>>, text string")
    assert (L.seed_spans(df, "words", "text").first().spans is not None) == kept


def test_lanes_are_stored_or_refused(spark):
    words = [
        ("good", 1, "there", 1.0, 1.5, 2, 1, None, "label"), ("good", 0, " hello ", 0.0, 0.5, 1, 1, 2, "typed"), ("again", 0, "x", 0.0, 1.0, 1, 1, None, "label"),
        ("bad", 0, "a b", 0.0, 1.0, 1, 1, None, "label"), ("bad", 1, "c", None, 1.0, None, 1, 7, "copied"), ("bad", 2, "d", float("nan"), 1.0, 7, 1, None, "copy"), ("bad", 3, "e", 0.5, 0.51, 1, 1, None, "copy"), ("bad", 4, "f", 9.0, 10.06, 1, 1, None, "copy"), ("bad", 5, "g", 9.0, 10.05, 1, 1, None, "copy"),
    ]
    words = spark.createDataFrame(words, f"{WORDS}, speaker int, proposed int, suggested int, source string")
    clips = spark.createDataFrame([(c, i, 1, "me", 10.0, [1, 2]) for i, c in enumerate(("good", "again", "bad", "none"))], "clip string, task int, run int, annotator string, seconds double, speakers array<int>")
    problems = {(r.clip, r.pos, r.problem) for r in L.lane_problems(words, clips).collect()}
    assert problems == {("bad", 0, "not one word"), ("bad", 1, "unknown source"), ("bad", 1, "no span"), ("bad", 1, "on no lane"), ("bad", 1, "unknown suggestion"), ("bad", 2, "span is not a number"), ("bad", 2, "unknown speaker"), ("bad", 3, "too short"), ("bad", 4, "outside the clip"), ("none", None, "no words")}
    labels, kept, refused = L.attributions(words, clips, spark.createDataFrame([("good", 1), ("again", 2), ("bad", 1), ("none", 1)], "clip string, run int"))
    assert [tuple(r) for r in labels.collect()] == [("good", 0, 1, "me", "hello there", 1, 1)]
    assert [(r.position, r.word, r.speaker) for r in kept.orderBy("position").collect()] == [(0, "hello", 1), (1, "there", 2)]
    assert {r.clip: r.refused for r in refused.collect()} == {"again": "diarized again", "bad": "not one word", "none": "no words"}


def test_clip_detail_says_what_is_stale(spark):
    clips = spark.createDataFrame([(1, "a", "the team won", "the team one"), (2, "b", "x", "x")], "run int, clip string, ref string, hyp string")
    out = {r.clip: (r.stale, [s.kind for s in r.steps]) for r in L.clip_detail(clips, spark.createDataFrame([(1, "old"), (2, "v")], "run int, version string"), "v").collect()}
    assert out == {"a": (True, ["match", "match", "sub"]), "b": (False, ["match"])}
