"""Evidence of the queue: seeds, neighbours, hazards and priorities by hand."""

import pytest

from oratorio.operators import corpus as C
from oratorio.operators import evidence as E
from oratorio.operators.texts import hazards_of

HYPS = "segment string, id int, system int, kind string, text string, avg_logprob double, code string, placed boolean, gap double"
SEGS = "segment string, episode string, start double, pipeline_status string"


@pytest.fixture(scope="module")
def inputs(spark):
    segs = [("a", "e", 0.0, "imported"), ("b", "e", 5.0, "queued"), ("c", "e", 9.0, "imported"), ("d", "f", 0.0, "imported"), ("x", "f", 1.0, "excluded")]
    hyps = [
        ("a", 1, 1, "asr", "the team won today", None, None, None, None), ("a", 2, 2, "asr", "the team won today", -0.25, None, None, None), ("a", 3, 3, "fusion", "the team won today", None, "k", True, 1.0),
        ("b", 4, 1, "asr", "hello", -0.4, None, None, None), ("b", 5, 2, "asr", "hallo", -0.1, None, None, None),
        ("c", 6, 1, "asr", "we go home now", -0.5, None, None, None), ("c", 7, 3, "fusion", "old", None, None, None, None), ("c", 8, 3, "fusion", "we go home now", None, "u", False, 9.0),
        ("x", 9, 1, "asr", "x", None, None, None, None),
    ]
    return spark.createDataFrame(segs, SEGS), spark.createDataFrame(hyps, HYPS)


def test_seeds_and_neighbours(inputs):
    segs, hyps = inputs
    assert {r.segment: (r.seed, r.fused) for r in E.seeds(hyps).collect()} == {"a": (3, True), "b": (5, False), "c": (8, True), "x": (9, False)}
    assert {r.segment: r.neighbours for r in E.neighbour_texts(segs, hyps).collect()} == {"a": ["hello", "hallo"], "b": ["the team won today"] * 2 + ["we go home now"], "c": ["hello", "hallo"], "x": []}


def test_priorities(spark, inputs):
    flags = spark.createDataFrame([("a", ["too_short", "own", "too_short"]), ("b", None)], "segment string, flags array<string>")
    got = {r.segment: r for r in E.prioritised(E.assembled(*inputs), flags, ("too_short", "too_long")).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.unsupported_rate, a.dropped_rate, a.asr_disagreement, a.acoustic_gap, a.low_confidence, a.rule_flag_score) == (0.0, 0.0, 0.0, 0.5, 0.5, 0.5)
    assert a.priority == pytest.approx(0.15 * 0.5 + 0.1 * 0.5 + 0.05 * 0.5) and a.hazards == [] and a.unmeasured == []
    assert b.hazards == ["unfused"] and b.unsupported_rate is None and b.asr_disagreement == 1.0 and b.priority == pytest.approx(1 + 0.2 + 0.1 * 0.8)
    assert set(b.unmeasured) == {"unsupported_rate", "dropped_rate", "acoustic_gap"}
    assert c.hazards == ["fuser_uncertain", "unaligned"] and c.acoustic_gap is None and c.seed_id == 8
    assert d.seed_id is None and d.hazards == ["unfused"] and d.priority == pytest.approx(1.0)


def test_queue_from_evidence(spark, inputs):
    segs, hyps = inputs
    tasks = spark.createDataFrame([("a", 1, "pending"), ("c", 2, "done")], "segment string, id int, status string")
    none = spark.createDataFrame([], "segment string, flags array<string>")
    plan = {r.segment: (r.queue, r.action, r.new_status) for r in E.queue(segs, hyps, none, ("f",), spark.createDataFrame([("b",)], "segment string"), tasks).collect()}
    assert plan == {"a": ("review", "update", "imported"), "b": ("audit", "insert", "queued"), "d": ("error", "insert", "queued")}


def test_hazards_stop_early():
    assert hazards_of(None, ["a b"], code="u", placed=False)["hazards"] == ["unfused"]
    assert hazards_of("", ["a b", "a b"], code="u")["hazards"] == ["emptied"]
    assert hazards_of("a b", [], placed=False)["hazards"] == ["speech_over_silence"]
    one = hazards_of("a b", ["a b"], gap=-1.0)
    assert one["hazards"] == [] and one["acoustic_gap"] == 0.0 and hazards_of("a b", ["a b"])["acoustic_gap"] is None


def test_hand_set_fields(spark):
    found = spark.createDataFrame([("e", "v", "f", "20s", None, "only_pair"), ("f", "v", "m", "20s", None, "only_pair"), ("e", "w", "f", None, None, "only_pair"), ("g", "w", "f", "30s", None, "rows_agree")], "episode string, voice string, gender string, age_bracket string, role string, by string")
    heard = spark.createDataFrame([("e", "v"), ("e", "w"), ("e", "z")], "episode string, voice string")
    manual = spark.createDataFrame([("v", "f", ""), ("w", "f", "40s"), ("z", "m", None)], "voice string, gender string, age_bracket string")
    got = {r.voice: (r.gender, r.age_bracket, r.status, r.manual, r.disagrees) for r in C.identities(found, heard, manual).collect()}
    assert got == {"v": ("f", "20s", "resolved", ["gender"], ["gender"]), "w": ("f", "40s", "resolved", ["gender", "age_bracket"], ["age_bracket"]), "z": ("m", None, "resolved", ["gender"], [])}
