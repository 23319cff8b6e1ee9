"""Hand-worked cases of identities, decisions, queue plans, audits and resampled intervals."""

from oratorio.operators import corpus as C
from oratorio.operators import resample as S

DECLARED = "episode string, gender string, age_bracket string, role string"
HEARD = "episode string, voice string"


def test_each_rule_reaches_its_voices(spark):
    declared = spark.createDataFrame(
        [("one", "f", "20s", "host"), ("two", "m", "40s", "host"), ("two", "f", "30s", "guest"), ("two", "f", "", "guest"), ("many", "f", "20s", "guest"), ("split", "f", None, None), ("split", "m", None, None), ("none", "f", "20s", "guest")], DECLARED)
    heard = spark.createDataFrame([("one", "a"), ("two", "h"), ("two", "b"), ("other", "h"), ("many", "c"), ("many", "d"), ("split", "e"), ("one", "a")], HEARD)
    out = {(r.episode, r.voice): (r.gender, r.age_bracket, r.role, r.by) for r in C.resolved(declared, heard).collect()}
    assert out == {("one", "a"): ("f", "20s", "host", "only_pair"), ("two", "h"): ("m", "40s", "host", "recurring_host"), ("two", "b"): ("f", None, "guest", "rows_agree")}


def test_conflicts_take_no_value_and_the_hand_wins(spark):
    found = spark.createDataFrame([("1", "a", "f", "20s", "host", "only_pair"), ("2", "a", "m", "20s", "host", "only_pair"), ("3", "b", "m", None, None, "rows_agree"), ("1", "c", "f", "20s", None, "only_pair"), ("2", "c", "m", "20s", None, "only_pair")], DECLARED.replace("episode string,", "episode string, voice string,") + ", by string")
    heard = spark.createDataFrame([("1", "a"), ("3", "b"), ("1", "c"), ("4", "z")], HEARD)
    manual = spark.createDataFrame([("c", "f", ""), ("nobody", "m", None)], "voice string, gender string, age_bracket string")
    out = {r.voice: (r.gender, r.age_bracket, r.status, r.only_pair, r.rows_agree) for r in C.identities(found, heard, manual).collect()}
    assert out == {"a": (None, None, "conflict", 2, 0), "b": ("m", None, "resolved", 0, 1), "c": ("f", "20s", "resolved", 2, 0), "z": (None, None, "unresolved", 0, 0)}


def test_decisions_are_refused_with_a_reason(spark):
    tasks = spark.createDataFrame([(1, 10, "pending"), (2, 20, "done")], "id long, segment_id long, status string")
    rows = [(1, 9, "edited", "x"), (2, 2, "edited", "x"), (3, 1, "cleared", None), (4, 1, "edited", ""), (5, 1, "edited", "x"), (6, 1, "edited", "y"), (7, 1, None, None)]
    incoming = spark.createDataFrame(rows, "decision_id long, task_id long, disposition string, final_text string")
    out = {r.decision_id: r.refused for r in C.decisions(incoming, tasks, ("edited", "uncertain")).collect()}
    assert out == {1: "unknown task", 2: "task not active", 3: "disposition", 4: "no text", 5: None, 6: "task decided", 7: "disposition"}


def test_queue_plan_updates_what_is_active(spark):
    rows = [(1, "imported", None, 0.1), (2, "queued", 5, None), (3, "imported", 6, 0.3), (4, "labeled", 7, 0.4), (5, "imported", 8, 0.5)]
    segments = spark.createDataFrame(rows, "segment_id long, pipeline_status string, seed_id long, priority double")
    tasks = spark.createDataFrame([(2, 70, "pending"), (3, 71, "done"), (5, 72, "skipped")], "segment_id long, id long, status string")
    audited = spark.createDataFrame([(5,), (5,), (1,)], "segment_id long")
    out = {r.segment_id: (r.queue, r.action, r.task_id, r.new_status) for r in C.queue_plan(segments, audited, tasks).collect()}
    assert out == {1: ("error", "insert", None, "queued"), 2: ("review", "update", 70, "queued"), 5: ("audit", "insert", None, "queued")}


def test_audit_names_what_changes(spark):
    kind = "k long, wer double, cer double"
    stored = spark.createDataFrame([(1, 10.0, None), (2, 5.0, 5.0), (3, 1.0, 1.0)], kind)
    fresh = spark.createDataFrame([(1, 12.0, 3.0), (2, 5.2, None)], kind)
    out = {(r.k, r["column"]): (r.old, r.new) for r in C.changed(stored, fresh, "k", ["wer", "cer"], 0.5).collect()}
    assert out == {(1, "wer"): (10.0, 12.0), (1, "cer"): (None, 3.0), (2, "cer"): (5.0, None)}


def test_resampled_bounds(spark):
    kind = "bucket string, group long, words long, errors long"
    rows = [(b, g, 100, e + g % 3) for g in range(60) for b, e in (("none", 10), ("some", 20), ("unmeasured", 1))] + [("lone", 3, 100, 50)]
    clips = spark.createDataFrame(rows, kind)
    out = {r.bucket: r for r in S.axis_breakdown(clips, "bucket", "none", "unmeasured", rounds=200).collect()}
    assert abs(out["some"].rate_ratio - 21 / 11) < 1e-9 and out["some"].low < out["some"].rate_ratio < out["some"].high < 2
    assert out["none"].rate_ratio is None and out["unmeasured"].ratio_groups is None
    assert out["lone"].rate_ratio == 5.0 and out["lone"].low is None
    assert S.axis_breakdown(clips.limit(0), "bucket", "none", "unmeasured", rounds=8).count() == 0
    rates = {r.bucket: r for r in S.rate_intervals(clips, "bucket", rounds=200).collect()}
    assert rates["none"].low < 11.0 < rates["none"].high and rates["lone"].low is None and rates["lone"].rate == 50.0


def test_poisson_counts_have_mean_one():
    bounds = [int(b, 16) / 2**32 for b in S.poisson_bounds()]
    assert bounds == sorted(bounds) and abs(sum(1 - b for b in bounds) - 1) < 1e-6
