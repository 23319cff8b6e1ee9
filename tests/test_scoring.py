"""Stored scores: what is aligned again, what an import skips, what a change of rules replaces."""

import pytest
from pyspark.sql import functions as F

from oratorio.functions.fold import default_folder
from oratorio.operators import scoring as S

CLIPS = "clip string, ref string, hyp string"
ROWS = [("a", "the team won", "the team one"), ("b", "होइन", "हैन"), ("c", "", "extra word"), ("d", None, "x"), ("e", "same", "same")]
LABEL = "clip string, id int, created_at int, disposition string, text string"


@pytest.fixture(scope="module")
def first(spark):
    clips = spark.createDataFrame(ROWS, CLIPS)
    scores = S.rescored(clips, S.scored(clips.limit(0), "v1"), "v1")
    return spark.createDataFrame(scores.collect(), scores.schema)


def by_clip(df):
    return {r.clip: r for r in df.collect()}


def test_scores_are_those_of_the_alignment(first):
    got = by_clip(first)
    assert {c: (r.ref_words, r.errors, r.raw_errors) for c, r in got.items()} == {"a": (3, 1, 1), "b": (1, 0, 0), "c": (0, 2, 2), "d": (0, 1, 1), "e": (1, 0, 0)}
    assert not any(r.reused for r in got.values())


def test_a_second_run_aligns_nothing(spark, first):
    again = by_clip(S.rescored(spark.createDataFrame(ROWS, CLIPS), first, "v1"))
    assert all(r.reused for r in again.values()) and len(again) == 5
    assert {c: r[:-1] for c, r in again.items()} == {c: r[:-1] for c, r in by_clip(first).items()}


def test_what_changed_is_aligned(spark, first):
    rows = [("a", "the team won", "the team won"), *ROWS[1:4], ("f", "new", "new")]
    got = by_clip(S.rescored(spark.createDataFrame(rows, CLIPS), first, "v1"))
    assert {c for c, r in got.items() if not r.reused} == {"a", "f"} and "e" not in got and got["a"].errors == 0
    status = {r.clip: r.status for r in S.plan(spark.createDataFrame(rows, CLIPS), first, "v1").collect()}
    assert status == {"a": "text", "b": "kept", "c": "kept", "d": "kept", "e": "gone", "f": "new"}
    assert {r.status for r in S.plan(spark.createDataFrame(ROWS, CLIPS), first, "v2").collect()} == {"rules"}
    # an empty text is not a null one
    assert by_clip(S.plan(spark.createDataFrame([("d", "", "x")], CLIPS), first.where("clip = 'd'"), "v1"))["d"].status == "text"


def test_an_import_says_what_it_skips(spark, first):
    clips = spark.createDataFrame([("a", "val"), ("b", "val"), ("c", "train"), ("e", None)], "clip string, split string")
    labels = spark.createDataFrame([("a", 1, 1, "edited", "old"), ("a", 2, 1, "edited", "the team won"), ("b", 1, 1, "edited", "x"), ("b", 2, 2, "uncertain", "y")], LABEL)
    run = spark.createDataFrame([("a", "the team one"), ("b", "x"), ("c", "x"), ("e", "x")], "clip string, text string")
    scores, counts = S.import_run(run, clips, labels, "val", first, "v1")
    assert {r.outcome: r.n for r in counts.collect()} == {"scored": 1, "no_reference": 1, "not_in_split": 2}
    assert [(r.clip, r.errors, r.reused) for r in scores.collect()] == [("a", 1, True)]
    with pytest.raises(ValueError, match="another dataset"):
        S.import_run(run.union(spark.createDataFrame([("z", "x")], run.schema)), clips, labels, "val", first, "v1")


def test_runs_of_older_rules_are_scored_again(spark):
    none = {f: (False if f == "is_loop" else 1) for f in S.FIELDS}
    rows = [{"run": r, "clip": c, "ref": a, "hyp": b} | none for r in (1, 2) for c, a, b in ROWS]
    schema = f"run int, {CLIPS}, " + ", ".join(f"{f} {'boolean' if f == 'is_loop' else 'int'}" for f in S.FIELDS)
    runs = spark.createDataFrame([(1, "v0"), (2, "v1")], "run int, version string")
    clips, audit = S.rescored_runs(runs, spark.createDataFrame(rows, schema), "v1")
    got = {(r.run, r.clip): r.errors for r in clips.collect()}
    assert got == {(1, "a"): 1, (1, "b"): 0, (1, "c"): 2, (1, "d"): 1, (1, "e"): 0} | {(2, c): 1 for c in "abcde"}
    assert [tuple(r) for r in audit.collect()] == [(1, "v0", 1.0, "v1", 0.8, 5)]


def test_breakdowns_and_pairs(spark, first):
    classes = spark.createDataFrame([("a", "voice", "f"), ("b", "voice", "f"), ("e", "voice", "m"), ("a", "length", "long")], "clip string, class string, value string")
    out = {(r["class"], r.value): (r.clips, r.words, r.wer) for r in S.by_classes(first, classes).collect()}
    assert out == {("voice", "f"): (2, 4, 0.25), ("voice", "m"): (1, 1, 0.0), ("length", "long"): (1, 3, 0.333333)}
    whole = S.summary(first).first()
    assert (whole.clips, whole.words, whole.errors, whole.wer) == (5, 5, 4, 0.8)
    runs = first.withColumn("ref_digest", F.col("digest"))
    base = runs.withColumn("errors", F.when(F.col("clip") == "a", 2).otherwise(F.col("errors"))).withColumn("ref_digest", F.when(F.col("clip") == "c", "other").otherwise(F.col("ref_digest")))
    assert tuple(S.paired(runs, base).first()) == (4, 5, 0.4, 0.6, -0.2, 1, 0)


def test_the_version_in_force_is_the_folders(spark, first):
    got = S.rescored(spark.createDataFrame(ROWS, CLIPS), first).collect()
    assert {r.version for r in got} == {default_folder().version} and not any(r.reused for r in got)
