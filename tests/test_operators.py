"""Hand-worked cases: six clips with five errors, intervals, windows, choices and folding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oratorio.functions import buckets as B
from oratorio.functions import intervals as I
from oratorio.functions import text as X
from oratorio.functions.fold import Folder, counts, default_folder, edit_distance, script, spoken
from oratorio.operators import attribution as A
from oratorio.operators import choices as C
from oratorio.operators import errors as E
from oratorio.operators import joins as J
from oratorio.operators import latest as L
from oratorio.operators import reports as R
from oratorio.operators import texts as T
from oratorio.operators import vectors as V

CLIPS = [
    ("c1", "g1", 0.0, "म घर जान्छु", "म घर जान्छु"), ("c2", "g1", 0.2, "घर 45 दिन", "घर दिन"), ("c3", "g2", 0.03, "म आयो", "म आयो थप"),
    ("c4", "g2", None, "पाँच", "6"), ("c5", "g3", 0.0, "राम्रो", "नराम्रो"), ("c6", "g3", 0.0, "नराम्रो", "राम्रो"),
]


@pytest.fixture(scope="module")
def rows(spark):
    clips = spark.createDataFrame(CLIPS, "clip_id string, group string, overlap_share double, ref string, hyp string")
    found = T.error_rows(clips).join(clips.select("clip_id", "overlap_share"), "clip_id")
    return found.withColumns({"words": F.size("ref").cast("long"), "overlap_bucket": B.overlap_bucket(F.col("overlap_share")), "snr_bucket": F.lit("unmeasured"), "ref": F.array_join("ref", " "), "hyp": F.array_join("hyp", " ")}).cache()


def test_six_clips(rows):
    h = E.headline(E.clips(rows)).first()
    assert (h.clips, h.ref_words, h.errors) == (6, 11, 5)
    assert h.wer == pytest.approx(100 * 5 / 11) and h.sub_rate == pytest.approx(100 * 3 / 11) and h.del_rate == pytest.approx(100 / 11)
    by = {r.bucket: (r.ref_words, r.errors) for r in E.breakdown(rows).collect()}
    assert by == {"none": (5, 2), ">15%": (3, 1), "0-5%": (2, 1), "unmeasured": (1, 1)}
    n = E.numbers(rows).first()
    assert (n.errors, n.sub, n["del"], n.ins, n.ref_clips) == (2, 1, 1, 0, 2)


def test_confusion_both_ways(rows):
    flt = E.ErrorFilter(kind=("sub",), number=False)
    both = E.confusion(rows, flt, both_ways=True).collect()
    assert [(r.a, r.b, r.n, r.forward) for r in both] == [("नराम्रो", "राम्रो", 2, 1)]
    assert E.confusion(rows, flt, base=rows.where("clip_id = 'c5'"), sort="change").first().change == 1


def test_card_adds_up_and_is_zero_against_itself(rows):
    clips = E.clips(rows)
    assert sum(r.points for r in A.card(clips).collect()) == pytest.approx(100 * 5 / 11)
    assert all(abs(r.points) < 1e-12 for r in A.card_difference(clips, clips).collect())


def test_mh_ratio_by_hand(spark):
    t = spark.createDataFrame([("g1", "x", 10, 5), ("g1", "b", 10, 1), ("g2", "x", 20, 4), ("g2", "b", 20, 2), ("g3", "x", 5, 5)], "group string, cell string, words long, errors long")
    r = A.mh_ratio(t, F.col("cell") == "x", F.col("cell") == "b").first()
    assert r.ratio == pytest.approx((5 * 10 / 20 + 4 * 20 / 40) / (1 * 10 / 20 + 2 * 20 / 40)) and r.groups == 2
    assert A.mh_ratio(t, F.col("cell") == "x", F.col("cell") == "none").first().ratio is None


def test_intervals_hold_the_rate_and_need_two_groups(spark):
    t = spark.createDataFrame([("a", f"g{i}", i % 5, 20) for i in range(30)] + [("b", "g", 1, 10)], "k string, group string, errors long, words long")
    out = {r.k: r for r in A.intervals(t, "k").collect()}
    assert out["a"].low < out["a"].rate < out["a"].high and out["b"].low is None


@pytest.mark.parametrize(("share", "bucket"), [(None, "unmeasured"), (0.0, "none"), (0.049, "0-5%"), (0.05, "5-15%"), (0.15, "5-15%"), (0.151, ">15%")])
def test_overlap_edges(spark, share, bucket):
    assert spark.range(1).select(B.overlap_bucket(F.lit(share).cast("double")).alias("b")).first().b == bucket


def test_spans(spark):
    df = spark.sql("select array(named_struct('start', 0D, 'end', 2D), named_struct('start', 1D, 'end', 3D), named_struct('start', 5D, 'end', 6D)) a, array(named_struct('start', 1D, 'end', 5.5D)) b, cast(null as array<struct<start:double,end:double>>) n")
    r = df.select(I.merged(F.col("a")).alias("m"), I.minus(F.col("a"), F.col("b")).alias("d"), I.overlap_share(F.col("a"), F.lit(2.0)).alias("s"), I.overlap_share(F.col("n"), F.lit(2.0)).alias("u"), I.overlap_share(F.col("a"), F.lit(0.0)).alias("z"), I.within(F.col("a"), F.lit(0.5), F.lit(1.5)).alias("w")).first()
    assert [tuple(x) for x in r.m] == [(0, 3), (5, 6)] and [tuple(x) for x in r.d] == [(0, 1), (5.5, 6)]
    assert r.s == 1.0 and r.u is None and r.z == 0.0 and [tuple(x) for x in r.w] == [(0, 1), (0.5, 1)]


def test_touching_intervals_do_not_overlap(spark):
    a = spark.createDataFrame([(1, "e", 0.0, 10.0), (2, "e", 10.0, 20.0), (3, "e", 55.0, 300.0)], "i int, e string, s double, t double")
    b = spark.createDataFrame([("e", 10.0, 12.0, "x"), ("e", 100.0, 250.0, "y")], "e string, s2 double, t2 double, n string")
    got = J.interval_join(a, b, ["e"], ("s", "t"), ("s2", "t2"), 50.0)
    assert sorted((r.i, r.n) for r in got.collect()) == [(2, "x"), (3, "y")]
    assert [r.i for r in J.interval_join(a, b, ["e"], ("s", "t"), ("s2", "t2"), 50.0, "left_anti").collect()] == [1]


def test_latest_then_filter(spark):
    log = spark.createDataFrame([("v", 1, "a"), ("v", 1, "cleared"), ("w", 1, "a")], "k string, t int, d string").withColumn("id", F.monotonically_increasing_id())
    got = L.latest_then(log, ["k"], F.col("d") != "cleared", F.desc("t"), F.desc("id"))
    assert [r.k for r in got.collect()] == ["w"]


def test_filled_spans(spark):
    w = spark.createDataFrame([("s", 0, None, None), ("s", 1, 1.0, 2.0), ("s", 2, None, None), ("s", 3, None, None), ("s", 4, 4.0, 5.0)], "k string, i int, a double, b double")
    got = [(r.filled_start, r.filled_end) for r in L.filled_spans(w, "k", "i", "a", "b", 0.0, 6.0).orderBy("i").collect()]
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_mixture_weights_sum_to_one(spark):
    rows = spark.createDataFrame([(None, 2.0), (None, 1.0), ("a", 4.0), ("b", 9.0)], "group string, hours double")
    got = R.mixture_weights(rows, 0.4).collect()
    assert sum(r.weight for r in got) == pytest.approx(1) and sum(r.weight for r in got if r.group is None) == pytest.approx(0.4)
    assert {r.group: r.weight for r in got}["b"] == pytest.approx(0.6 * 3 / 5)


def test_seed_and_audit(spark):
    h = spark.createDataFrame([(1, 1, "asr", 1, None), (2, 1, "asr", 2, -0.5), (3, 2, "fusion", 5, None), (4, 2, "asr", 1, -0.1), (5, 2, "fusion", 4, None)], "id long, segment_id long, kind string, system_id int, logprob double")
    assert {r.segment_id: r.hypothesis_id for r in C.seed_hypothesis(h).collect()} == {1: 2, 2: 3}
    assert C.audit_sample([(i, float(i)) for i in range(10)], 0.2, 1) == C.audit_sample([(i, float(i)) for i in range(10)], 0.2, 1) <= set(range(5))


def test_draw_val_bounds(spark):
    eps = spark.createDataFrame([(f"e{i}", 0.2 + (i % 4) * 0.1, f"s{i % 6}") for i in range(60)], "external_id string, hours double, show_id string")
    for seed in range(3):
        got = C.draw_val(eps, 0.2, seed, 1.0).agg(F.sum("hours").alias("h")).first().h
        assert got <= 1.25 * 0.2 * eps.agg(F.sum("hours").alias("h")).first().h


def test_slots_need_overlap():
    words = [("a", 0, "one", 0.0, 1.0), ("b", 0, "One", 0.1, 1.1), ("c", 0, "two", 0.8, 1.8), ("a", 1, "x", 5.0, 6.0)]
    assert [sorted(s["words"]) for s in T.slots_of(words)] == [["a", "b"], ["c"], ["a"]]


def test_slices():
    assert T.slices_of([(0, 1), (1.3, 3), (10, 55)], 60) == [(0, 3), (10, 25), (25, 40), (40, 55)]
    assert T.slices_of([], 1.0) == [] and T.slices_of([(5, 5.5)], 60) == [(5, 7.0)]


@pytest.mark.parametrize(("ref", "hyp", "errors"), [("घर 45 दिन", "घर दिन", 1), ("don't go", "do not go", 0), ("5 हजार", "पाँच हजार", 0), ("KG", "केजी", 0), ("uh yes", "yes", 0), ("", "x", 1), ("फेस बुक", "Facebook", 0), ("twenty", "thirty", 1)])
def test_folded_errors(ref, hyp, errors):
    f = default_folder()
    steps = f.word_errors(ref, hyp)
    assert counts(steps).errors == errors
    assert [w for s in steps for w in s.ref] == f.tokens(ref) and [w for s in steps for w in s.hyp] == f.tokens(hyp)


def test_fold_parts():
    f = default_folder()
    assert f.key("पानी") == f.key("पानि") and f.rule("पानी", "पानि") == "vowel-length"
    assert f.is_number("४५") and f.is_number("दुईटा") and not f.is_number("एक") and script("queriesहरू") == "mix"
    assert spoken([5, 100, 40, 2]) == 542 and spoken([5, 20]) is None and f.variant("बन", "वन") == "ba-va"
    assert edit_distance("kitten", "sitting") == 3
    with pytest.raises(ValueError):
        Folder(table={"a": "b", "b": "c"})


def test_hazards():
    assert T.hazards_of(None, ["a b"])["hazards"] == ["unfused"]
    assert T.hazards_of("", ["one two", "one two"])["hazards"] == ["emptied"]
    assert T.hazards_of("one two", [])["unsupported_rate"] == 1.0
    assert "invention" in T.hazards_of("good day all of my dear friends", ["good day"])["hazards"]


def test_loops_agree(spark):
    for t, want in (("a b c " * 5, True), ("a b c " * 4 + "d", False), ("", False)):
        assert T.is_loop(t) is want
        assert spark.createDataFrame([(t,)], "t string").select(X.is_loop(F.col("t")).alias("l")).first().l is want


def test_voices_keep_apart():
    centroids: dict = {}
    first = V.assign_voices({"a": [1, 0], "b": [0, 1]}, ["a", "b"], centroids)
    assert V.assign_voices({"x": [0.9, 0.1], "y": [0.95, 0.05], "z": []}, ["x", "y", "z"], centroids) == {"y": first["a"], "x": "V0003"}
    assert np.isfinite(centroids["V0001"]).all()


def test_repartition_changes_nothing(rows):
    a, b = (sorted(map(tuple, E.breakdown(rows.repartition(n)).collect())) for n in (1, 7))
    assert a == b
