"""Clip facts by hand: who counts, who dominates, what is not measured."""

from oratorio.operators import facts as C

CLIPS = "clip string, episode string, start double, end double, pot string, split string"


def test_clip_facts(spark):
    clips = spark.createDataFrame([("a", "e", 0.0, 10.0, "gold", "train"), ("b", "e", 10.0, 20.0, "train", "train"), ("quiet", "e", 50.0, 60.0, "train", "train"), ("val", "f", 0.0, 10.0, "train", "val"), ("none", "g", 0.0, 10.0, "train", "train")], CLIPS)
    runs = spark.createDataFrame([(1, "e", {"x": "old"}), (2, "e", {"s1": "ann", "s2": "bob"}), (3, "f", None)], "run int, episode string, voices map<string,string>")
    turns = spark.createDataFrame([
        (1, "x", 0.0, 100.0), (2, "s1", 0.0, 4.0), (2, "s2", 3.5, 6.5), (2, "s1", 6.0, 12.0), (2, "s3", 9.9, 10.1), (2, "s2", 14.0, 19.0), (2, "s3", 19.0, 20.0), (3, "s1", 1.0, 2.0), (3, "s0", 3.0, 4.0),
    ], "run int, speaker string, start double, end double")
    got = {r.clip: tuple(r)[1:] for r in C.clip_facts(clips, runs, turns).collect()}
    assert got == {
        "a": (True, 2, 2, "s1", "ann", 2.0),
        "b": (True, 3, 3, "s2", "bob", 5.0),
        "quiet": (True, 0, 0, None, None, None),
        "val": (True, 2, 1, "s0", None, None),
        "none": (False, None, None, None, None, None),
    }
    assert {r.voice: r.seconds for r in C.voice_seconds(clips, runs, turns).collect()} == {"ann": 2.0, "bob": 5.0}
    assert C.clip_facts(clips.limit(0), runs, turns).count() == 0 and C.clip_facts(clips, runs.limit(0), turns).where("diarized").count() == 0
