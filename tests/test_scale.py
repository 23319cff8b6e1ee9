"""What keeps work in proportion to the input, in many tasks and in bounded memory."""

import pyarrow as pa
import pytest

from oratorio.functions import fold
from oratorio.operators import lanes as L
from oratorio.operators import scoring as S
from oratorio.operators import texts as T
from oratorio.plans import registry


@pytest.mark.parametrize("name", ["c1_align", "c14_error_rows", "c24_score_clip", "c25_hazards", "c26_matched", "c27_placed", "r5_clip_detail"])
def test_alignment_of_one_file_is_many_tasks(spark, sf, name):
    assert registry.queries()[name](spark, sf).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_scores_of_one_file_are_many_tasks(spark):
    clips = spark.createDataFrame([(str(k), "a b", "a c") for k in range(4)], "clip string, ref string, hyp string").coalesce(1)
    assert S.scored(clips, "now").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_words_of_one_script_are_not_compared_with_all_pairs_of_the_other_side():
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    before = fold.script.cache_info()
    fold.Folder().align(words, words[::-1])
    after = fold.script.cache_info()
    assert after.hits + after.misses - before.hits - before.misses < 40 * len(words)


def test_merges_are_found_beside_quick_paths():
    f = fold.Folder()
    assert [s.kind for s in f.align("can not go".split(), "cannot go".split())] == ["merge", "match"]
    assert [s.kind for s in f.align(["twenty", "one"], ["21"])] == ["merge"]
    assert f.trace("don't")[-1] == f.key("don't") and len(f.trace("don't")) == len(f.stage_names) == len(f.trace("किमी"))


def test_stages_of_a_caller_see_ascii():
    assert fold.Folder(dialect=(("upper", lambda key, word: key.upper()),)).key("ab") == "AB"


def test_aligned_keeps_rows_in_order_over_slices(spark):
    n = 3 * T.SLICE + 5
    rows = spark.createDataFrame([(k, " ".join(["w"] * (k % 7)), "w") for k in range(n)], "k int, ref string, hyp string").coalesce(1)
    got = {r.k: len(r.x) for r in rows.select("k", T.aligned(rows.ref, rows.hyp).alias("x")).collect()}
    assert got == {k: max(1, k % 7) for k in range(n)}


def test_words_are_placed_a_slice_of_clips_at_a_time():
    n = 2 * L.SLICE + 1
    seed = [{"word": "a", "start": 0.5, "end": float("nan")}]
    batch = pa.RecordBatch.from_pydict({"clip": [str(k) for k in range(n)], "words": [["a", "b"]] * (n - 1) + [None], "seed": [seed] * n})
    made = list(L._placing("clip", L.on_clock)([batch]))
    assert [b.num_rows for b in made] == [2 * L.SLICE, 2 * L.SLICE, 0]
    assert made[0].to_pylist()[:2] == [{"clip": "0", "pos": 0, "word": "a", "start": 0.5, "end": None}, {"clip": "0", "pos": 1, "word": "b", "start": None, "end": None}]


def test_moments_of_little_input_are_many_tasks(spark):
    words = spark.createDataFrame([(str(c), s, k, "w", k * 0.4, k * 0.4 + 0.3) for c in range(6) for s in "ab" for k in range(5)], "clip string, system string, position int, word string, start double, end double")
    found = L.slot_words(words, "clip")
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted((r.clip, r.slot, r.system) for r in found.collect()) == [(str(c), k, s) for c in range(6) for k in range(5) for s in "ab"]
