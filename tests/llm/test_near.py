"""Near copies that only bands of many texts can bring together are found, each pair."""

import random

import pytest

from oratorio.llm import simhash


def _edited(words, n, of, rng):
    """n words changed, so that all bands stay."""
    words = list(words)
    while n:
        new = list(words)
        new[rng.randrange(len(words))] = f"e{rng.randrange(1 << 40)}"
        if simhash.bands(simhash.shingles(" ".join(new), 5)) == of:
            words, n = new, n - 1
    return words


@pytest.fixture(scope="module")
def planted():
    """60 pairs of near copies; all 120 texts have the same bands, and other pairs are below 0.8."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(1 << 40)}" for _ in range(400)]
    of = simhash.bands(simhash.shingles(" ".join(base), 5))
    texts = []
    for _ in range(60):
        x = _edited(base, 8, of, rng)
        texts += [x, _edited(x, 5, of, rng)]
    texts = [" ".join(t) for t in texts]
    ids = rng.sample(range(1000), 120)
    h = [simhash.shingles(t, 5) for t in texts]
    alike = {(i, j) for i in range(120) for j in range(i) if simhash._jaccard(h[i], h[j]) >= 0.8}
    assert alike == {(2 * k + 1, 2 * k) for k in range(60)}
    return list(zip(range(120), ids, texts, strict=True))


# of 1024 texts: one task; of 32: rounds, and what they leave by blocks
@pytest.mark.parametrize("home", [1024, 32])
def test_pairs_of_a_large_band(spark, planted, monkeypatch, home):
    monkeypatch.setattr(simhash, "HOME", home, raising=False)
    got = simhash.representatives(spark.createDataFrame(planted, "row long, doc_id long, text string"), "row", "text", "doc_id").collect()
    ids = {row: doc_id for row, doc_id, _ in planted}
    assert {r.row for r in got} == {min(2 * k, 2 * k + 1, key=ids.get) for k in range(60)} and len(got) == 60


def test_sizes_tell_what_is_not_alike():
    x = simhash.shingles(" ".join(f"w{i}" for i in range(104)), 5)
    assert simhash._jaccard(x[:80], x, 0.8) == 0.8 and simhash._jaccard(x[:79], x, 0.8) < 0.8


def test_texts_that_stay_are_not_shuffled(spark, planted, monkeypatch):
    """Whatever the size of the tables; the rows are the same where more go than are broadcast."""
    docs = spark.createDataFrame([r[1:] for r in planted] + [(None, planted[0][2]), (2000, None), (2001, "")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = simhash.simhash_stage(spark, docs, None)
        want = sorted(min(planted[2 * k][1], planted[2 * k + 1][1]) for k in range(60)) + [2000]
        assert sorted(r.doc_id for r in out.collect()) == sorted(want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(simhash, "MOST_PAIRS", -1)
        assert sorted(r.doc_id for r in simhash.simhash_stage(spark, docs, None).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
