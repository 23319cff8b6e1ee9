"""Exact samples, ranks and similarities against plain loops, with ties."""

import difflib
import hashlib
import random

import pytest

from oratorio.operators import choices as C
from oratorio.operators import reports as R
from oratorio.operators import texts as T
from oratorio.operators import vectors as V


@pytest.mark.parametrize("scores", [[float(i * 7 % 13) for i in range(101)], [0.5] * 40, [1.0], [None, 2.0, 1.0], [None], [1.0, 1e9, *[2.0] * 30]])
@pytest.mark.parametrize("rate", [0.05, 0.9])
def test_audit_samples_are_exact(spark, scores, rate):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id int, s double")
    kept = sorted((s, i) for i, s in enumerate(scores) if s is not None)
    half = [i for _, i in kept[: max(1, len(kept) // 2)]]
    want = sorted(half, key=lambda i: (hashlib.md5(f"{i}:3".encode()).hexdigest(), i))[: max(1, round(len(kept) * rate))]
    assert {r.id for r in C.audit_exact(rows, "id", "s", rate, 3, buckets=8).collect()} == set(want)


def test_index_percentiles(spark):
    data = {"a": [float(i * 31 % 97) for i in range(500)], "b": [3.0] * 50, "c": [1.0], "d": [float(i) for i in range(41)]}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    got = {r.k: (r.low, r.high) for r in R.index_percentiles(rows, "k", "v", 0.025, 0.975).collect()}
    for k, vs in data.items():
        vs = sorted(vs)
        at = int(0.975 * len(vs)) - 1
        assert got[k] == (vs[int(0.025 * len(vs))], vs[at] if at >= 0 else None)


def test_pseudo_rows_without_a_log_probability_stay(spark):
    rows = [(i, 10, 5.0, None if i % 4 == 0 else -float(i), False, 0.0, "x") for i in range(40)] + [(100, 10, 5.0, -99.0, True, 0.0, "x"), (101, 10, 5.0, -99.0, False, 0.9, "x"), (102, 10, 5.0, -99.0, False, None, " ")]
    df = spark.createDataFrame(rows, "id int, n_tokens int, duration double, mean_logprob double, looped boolean, overlap_share double, text string")
    got = {r.id: r.reason for r in R.filtered_pseudo(df, 0.5, 40, 0.1, 0.18, ["id"]).collect()}
    assert {i for i, r in got.items() if r == "confidence"} == {39, 38, 37, 35} and (got[100], got[101], got[102]) == ("loop", "overlap", "empty") and len(got) == 43


def test_disagreement_by_matching_blocks(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(12))) for _ in range(300)]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()
    for a, b in zip(texts, texts[1:], strict=False):
        x, y = a.split(), b.split()
        assert 2 * T.matched_words(x, y) == pytest.approx(ratio(a, b) * (len(x) + len(y)) if x or y else 0)
    rows = [(i, texts[3 * i : 3 * i + 3]) for i in range(20)] + [(90, ["one"]), (91, []), (92, None), (93, ["", ""])]
    got = {x.i: x.disagreement for x in T.disagreements(spark.createDataFrame(rows, "i int, t array<string>"), "i", "t").collect()}
    for i, t in rows[:20]:
        assert got[i] == pytest.approx(1 - (ratio(t[0], t[1]) + ratio(t[0], t[2]) + ratio(t[1], t[2])) / 3)
    assert got[90] == got[91] == got[92] == got[93] == 0.0


@pytest.mark.parametrize("most", [10_000, 0])
def test_suggestions_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(V, "MOST_PRINTS", most)
    monkeypatch.setattr(V, "BLOCK", 4)
    monkeypatch.setattr(V, "SALTS", 3)
    r = random.Random(9)
    vector = lambda: [r.gauss(0, 1) for _ in range(3)]
    prints = [(g, f"v{i:02d}", vector()) for g in (0, 1) for i in range(20)] + [(2, "only", [1.0, 0.0, 0.0]), (1, "v99", None), (1, "zero", [0.0] * 3)]
    rows = [(i, i % 4, vector()) for i in range(60)] + [(90, 0, None), (91, 0, [0.0] * 3)]
    got = {x.id: (x.voice, x.cosine, x.second) for x in V.suggestions(spark.createDataFrame(rows, "id int, group int, vector array<double>"), spark.createDataFrame(prints, "group int, voice string, print array<double>"), 0.05).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {}
    for i, g, v in rows[:60]:
        best = sorted((-cosine(v, p), name) for h, name, p in prints if h == g and p and any(p))
        if best and (len(best) == 1 or best[1][0] - best[0][0] >= 0.05):
            want[i] = (best[0][1], pytest.approx(-best[0][0]), pytest.approx(-best[1][0]) if len(best) > 1 else None)
    assert got == want and len(want) > 20
