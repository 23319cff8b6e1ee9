"""Cuts of sequences against plain loops, with chunks small enough that they matter."""

import random

import pytest

from oratorio.operators import sequences as S


def plain_steps(values, budget):
    out, step, acc = [], 0, 0.0
    for v in values:
        out.append(step)
        acc += v
        if acc >= budget:
            step, acc = step + 1, 0.0
    return out


def test_steps_equal_the_loop(spark):
    r = random.Random(1)
    data = {"a": [r.choice([0.0, 0.5, 1.0, 2.5, 40.0]) for _ in range(500)], "b": [3.0], "c": [0.0] * 5, "d": [9.0, 9.0, 0.0, 0.0, 9.0], "e": [0.25] * 64}
    rows = spark.createDataFrame([(k, i * 3 - 7, v) for k, vs in data.items() for i, v in enumerate(vs)] + [("b", 99, None)], "k string, i int, v double")
    got = {}
    for x in S.group_steps(rows, "k", "i", "v", 9.0).orderBy("i").collect():
        got.setdefault(x.k, []).append(x.step)
    data["b"].append(0.0)
    assert got == {k: plain_steps(vs, 9.0) for k, vs in data.items()}
    assert S.group_steps(rows.limit(0), "k", "i", "v", 9.0).count() == 0


def test_running_sums_over_chunks(spark):
    rows = spark.createDataFrame([(k, i, i % 7) for k in "ab" for i in range(100)], "k string, i int, v int")
    for x in S.running(rows, "k", "i", rows["v"], chunk=9).collect():
        assert (x["index"], x["before"]) == (x.i, sum(j % 7 for j in range(x.i)))
    least = {(x.k, x.i): x.m for x in S.running_least(rows.selectExpr("k", "i", "50 - i * i % 31 as v"), "k", "i", "v", "m", chunk=9).collect()}
    assert all(m == min(50 - j * j % 31 for j in range(i + 1)) for (_, i), m in least.items())


def plain_windows(words, target, most):
    total, n = sum(words), len(words)
    count = max(1, -(-total // target), -(-n // most))
    groups, elapsed = [[]], 0
    for w in words:
        g = len(groups)
        crossed = elapsed + w / 2 > total / count * g if total else sum(map(len, groups)) >= n / count * g
        if g < count and groups[-1] and (crossed or len(groups[-1]) >= most):
            groups.append([])
        groups[-1].append(w)
        elapsed += w
    return [k for k, g in enumerate(groups) for _ in g]


@pytest.mark.parametrize("most", [250, 6])
def test_windows_equal_the_loop(spark, most):
    r = random.Random(2)
    data = {f"k{c}": [r.choice([0, 1, 5, 30, 200]) for _ in range(r.randrange(1, 60))] for c in range(30)} | {"none": [0] * 20, "one": [7]}
    rows = spark.createDataFrame([(k, i, w, "x") for k, ws in data.items() for i, w in enumerate(ws)], "k string, i int, w int, other string")
    got = {}
    for x in S.balanced_windows(rows, "k", "i", "w", 64, most).orderBy("i").collect():
        got.setdefault(x.k, []).append(x.window)
    assert got == {k: plain_windows(ws, 64, most) for k, ws in data.items()}


def test_random_windows_keep_their_rules(spark):
    rows = spark.createDataFrame([(i, float(i % 30), (i % 50) / 100) for i in range(400)] + [(1000, None, 0.5), (1001, 5.0, None)], "c int, s double, p double")
    out = S.random_windows(rows, "c", "s", "p", seed=3).collect()
    assert out == S.random_windows(rows, "c", "s", "p", seed=3).collect() != S.random_windows(rows, "c", "s", "p", seed=4).collect()
    full = 0
    for x in out:
        wins = sorted((w.start, w.length) for w in x.windows)
        assert all(0 <= s and s + d <= x.s + 1e-9 for s, d in wins)
        assert all(s1 + d1 + 0.05 <= s2 for (s1, d1), (s2, _) in zip(wins, wins[1:]))
        covered = sum(d for _, d in wins)
        assert not wins or covered <= min(0.6, 1.5 * x.p) * x.s + 1e-9
        full += bool(wins) and covered >= x.p * x.s
    assert full > 200 and not [x for x in out if x.c >= 1000 and x.windows]


def test_quantiles_are_met(spark):
    u = spark.range(1).select(*[S.interpolated(S.F.lit(q), S.WINDOW_SECONDS).alias(f"q{k}") for k, (q, _) in enumerate(S.WINDOW_SECONDS)]).first()
    assert list(u) == [pytest.approx(v) for _, v in S.WINDOW_SECONDS]
