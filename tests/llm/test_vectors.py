"""Hard negatives and nearest neighbours against brute force, on hard rows, and what their filters promise."""

import numpy as np
import pytest

from oratorio.llm import hard_negatives as H
from oratorio.llm import multi_index as M
from tests.oracle import connect, rows_of, rows_of_sql

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """rows of (vec_id, embedding, label), with columns whose names clash with our own."""
    return spark.createDataFrame([(*r, 1, "z", [0], 2) for r in rows], "vec_id long, embedding array<float>, label int, g long, code string, ids array<int>, rank int")


def crowd(seed, n=300, copies=90, width=24):
    """Vectors with a hot group of equal ones, a cluster of near ones, ties, and rows that take no part."""
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.3, (n, width))
    x[:copies] = x[0]
    x[copies : copies + 40] = x[1] + r.normal(0, 0.001, (40, width))
    x[200:230] = np.round(x[200:230], 1)
    rows = [(int(i) if i % 50 else int(i), [float(np.float32(v)) for v in x[i]], int(r.integers(0, 3))) for i in range(n)]
    rows += [(100, rows[100][1], 1), (100, rows[100][1], rows[100][2]), (rows[7][0], rows[8][1], 2)]
    rows += [(400, None, 1), (500, [1.0, None], 1), (600, [NAN] * width, 1), (None, rows[3][1], 1), (700, rows[3][1], None), (800, [INF, 1.0], 1), (801, [3e38] * width, 1), (900, [0.0] * width, 1), (901, [], 1), (950, [0.5], 2)]
    return rows


def valid(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]


def brute_negatives(rows, width=24):
    own = [(i, np.array([int(np.floor(256 * v)) for v in v] + [0] * (width - len(v)), object), label) for i, v, label in valid(rows) if label is not None]
    own = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in own if float((v.astype(float) ** 2).sum()) < H.MOST_NORM]
    out = []
    for k, (i, v, label) in enumerate(own):
        if i % 100:
            continue
        scored = sorted((-int((v * w).sum()), j, m) for n, (j, w, m) in enumerate(own) if n != k)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, tmp_path, seed):
    rows = crowd(seed)
    frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in H.op11_hard_negatives(spark, str(tmp_path)).collect()]
    assert sorted(got) == brute_negatives(rows) and len(got) > 20


def test_hard_negatives_as_sql_with_ties(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 8) / 8], int(r.integers(0, 4))) for i in range(400)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(H.op11_hard_negatives(spark, str(tmp_path))) == rows_of_sql(connect(str(tmp_path)), H.OP11_SQL)


def test_bounds_hold_the_exact_score(spark):
    """The filter is rigorous: every exact score lies within its bounds, also for vectors far off the sample."""
    import pyarrow as pa

    r = np.random.default_rng(4)
    for scale in (1, 256, 10**6):
        x = np.floor(r.normal(0, scale, (500, 13))).astype(np.int64)
        book = H.fit(x[:60].astype(float), 13)
        codes, rest = H.encode(x.astype(float), book)
        t = pa.table({"code": [c.tobytes() for c in codes], "rest": list(rest), "vector": list(x)})
        bounds = H._Bounds(t, book, H.PART)
        low, high = bounds.of(x[:50])
        exact = x[:50] @ x.T
        assert np.all(low <= exact) and np.all(exact <= high)
        assert np.median(high - low) < 2 * np.median(np.abs(exact))


def test_empty_tables(spark, tmp_path):
    frame(spark, [(100, [1.0], 1)]).limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert H.op11_hard_negatives(spark, str(tmp_path)).count() == 0 and M.op12_nearest_neighbours(spark, str(tmp_path)).count() == 0
    frame(spark, [(100, [1.0], 1), (200, None, 2)]).write.parquet(f"{tmp_path}/one/embeddings.parquet")
    assert H.op11_hard_negatives(spark, f"{tmp_path}/one").count() == 0 and M.op12_nearest_neighbours(spark, f"{tmp_path}/one").count() == 0


def brute_nearest(rows, width=24, k=5):
    own = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v, _ in valid(rows) if any(v)]
    out = {}
    for n, (i, v) in enumerate(own):
        if i % 50 == 0:
            scored = sorted((-float(M.cosines(w[None], v)[0]), j) for m, (j, w) in enumerate(own) if m != n)
            out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_nearest_on_hard_rows(spark, tmp_path, seed):
    """So few rows that all are in the sample: with copies, ties and near copies nothing may be lost."""
    rows = crowd(seed)
    frame(spark, rows).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in sorted(M.op12_nearest_neighbours(spark, str(tmp_path)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want, hit, total = brute_nearest(rows), 0, 0
    assert set(got) == set(want)
    for q, lists in want.items():
        assert len(got[q]) == sum(map(len, lists)) and {n for n, _, _ in got[q]} == set(range(1, 6))
        if len(lists) > 1:
            continue  # a repeated query is answered once for each time
        near = {j for j, _ in lists[0]}
        exact = {j: s for j, s in lists[0]}
        hit, total = hit + sum(j in near for _, j, _ in got[q]), total + len(near)
        assert all(abs(s - exact[j]) < 1e-12 for _, j, s in got[q] if j in exact)
        assert [s for _, _, s in got[q]] == sorted((s for _, _, s in got[q]), reverse=True)
    assert hit >= 0.97 * total


def test_recall_beyond_the_sample(spark, tmp_path):
    """3,000 random vectors, a quarter of them in the sample: recall of at least 0.9."""
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 48)).astype(np.float32)
    df = frame(spark, [(i, [float(v) for v in row], 0) for i, row in enumerate(x)])
    got = M.nearest(df, df.vec_id % 50 == 0, sample_size=750).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {q: set(np.argsort(-np.where(np.arange(3000) == q, -2, u @ u[q]))[:5].tolist()) for q in range(0, 3000, 50)}
    assert sum(g.vec_id in best[g.query_id] for g in got) >= 0.9 * 300


def test_probing_finds_every_code_within_the_radius():
    r = np.random.default_rng(10)
    for n_bytes in (1, 3, 8, 32):
        codes = r.integers(0, 256, (600, n_bytes)).astype(np.uint8)
        codes[100:300] = codes[0] ^ (r.random((200, n_bytes)) < 0.2) * (1 << r.integers(0, 8, (200, n_bytes)))
        probe = M.Probe(codes)
        for radius in (0, 1, n_bytes - 1, n_bytes, 2 * n_bytes + 1, 3 * n_bytes, 8 * n_bytes):
            near = np.bitwise_count(codes ^ codes[0]).sum(1) <= radius
            assert np.array_equal(probe.within(codes[0], radius), np.flatnonzero(near)), (n_bytes, radius)
