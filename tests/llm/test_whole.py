"""Whole jobs: what a cut by prefix, by id or by count would lose."""

import numpy as np

from oratorio.llm import fingerprints, media


def test_op3_counts_repeated_terms(spark):
    p = " ".join(f"w{i}" for i in range(40))
    q = " ".join(f"v{i}" for i in range(40))
    rows = [(1, p), (2, " ".join([p] * 200)), (3, " ".join([p] * 20 + [q] * 20)), (4, " ".join([p] * 20 + [q] * 60)), (5, ""), (6, "x y"), (6, "x y")]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), n_samples=256).collect()
    assert len(got) == len(rows)
    fp = {r.doc_id: r.fingerprint for r in got}
    like = lambda a, b: sum(fp[a][4 * k : 4 * k + 4] == fp[b][4 * k : 4 * k + 4] for k in range(256)) / 256
    assert like(1, 2) < 0.05  # 36 of some 8000 shingles
    assert abs(like(3, 4) - 0.5) < 0.12  # as often p, a third of q
    assert fp[5] == "0" * 4 * 256


def test_op2_describes_faint_parts(spark):
    """A crop of a faint part, beside a part with many stronger corners, is found."""
    random = np.random.default_rng(3)
    strong, faint = (np.kron(random.normal(0, 1, (40, 20)), np.ones((8, 8))) for _ in range(2))
    a = np.hstack([127 + 50 * strong, 127 + 8 * faint])
    rows = spark.createDataFrame([(1, media.encode(a)), (2, media.encode(random.normal(127, 50, a.shape)))], "id long, media binary")
    crop = spark.createDataFrame([(9, media.encode(a[60:260, 180:310]))], "id long, media binary")
    found = {r.image: r.agree for r in media.matches(media.described(crop, "bigint", scales=media.FINE), media.described(rows, "bigint")).collect()}
    assert found.get(1, 0) >= 20 and 2 not in found


def _brute(q, images):
    """The image with the most agreement, each compared with the query corner by corner."""
    own = {c: v for c, v in media.describe(q[None].astype(np.float32), media.FINE).items() if c != "image"}
    return [media.agreement(own, i) for i in images]


def test_op2_recall_against_brute_force(spark):
    """Copies that are cropped, noisy, resized and turned, among 60 pictures of squares: of the pairs that
    brute force finds, the index finds 0.9."""
    random = np.random.default_rng(8)
    pictures = [media.decode(media.drawn(random.normal(0, 1, 64).tolist())) for _ in range(60)]
    edits = []
    for k, a in enumerate(pictures[:24]):
        kind = k % 4
        edits.append([lambda: 18 + 0.8 * a[9:88, 8:86], lambda: a + random.normal(0, 8, a.shape), lambda: media._resized(a[None], 0.9)[0], lambda: np.rot90(a[8:])][kind]())
    frame = lambda xs: spark.createDataFrame([(k, bytearray(media.encode(x))) for k, x in enumerate(xs)], "id long, media binary")
    got = {(r.query, r.image): r.agree for r in media.matches(media.described(frame(edits), "bigint", scales=media.FINE), media.described(frame(pictures), "bigint")).collect()}
    described = [{c: v for c, v in media.describe(media.decode(media.encode(a))[None].astype(np.float32)).items() if c != "image"} for a in pictures]
    want = {(q, i): n for q, e in enumerate(edits) for i, n in enumerate(_brute(media.decode(media.encode(e)), described)) if n >= media.AGREE}
    assert all((k, k) in want for k in range(24))
    assert all(want[p] == n for p, n in got.items()) and len(got) >= 0.9 * len(want)
    assert sum((k, k) in got for k in range(24)) >= 22
