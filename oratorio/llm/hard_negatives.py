"""Hard negatives by product quantisation with stored residual norms.

Vectors are integers, scores inner products. A vector is cut into short parts, each named by the nearest
of up to 256 centroids; beside the codes, the norm of what the centroids leave of each part is stored. An
anchor's table of products with all centroids gives an approximate score by lookups, and the sum over the
parts of (anchor's norm) * (residual's norm) bounds its error (Cauchy-Schwarz). Lower bounds of a block's
rows give a threshold that the best must pass; only rows whose upper bound reaches it are scored exactly,
in integers. The filter is rigorous, so that results equal those of brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import bytes_matrix, cells, collapsed, finite, matrix, padded, sample, without_one
from .common import table, written

#: Components in a part, centroids of a part, rows of the sample that they are fitted to.
PART, CENTROIDS, SAMPLE = 2, 256, 4096
#: Integer vectors of this squared norm or more take no part: a hundred times a product must fit a long.
MOST_NORM = 2.0**56
#: Anchors that are looked up together.
TOGETHER = 64


def fit(points: np.ndarray, width: int, part: int = PART, centroids: int = CENTROIDS, rounds: int = 8, seed: int = 11) -> list[np.ndarray]:
    """The centroids of each part, by k-means over the points; one of zero where there are no points."""
    random, out = np.random.default_rng(seed), []
    for at in range(0, width, part):
        x = points[:, at : at + part] if len(points) else np.zeros((1, min(part, width - at)))
        u = np.unique(x, axis=0)
        c = u[random.choice(len(u), min(centroids, len(u)), replace=False)]
        for _ in range(rounds if len(c) < len(u) else 0):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            sums = np.stack([np.bincount(near, x[:, k], len(c)) for k in range(x.shape[1])], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append(c)
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    far = (c * c).sum(1)
    return np.concatenate([(far - 2 * x[at : at + 4096] @ c.T).argmin(1) for at in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def encode(x: np.ndarray, book: list[np.ndarray], part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Codes, a byte a part, and the norms of the parts' residuals (a little raised, never lowered)."""
    codes, rest = [], []
    for k, c in enumerate(book):
        y = x[:, k * part : (k + 1) * part]
        near = _nearest(y, c)
        codes.append(near.astype(np.uint8))
        rest.append(np.linalg.norm(y - c[near], axis=1) * (1 + 1e-9))
    return np.stack(codes, 1), np.stack(rest, 1)


def _encoded(groups: DataFrame, book: list[np.ndarray], part: int) -> DataFrame:
    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            codes, rest = encode(matrix(t.column("vector"), np.float64), book, part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(rest), pa.list_(pa.float64()))], [*b.schema.names, "code", "rest"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return groups.mapInArrow(run, f"{kinds}, code binary, rest array<double>")


class _Bounds:
    """Approximate scores and error bounds of a block's rows with anchors, and exact scores on demand."""

    def __init__(self, rows: pa.Table, book: list[np.ndarray], part: int) -> None:
        self.book, self.part = book, part
        self.codes, self.rest, self.x = bytes_matrix(rows.column("code")), matrix(rows.column("rest"), np.float64), matrix(rows.column("vector"), np.int64)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))

    def of(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the exact scores, a row an anchor."""
        a = anchors.astype(np.float64)
        score, norms = np.zeros((len(self.codes), len(a))), []
        for k, c in enumerate(self.book):
            own = a[:, k * self.part : (k + 1) * self.part]
            score += (c @ own.T)[self.codes[:, k]]  # the lookup table of the part
            norms.append(np.linalg.norm(own, axis=1))
        # what rounding of doubles may add is far below this slack
        error = self.rest @ np.stack(norms) * (1 + 1e-9) + 1e-9 * np.outer(self.norm, np.linalg.norm(a, axis=1)) + 1e-6
        return (score - error).T, (score + error).T

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.x[at] * anchor).sum(1)


def _best(score: np.ndarray, first_id: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((first_id, -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _positive_kernel(book: list[np.ndarray], part: int, k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        bounds, label, first, g = _Bounds(rows, book, part), *(rows.column(c).to_numpy() for c in ("label", "first_id", "g"))
        asked, a, own = anchors.column("g").to_numpy(), matrix(anchors.column("vector"), np.int64), anchors.column("label").to_numpy()
        out = []
        for at in range(0, len(a), TOGETHER):
            low, high = bounds.of(a[at : at + TOGETHER])
            for i in range(len(low)):
                same = np.flatnonzero(label == own[at + i])
                same = same[high[i, same] >= _kth(low[i, same], k)]
                score = bounds.exact(a[at + i], same)
                best = _best(score, first[same], k)
                out.append((np.full(len(best), asked[at + i]), g[same[best]], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], ["a", "g", "score"])

    return run


def _negative_kernel(book: list[np.ndarray], part: int, k: int, low_share: int, high_share: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        bounds, label, first, g = _Bounds(rows, book, part), *(rows.column(c).to_numpy() for c in ("label", "first_id", "g"))
        asked, a, own, windows = anchors.column("g").to_numpy(), matrix(anchors.column("vector"), np.int64), anchors.column("label").to_numpy(), anchors.column("positives").to_pylist()
        out = [(np.empty(0, np.int64),) * 4]
        for at in range(0, len(a), TOGETHER):
            low, high = bounds.of(a[at : at + TOGETHER])
            for i in range(len(low)):
                other = np.flatnonzero(label != own[at + i])
                lo, hi = low[i, other], high[i, other]
                for p in windows[at + i]:
                    least, most = low_share * p / 100, high_share * p / 100
                    # a slack for the rounding of these two numbers, on the side that keeps rows
                    slack = 1e-9 * abs(p)
                    met = (hi >= least - slack) & (lo <= most + slack)
                    sure = met & (lo >= least + slack) & (hi <= most - slack)
                    left = other[met & (hi >= _kth(lo[sure], k))]
                    score = bounds.exact(a[at + i], left)
                    inside = (low_share * p <= 100 * score) & (100 * score <= high_share * p)
                    left, score = left[inside], score[inside]
                    best = _best(score, first[left], k)
                    out.append((np.full(len(best), asked[at + i]), np.full(len(best), p), g[left[best]], score[best]))
        return pa.table([np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)], ["a", "positive_score", "g", "score"])

    return run


def hard_negatives(
    rows: DataFrame, is_anchor: Column, row_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90, scale: int = 256, part: int = PART, centroids: int = CENTROIDS, sample_size: int = SAMPLE,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x). An anchor's positives are its first `positives` other rows of
    its label by score, ties by smaller id; for each, the first `negatives` rows of other labels with
    low_share * positive_score <= 100 * negative_score <= high_share * positive_score.

    Rows with a null id, label, vector or component, or one that is not finite, take no part, and neither
    do those whose integers have a squared norm of 2**56 or more, as products would not fit. Shorter
    vectors count as ended with zeros. Repeated rows are rows of their own: an anchor's copy with the same
    id may be its positive, and a repeated anchor is answered once for each time. A positive without rows
    in its window gives no row. An empty table gives none. Extra columns are ignored.
    """
    spark = rows.sparkSession
    v = F.col("v")
    own = rows.select(rows[f"`{row_id}`"].cast("long").alias("id"), rows[f"`{label}`"].cast("long").alias("label"), rows[f"`{vector}`"].alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    own = own.where("id is not null and label is not null").where(finite(v))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    small = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * F.lit(float(scale))).cast("double"), 2)) < F.lit(MOST_NORM)
    own, width = padded(own.where(small).select("id", "label", "is_anchor", whole.alias("vector")))
    groups = collapsed(own, ["vector", "label"], max(positives + 1, negatives), "vector-groups")
    book = fit(sample(groups, "vector", sample_size), width, part, centroids)
    groups = written(_encoded(groups, book, part), "codes")
    anchors = own.where("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), F.col("id").alias("anchor_id"), "vector", "label")
    anchors = written(anchors.join(groups.select("vector", "label", F.col("g").alias("a")), ["vector", "label"]).select("anchor", "anchor_id", "a"), "anchors")
    asked = groups.join(anchors.select(F.col("a").alias("g")).distinct(), "g", "left_semi").select("g", "vector", "label")
    asked = written(asked, "anchor-vectors")

    ids = groups.select("g", "ids")
    first = lambda *key: Window.partitionBy(*key).orderBy(F.desc("score"), "first_id")
    near = cells(groups.drop("ids"), asked, _positive_kernel(book, part, positives + 1), "a bigint, g bigint, score bigint").join(groups.select("g", "first_id", "ids"), "g")
    near = near.withColumn("n", F.row_number().over(first("a"))).where(F.col("n") <= positives + 1).select("a", "g", "score", "ids")
    each = anchors.join(written(near, "positives"), "a")
    each = each.select("anchor", "anchor_id", "a", "score", F.explode(F.when(F.col("a") == F.col("g"), without_one(F.col("ids"), F.col("anchor_id"))).otherwise(F.col("ids"))).alias("positive_id"))
    by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    each = written(each.withColumn("n", F.row_number().over(by_anchor)).where(F.col("n") <= positives).select("anchor_id", "a", "positive_id", F.col("score").alias("positive_score")), "positives")

    # the windows of all anchors with the same vector and label: at most positives + 1 different scores
    windows = written(asked.join(each.groupBy(F.col("a").alias("g")).agg(F.sort_array(F.collect_set("positive_score")).alias("positives")), "g"), "windows")
    far = cells(groups.drop("ids"), windows, _negative_kernel(book, part, negatives, low_share, high_share), "a bigint, positive_score bigint, g bigint, score bigint").join(groups.select("g", "first_id"), "g")
    far = far.withColumn("n", F.row_number().over(first("a", "positive_score"))).where(F.col("n") <= negatives)
    far = far.join(ids, "g").select("a", "positive_score", F.col("score").alias("negative_score"), F.explode("ids").alias("negative_id"))
    ranked = Window.partitionBy("a", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    far = written(far.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives), "negatives")
    return each.join(far, ["a", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings by hard_negatives; where vec_id is divisible by 7, label first becomes (label+1)%10.
    Anchors are rows whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
with own as (
    select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select a.row as anchor, a.vec_id as anchor_id, a.label as own_label, b.row, b.vec_id, b.label,
        list_inner_product(a.v, b.v)::bigint as score
    from own a join own b on a.row <> b.row
    where a.vec_id % 100 = 0
), positives as (
    select anchor, anchor_id, own_label, row as positive, vec_id as positive_id, score as positive_score
    from pairs where label = own_label
    qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id,
    row_number() over (partition by p.anchor, p.positive order by n.score desc, n.vec_id)::integer as rank,
    n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on n.anchor = p.anchor and n.label <> p.own_label
where 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor, p.positive order by n.score desc, n.vec_id) <= 10
"""
