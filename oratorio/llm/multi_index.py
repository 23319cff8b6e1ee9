"""Approximate nearest neighbours by multi-index hashing.

A vector's code has a bit for the sign of each of its coordinates after learned rotations. Codes are split
into substrings of a byte, and a block of rows has an index of each substring: for each of its 256 values
the rows that have it. Codes that differ in at most r bits differ in at most t_j bits in some substring j,
wherever the t_j + 1 sum to r + 1 (pigeonhole): probing each index at the values within t_j bits retrieves
every code within r. These are compared whole, and those within r are ranked by the cosine of the vectors.

A query's radius comes from what is known of its neighbours: the cosine of the k-th nearest in a bounded
sample, which its k-th nearest of all rows can only surpass, and how far apart, on the sample, the codes of
near vectors are. A query with near copies is thus probed narrowly, one without them widely.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import bytes_matrix, cells, collapsed, finite, matrix, padded, sample, without_one
from .common import table, written

BITS, SAMPLE = 256, 4096
#: The share of near pairs of the sample whose codes the radius must reach.
REACH = 0.99
#: The values of a byte, those with fewer bits first, and how many have at most 0, 1, ... bits.
_FLIPS = np.array(sorted(range(256), key=int.bit_count))
_WITHIN = np.cumsum(np.bincount([i.bit_count() for i in range(256)]))


@dataclass
class Index:
    """What is learned: the rotations, the sample's unit vectors, and how codes stray from angles."""

    rotation: np.ndarray
    known: np.ndarray
    stray: float

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The codes of vectors, as bytes."""
        return np.packbits(_unit(x) @ self.rotation > 0, axis=1)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """The radius that reaches the codes of all but a few vectors with this cosine or a larger one."""
        p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return np.minimum(self.bits, np.ceil(self.bits * p + self.stray * np.sqrt(self.bits * p * (1 - p) + 1))).astype(np.int64)

    def radii(self, x: np.ndarray, k: int) -> np.ndarray:
        """Each vector's radius for its k nearest other vectors."""
        out = [np.empty(0, np.int64)]
        for at in range(0, len(x), 512):
            u = _unit(x[at : at + 512])
            if len(self.known) <= k:
                out.append(np.full(len(u), self.bits))
                continue
            # the vector itself may be in the sample: one more than k
            out.append(self.radius(np.partition(u @ self.known.T, len(self.known) - k - 1, axis=1)[:, len(self.known) - k - 1]))
        return np.concatenate(out)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, initial=0, keepdims=True).clip(np.finfo(np.float64).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True).clip(np.finfo(np.float64).tiny)


def learn(points: np.ndarray, width: int, bits: int = BITS, rounds: int = 12, seed: int = 12, near: int = 5) -> Index:
    """Rotations of the leading directions of the points, each turned, from a random start, towards the
    signs that it gives (iterative quantisation); as many rotations as the bits need."""
    random, u = np.random.default_rng(seed), _unit(points) if len(points) else np.zeros((0, width))
    keep = min(width, bits)
    lead = np.linalg.eigh(u.T @ u + 1e-9 * np.eye(width))[1][:, ::-1][:, :keep]
    y, turned = u @ lead, []
    for _ in range(-(-bits // keep)):
        r = np.linalg.qr(random.normal(size=(keep, keep)))[0]
        for _ in range(rounds if len(u) else 0):
            a, _, b = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
            r = (a @ b).T
        turned.append(lead @ r)
    index = Index(np.concatenate(turned, 1)[:, :bits], u, 3.0)
    if len(u) > near:
        words, asked = index.codes(u), u[:512]
        cosine = asked @ u.T
        cosine[np.arange(len(asked)), np.arange(len(asked))] = -2
        best = np.argpartition(-cosine, near, axis=1)[:, :near]
        p = np.arccos(np.clip(np.take_along_axis(cosine, best, 1), -1, 1)) / np.pi
        apart = np.bitwise_count(words[best] ^ words[: len(asked), None]).sum(-1)
        index.stray = float(np.quantile((apart - index.bits * p) / np.sqrt(index.bits * p * (1 - p) + 1), REACH))
    return index


class Probe:
    """The substring indexes of a block of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, n = codes, codes.shape[1]
        self.order = np.concatenate([np.argsort(codes[:, j], kind="stable") for j in range(n)])
        counts = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(n)])
        self.counts = counts.ravel()
        self.starts = np.cumsum(self.counts) - self.counts

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes differ from code in at most radius bits."""
        n = len(code)
        base, more = divmod(radius + 1, n)
        flips = _WITHIN[np.minimum([base if j < more else base - 1 for j in range(n)], 8)] * (np.array([base if j < more else base - 1 for j in range(n)]) >= 0)
        probes = np.concatenate([256 * j + (_FLIPS[: flips[j]] ^ int(code[j])) for j in range(n)])
        found = self.counts[probes]
        probes, found = probes[found > 0], found[found > 0]
        ends = np.cumsum(found)
        at = np.repeat(self.starts[probes] - (ends - found), found) + np.arange(ends[-1] if len(ends) else 0)
        met = np.zeros(len(self.codes), bool)
        met[self.order[at]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with y, in double precision. Vectors whose squares a double cannot
    hold are scaled first."""
    dot, norms = (x * y).sum(1), np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum())
    if np.all(np.isfinite(norms) & (norms > 1e-290)):
        return dot / norms
    return _unit(x) @ _unit(y[None])[0]


def _kernel(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        x, first, g = matrix(rows.column("vector"), np.float64), rows.column("first_id").to_numpy(), rows.column("g").to_numpy()
        probe = Probe(bytes_matrix(rows.column("code")))
        asked, a, codes, radius = queries.column("g").to_numpy(), matrix(queries.column("vector"), np.float64), bytes_matrix(queries.column("code")), queries.column("radius").to_numpy()
        out = []
        for i in range(len(a)):
            near = probe.within(codes[i], int(radius[i]))
            score = cosines(x[near], a[i]) if len(near) else np.empty(0)
            best = np.lexsort((first[near], -score))[:k]
            out.append((np.full(len(best), asked[i]), g[near[best]], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], ["a", "g", "score"])

    return run


def _coded(groups: DataFrame, index: Index, k: int | None = None) -> DataFrame:
    """With a column code; where k is given, with the radius for k neighbours too."""
    names = [*groups.columns, "code"] + (["radius"] if k else [])

    def run(batches):
        for b in batches:
            x = matrix(pa.Table.from_batches([b]).column("vector"), np.float64)
            if len(x):
                more = [pa.array(index.radii(x, k), pa.int64())] if k else []
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in index.codes(x)], pa.binary()), *more], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return groups.mapInArrow(run, f"{kinds}, code binary" + (", radius bigint" if k else ""))


def nearest(rows: DataFrame, is_query: Column, row_id: str = "vec_id", vector: str = "embedding", k: int = 5, bits: int = BITS, sample_size: int = SAMPLE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of all rows but the query's own, by
    cosine in double precision; ties by smaller id.

    Rotations and radii are learned of at most sample_size vectors, those with the least hashes; every row
    is indexed. Rows with a null id or vector, a component that is null or not finite, or only zeros, take
    no part. Shorter vectors count as ended with zeros. Repeated rows are rows of their own: a query's copy
    is found at cosine 1, with the same id or another, and a repeated query is answered once for each time.
    A query alone in its table gives no row, and neither does an empty table. Extra columns are ignored.
    """
    v = F.col("vector")
    own = rows.select(rows[f"`{row_id}`"].cast("long").alias("id"), rows[f"`{vector}`"].cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    own, width = padded(own.where("id is not null").where(finite(v)).where(F.exists(v, lambda x: x != 0)))
    groups = collapsed(own, ["vector"], k + 1, "vector-groups")
    index = learn(sample(groups, "vector", sample_size), width, bits - bits % 8 or 8, near=k)
    groups = written(_coded(groups, index), "codes")
    queries = own.where("is_query").select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), "vector")
    queries = written(queries.join(groups.select("vector", F.col("g").alias("a")), "vector").select("query", "query_id", "a"), "queries")
    asked = groups.join(queries.select(F.col("a").alias("g")).distinct(), "g", "left_semi").select("g", "vector")
    asked = written(_coded(asked, index, k), "query-codes")

    found = cells(groups.drop("ids"), asked, _kernel(k + 1), "a bigint, g bigint, score double").join(groups.select("g", "first_id", "ids"), "g")
    best = Window.partitionBy("a").orderBy(F.desc("score"), "first_id")
    found = written(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("a", "g", "score", "ids"), "found")
    each = queries.join(found, "a").select("query", "query_id", "score", F.explode(F.when(F.col("a") == F.col("g"), without_one(F.col("ids"), F.col("query_id"))).otherwise(F.col("ids"))).alias("vec_id"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings by nearest; queries are the rows whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
