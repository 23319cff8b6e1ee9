"""Vectors in blocks: what the operators that search vectors share.

Equal vectors are collapsed before anything is compared, so that a vector that a third of all rows share
costs one row. Rows and queries are then dealt into blocks of bounded size; each pair of a block of
queries with a block of rows is a cell, whose two sides meet in one task and which returns a bounded
number of rows a query. No pair of a query and a row is a row of a Spark table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffles, written

#: Rows in a block at most (about), and below which a block is not cut to keep more cores busy.
MOST_ROWS, LEAST_ROWS, MOST_QUERIES = 16384, 1024, 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there and every component is there and finite."""
    ok = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return vector.isNotNull() & F.forall(vector, ok)


def padded(rows: DataFrame, vector: str = "vector") -> tuple[DataFrame, int]:
    """The rows with vectors of one length, shorter ones ended with zeros, and that length (at least 1)."""
    low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    width = max(high or 0, 1)
    if low is not None and low != width:
        zero = F.lit(0).cast(rows.schema[vector].dataType.elementType)
        rows = rows.withColumn(vector, F.concat(vector, F.array_repeat(zero, F.lit(width) - F.size(vector))))
    return rows, width


def collapsed(rows: DataFrame, keys: list[str], keep: int, name: str) -> DataFrame:
    """Written rows (g, *keys, ids, first_id): one for each different key, ids its `keep` least values of
    `id`, in order. Who ranks rows by a measure of the keys and then by id, and takes `keep` at most, loses
    nothing by the rest. Row limits are applied before the shuffle, so that a hot key moves few rows."""
    w = Window.partitionBy(*keys).orderBy("id")
    least = rows.select(*keys, "id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    groups = least.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return written(groups.select(F.monotonically_increasing_id().alias("g"), *keys, "ids", F.col("ids")[0].alias("first_id")), name)


def sample(groups: DataFrame, column: str, size: int) -> np.ndarray:
    """At most `size` vectors, those with the least hashes, so that reruns agree; a matrix of doubles."""
    got = groups.select(column, F.xxhash64(column).alias("h")).orderBy("h", column).limit(size).collect()
    return np.array([r[0] for r in got], np.float64)


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    a = column.combine_chunks()
    return np.asarray(a.flatten(), kind).reshape(len(a), -1) if len(a) else np.empty((0, 0), kind)


def bytes_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of binary values of one length as a matrix of bytes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def cells(rows: DataFrame, queries: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """kernel(rows, queries) for each cell. Both tables are written ones and have a unique column g."""
    spark = rows.sparkSession
    n, m = rows.count(), queries.count()
    n_rows = max(1, -(-n // MOST_ROWS), min(2 * shuffles(spark), -(-n // LEAST_ROWS)))
    n_queries = max(1, -(-m // MOST_QUERIES))
    own = lambda k: F.pmod(F.xxhash64("g"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("row_block", own(n_rows).cast("int")).withColumn("query_block", every(n_queries))
    right = queries.withColumn("query_block", own(n_queries).cast("int")).withColumn("row_block", every(n_rows))
    empty = _arrow_schema(spark.createDataFrame([], schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return kernel(a, b) if len(a) and len(b) else empty.empty_table()

    key = ("row_block", "query_block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def without_one(ids: Column, own: Column) -> Column:
    """ids without one occurrence of own, if it is there."""
    at = F.array_position(ids, own)
    return F.filter(ids, lambda x, k: k + 1 != at)


def lists(values: list[np.ndarray]) -> pa.Array:
    """Arrays as an Arrow column of lists of longs."""
    return pa.array([v.tolist() for v in values], pa.list_(pa.int64()))
