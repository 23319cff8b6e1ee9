"""Joins: intervals, points in intervals, anti-joins, lookups and pairs within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a large table that one task of a shuffle takes.
TASK_ROWS = 1 << 19


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, n of them, dealt by the keys over a task for each TASK_ROWS, where that is more tasks than the session
    shuffles into: what a task sorts and adds up, in all joins and sums by these keys, then has one size."""
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _bins(rows: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    low, high = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return rows.withColumn(name, F.explode(F.sequence(low, F.greatest(low, high))))


def interval_join(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float, how: str = "inner") -> DataFrame:
    """Rows of a and b with equal keys whose spans overlap; spans that only touch do not.

    Spans are put into bins of `width`, and (keys, bin) is the join key, so that a key with very many
    spans is many partitions and no nested loop. A pair that shares several bins is kept in the bin
    where the later of the two starts. width is best near the usual length of a span. b's key and
    span columns must have names of their own, but for `on`. how: inner, left_semi or left_anti.
    """
    lo = F.greatest(F.col(a_span[0]), F.col(b_span[0]))
    meets = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(a_span[1]) > F.col(b_span[0]))
    right = _bins(b, *b_span, width, "__bin")
    if how == "inner":
        joined = _bins(a, *a_span, width, "__bin").join(right, [*on, "__bin"]).where(meets & (F.floor(lo / width) == F.col("__bin")))
        return joined.select(*a.columns, *[c for c in b.columns if c not in on])
    keyed = a.withColumn("__row", F.struct(*a.columns))
    right = right.select(*[F.col(k).alias(f"__{k}") for k in on], F.col("__bin").alias("__bin2"), *b_span)
    same = F.col("__bin") == F.col("__bin2")
    for k in on:
        same = same & (F.col(k) == F.col(f"__{k}"))
    hit = _bins(keyed, *a_span, width, "__bin").join(right, same & meets, "left_semi").select("__row").distinct()
    return keyed.join(hit, "__row", how).drop("__row")


def clipped(joined: DataFrame, clip: tuple[str, str], turn: tuple[str, str]) -> DataFrame:
    """The joined turns cut to their clip and made relative to its start."""
    s, e = F.greatest(F.col(clip[0]), F.col(turn[0])), F.least(F.col(clip[1]), F.col(turn[1]))
    return joined.withColumn("rel_start", s - F.col(clip[0])).withColumn("rel_end", e - F.col(clip[0]))


def point_in_interval(points: DataFrame, spans: DataFrame, on: list[str], at: str, span: tuple[str, str], width: float) -> DataFrame:
    """Points with the spans that hold them: start <= point < end."""
    right = _bins(spans, *span, width, "__bin")
    left = points.withColumn("__bin", F.floor(F.col(at) / width))
    return left.join(right, [*on, "__bin"]).where((F.col(at) >= F.col(span[0])) & (F.col(at) < F.col(span[1]))).drop("__bin")


def without(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows with no match: a null key matches nothing, so it stays, where SQL's NOT IN drops all."""
    return rows.join(others.select(*on).distinct(), on, "left_anti")


def ranked_for(rows: DataFrame, verified: DataFrame, done: DataFrame, active: DataFrame, on: str, order: list[Column]) -> DataFrame:
    """Verified rows that are neither done nor active, in order: one semi and two anti-joins."""
    return rows.join(verified.select(on), on, "left_semi").join(done.select(on), on, "left_anti").join(active.select(on), on, "left_anti").orderBy(*order)


def lookup(rows: DataFrame, values: DataFrame, on: str, value: str, default) -> DataFrame:
    """rows with the value of a keyed table, or a default. AQE broadcasts the table if it is small."""
    return rows.join(values.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def pairs(rows: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """Each two rows of a key once: (key, by_a, by_b, value_a, value_b) with by_a < by_b. For keys with
    few rows, such as the systems of a segment."""
    a = rows.select(key, F.col(by).alias(f"{by}_a"), F.col(value).alias(f"{value}_a"))
    b = rows.select(key, F.col(by).alias(f"{by}_b"), F.col(value).alias(f"{value}_b"))
    return a.join(b, key).where(F.col(f"{by}_a") < F.col(f"{by}_b"))


def grid(rows: DataFrame, row: str, col: str, row_values: DataFrame, col_values: DataFrame, *aggs: Column) -> DataFrame:
    """A cross-tabulation with every cell of two closed vocabularies, empty ones included. The
    vocabularies are small by definition: only they are crossed."""
    found = rows.groupBy(row, col).agg(*aggs)
    return row_values.select(row).distinct().crossJoin(F.broadcast(col_values.select(col).distinct())).join(found, [row, col], "left")
