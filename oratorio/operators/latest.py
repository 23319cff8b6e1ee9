"""Newest rows of append-only logs, and other windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the order; Spark keeps one row a key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def latest_then(rows: DataFrame, keys: list[str], keep: Column, *order: Column) -> DataFrame:
    """The newest row of each key, if it passes: the filter comes after the pick, so that a newest row
    that clears an older one hides it."""
    return latest(rows, keys, *order).where(keep)


def newest_run(runs: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    cols = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")


def top_per_group(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How often the value changes from one row of a key to the next."""
    w = Window.partitionBy(key).orderBy(order)
    changed = (F.lag(value).over(w) != F.col(value)).cast("int")
    return rows.withColumn("__c", changed).groupBy(key).agg(F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("changes"), F.count("*").alias("rows"))


def boundary_flags(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Whether a row's value differs from the one before or after it."""
    w = Window.partitionBy(key).orderBy(order)
    differs = lambda other: F.coalesce(other != F.col(value), F.lit(False))
    return rows.withColumn("boundary", differs(F.lag(value).over(w)) | differs(F.lead(value).over(w)))


def numbered_repeats(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The nth repeat of an id gets "#n" behind it, from the second on."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(id_col)).otherwise(F.concat_ws("#", id_col, n.cast("string"))))


def islands(rows: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Maximal runs of rows with the flag: (key, start, end, n), start and end being orders."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("__n", F.row_number().over(w)).where(flag)
    return numbered.withColumn("__island", F.col("__n") - F.row_number().over(w)).groupBy(key, "__island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("__island")


def merged_within(rows: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """Spans of a key joined where they overlap or lie at most `gap` apart: (key, start, end, n)."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return rows.withColumn("__new", fresh).withColumn("__k", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "__k").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__k")


def filled_spans(rows: DataFrame, key: str, order: str, start: str, end: str, first: float, last: float) -> DataFrame:
    """Rows without a span get an even part of the gap between the spans known before and after, the
    parts rounded to milliseconds; outside the known ones the gap runs from `first` or to `last`."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    out = rows.withColumn("__lo", F.coalesce(F.last(end, True).over(back), F.lit(first))).withColumn("__hi", F.coalesce(F.first(start, True).over(ahead), F.lit(last)))
    out = out.withColumn("__known", F.count(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gap = Window.partitionBy(key, "__known", F.col(start).isNull()).orderBy(order)
    size = F.count("*").over(gap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    step = F.greatest(F.lit(0.0), F.col("__hi") - F.col("__lo")) / size
    s = F.bround(F.col("__lo") + (F.row_number().over(gap) - 1) * step, 3)
    out = out.withColumn("filled_start", F.when(F.col(start).isNull(), s).otherwise(F.col(start))).withColumn("filled_end", F.when(F.col(start).isNull(), F.bround(s + step, 3)).otherwise(F.col(end)))
    return out.drop("__lo", "__hi", "__known")


def neighbours(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def running_sum(rows: DataFrame, key: str, order: str, value: str, name: str, width: int = 10_000) -> DataFrame:
    """rows with the sum of a value up to each row in the order of a whole number, distinct within the key.
    Ranges of the order are summed first, and rows within their range, so that a key with very many rows
    is many groups."""
    ranged = rows.withColumn("__range", F.floor(F.col(order) / width))
    ahead = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(key, "__range").agg(F.sum(value).alias("__total"))
    starts = totals.select(F.col(key).alias("__key"), F.col("__range").alias("__at"), F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__inside", F.sum(value).over(inside))
    joined = summed.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at")))
    return joined.withColumn(name, F.col("__start") + F.col("__inside")).select(*[F.col(f"`{c}`") for c in rows.columns], name)
