"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws an exponential key, -ln(u) / weight, so that the order by key is a weighted
sample without replacement at each prefix. A source with a target of r times its size gives floor(r)
complete epochs, and then the prefix by key that fills the rest; the document across the line is cut.

Prefix sums are made in two passes: keys fall into ranges, the ranges' totals are summed within each
source, and rows are summed within their range. A source with a third of all rows is many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, column_of, named_as, numbered, table, written

#: Rows of one range of keys, about.
RANGE_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size), a row a source in the windows here.

    Sources in code point order, null last, take the weights in turn and share `share` times the total
    size. No target is above cap times its source's size: what is above is shared out again by weight
    until none is. That has a closed form: targets are min(cap * size, level * weight), where the
    sources with the smallest cap / weight are full and the level divides what they leave. If all are
    full, all take their cap; sources without words have target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    whole = Window.partitionBy(F.lit(0))
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        weighed.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("w_left"))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    )
    # the level that counts is that of the first source that is not full
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"]
    return ranked.withColumn("lambda", level).select("source", "source_size", F.when(F.col("lambda").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("lambda") * F.col("w"))).alias("target"))


def _ranges(keyed: DataFrame) -> tuple[Column, int]:
    """The range of a key, and the number of ranges. Of the rows with weight w, a share of exp(-w key) has
    greater keys; summed over classes of weights, at most 41 rows brought to the driver, that is how many
    rows of all stand before a key: ranges of equal widths of it hold about as many rows each."""
    step = F.greatest(F.lit(-20), F.least(F.lit(20), F.round(F.log2("weight")))).cast("int")
    classes = keyed.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.avg("weight").alias("w")).collect()
    n = sum(r.n for r in classes)
    ranges = max(1, -(-n // RANGE_ROWS))
    before = F.lit(0.0)
    for r in sorted(classes, key=lambda r: r.step):
        before = before + F.lit(r.n / n) * (1 - F.exp(F.lit(-float(r.w)) * F.col("key")))
    return F.greatest(F.lit(0), F.least(F.floor(before * ranges), F.lit(ranges - 1))).cast("long"), ranges


def mixed(sizes: DataFrame, targets: DataFrame, seed: int = 11, quality: str = "quality") -> DataFrame:
    """Rows of sizes (doc_id, source, size, quality, perhaps row) with source_size, target, taken and key.

    taken is the number of words that the mix takes of the row, repeats counted. quality is the
    weight of a document, above 0 (null, 0 or less: 1). The uniform draw is a hash of the doc_id, so
    reruns agree; rows with equal keys go by doc_id, size and row, and repeated rows are alike.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = sizes.withColumn("weight", F.when(F.col(quality) > 0, F.col(quality).cast("double")).otherwise(1.0)).withColumn("key", -F.log(u) / F.col("weight"))
    keyed = keyed.withColumn("range", _ranges(keyed)[0])
    totals = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("s"), F.col("range").alias("r"), "start", "source_size", "target")
    ties = ["key", "doc_id", "size", *[c for c in ("row",) if c in sizes.columns]]
    inside = Window.partitionBy("source", "range").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    ahead_here = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = ahead_here.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("inside")))
    return placed.withColumn("epochs", epochs).withColumn("rest", rest).withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("s", "r", "range", "start", "inside", "rest", "weight")


def quality_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, quality): 2 for documents labelled good, 0.5 for the others that have a label."""
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select(F.col("doc_id").alias("labelled"), F.when(F.col("q") > 0, 2.0).otherwise(0.5).alias("quality"))


def mix(docs: DataFrame, quality: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", share: float = 1.5, row: str | None = None) -> DataFrame:
    """Rows (doc_id, size, source, source_size, target, taken, epochs, quality, key), one a row of docs,
    with `row`, a number of the row, where its column is named. Null texts have size 0, null doc_ids draw
    alike, other columns are ignored; an empty table gives no rows."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *([F.col(row).alias("row")] if row else []))
    sized = sized.join(quality, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "source", "size", "quality", *(["row"] if row else []))
    sized = written(sized, "sizes")
    targets = written(source_targets(sized, share), "targets")
    return mixed(sized, targets)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by mix, weighed by their labels; nulls, ties and repeated rows as it says."""
    out = mix(table(spark, sf_dir, "documents"), quality_of(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "quality")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as many times as it is taken, the last time perhaps cut after a
    word. Sources whose target is their whole size or more lose nothing; documents of which nothing
    is taken go, and with them null texts and those without a word. Each row counts by itself, with a
    doc_id that others have or none; extra columns stay as they are; an empty table gives no rows."""
    rows = numbered(docs)
    doc_id, text, source = (column_of(docs, c) for c in ("doc_id", "text", "source"))
    taken = mix(rows, quality_of(spark, sf_dir), text, source, doc_id, row="__row").where("taken > 0").select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    copies = F.transform(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("__taken") / F.col("__size"))), lambda k: F.least(F.col("__size"), F.col("__taken") - (k - 1) * F.col("__size")))
    each = rows.join(taken, "__row").withColumn("__words", F.explode(copies))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("__words").cast("int")), "")
    each = each.withColumn(text, F.when(F.col("__words") < F.col("__size"), cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        each = each.withColumn(column_of(docs, "n_chars"), F.length(text).cast("long"))
    return each.select(*named_as(each, docs))
