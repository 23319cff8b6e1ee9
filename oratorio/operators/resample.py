"""Intervals from resampled groups, breakdowns by an axis, and word classes.

Groups are resampled by Poisson weights: in each round a group counts as often as a Poisson variable of
mean one says, read off a digest of (seed, round, group). Reruns agree, whatever the partitions, and a
round is a sum, so that groups are never brought together in a task. That replaces drawing as many
groups as there are, with replacement, which it approaches as groups grow many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import cases, rate
from .attribution import ROUNDS, SEED

#: Rounds that one digest of 128 bits serves.
A_DIGEST = 4


def poisson_bounds() -> list[str]:
    """As eight hex digits, the least uniform draw of each count from one on."""
    out, total, k = [], 0.0, 0
    while (total := total + math.exp(-1) / math.factorial(k)) * 2**32 < 2**32 - 1:
        out.append(f"{int(total * 2**32):08x}")
        k += 1
    return out


def resampled(terms: DataFrame, by: str, values: list[str], rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Rows (by, round, values): sums of the values over the groups as each round counts them.
    terms: (by, group, values), one row for each, with few values of `by`. A round that counts no group of
    a value of `by` has no row."""
    part = terms.sparkSession.sparkContext.defaultParallelism
    listed = terms.repartition(part, "group").groupBy("group").agg(F.collect_list(F.struct(by, *values)).alias("terms"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("block").cast("string"), F.col("group").cast("string")))
    blocks = listed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // A_DIGEST)))).withColumn("digest", digest)
    drawn = F.array(*[F.struct((F.col("block") * A_DIGEST + i).alias("round"), F.substring("digest", 8 * i + 1, 8).alias("u")) for i in range(A_DIGEST)])
    bounds = poisson_bounds()
    n = cases([(F.col("u") < b, F.lit(k)) for k, b in enumerate(bounds)], F.lit(len(bounds)))
    rows = blocks.select("terms", F.inline(drawn)).where((F.col("u") >= bounds[0]) & (F.col("round") < rounds))
    counted = rows.select("round", n.alias("n"), F.inline("terms"))
    return counted.groupBy(by, "round").agg(*[F.sum(F.col("n") * F.col(v)).alias(v) for v in values])


def _bounds(draws: DataFrame, by: str, value: Column) -> DataFrame:
    """The 95 % bounds of a value over rounds by index, and how many rounds have one; at most `rounds`
    numbers are listed for each value of `by`."""
    v, n = F.col("v"), F.size("v")
    at = lambda share, less: F.get(v, F.greatest(F.floor(n * share).cast("int") - less, F.lit(0)))
    listed = draws.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("v"))
    return listed.select(by, at(0.025, 0).alias("low"), at(0.975, 1).alias("high"), n.alias("valid"))


def rate_intervals(totals: DataFrame, by: str, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Rows (by, rate, low, high): pooled rates with the bounds of resampled groups, null with fewer than
    two groups. totals: (by, group, errors, words). Rounds without words are left out."""
    points = totals.groupBy(by).agg(rate(F.sum("errors"), F.sum("words")).alias("rate"), F.count_distinct("group").alias("groups"))
    once = totals.groupBy(by, "group").agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"))
    found = _bounds(resampled(once, by, ["errors", "words"], rounds, seed), by, F.try_divide(100.0 * F.col("errors"), F.nullif("words", F.lit(0))))
    at = lambda c: F.when(F.col("groups") >= 2, F.col(c)).alias(c)
    return points.join(F.broadcast(found), by, "left").select(by, "rate", at("low"), at("high"))


def paired_difference(totals: DataFrame, rounds: int = 2000, seed: int = SEED) -> DataFrame:
    """One row (difference, low, high, below): a run's pooled rate less another's over the same groups,
    with interpolated percentiles; below is the share of rounds under zero. totals: (group, errors_a,
    words_a, errors_b, words_b), one row a group."""
    values = ["errors_a", "words_a", "errors_b", "words_b"]
    pooled = lambda e, w: F.try_divide(100.0 * F.col(e), F.nullif(w, F.lit(0)))
    diff = (pooled("errors_a", "words_a") - pooled("errors_b", "words_b")).alias("d")
    drawn = resampled(totals.withColumn("all", F.lit("all")), "all", values, rounds, seed).select(diff)
    spread = drawn.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") < 0).cast("int")).alias("below"))
    return totals.agg(*[F.sum(v).alias(v) for v in values]).select(diff.alias("difference")).crossJoin(F.broadcast(spread))


def axis_breakdown(clips: DataFrame, axis: str, baseline: str, unmeasured: str, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Rows (bucket, clips, words, errors, wer, share_of_errors, rate_ratio, ratio_groups, low, high) of each
    bucket of an axis: its pooled rate and its Mantel-Haenszel ratio to the baseline within groups. The
    baseline and the unmeasured have no ratio; bounds need two comparable groups and half the rounds.
    clips: (group, words, errors, axis); null buckets are left out."""
    known = clips.where(F.col(axis).isNotNull()).select(F.col(axis).alias("bucket"), "group", "words", "errors")
    totals = known.groupBy("bucket", "group").agg(F.count("*").alias("clips"), F.sum("words").alias("words"), F.sum("errors").alias("errors"))
    base = totals.where(F.col("bucket") == baseline).select("group", F.col("errors").alias("b"), F.col("words").alias("t0"))
    pairs = totals.where(~F.col("bucket").isin(baseline, unmeasured)).join(base, "group").where("words > 0 and t0 > 0")
    both = F.col("t0") + F.col("words")
    terms = pairs.select("bucket", "group", (F.col("errors") * F.col("t0") / both).alias("x"), (F.col("b") * F.col("words") / both).alias("y"))
    ratio = F.try_divide(F.col("x"), F.nullif("y", F.lit(0.0)))
    points = terms.groupBy("bucket").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("ratio_groups")).select("bucket", ratio.alias("rate_ratio"), "ratio_groups")
    found = _bounds(resampled(terms, "bucket", ["x", "y"], rounds, seed), "bucket", ratio)
    head = totals.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("clips", "words", "errors")])
    all_errors = head.agg(F.sum("errors").alias("all_errors"))
    sure = (F.col("ratio_groups") >= 2) & F.col("rate_ratio").isNotNull() & (F.col("valid") >= rounds // 2)
    # one row a bucket
    joined = head.crossJoin(F.broadcast(all_errors)).join(F.broadcast(points), "bucket", "left").join(F.broadcast(found), "bucket", "left")
    return joined.select(
        "bucket", "clips", "words", "errors", rate(F.col("errors"), F.col("words")).alias("wer"), F.coalesce(F.try_divide(F.col("errors").cast("double"), F.nullif("all_errors", F.lit(0))), F.lit(0.0)).alias("share_of_errors"),
        "rate_ratio", "ratio_groups", *[F.when(sure, F.col(c)).alias(c) for c in ("low", "high")],
    )


def word_classes(words: DataFrame) -> DataFrame:
    """Rows (class, words, wer, cer, share_of_words): reference words by their classes, of which a word may
    have several: its script, number, switch beside a word of the other script, edge of its clip.
    words: (clip_id, pos, script, number, wrong, chars, char_errors), script null for neither."""
    w = Window.partitionBy("clip_id").orderBy("pos")
    script, lettered = F.col("script"), lambda c: c.isin("dev", "lat")
    other = lambda c: F.coalesce(lettered(c) & (c != script), F.lit(False))
    before, after = F.lag("script").over(w), F.lead("script").over(w)
    first, last = F.lag("pos").over(w).isNull(), F.lead("pos").over(w).isNull()
    seen = words.withColumn("switch", lettered(script) & (other(before) | other(after))).withColumn("edge", first | last)
    names = F.array_compact(F.array(script, *[F.when(F.col(c), F.lit(c)) for c in ("number", "switch", "edge")]))
    total = words.agg(F.count("*").alias("all_words"))
    per = seen.select(F.explode(names).alias("class"), F.col("wrong").cast("int").alias("wrong"), "chars", "char_errors")
    summed = per.groupBy("class").agg(F.count("*").alias("words"), F.sum("wrong").alias("e"), F.sum("chars").alias("chars"), F.sum("char_errors").alias("ce"))
    return summed.crossJoin(F.broadcast(total)).select("class", "words", rate(F.col("e"), F.col("words")).alias("wer"), rate(F.col("ce"), F.col("chars")).alias("cer"), (F.col("words") / F.col("all_words")).alias("share_of_words"))
