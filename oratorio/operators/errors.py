"""Queries over error rows: one row for each aligned pair of words of a run on a set.

The frames have clip_id, group, pos, kind, words (reference words of the row), number, ref_number,
ref_script, hyp_script, similarity, ref, hyp, fold_rule, variant and the bucket columns.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import error_kind, rate, rate_or_null

KINDS = ("number", "deletion", "insertion", "script", "english", "nepali_similar", "nepali_other")
ERRORS = ("sub", "del", "ins")


@dataclass(frozen=True)
class ErrorFilter:
    """What rows count; None is no condition."""

    kind: tuple[str, ...] | None = None
    forgiven: str | None = None
    ref_script: str | None = None
    hyp_script: str | None = None
    overlap_bucket: str | None = None
    snr_bucket: str | None = None
    fold_rule: str | None = None
    variant: str | None = None
    by: str | None = None
    number: bool | None = None
    min_similarity: float | None = None
    max_similarity: float | None = None

    def where(self) -> Column:
        out = F.lit(True)
        for f in fields(self):
            v = getattr(self, f.name)
            if v is None:
                continue
            if f.name == "kind":
                out = out & F.col("kind").isin(*v)
            elif f.name == "min_similarity":
                out = out & (F.col("similarity") >= v)
            elif f.name == "max_similarity":
                out = out & (F.col("similarity") <= v)
            else:
                out = out & (F.col(f.name) == v)
        return out


def with_error_kind(rows: DataFrame) -> DataFrame:
    return rows.withColumn("error_kind", error_kind(F.col("kind"), F.col("number"), F.col("ref_script"), F.col("hyp_script"), F.col("similarity")))


def clips(rows: DataFrame) -> DataFrame:
    """One row for each clip: words, errors by kind and what of them concerns numbers."""
    n = lambda cond: F.count_if(cond).cast("long")
    kind, number = F.col("kind"), F.col("number")
    return with_error_kind(rows).groupBy("clip_id", "group").agg(
        F.max("overlap_bucket").alias("bucket"), F.max("snr_bucket").alias("snr_bucket"), F.sum("words").alias("words"),
        n(kind == "sub").alias("sub"), n(kind == "del").alias("dele"), n(kind == "ins").alias("ins"),
        n(number & (kind == "sub")).alias("number_sub"), n(number & (kind == "del")).alias("number_del"), n(number & (kind == "ins")).alias("number_ins"),
        F.coalesce(F.sum(F.when(number, F.col("words"))), F.lit(0)).alias("number_words"), F.bool_or("ref_number").alias("ref_number"),
        *[n(F.col("error_kind") == k).alias(f"k_{k}") for k in KINDS],
    )


def headline(of: DataFrame, *by: str) -> DataFrame:
    """Clips, words, errors and pooled rates, of all clips or by the columns named."""
    errors = F.sum(F.col("sub") + F.col("dele") + F.col("ins"))
    words = F.sum("words")
    return of.groupBy(*by).agg(
        F.count("*").alias("clips"), F.coalesce(words, F.lit(0)).alias("ref_words"), F.coalesce(errors, F.lit(0)).alias("errors"),
        rate(errors, words).alias("wer"), rate(F.sum("sub"), words).alias("sub_rate"), rate(F.sum("dele"), words).alias("del_rate"), rate(F.sum("ins"), words).alias("ins_rate"),
    )


def breakdown(rows: DataFrame) -> DataFrame:
    """The headline of each crosstalk bucket with its share of words and of errors. The totals are
    one row, joined by broadcast."""
    per = headline(clips(rows), "bucket")
    total = per.agg(F.sum("ref_words").alias("all_words"), F.sum("errors").alias("all_errors"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0))), F.lit(0.0))
    return per.crossJoin(F.broadcast(total)).withColumn("share_of_words", share("ref_words", "all_words")).withColumn("share_of_errors", share("errors", "all_errors")).drop("all_words", "all_errors")


def numbers(rows: DataFrame) -> DataFrame:
    """The number block: errors on numbers, their share, the rate without them, clips with a number."""
    c = clips(rows)
    errors = F.col("sub") + F.col("dele") + F.col("ins")
    on = F.col("number_sub") + F.col("number_del") + F.col("number_ins")
    own = lambda x: F.coalesce(F.sum(F.when(F.col("ref_number"), x)), F.lit(0))
    return c.agg(
        F.sum(on).alias("errors"), F.sum("number_sub").alias("sub"), F.sum("number_del").alias("del"), F.sum("number_ins").alias("ins"),
        F.coalesce(F.try_divide(F.sum(on).cast("double"), F.nullif(F.sum(errors), F.lit(0))), F.lit(0.0)).alias("share_of_errors"),
        rate(F.sum(errors - on), F.sum(F.col("words") - F.col("number_words"))).alias("wer_without"),
        F.count_if("ref_number").alias("ref_clips"), own(F.col("words")).alias("ref_clip_words"), rate(own(errors), own(F.col("words"))).alias("ref_clip_wer"),
    )


def paired(run: DataFrame, base: DataFrame) -> DataFrame:
    """Run less base, pooled over the clips that both have: difference and number of clips."""
    e = F.col("sub") + F.col("dele") + F.col("ins")
    a, b = clips(run).select("clip_id", e.alias("e"), "words"), clips(base).select("clip_id", e.alias("e2"), F.col("words").alias("w2"))
    return a.join(b, "clip_id").agg((rate(F.sum("e"), F.sum("words")) - rate(F.sum("e2"), F.sum("w2"))).alias("difference"), F.count("*").alias("clips"))


def rarity(rows: DataFrame, counts: DataFrame, buckets: list[str], bucket) -> DataFrame:
    """By how often a word was trained on: words, errors and rates of each bucket, all buckets listed.
    rows have ref_words and hyp_words (arrays); counts (word, n); rates are null without words."""
    words = rows.select(F.explode("ref_words").alias("word")).groupBy("word").agg(F.count("*").alias("ref_words"))
    of = F.when(F.col("kind") == "ins", F.get("hyp_words", F.lit(0))).otherwise(F.get("ref_words", F.lit(0)))
    wrong = rows.where(F.col("kind").isin(*ERRORS)).groupBy(of.alias("word")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ERRORS])
    per = words.join(wrong, "word", "full").join(counts, "word", "left").withColumn("bucket", bucket(F.coalesce("n", F.lit(0))))
    summed = per.groupBy("bucket").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("ref_words", *ERRORS)])
    dense = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string").join(summed, "bucket", "left")
    filled = dense.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ref_words", *ERRORS)])
    total = filled.agg(F.sum("ref_words").alias("all_words"))
    errors = F.col("sub") + F.col("del") + F.col("ins")
    return filled.crossJoin(F.broadcast(total)).select(
        "bucket", "ref_words", F.coalesce(F.try_divide(F.col("ref_words").cast("double"), F.nullif("all_words", F.lit(0))), F.lit(0.0)).alias("share_of_words"),
        errors.alias("errors"), rate_or_null(errors, F.col("ref_words")).alias("wer"), *[rate_or_null(F.col(k), F.col("ref_words")).alias(f"{k}_rate") for k in ERRORS],
    )


def confused(rows: DataFrame, flt: ErrorFilter, both_ways: bool = False) -> DataFrame:
    """Counts of (kind, a, b): reference text written as model text; with both_ways a pair and its
    reverse are one row, forward counting the rows already in order."""
    ref, hyp = F.col("ref"), F.col("hyp")
    a, b, fwd = (F.least(ref, hyp), F.greatest(ref, hyp), ref <= hyp) if both_ways else (ref, hyp, F.lit(True))
    return rows.where(flt.where()).select("kind", a.alias("a"), b.alias("b"), fwd.alias("fwd")).groupBy("kind", "a", "b").agg(F.count("*").alias("n"), F.count_if("fwd").alias("forward"))


def confusion(rows: DataFrame, flt: ErrorFilter, *, both_ways: bool = False, base: DataFrame | None = None, sort: str = "count", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the confusion table: count, share of its kind, and with base the change against it.
    Shares come from a count by kind, which is a handful of rows, not from a window over all pairs."""
    found = confused(rows, flt, both_ways)
    of_kind = found.groupBy("kind").agg(F.sum("n").alias("kind_n"))
    out = found.join(F.broadcast(of_kind), "kind").withColumn("share", F.col("n") / F.col("kind_n")).drop("kind_n")
    order = [F.desc("n")]
    if base is not None:
        t = confused(base, flt, both_ways).select("kind", "a", "b", F.col("n").alias("base_n"))
        out = out.join(t, ["kind", "a", "b"], "left").withColumn("base_count", F.coalesce("base_n", F.lit(0))).withColumn("change", F.col("n") - F.col("base_count")).drop("base_n")
        order = [F.desc("change"), *order] if sort == "change" else order
    return out.orderBy(*order, "kind", "a", "b").offset(offset).limit(limit)


def top_confusions(rows: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent pairs of each kind of error."""
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "a", "b")
    return confused(rows, ErrorFilter(kind=ERRORS)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("kind", "a", "b", "n", "rank")


def rule_evidence(rows: DataFrame, top: int = 5) -> DataFrame:
    """For each rule or tag its pairs, their rate by 100 words, and its most frequent pairs."""
    tagged = rows.withColumn("id", F.coalesce("fold_rule", "variant")).where("id is not null").groupBy("id", "ref", "hyp").agg(F.count("*").alias("n"))
    totals = tagged.groupBy("id").agg(F.sum("n").alias("pairs"))
    words = rows.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("all_words"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "ref", "hyp")
    best = tagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(totals, "id").crossJoin(F.broadcast(words)).select("id", "ref", "hyp", "n", "pairs", rate(F.col("pairs"), F.col("all_words")).alias("per_100"), "rank")


def occurrences(rows: DataFrame, flt: ErrorFilter, *, sample: int | None = None, seed: int = 0, limit: int = 50, offset: int = 0) -> DataFrame:
    """The pairs behind a filter: a page in clip order, or a sample that the seed fixes. An order by
    all of the key with a limit is a top-k of each task, not a sort of all rows."""
    found = rows.where(flt.where())
    if sample is not None:
        return found.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("clip_id").cast("string"), F.col("pos").cast("string")))).orderBy("draw", "clip_id", "pos").limit(sample)
    return found.orderBy("clip_id", "pos").offset(offset).limit(limit)


def with_context(hits: DataFrame, rows: DataFrame, steps: int = 5) -> DataFrame:
    """For each hit the rows of its clip at most `steps` positions away: a join on clip and a band of
    positions. Positions are cut into blocks of `steps`, so that a long clip is no nested loop."""
    left = hits.select("clip_id", F.col("pos").alias("hit_pos"), F.explode(F.expr(f"array(pos div {steps} - 1, pos div {steps}, pos div {steps} + 1)")).alias("block"))
    right = rows.select("clip_id", "pos", "kind", "ref", "hyp", F.expr(f"pos div {steps}").alias("block"))
    return left.join(right, ["clip_id", "block"]).where((F.abs(F.col("pos") - F.col("hit_pos")) <= steps) & (F.col("pos") != F.col("hit_pos"))).drop("block")


def rows_of_clip(rows: DataFrame, clip_id) -> DataFrame:
    return rows.where(F.col("clip_id") == F.lit(clip_id)).orderBy("pos")


def repeats(rows: DataFrame) -> DataFrame:
    """Whether a deleted or inserted word repeats the word beside it on its side."""
    w = Window.partitionBy("clip_id").orderBy("pos")
    near = lambda c: (F.col(c) == F.lag(c).over(w)) | (F.col(c) == F.lead(c).over(w))
    return rows.withColumn("repeats", F.coalesce(F.when(F.col("kind") == "del", near("ref")).when(F.col("kind") == "ins", near("hyp")), F.lit(False)))


def forgiven(rows: DataFrame) -> DataFrame:
    """What an alignment step was forgiven as; null for identical matches and errors."""
    kind = F.col("kind")
    return rows.withColumn("forgiven", F.when((kind == "match") & ~F.col("identical"), "spelling").when(kind == "fold", F.when(F.col("number"), "number").otherwise("script")).when(kind == "merge", "merge"))
