"""Scores of transcripts that are kept: only what is new, or changed, or scored by other rules is aligned.

A stored score is known by its clip, the digest of both texts, and the version of the rules. Which clips are
stale is a join; alignment, by far the dearest step, sees those rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import default_folder
from .latest import latest
from .texts import SCORE, score, spread

#: The columns of a clip's score, in order.
FIELDS = [p.split()[0] for p in SCORE.split(", ")]


def digest(ref: Column, hyp: Column) -> Column:
    """The identity of a pair of texts; a null one is not an empty one."""
    return F.sha2(F.to_json(F.struct(ref.alias("ref"), hyp.alias("hyp")), {"ignoreNullFields": "false"}), 256)


def plan(clips: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """(clip, status) of each clip of either side. clips: clip, ref, hyp; stored: clip, digest, version.
    `kept`: its texts and the rules are those of the stored score; `text`: a text differs; `rules`: only the
    rules do; `new`: not stored; `gone`: stored only."""
    a = clips.select("clip", digest(F.col("ref"), F.col("hyp")).alias("__now"))
    b = stored.select("clip", F.col("digest").alias("__then"), F.col("version").alias("__version"))
    both = a.join(b, "clip", "full_outer")
    status = F.when(F.col("__now").isNull(), "gone").when(F.col("__then").isNull(), "new").when(F.col("__now") != F.col("__then"), "text").when(F.col("__version") != F.lit(version), "rules").otherwise("kept")
    return both.select("clip", status.alias("status"))


def scored(clips: DataFrame, version: str) -> DataFrame:
    """(clip, digest, version, the fields of a score) of clips, every one aligned."""
    own = spread(clips.select("clip", "ref", "hyp"), "clip").select("clip", digest(F.col("ref"), F.col("hyp")).alias("digest"), F.lit(version).alias("version"), score(F.col("ref"), F.col("hyp")).alias("s"))
    return own.select("clip", "digest", "version", *[F.col(f"s.{f}").alias(f) for f in FIELDS])


def rescored(clips: DataFrame, stored: DataFrame, version: str | None = None) -> DataFrame:
    """The scores of all clips, with `reused`: those whose texts and rules are unchanged come from stored,
    the others are aligned. clips without a stored score are new ones; stored scores of clips that are no
    longer there are left out. clip is unique on both sides."""
    version = version or default_folder().version
    status = plan(clips, stored, version)
    kept = stored.join(status.where("status = 'kept'"), "clip", "left_semi").select("clip", "digest", "version", *FIELDS, F.lit(True).alias("reused"))
    stale = clips.join(status.where("status = 'kept'"), "clip", "left_anti")
    return kept.unionByName(scored(stale, version).withColumn("reused", F.lit(False)))


def imported(transcripts: DataFrame, clips: DataFrame, labels: DataFrame, split: str, approved: Sequence[str] = ("accepted_unchanged", "edited")) -> DataFrame:
    """transcripts (clip, text) with `outcome` and `ref`. `unknown`: a clip that the corpus (clip, split) has
    not; `not_in_split`: one of another split; `no_reference`: its newest label (clip, id, created_at,
    disposition, text) is not approved, or it has none; `scored`: ref is that label's text."""
    label = latest(labels, ["clip"], F.desc("created_at"), F.desc("id")).select("clip", "disposition", F.col("text").alias("ref"))
    of = transcripts.join(clips.select("clip", F.col("split").alias("__split"), F.lit(True).alias("__known")), "clip", "left").join(label, "clip", "left")
    good = F.coalesce(F.col("disposition").isin(*approved), F.lit(False))
    outcome = F.when(F.col("__known").isNull(), "unknown").when(~F.col("__split").eqNullSafe(F.lit(split)), "not_in_split").when(~good, "no_reference").otherwise("scored")
    out = of.withColumn("outcome", outcome)
    return out.select("clip", "text", "outcome", F.when(F.col("outcome") == "scored", F.coalesce("ref", F.lit(""))).alias("ref"))


def import_run(transcripts: DataFrame, clips: DataFrame, labels: DataFrame, split: str, stored: DataFrame, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The scores of a run's transcripts against today's labels, and how many rows had which outcome. A run
    with clips that the corpus has not is from another dataset: it raises."""
    outcomes = imported(transcripts, clips, labels, split)
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    if unknown := outcomes.where("outcome = 'unknown'").select("clip").limit(1).collect():
        raise ValueError(f"a clip that the corpus has not: {unknown[0].clip!r}; the run is from another dataset")
    of = outcomes.where("outcome = 'scored'").select("clip", "ref", F.col("text").alias("hyp"))
    return rescored(of, stored, version), counts


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """Pooled rates, of all scores or by the columns named: clips, words, errors by kind, folded, raw and
    character error rates, and the share of clips that loop. A group without a reference word has null
    rates."""
    rate = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 6)
    return scores.groupBy(*by).agg(
        F.count("*").alias("clips"), F.sum("ref_words").alias("words"), *[F.sum(c).alias(c) for c in ("errors", "substitutions", "deletions", "insertions")],
        rate("errors", "ref_words").alias("wer"), rate("raw_errors", "raw_ref_words").alias("raw_wer"), rate("char_errors", "ref_chars").alias("cer"), F.round(F.avg(F.col("is_loop").cast("int")), 6).alias("looped"),
    )


def by_classes(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """summary by each (class, value) of classes (clip, class, value): a clip counts in each that it has."""
    return summary(scores.join(classes, "clip"), "class", "value")


def rescored_runs(runs: DataFrame, clips: DataFrame, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the scores of all clips, an audit row for each run scored again). runs: run, version; clips: run,
    clip, ref, hyp, the fields of a score. Runs of other rules are scored again from the texts that they
    stored, never from today's labels; the rest stays. audit: run, old_version, old_wer, version, wer, clips."""
    version = version or default_folder().version
    old = runs.where(~F.col("version").eqNullSafe(F.lit(version))).select("run", F.col("version").alias("old_version"))
    stale, kept = clips.join(old, "run", "left_semi"), clips.join(old, "run", "left_anti")
    again = spread(stale, "clip").select(*[c for c in stale.columns if c not in FIELDS], score(F.col("ref"), F.col("hyp")).alias("s"))
    again = again.select(*[c for c in again.columns if c != "s"], *[F.col(f"s.{f}").alias(f) for f in FIELDS])
    before = summary(stale, "run").select("run", F.col("wer").alias("old_wer"))
    audit = old.join(before, "run", "left").join(summary(again, "run").select("run", "wer", "clips"), "run", "left").withColumn("version", F.lit(version))
    return kept.unionByName(again), audit.select("run", "old_version", "old_wer", "version", "wer", "clips")


def reclassified(scores: DataFrame, classes: DataFrame, genres: DataFrame) -> DataFrame:
    """(axis, class, value, rates): a run's breakdowns by today's classes (clip, class, value) and genres
    (clip, genre), with its stored counts as they are."""
    by_class = by_classes(scores, classes).withColumn("axis", F.lit("class"))
    genre = summary(scores.join(genres, "clip", "left"), "genre").select(F.lit("genre").alias("class"), F.col("genre").alias("value"), *[c for c in summary(scores).columns]).withColumn("axis", F.lit("genre"))
    return by_class.unionByName(genre)


def paired(run: DataFrame, base: DataFrame) -> DataFrame:
    """Two runs over the clips that both scored against the same reference: (clips, words, wer, base_wer,
    difference, better, worse), better and worse being clips. Clips whose reference differs are no pair."""
    a = run.select("clip", "ref_words", "errors", "ref_digest")
    b = base.select("clip", F.col("errors").alias("base_errors"), F.col("ref_digest"))
    both = a.join(b, ["clip", "ref_digest"])
    rate = lambda c: F.try_divide(F.sum(c), F.sum("ref_words"))
    return both.agg(
        F.count("*").alias("clips"), F.sum("ref_words").alias("words"), F.round(rate("errors"), 6).alias("wer"), F.round(rate("base_errors"), 6).alias("base_wer"), F.round(rate("errors") - rate("base_errors"), 6).alias("difference"),
        F.count_if(F.col("errors") < F.col("base_errors")).alias("better"), F.count_if(F.col("errors") > F.col("base_errors")).alias("worse"),
    )
