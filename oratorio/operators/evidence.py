"""What the review queue knows of a clip: its seed, its neighbours' texts, the hazards, and the priority."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import low_confidence, priority_score
from .corpus import queue_plan
from .texts import hazards, spread

#: What each component weighs in the priority.
WEIGHTS = {"unsupported_rate": 0.30, "dropped_rate": 0.20, "asr_disagreement": 0.20, "acoustic_gap": 0.15, "low_confidence": 0.10, "rule_flag_score": 0.05}
LOGPROB_FLOOR = -0.5


def seeds(hypotheses: DataFrame) -> DataFrame:
    """(segment, seed, fused): the hypothesis (segment, id, system, kind, avg_logprob) that an editor opens with: of
    the newest fusion system the newest, else the recogniser with the greatest log-probability, null ones
    last, the newest of equal ones. fused says which of the two it is."""
    is_fused = F.col("kind") == "fusion"
    order = F.struct(is_fused.alias("fused"), F.when(is_fused, F.col("system")).alias("system"), F.when(~is_fused, F.coalesce("avg_logprob", F.lit(float("-inf")))).alias("logprob"), F.col("id"))
    return hypotheses.groupBy("segment").agg(F.max_by("id", order).alias("seed"), F.max(is_fused).alias("fused"))


def neighbour_texts(segments: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(segment, neighbours): the texts of the recognisers' hypotheses (segment, id, kind, text) of the segment
    before and the one after in its episode, in order. segments: segment, episode, start. Segments are
    numbered in their episode, and the texts come by a join on the number, so that only numbers are sorted;
    a segment without hypotheses has no place in the row. A null text counts as empty."""
    texts = hypotheses.where("kind <> 'fusion'").groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("texts"))
    own = segments.join(texts, "segment").select("segment", "episode", "start", "texts")
    placed = own.select("segment", "episode", F.row_number().over(Window.partitionBy("episode").orderBy("start", "segment")).alias("place"))
    beside = own.drop("episode", "start").join(placed, "segment")
    beside = beside.select("episode", F.explode(F.array(F.struct((F.col("place") + 1).alias("place"), F.lit(0).alias("side")), F.struct((F.col("place") - 1).alias("place"), F.lit(1).alias("side")))).alias("p"), "texts").select("episode", "p.*", "texts")
    near = placed.join(beside, ["episode", "place"], "left").where("side is not null").groupBy("segment").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("side", "texts"))), lambda x: x["texts"])).alias("neighbours"))
    return placed.select("segment").join(near, "segment", "left").select("segment", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))


def assembled(segments: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(segment, seed_id, fused_text, texts, neighbours, avg_logprob, code, placed, gap) of all segments:
    fused_text with what the fuser and the aligner said of it where the seed is a fusion; texts of the
    recognisers, and the first log-probability that one of them has, in order of id. hypotheses: segment,
    id, system, kind, text, avg_logprob, code, placed, gap."""
    seed = seeds(hypotheses)
    own = hypotheses.where("kind = 'fusion'").select(F.col("id").alias("seed"), F.coalesce("text", F.lit("")).alias("fused_text"), "code", "placed", "gap")
    asr = hypotheses.where("kind <> 'fusion'").groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("text"), "avg_logprob"))).alias("asr"))
    of = segments.select("segment").join(seed, "segment", "left").join(own, "seed", "left").join(asr, "segment", "left").join(neighbour_texts(segments, hypotheses), "segment", "left")
    none = F.array().cast("array<string>")
    first = F.get(F.filter(F.transform("asr", lambda x: x["avg_logprob"]), lambda x: x.isNotNull()), F.lit(0))
    return of.select("segment", F.col("seed").alias("seed_id"), "fused_text", F.coalesce(F.transform("asr", lambda x: x["text"]), none).alias("texts"), F.coalesce("neighbours", none).alias("neighbours"), first.alias("avg_logprob"), "code", "placed", "gap")


def prioritised(evidence: DataFrame, flags: DataFrame, known: Sequence[str], weights: Mapping[str, float] = WEIGHTS, floor: float = LOGPROB_FLOOR) -> DataFrame:
    """(segment, seed_id, priority, unmeasured, hazards, and the rates) of the evidence assembled. flags: (segment, flags:
    an array), of which the share of the known ones raised counts, and others do not. Unsupported and
    dropped rates are measured of a fused text only."""
    h = hazards(F.col("fused_text"), F.col("texts"), F.col("neighbours"), F.col("code"), F.col("placed"), F.col("gap"))
    of = spread(evidence, "segment").withColumn("h", h).select("segment", "seed_id", "avg_logprob", F.col("fused_text").isNotNull().alias("fused"), "h.*").join(flags.select("segment", "flags"), "segment", "left")
    measured = lambda c: F.when(F.col("fused"), F.col(c))
    rule: Column = F.coalesce(F.size(F.array_intersect("flags", F.array(*[F.lit(f) for f in known]))) / F.lit(float(len(known))), F.lit(0.0))
    parts = {"unsupported_rate": measured("unsupported_rate"), "dropped_rate": measured("dropped_rate"), "asr_disagreement": F.col("asr_disagreement"), "acoustic_gap": F.col("acoustic_gap"), "low_confidence": F.when(F.col("avg_logprob").isNotNull(), low_confidence(F.col("avg_logprob"), floor)), "rule_flag_score": rule}
    score, unmeasured = priority_score(parts, weights, F.col("hazards"))
    return of.select("segment", "seed_id", score.alias("priority"), unmeasured.alias("unmeasured"), "hazards", *[c.alias(k) for k, c in parts.items()])


def queue(segments: DataFrame, hypotheses: DataFrame, flags: DataFrame, known: Sequence[str], audited: DataFrame, tasks: DataFrame) -> DataFrame:
    """The queue's plan with priorities from the evidence: queue_plan, and the reason beside each row.
    segments: segment, episode, start, pipeline_status; audited: (segment); tasks: (segment, id, status)."""
    ranked = prioritised(assembled(segments, hypotheses), flags, known)
    waiting = segments.select("segment", "pipeline_status").join(ranked, "segment").withColumnRenamed("segment", "segment_id")
    plan = queue_plan(waiting, audited.withColumnRenamed("segment", "segment_id"), tasks.withColumnRenamed("segment", "segment_id"), "hazards", "unmeasured")
    return plan.withColumnRenamed("segment_id", "segment")
