"""Interval algebra over array<struct<start, end>> columns. Null means not measured, [] means clean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(start: Column, end: Column) -> Column:
    return F.array(F.struct(start.alias("start"), end.alias("end")))


def covered(of: Column) -> Column:
    """Sum of the lengths; overlaps count twice, reversed spans nothing."""
    return F.aggregate(of, F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), s["end"] - s["start"]))


def overlap_share(of: Column, duration: Column) -> Column:
    """The share of a clip that its spans take, at most 1: null unmeasured, 0 for no duration."""
    return F.when(of.isNull(), F.lit(None).cast("double")).when(duration <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), covered(of) / F.when(duration > 0, duration)))


def within(of: Column, start: Column, end: Column, places: int = 3) -> Column:
    """The spans cut to [start, end) and made relative to start; empty pieces go."""
    cut = F.transform(of, lambda s: F.struct((F.greatest(s["start"], start) - start).alias("start"), (F.least(s["end"], end) - start).alias("end")))
    return F.transform(F.filter(cut, lambda s: s["end"] > s["start"]), lambda s: F.struct(F.bround(s["start"], places).alias("start"), F.bround(s["end"], places).alias("end")))


def merged(of: Column, gap: float = 0.0) -> Column:
    """The union of the spans, in order; spans at most `gap` apart are joined."""
    kind = "array<struct<start:double,end:double>>"
    start = F.struct(F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.array().cast(kind).alias("out"))
    one = lambda lo, hi: F.array(F.struct(lo.alias("start"), hi.alias("end")))

    def step(a: Column, s: Column) -> Column:
        joined = F.struct(a["lo"].alias("lo"), F.greatest(a["hi"], s["end"]).alias("hi"), a["out"].alias("out"))
        fresh = F.struct(s["start"].alias("lo"), s["end"].alias("hi"), F.when(a["lo"].isNull(), a["out"]).otherwise(F.concat(a["out"], one(a["lo"], a["hi"]))).alias("out"))
        return F.when(s["start"] <= a["hi"] + gap, joined).otherwise(fresh)

    return F.aggregate(F.array_sort(of), start, step, lambda a: F.when(a["lo"].isNull(), a["out"]).otherwise(F.concat(a["out"], one(a["lo"], a["hi"]))))


def shared(a: Column, b: Column) -> Column:
    """Seconds of a that b covers; both without overlaps of their own."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.aggregate(b, F.lit(0.0), lambda c, y: c + F.greatest(F.lit(0.0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))))


def uncovered_share(speech: Column, words: Column) -> Column:
    """The share of the speech that no word covers; null where there is no speech or no word."""
    total = covered(speech)
    return F.when((F.size(words) > 0) & (total > 0), F.greatest(F.lit(0.0), 1 - shared(speech, merged(words)) / F.when(total > 0, total)))


def minus(a: Column, b: Column) -> Column:
    """What of the spans a no span of b covers, in order."""
    kind = "array<struct<start:double,end:double>>"

    def cut(x: Column) -> Column:
        start = F.struct(x["start"].alias("at"), F.array().cast(kind).alias("out"))
        piece = lambda lo, hi: F.when(hi > lo, F.array(F.struct(lo.alias("start"), hi.alias("end")))).otherwise(F.array().cast(kind))

        def step(acc: Column, y: Column) -> Column:
            gone = (y["end"] <= acc["at"]) | (y["start"] >= x["end"])
            moved = F.struct(F.greatest(acc["at"], y["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], F.least(y["start"], x["end"]))).alias("out"))
            return F.when(gone, acc).otherwise(moved)

        return F.aggregate(merged(b), start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], x["end"])))

    return F.flatten(F.transform(F.array_sort(a), cut))


def longest(of: Column, least: float = 0.0) -> Column:
    """The longest span of at least so many seconds, of equal ones the first; null if none."""
    big = F.filter(of, lambda s: s["end"] - s["start"] >= least)
    most = F.array_max(F.transform(big, lambda s: s["end"] - s["start"]))
    return F.get(F.filter(big, lambda s: s["end"] - s["start"] == most), F.lit(0))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two spans; 0 where they do not meet or have no length."""
    inter = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - inter
    return F.coalesce(F.try_divide(inter, F.nullif(union, F.lit(0.0))), F.lit(0.0))
