"""Buckets, ordered cases and clamps over columns. Edges mix < and <= as stated for each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Cases = Sequence[tuple[Column, str]]


def cases(pairs: Cases, otherwise: Column | str | None) -> Column:
    """The value of the first condition that holds; null counts as false."""
    (first, value), *rest = pairs
    out = F.when(first, F.lit(value))
    for cond, v in rest:
        out = out.when(cond, F.lit(v))
    return out.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def below(x: Column, edges: Sequence[float], names: Sequence[str], null: str = "unmeasured") -> Column:
    """names[i] for the first edge above x, the last name beyond all edges."""
    return cases([(x.isNull(), null), *[(x < e, n) for e, n in zip(edges, names, strict=False)]], names[-1])


def overlap_bucket(share: Column) -> Column:
    return cases([(share.isNull(), "unmeasured"), (share <= 0, "none"), (share < 0.05, "0-5%"), (share <= 0.15, "5-15%")], ">15%")


def snr_bucket(db: Column) -> Column:
    return below(db, (15, 25, 35, 45), ("<15 dB", "15-25 dB", "25-35 dB", "35-45 dB", "45+ dB"))


def reverb_bucket(db: Column) -> Column:
    return below(db, (40, 50, 55), ("<40 dB", "40-50 dB", "50-55 dB", "55+ dB"))


def bandwidth_bucket(hz: Column) -> Column:
    return below(hz, (4500, 6500), ("<4.5 kHz", "4.5-6.5 kHz", "6.5+ kHz"))


def rarity_bucket(n: Column) -> Column:
    return cases([(n.isNull() | (n < 1), "never"), (n < 10, "1-9"), (n < 50, "10-49"), (n < 100, "50-99")], "100+")


def duration_bucket(seconds: Column) -> Column:
    return below(seconds, (5, 15), ("<5 s", "5-15 s", "15+ s"), "unmeasured")


def pause_bucket(speech: Column, duration: Column) -> Column:
    pause = F.greatest(F.lit(0.0), 1 - speech / F.when(duration > 0, duration))
    return cases([(pause.isNull(), "unmeasured"), (pause < 0.02, "<2%"), (pause <= 0.10, "2-10%")], ">10%")


def exposure_bucket(voice: Column, seconds: Column) -> Column:
    return cases([(voice.isNull() | seconds.isNull(), "unlinked"), (seconds <= 0, "unseen"), (seconds < 600, "<10 min"), (seconds < 3600, "10-60 min")], "1 h+")


def cmi_bucket(cmi: Column) -> Column:
    return cases([(cmi.isNull(), "unmeasured"), (cmi <= 0, "0"), (cmi < 15, "<15"), (cmi < 30, "15-30")], "30+")


def count_bucket(n: Column, most: int, null: str = "undiarized", zero: str | None = None) -> Column:
    """The count as text up to most, then "most+"."""
    out = F.when(n.isNull(), F.lit(null))
    if zero is not None:
        out = out.when(n == 0, F.lit(zero))
    return out.when(n >= most, F.lit(f"{most}+")).otherwise(n.cast("string"))


def speaking_rate_bucket(words_per_second: Column) -> Column:
    return below(words_per_second, (2.0, 2.6, 3.2, 3.8), ("<2.0 w/s", "2.0-2.6 w/s", "2.6-3.2 w/s", "3.2-3.8 w/s", "3.8+ w/s"))


def mixing_bucket(share: Column) -> Column:
    return cases([(share == 0, "0"), (share < 0.15, "<15"), (share < 0.30, "15-30")], "30+")


def effective_split(pot: Column, split: Column) -> Column:
    return F.when(pot == "gold", F.lit("test")).otherwise(split)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null counts as the lower end."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(low))))


def low_confidence(logprob: Column, floor: float) -> Column:
    return F.when(logprob.isNull(), F.lit(0.0)).otherwise(clamp(logprob / F.lit(floor)))


def rate(errors: Column, words: Column) -> Column:
    """Errors per 100 words; 0 where there are no words."""
    return F.coalesce(F.try_divide(errors * F.lit(100.0), F.nullif(words, F.lit(0))), F.lit(0.0))


def rate_or_null(errors: Column, words: Column) -> Column:
    return F.try_divide(errors * F.lit(100.0), F.nullif(words, F.lit(0)))


def error_kind(kind: Column, number: Column, ref_script: Column, hyp_script: Column, similarity: Column, similar: float = 0.75) -> Column:
    """Parts errors into seven kinds; the first that holds wins. Null for rows that are no error."""
    native = (ref_script == "dev") & (hyp_script == "dev")
    named = cases(
        [(number, "number"), (kind == "del", "deletion"), (kind == "ins", "insertion"), ((ref_script == "lat") & (hyp_script == "lat"), "english"), (native & (similarity >= similar), "nepali_similar"), (native, "nepali_other")],
        "script",
    )
    return F.when(kind.isin("sub", "del", "ins"), named)


def priority_score(components: Mapping[str, Column], weights: Mapping[str, float], hazards: Column) -> tuple[Column, Column]:
    """(priority, names of components that are null): clamped components times weights, plus one where
    any hazard was raised."""
    score = sum((clamp(components[k]) * weights[k] for k in list(components)[1:]), clamp(components[next(iter(components))]) * weights[next(iter(components))])
    unmeasured = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(k)) for k, c in components.items()]))
    return score + F.when(F.size(hazards) > 0, 1.0).otherwise(0.0), unmeasured


def coverage_status(rated: Column, kind: Column, clips: Column, hours: Column, unit: Column, voices: Column, share: Column, *, thin_hours: float, thin_voices: int, plenty: float, dominant: float) -> Column:
    """kind: 'unknown', 'defect', 'off_list' or null."""
    return cases(
        [(~rated, "unrated"), (kind == "unknown", "unknown"), (kind == "defect", "defect"), (kind == "off_list", "off_list"), (clips == 0, "missing"), (hours < thin_hours, "thin"), ((unit == "voices") & (voices < thin_voices), "thin"), (share > dominant, "overdone"), (hours >= plenty * thin_hours, "plenty")],
        "enough",
    )


def vendor(route: Column, model: Column) -> Column:
    """The vendor of a request by its route and model; `scribe` must not be part of `transcribe`."""
    r, m = F.lower(F.coalesce(route, F.lit(""))), F.lower(F.coalesce(model, F.lit("")))
    return cases(
        [
            (r.contains("elevenlabs") | m.contains("elevenlabs") | m.rlike("(?<!tran)scribe") | r.startswith("asr_scribe") | r.startswith("scribe"), "ElevenLabs"),
            (r.contains("vertex") | r.contains("gemini") | m.contains("gemini"), "Google Cloud Vertex AI"),
            (r.contains("mai") | r.contains("openrouter") | m.contains("/"), "OpenRouter"),
        ],
        "Unknown Vendor",
    )


def duration_cost(seconds: Column, per_hour: str) -> Column:
    """USD of audio at a price an hour, rounded half up to six places."""
    return F.round(F.greatest(F.lit(0.0), seconds).cast("decimal(18,6)") / F.lit(3600).cast("decimal(18,0)") * F.lit(per_hour).cast("decimal(12,6)"), 6).cast("decimal(12,6)")


def token_cost(prompt: Column, completion: Column, per_million_in: str, per_million_out: str) -> Column:
    price = lambda n, p: F.coalesce(n, F.lit(0)).cast("decimal(18,0)") * F.lit(p).cast("decimal(12,6)")
    return F.round((price(prompt, per_million_in) + price(completion, per_million_out)) / F.lit(1_000_000).cast("decimal(18,0)"), 6).cast("decimal(12,6)")


def declared_value(speakers: Column, field: str, count: Column) -> Column:
    """The value of a field that all speakers of a map share: else `mixed`, or `undeclared` where any
    has none, none is listed, or more are counted than listed."""
    values = F.transform(F.map_values(speakers), lambda s: F.when(s[field] != "", s[field]))
    return cases(
        [(speakers.isNull() | (F.size(speakers) == 0) | (count > F.size(speakers)), "undeclared"), (F.exists(values, lambda v: v.isNull()), "undeclared"), (F.size(F.array_distinct(values)) > 1, "mixed")],
        F.element_at(values, 1),
    )
