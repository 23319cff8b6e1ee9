"""Counts, progress, pots, costs and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import effective_split
from .latest import latest


def filled_counts(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows by value over a closed vocabulary, zero where there are none."""
    names = rows.sparkSession.createDataFrame([(a,) for a in allowed], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def throughput(events: DataFrame, since: str) -> DataFrame:
    """One row: exact medians of seconds, hours and counts, of all events and of those since a time."""
    s = F.col("duration_ms") / 1000
    new = F.col("created_at") >= F.lit(since).cast("timestamp")
    return events.agg(F.median(s).alias("median_seconds"), (F.sum(s) / 3600).alias("hours"), F.count("duration_ms").alias("events"), F.count_if(new).alias("session_events"), F.median(F.when(new, s)).alias("session_median_seconds"))


def current_labels(log: DataFrame) -> DataFrame:
    return latest(log, ["segment_id", "version"], F.desc("created_at"), F.desc("id"))


def accept_rate_by_day(current: DataFrame) -> DataFrame:
    accepted = F.count_if(F.col("disposition") == "accepted_unchanged")
    return current.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count("*").alias("labeled"), accepted.alias("accepted"), F.round(accepted / F.count("*"), 4).alias("accept_rate"))


def split_balance(segments: DataFrame) -> DataFrame:
    return segments.groupBy(effective_split(F.col("pot"), F.col("split")).alias("split")).agg(F.count_distinct("episode").alias("episodes"), F.count("*").alias("segments"), F.coalesce(F.sum("duration") / 3600, F.lit(0.0)).alias("hours"))


def pots(segments: DataFrame, labelled: DataFrame) -> DataFrame:
    """By gold or split: segments, episodes, hours and the hours that have a label."""
    bucket = F.when(F.col("pot") == "gold", "gold").otherwise(F.col("split"))
    have = labelled.select("segment_id").distinct().withColumn("has", F.lit(True))
    return segments.join(have, "segment_id", "left").groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("segments"), F.count_distinct("episode").alias("episodes"), (F.sum("duration") / 3600).alias("hours"), F.coalesce(F.sum(F.when(F.col("has"), F.col("duration"))) / 3600, F.lit(0.0)).alias("labeled_hours")
    )


def spanning(segments: DataFrame, key: str = "episode", value: str = "pot") -> DataFrame:
    """Keys with more than one value."""
    return segments.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def fanned(segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Episodes with distinct counts over a join that repeats segments for each of their tasks."""
    done = F.count_distinct(F.when(F.col("status") == "done", F.col("segment_id")))
    return segments.join(tasks, "segment_id", "left").groupBy("episode").agg(F.count_distinct("segment_id").alias("segments"), done.alias("done"), F.count_distinct(F.when(F.col("pot") == "gold", F.col("segment_id"))).alias("gold"))


def cost_by(requests: DataFrame, *by: str | Column) -> DataFrame:
    """Requests, outcomes, cost, tokens, and the mean latency of those that succeeded."""
    ok = F.col("status") == "succeeded"
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "dry_run").alias("dry_run"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("average_latency_ms"),
    )


def with_share(rows: DataFrame, value: str, name: str, scale: float = 1.0) -> DataFrame:
    """rows with their part of the total of a value, 0 where the total is. rows is an aggregate."""
    total = rows.agg(F.sum(value).alias("__total"))
    return rows.crossJoin(F.broadcast(total)).withColumn(name, F.coalesce(F.try_divide(F.col(value) * scale, F.nullif("__total", F.lit(0))), F.lit(0.0))).drop("__total")


def daily_by_vendor(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"), "vendor").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost_usd"), F.count("*").alias("requests"))


def search(rows: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{term.strip()}%"), F.lit(False))
    return rows.where(cond)


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order: a top-k of each task, merged."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def by_axes(clips: DataFrame, classes: Column, total_errors: str = "errors") -> DataFrame:
    """One row for each axis and bucket of a map column: clips, words, errors, rate and share of all
    errors. The map is exploded once, so that all axes are one aggregation."""
    per = clips.select("errors", "words", F.explode(classes).alias("axis", "bucket")).groupBy("axis", "bucket").agg(F.count("*").alias("clips"), F.sum("words").alias("words"), F.sum("errors").alias("errors"))
    total = clips.agg(F.sum("errors").alias("__total"))
    return per.crossJoin(F.broadcast(total)).select("axis", "bucket", "clips", "words", "errors", F.coalesce(F.try_divide(F.col("errors") * 100.0, F.nullif("words", F.lit(0))), F.lit(0.0)).alias("wer"), F.coalesce(F.try_divide(F.col("errors") * 1.0, F.nullif("__total", F.lit(0))), F.lit(0.0)).alias("share_of_errors"))


def categories(clips: DataFrame, buckets: Column, voice_words: int) -> DataFrame:
    """Every bucket of every category of a map column: hours by tier and pot, distinct episodes and
    voices, voices with enough words, and the share of the category's hours. clips: episode, voice,
    words, duration, tier, pot. Two levels, so that voices are counted without a second pass."""
    h = F.col("duration") / 3600
    per = clips.select("*", F.explode(buckets).alias("category", "bucket"))
    by_voice = per.groupBy("category", "bucket", "voice", "episode").agg(F.sum(h).alias("h"), F.count("*").alias("n"), F.sum("words").alias("w"), *[F.sum(F.when(F.col(c) == v, h).otherwise(0.0)).alias(f"{v}_hours") for c, v in (("tier", "verified"), ("tier", "screened"), ("pot", "gold"), ("pot", "train"))])
    sums = ["verified_hours", "screened_hours", "gold_hours", "train_hours"]
    usable = by_voice.groupBy("category", "bucket", "voice").agg(F.sum("w").alias("w")).groupBy("category", "bucket").agg(F.count("voice").alias("voices"), F.count_if((F.col("w") >= voice_words) & F.col("voice").isNotNull()).alias("usable_voices"))
    out = by_voice.groupBy("category", "bucket").agg(F.sum("h").alias("hours"), F.sum("n").alias("clips"), F.count_distinct("episode").alias("episodes"), *[F.sum(s).alias(s) for s in sums]).join(usable, ["category", "bucket"])
    return out.withColumn("share", F.col("hours") / F.sum("hours").over(Window.partitionBy("category")))


def voice_profiles(clips: DataFrame) -> DataFrame:
    """One row a voice: clips, hours, hours by pot, words, rate, weighted mean of code-mixing, first and
    last day, episodes."""
    h = F.col("duration") / 3600
    return clips.where("voice is not null").groupBy("voice").agg(
        F.count("*").alias("clips"), F.sum(h).alias("hours"), F.sum(F.when(F.col("pot") == "gold", h).otherwise(0.0)).alias("gold_hours"), F.sum("words").alias("words"),
        F.try_divide(F.sum("words") * 1.0, F.nullif(F.sum("duration"), F.lit(0.0))).alias("words_per_second"), F.try_divide(F.sum(F.col("cmi") * F.col("words")), F.nullif(F.sum(F.when(F.col("cmi").isNotNull(), F.col("words"))), F.lit(0))).alias("mean_cmi"),
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count_distinct("episode").alias("episodes"),
    )


def co_voices(clips: DataFrame) -> DataFrame:
    """Voices heard in one episode: (voice, other, episodes), from distinct pairs of voice and episode."""
    v = clips.where("voice is not null").select("episode", "voice").distinct()
    return v.join(v.withColumnRenamed("voice", "other"), "episode").where("voice <> other").groupBy("voice", "other").agg(F.count("*").alias("episodes"))


def completeness(rows: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """(field, filled, missing) over all fields in one pass."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("has")) for f in fields]))
    return rows.select(key, stack.alias("s")).groupBy("s.field").agg(F.count_if("s.has").alias("filled"), F.count_if(~F.col("s.has")).alias("missing"))


def rollup_all(rows: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """By key and for all together, named `all`."""
    return rows.rollup(key).agg(F.grouping(key).alias("__g"), *aggs).withColumn(key, F.when(F.col("__g") == 1, "all").otherwise(F.col(key))).drop("__g")


def mixture_weights(rows: DataFrame, human_share: float) -> DataFrame:
    """Each clip's chance of being drawn: human clips (group null) share human_share, channels share the
    rest by the square root of their hours, and within each a clip counts by its length."""
    per = rows.groupBy("group").agg(F.sum("hours").alias("total"))
    whole = per.agg(F.sum(F.when(F.col("group").isNotNull(), F.sqrt("total"))).alias("roots"), F.bool_or(F.col("group").isNull()).alias("has_human"))
    part = F.when(F.col("group").isNull(), F.when(F.col("roots").isNull(), 1.0).otherwise(human_share)).otherwise(F.when(F.col("has_human"), 1 - human_share).otherwise(1.0) * F.sqrt("total") / F.col("roots"))
    shares = per.crossJoin(F.broadcast(whole)).select(F.col("group").alias("g"), (part / F.col("total")).alias("per_hour"))
    return rows.join(shares, rows["group"].eqNullSafe(shares["g"])).withColumn("weight", F.col("per_hour") * F.col("hours")).drop("g", "per_hour")


def filtered_pseudo(rows: DataFrame, low: float, high: float, drop_fraction: float, max_overlap: float | None, order: list[str]) -> DataFrame:
    """rows with `reason`: the first rule that drops a row, or null. The least confident part of what is
    left goes last: its threshold is found by rank within ranges of confidence, whose sizes are added
    up first, so that no task holds all rows. Rows that an earlier rule drops are not ranked, and rows
    without a log-probability are not dropped for it."""
    over = F.col("overlap_share") > F.lit(max_overlap) if max_overlap is not None else F.lit(False)
    speed = F.try_divide(F.col("n_tokens") * 1.0, F.col("duration"))
    first = F.when(over, "overlap").when(F.col("looped"), "loop").when(F.trim("text") == "", "empty").when(~speed.between(low, high) | speed.isNull(), "rate")
    marked = rows.withColumn("reason", first)
    left = marked.where("reason is null")
    by = F.floor(F.col("mean_logprob") * 1000)
    ranked = left.where("mean_logprob is not null").withColumn("range", by)
    sizes = ranked.groupBy("range").agg(F.count("*").alias("size"))
    starts = sizes.select("range", F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    n_drop = left.agg(F.floor(F.count("*") * drop_fraction).alias("n_drop"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("mean_logprob", *order))
    placed = ranked.withColumn("rank", rank).join(starts, "range").crossJoin(F.broadcast(n_drop))
    placed = placed.withColumn("reason", F.when(F.col("start") + F.col("rank") <= F.col("n_drop"), "confidence"))
    rest = marked.where("reason is not null or mean_logprob is null")
    return rest.unionByName(placed.select(*rest.columns))


def index_percentiles(rows: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """(key, low, high): the values at places floor(low * n) and floor(high * n) - 1, from 0, of a key's n
    sorted values. Equal values are counted first and a key's counts summed in ranges of the values, so that
    a key with very many rows is many tasks; nulls are no values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    whole = counts.groupBy(key).agg(F.sum("n").alias("all"), F.min(value).alias("least"), F.max(value).alias("most"))
    part = F.when(F.col("most") > F.col("least"), F.floor((F.col(value) - F.col("least")) / (F.col("most") - F.col("least")) * 1024)).otherwise(F.lit(0))
    of = counts.join(whole, key).withColumn("part", part)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = of.groupBy(key, "part").agg(F.sum("n").alias("n")).select(key, "part", before(Window.partitionBy(key).orderBy("part")).alias("start"))
    placed = of.withColumn("within", before(Window.partitionBy(key, "part").orderBy(value))).join(parts, [key, "part"])
    first = F.col("start") + F.col("within")
    holds = lambda at: (first <= at) & (at < first + F.col("n"))
    at_low, at_high = F.floor(F.lit(low) * F.col("all")), F.floor(F.lit(high) * F.col("all")) - 1
    return placed.groupBy(key).agg(F.max(F.when(holds(at_low), F.col(value))).alias("low"), F.max(F.when(holds(at_high), F.col(value))).alias("high"))
