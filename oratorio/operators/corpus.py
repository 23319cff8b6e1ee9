"""The corpus as its maintainers see it: views of clips, who the voices are, coverage, the queue and what
changes it. Changes are frames of rows to append or to write, with the rows of their audit; nothing is
written here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest, newest_run

ACTIVE = ("pending", "in_progress")
APPROVED = ("accepted_unchanged", "edited")
PERSON = ("gender", "age_bracket")


def _given(c: str) -> Column:
    return F.nullif(c, F.lit(""))


def corpus_view(segments: DataFrame, labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows (segment_id, episode, duration, text, text_source, tier, pot), one a segment: the newest label's
    text if the label is approved and has one, else the seed's. segments: (segment_id, episode, duration,
    pot, split); labels, a log: (segment_id, created_at, id, disposition, tier, final_text); seeds: (segment_id,
    seed), one a segment."""
    current = latest(labels, ["segment_id"], F.desc("created_at"), F.desc("id")).select("segment_id", "disposition", "tier", _given("final_text").alias("final_text"))
    joined = segments.join(current, "segment_id", "left").join(seeds.select("segment_id", _given("seed").alias("seed")), "segment_id", "left")
    approved = F.coalesce(F.col("disposition").isin(*APPROVED) & F.col("final_text").isNotNull(), F.lit(False))
    return joined.select(
        "segment_id", "episode", "duration", F.when(approved, F.col("final_text")).otherwise(F.col("seed")).alias("text"),
        F.when(approved, "label").when(F.col("seed").isNotNull(), "seed").alias("text_source"), "tier", F.when(F.col("pot") == "gold", "gold").otherwise(F.col("split")).alias("pot"),
    )


def clip_turns(clips: DataFrame, runs: DataFrame, turns: DataFrame, width: float) -> DataFrame:
    """Rows (clip_id, speaker, rel_start, rel_end): the turns of each episode's newest run that meet a clip,
    cut to it and counted from its start. clips: (clip_id, episode, clip_start, clip_end); runs: (episode,
    run_id); turns: (run_id, speaker, start, end)."""
    from .joins import clipped, interval_join

    newest = newest_run(runs.select("episode", "run_id", F.col("run_id").alias("made")), "episode", "made").select("episode", "run_id")
    own = turns.join(newest, "run_id").select("episode", "speaker", "start", "end")
    met = interval_join(clips, own, ["episode"], ("clip_start", "clip_end"), ("start", "end"), width)
    return clipped(met, ("clip_start", "clip_end"), ("start", "end")).select("clip_id", "speaker", "rel_start", "rel_end")


def coverage(episodes: DataFrame) -> DataFrame:
    """Rows (key, value, episodes): in how many episodes each value of a key occurs. Shows are a column,
    topics and what speakers declare stand in the metadata, JSON with topic and speakers (an object by
    name); what an episode does not say counts nowhere. episodes: (episode, show_id, metadata)."""
    read = F.from_json("metadata", "topic string, speakers map<string, struct<gender: string, age_bracket: string>>")
    of = episodes.select("episode", "show_id", read.alias("m"))
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    said = F.transform(F.coalesce(F.map_values("m.speakers"), F.array()), lambda p: F.array(pair("gender", p["gender"]), pair("age_bracket", p["age_bracket"])))
    rows = of.select("episode", F.explode(F.concat(F.array(pair("show_id", F.col("show_id").cast("string")), pair("topic", F.col("m.topic"))), F.flatten(said))).alias("kv")).select("episode", "kv.*")
    return rows.where("value <> ''").groupBy("key", "value").agg(F.count_distinct("episode").alias("episodes"))


def _agreement(rows: str, n: Column) -> list[Column]:
    """For each field the value that all of n rows give, from lists of what they give."""
    lists = {f: F.array_compact(F.col(f"{rows}.{f}")) for f in (*PERSON, "role")}
    return [F.when((F.size(v) == n) & (F.size(F.array_distinct(v)) == 1), F.get(v, F.lit(0))).alias(f) for f, v in lists.items()]


def resolved(declared: DataFrame, heard: DataFrame) -> DataFrame:
    """Rows (episode, voice, gender, age_bracket, role, by) of the voices that a rule reaches: the only voice
    is the only declared row (only_pair); the only voice of the episode that recurs in others is the only
    host (recurring_host); the rows left agree, and there are as many as voices left (rows_agree).
    declared: (episode, gender, age_bracket, role); an episode has few. heard: (episode, voice)."""
    rows = declared.select("episode", F.struct(*[_given(c).alias(c) for c in (*PERSON, "role")]).alias("row"))
    host = F.coalesce(F.col("row.role") == "host", F.lit(False))
    per = rows.groupBy("episode").agg(F.count("*").alias("n"), F.count_if(host).alias("hosts"), F.collect_list("row").alias("every"), F.collect_list(F.when(~host, F.col("row"))).alias("guests"), F.first(F.when(host, F.col("row")), True).alias("host"))
    voices = heard.select("episode", "voice").distinct()
    recurs = voices.groupBy("voice").agg((F.count("*") > 1).alias("recurs"))
    own = Window.partitionBy("episode")
    at = voices.join(recurs, "voice").withColumn("v", F.count("*").over(own)).withColumn("r", F.count_if("recurs").over(own)).join(per, "episode")
    single = (F.col("n") == 1) & (F.col("v") == 1)
    matched = ~single & (F.col("hosts") == 1) & (F.col("r") == 1)
    less = F.when(matched, 1).otherwise(0)
    left, fits = F.col("n") - less, (F.col("n") > less) & (F.col("v") - less <= F.col("n") - less)
    agreed = F.when(matched, F.struct(*_agreement("guests", left))).otherwise(F.struct(*_agreement("every", left)))
    any_agreed = F.coalesce(*[agreed[f] for f in (*PERSON, "role")]).isNotNull()
    by = F.when(single, "only_pair").when(matched & F.col("recurs"), "recurring_host").when(fits & any_agreed, "rows_agree")
    pick = lambda f: F.when(F.col("by") == "only_pair", F.get("every", F.lit(0))[f]).when(F.col("by") == "recurring_host", F.col(f"host.{f}")).otherwise(F.col("agreed")[f]).alias(f)
    return at.withColumn("by", by).withColumn("agreed", agreed).where("by is not null").select("episode", "voice", *[pick(f) for f in (*PERSON, "role")], "by")


def identities(found: DataFrame, heard: DataFrame, manual: DataFrame) -> DataFrame:
    """Rows (voice, gender, age_bracket, status, only_pair, recurring_host, rows_agree, manual, disagrees), one
    a voice heard: what the episodes agree on, how many each rule gave, and whether two disagree (conflict:
    none of their values is taken). Values set by hand win, and their fields never conflict: manual lists
    them, disagrees those of them for which the episodes give another value, or several. manual: (voice,
    gender, age_bracket), one a voice."""
    rules = ("only_pair", "recurring_host", "rows_agree")
    per = found.groupBy("voice").agg(*[x for f in PERSON for x in (F.min(f).alias(f"low_{f}"), F.max(f).alias(f"high_{f}"))], *[F.count_if(F.col("by") == r).alias(r) for r in rules])
    hand = manual.select("voice", *[_given(f).alias(f"hand_{f}") for f in PERSON])
    at = heard.select("voice").distinct().join(per, "voice", "left").join(hand, "voice", "left")
    clash = lambda f: F.coalesce((F.col(f"low_{f}") != F.col(f"high_{f}")) & F.col(f"hand_{f}").isNull(), F.lit(False))
    at = at.withColumn("conflict", clash(PERSON[0]) | clash(PERSON[1]))
    ruled = lambda f: F.when(~F.col("conflict") & (F.col(f"low_{f}") == F.col(f"high_{f}")), F.col(f"low_{f}"))
    chosen = {f: F.coalesce(F.col(f"hand_{f}"), ruled(f)) for f in PERSON}
    status = F.when(F.col("conflict"), "conflict").when(F.coalesce(*chosen.values()).isNotNull(), "resolved").otherwise("unresolved")
    named = lambda of: F.array_compact(F.array(*[F.when(of(f), F.lit(f)) for f in PERSON]))
    by_hand = lambda f: F.col(f"hand_{f}").isNotNull()
    other = lambda f: by_hand(f) & ((F.col(f"low_{f}") != F.col(f"hand_{f}")) | (F.col(f"high_{f}") != F.col(f"hand_{f}")))
    return at.select("voice", *[c.alias(f) for f, c in chosen.items()], status.alias("status"), *[F.coalesce(r, F.lit(0)).alias(r) for r in rules], named(by_hand).alias("manual"), named(other).alias("disagrees"))


def voice_page(clips: DataFrame, verdicts: DataFrame, limit: int) -> DataFrame:
    """The first clips of a voice with the number of all: confirmed ones first, rejected last, the longest
    stretch first within each. clips: (segment_id, start, end); verdicts: (segment_id, verdict)."""
    rank = F.when(F.col("verdict") == "confirmed", 0).when(F.col("verdict") == "rejected", 2).otherwise(1)
    judged = clips.join(verdicts.select("segment_id", "verdict"), "segment_id", "left")
    shown = judged.orderBy(rank, F.desc(F.col("end") - F.col("start")), "segment_id").limit(limit)
    return shown.crossJoin(F.broadcast(clips.agg(F.count("*").alias("total"))))


def queue_plan(segments: DataFrame, audited: DataFrame, tasks: DataFrame, *more: str) -> DataFrame:
    """Rows (segment_id, queue, priority, action, task_id, new_status), one a segment that waits and has no
    task done: without a seed it is an error, else audited or to be reviewed; its active task is updated, or
    one is inserted, which makes an imported segment queued. segments: (segment_id, pipeline_status, seed_id,
    priority, and more columns, which stay); audited: (segment_id); tasks: (segment_id, id, status), one
    active a segment at most."""
    waiting = segments.where(F.col("pipeline_status").isin("imported", "queued"))
    open_ = waiting.join(tasks.where("status = 'done'").select("segment_id"), "segment_id", "left_anti")
    active = tasks.where(F.col("status").isin(*ACTIVE)).select("segment_id", F.col("id").alias("task_id"))
    chosen = audited.select("segment_id").distinct().withColumn("audited", F.lit(True))
    joined = open_.join(active, "segment_id", "left").join(chosen, "segment_id", "left")
    insert = F.col("task_id").isNull()
    return joined.select(
        "segment_id", F.when(F.col("seed_id").isNull(), "error").when(F.col("audited"), "audit").otherwise("review").alias("queue"), "priority",
        F.when(insert, "insert").otherwise("update").alias("action"), "task_id", F.when(insert, "queued").otherwise(F.col("pipeline_status")).alias("new_status"), *more,
    )


def decisions(incoming: DataFrame, tasks: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """incoming with the segment of its task and why it is refused, null where it is to be appended: an unknown
    task, one that is not active, a disposition that is not allowed, an edit without text, or a later
    decision on the same task. incoming: (decision_id, task_id, disposition, final_text)."""
    at = incoming.join(tasks.select(F.col("id").alias("task_id"), "segment_id", "status"), "task_id", "left")
    why = (
        F.when(F.col("status").isNull(), "unknown task").when(~F.col("status").isin(*ACTIVE), "task not active")
        .when(~F.coalesce(F.col("disposition").isin(*allowed), F.lit(False)), "disposition").when((F.col("disposition") == "edited") & _given("final_text").isNull(), "no text")
    )
    judged = at.withColumn("refused", why)
    first = F.row_number().over(Window.partitionBy("task_id", F.col("refused").isNull()).orderBy("decision_id"))
    return judged.withColumn("refused", F.when(F.col("refused").isNull() & (first > 1), "task decided").otherwise(F.col("refused"))).select(*incoming.columns, "segment_id", "refused")


def changed(stored: DataFrame, fresh: DataFrame, key: str, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """Rows (key, column, old, new) of the audit: what of the stored numbers a new computation changes by more
    than `least`, or fills, or clears. Keys that were not computed again stay as they are."""
    new = fresh.select(key, *[F.col(c).cast("double").alias(f"__{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("old"), F.col(f"__{c}").alias("new")) for c in columns])
    pairs = stored.select(key, *columns).join(new, key).select(key, F.inline(rows))
    return pairs.where((F.abs(F.col("old") - F.col("new")) > least) | (F.col("old").isNull() != F.col("new").isNull()))


def pot_moves(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (segment_id, from_pot, to_pot) of segments whose pot is another than wanted. wanted: (segment_id, pot)."""
    to = wanted.select("segment_id", F.col("pot").alias("to_pot"))
    return segments.select("segment_id", F.col("pot").alias("from_pot")).join(to, "segment_id").where(~F.col("from_pot").eqNullSafe(F.col("to_pot")))


def model_table(metrics: DataFrame, sets: Sequence[str], teacher: str, order: Sequence[str]) -> DataFrame:
    """One row a model with its pooled rate on each set and its difference to the teacher's, in a fixed order of
    models, others last by name. metrics: (model, set, errors, words)."""
    cells = metrics.groupBy("model").pivot("set", list(sets)).agg(F.try_divide(100.0 * F.sum("errors"), F.nullif(F.sum("words"), F.lit(0))))
    own = cells.where(F.col("model") == teacher).select(*[F.col(s).alias(f"__{s}") for s in sets])
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model")), F.lit(0)), F.lit(len(order) + 1))
    joined = cells.join(F.broadcast(own), how="left")  # one row
    return joined.select("model", place.cast("int").alias("place"), *sets, *[(F.col(s) - F.col(f"__{s}")).alias(f"{s}_to_teacher") for s in sets]).orderBy("place", "model")


def episode_segments(segments: DataFrame, hypotheses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Segments with the text of their first hypothesis and their task, an active one before others and the
    newest before older ones; those without either stay. hypotheses: (segment_id, id, text); tasks: (segment_id,
    id, status)."""
    first = hypotheses.groupBy("segment_id").agg(F.min_by("text", "id").alias("text"))
    task = latest(tasks, ["segment_id"], F.when(F.col("status").isin(*ACTIVE), 0).otherwise(1), F.desc("id"))
    return segments.join(first, "segment_id", "left").join(task.select("segment_id", F.col("id").alias("task_id"), "status"), "segment_id", "left")


def newest_clips(runs: DataFrame, clips: DataFrame) -> DataFrame:
    """The clips of each model's newest run on a set, what a new scoring starts from. runs: (model, set, run_id);
    clips: (run_id, and whatever they have)."""
    newest = runs.groupBy("model", "set").agg(F.max("run_id").alias("run_id"))
    return clips.join(newest, "run_id")


def error_files(files: DataFrame, summaries: DataFrame, imported: DataFrame) -> DataFrame:
    """One row a file of error rows: its own pooled rate, the imported one, and the difference; null where either
    is missing. files: (file); summaries: (file, errors, words), added up here; imported: (file, wer)."""
    own = summaries.groupBy("file").agg(F.try_divide(100.0 * F.sum("errors"), F.nullif(F.sum("words"), F.lit(0))).alias("wer"))
    joined = files.join(own, "file", "left").join(imported.select("file", F.col("wer").alias("imported_wer")), "file", "left")
    return joined.withColumn("difference", F.col("wer") - F.col("imported_wer"))
