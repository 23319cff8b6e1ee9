"""What is known of a clip before it is classified: who speaks in it, how often the floor passes, whose voice
it is and how long that voice is heard in what a model trains on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import interval_join

#: Talk in seconds below which a speaker does not count in a clip.
LEAST_TALK = 0.5
#: The length in seconds of the bins in which clips and turns meet.
BIN = 30.0


def newest_turns(runs: DataFrame, turns: DataFrame) -> DataFrame:
    """(episode, speaker, voice, turn_start, turn_end) of each episode's newest run. runs: run, episode, voices (a
    map of speakers, null until the run is linked); turns: run, speaker, start, end."""
    newest = runs.groupBy("episode").agg(F.max_by(F.struct("run", "voices"), "run").alias("r")).select("episode", "r.*")
    of = turns.join(newest, "run")
    return of.select("episode", "speaker", F.try_element_at("voices", F.col("speaker")).alias("voice"), F.col("start").alias("turn_start"), F.col("end").alias("turn_end"))


def talk(clips: DataFrame, turns: DataFrame) -> DataFrame:
    """(clip, speaker, voice, turn_start, turn_end) of the turns (episode, speaker, voice, turn_start, turn_end) that meet a clip
    (clip, episode, start, end), cut to it. Spans meet in bins of time, so that a long episode is many tasks."""
    met = interval_join(clips.select("clip", "episode", "start", "end"), turns, ["episode"], ("start", "end"), ("turn_start", "turn_end"), BIN)
    return met.select("clip", "speaker", "voice", F.greatest("start", "turn_start").alias("turn_start"), F.least("end", "turn_end").alias("turn_end"))


def voice_seconds(clips: DataFrame, runs: DataFrame, turns: DataFrame) -> DataFrame:
    """(voice, seconds): the talk of each linked voice in the clips (with pot and split) that a model trains
    on: those in the train pot of train episodes."""
    trained = clips.where("pot = 'train' and split = 'train'")
    own = talk(trained, newest_turns(runs, turns)).where("voice is not null")
    return own.groupBy("voice").agg(F.round(F.sum(F.col("turn_end") - F.col("turn_start")), 6).alias("seconds"))


def clip_facts(clips: DataFrame, runs: DataFrame, turns: DataFrame, least: float = LEAST_TALK) -> DataFrame:
    """(clip, diarized, speakers, turn_changes, speaker, voice, voice_seconds), one a clip.

    speakers counts those with at least `least` seconds of talk, turn_changes how often a turn of one of
    them follows one of another, in order of start: null where the episode was never diarized, 0 where the
    diarizer heard nobody. speaker has most talk, of equal ones the first name; voice is who it is linked to,
    and voice_seconds that voice's talk in train clips, 0 if it has none; null without a voice.
    """
    newest = newest_turns(runs, turns)
    cut = talk(clips, newest)
    length = F.col("turn_end") - F.col("turn_start")
    each = cut.groupBy("clip", "speaker").agg(F.round(F.sum(length), 9).alias("talk"), F.first("voice", True).alias("voice"))
    most = each.groupBy("clip").agg(F.min_by(F.struct("speaker", "voice"), F.struct((-F.col("talk")).alias("less"), "speaker")).alias("m"), F.count_if(F.col("talk") >= least).alias("speakers"))
    present = cut.join(each.where(F.col("talk") >= least).select("clip", "speaker"), ["clip", "speaker"], "left_semi")
    before = F.lag("speaker").over(Window.partitionBy("clip").orderBy("turn_start", "turn_end", "speaker"))
    changes = present.withColumn("before", before).groupBy("clip").agg(F.count_if(F.col("before") != F.col("speaker")).alias("changes"))
    exposure = voice_seconds(clips, runs, turns)
    of = clips.select("clip", "episode").join(runs.select("episode").distinct().withColumn("diarized", F.lit(True)), "episode", "left").join(most, "clip", "left").join(changes, "clip", "left")
    of = of.withColumn("voice", F.col("m.voice")).join(exposure, "voice", "left")
    known = lambda c: F.when(F.col("diarized"), F.coalesce(c, F.lit(0).cast("long")))
    return of.select(
        "clip", F.coalesce("diarized", F.lit(False)).alias("diarized"), known("speakers").alias("speakers"), known("changes").alias("turn_changes"), F.col("m.speaker").alias("speaker"), "voice",
        F.when(F.col("voice").isNotNull(), F.coalesce("seconds", F.lit(0.0))).alias("voice_seconds"),
    )
