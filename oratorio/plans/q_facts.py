"""Queries of clip facts, over events: every fifth is a clip, the others are turns of its episode."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as C
from .registry import query
from .views import TURNS, turns

_IN = f"""{TURNS}, clips AS (
  SELECT turn_id AS clip, episode, start, "end", CASE WHEN turn_id % 3 = 0 THEN 'gold' ELSE 'train' END AS pot, CASE WHEN episode % 4 = 1 THEN 'val' ELSE 'train' END AS split FROM turns WHERE turn_id % 5 = 0
), heard AS (
  SELECT episode, CAST(speaker AS VARCHAR) AS speaker, CASE WHEN episode <> 2 AND speaker % 3 <> 0 THEN 'v' || speaker % 7 END AS voice, start AS turn_start, "end" AS turn_end FROM turns WHERE turn_id % 5 <> 0 AND turn_id % 2 = 1 AND episode <> 9
), cut AS (
  SELECT clip, pot, split, speaker, voice, greatest(start, turn_start) AS a, least("end", turn_end) AS b FROM clips JOIN heard USING (episode) WHERE start < turn_end AND "end" > turn_start
)"""


def _inputs(s, d):
    t = turns(s, d)
    clips = t.where("turn_id % 5 = 0").select(F.col("turn_id").alias("clip"), "episode", "start", "end", F.when(F.col("turn_id") % 3 == 0, "gold").otherwise("train").alias("pot"), F.when(F.col("episode") % 4 == 1, "val").otherwise("train").alias("split"))
    said = t.where("turn_id % 5 <> 0 and episode <> 9").select((F.col("episode") * 2 + F.col("turn_id") % 2).alias("run"), F.col("speaker").cast("string").alias("speaker"), "start", "end")
    names = t.select("episode", "speaker").distinct().where("speaker % 3 <> 0").groupBy("episode").agg(F.map_from_entries(F.collect_list(F.struct(F.col("speaker").cast("string"), F.concat(F.lit("v"), (F.col("speaker") % 7).cast("string"))))).alias("voices"))
    runs = t.where("episode <> 9").select("episode").distinct().join(names, "episode", "left").withColumn("voices", F.when(F.col("episode") != 2, F.col("voices")))
    return clips, runs.select(F.explode(F.array(F.col("episode") * 2, F.col("episode") * 2 + 1)).alias("run"), "episode", "voices"), said


@query("r2_voice_seconds", f"WITH {_IN} SELECT voice, round(sum(b - a), 6) AS seconds FROM cut WHERE pot = 'train' AND split = 'train' AND voice IS NOT NULL GROUP BY voice")
def _(s, d):
    return C.voice_seconds(*_inputs(s, d))


@query(
    "r2_clip_facts",
    f"""WITH {_IN}, each AS (SELECT clip, speaker, any_value(voice) AS voice, round(sum(b - a), 9) AS talk FROM cut GROUP BY clip, speaker
), most AS (SELECT clip, max(CASE WHEN k = 1 THEN voice END) AS voice, max(CASE WHEN k = 1 THEN speaker END) AS first, count(*) FILTER (talk >= 0.5) AS n FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY talk DESC, speaker) AS k FROM each) GROUP BY clip
), changes AS (SELECT clip, count(*) FILTER (before <> speaker) AS n FROM (SELECT c.clip, c.speaker, lag(c.speaker) OVER (PARTITION BY c.clip ORDER BY a, b, c.speaker) AS before FROM cut c JOIN each e ON e.clip = c.clip AND e.speaker = c.speaker AND e.talk >= 0.5) GROUP BY clip
), seconds AS (SELECT voice, round(sum(b - a), 6) AS s FROM cut WHERE pot = 'train' AND split = 'train' AND voice IS NOT NULL GROUP BY voice)
SELECT c.clip, c.episode <> 9 AS diarized, CASE WHEN c.episode <> 9 THEN coalesce(m.n, 0) END AS speakers, CASE WHEN c.episode <> 9 THEN coalesce(h.n, 0) END AS turn_changes, m.first AS speaker, m.voice, CASE WHEN m.voice IS NOT NULL THEN coalesce(s.s, 0.0) END AS voice_seconds
FROM clips c LEFT JOIN most m ON m.clip = c.clip LEFT JOIN changes h ON h.clip = c.clip LEFT JOIN seconds s ON s.voice = m.voice""",
)
def _(s, d):
    return C.clip_facts(*_inputs(s, d))
