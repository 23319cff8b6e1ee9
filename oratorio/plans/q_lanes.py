"""Queries of words on clocks and lanes, over conversations (turns as clips) and events (as timed words)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lanes as L
from .registry import query
from .views import TURNS, table, turns


def _texts(s, d):
    """Turns as clips: (clip, conv, turn, text)."""
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("clip"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def _timed(texts, step: float = 0.4, late: float = 0.0):
    """(clip, pos, word, start, end): words said every `step` seconds; every eleventh has no time."""
    w = texts.select("clip", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("pos", "word"))
    at = F.when((F.col("pos") + F.col("turn")) % 11 != 0, F.round(F.col("pos") * step + late, 3))
    return w.select("clip", "pos", "word", at.alias("start"), F.round(at + 0.3, 3).alias("end"))


def _later(s, d, by: int):
    """Each clip with the text of the turn `by` further on."""
    t = _texts(s, d)
    other = t.select("conv_id", (F.col("turn") - by).alias("turn"), F.col("text").alias("other"))
    return t.drop("text").join(other, ["conv_id", "turn"]).select("clip", "turn", F.col("other").alias("text"))


def _lane_turns(s, d):
    """Three speakers that take turns of 3.5 seconds every 3 in each clip."""
    t = _texts(s, d).select("clip", "turn", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return t.select("clip", (F.col("k") * 3.0).alias("turn_start"), (F.col("k") * 3.0 + 3.5).alias("turn_end"), ((F.col("k") + F.col("turn")) % 3 + 1).cast("int").alias("speaker"))


@query("c26_matched")
def _(s, d):
    return L.matched(_timed(_texts(s, d)), _timed(_later(s, d, 1)), "clip")


@query("c26_boundaries")
def _(s, d):
    return L.boundary_differences(_timed(_texts(s, d)), _timed(_later(s, d, 1), 0.5), "clip")


@query("c27_placed")
def _(s, d):
    return L.placed(_texts(s, d), _timed(_later(s, d, 1)), "clip")


@query(
    "c27_by_turns",
    f"""WITH {TURNS}, words AS (SELECT turn_id AS pos, episode, start, CASE WHEN turn_id % 9 = 0 THEN start ELSE start + ("end" - start) / 2 END AS "end" FROM turns WHERE kind IN ('view', 'click')
), said AS (SELECT episode, speaker, start AS turn_start, "end" AS turn_end FROM turns WHERE kind NOT IN ('view', 'click')
), share AS (
  SELECT pos, speaker, round(sum(CASE WHEN w."end" > w.start THEN least(w."end", turn_end) - greatest(w.start, turn_start) ELSE 1.0 END), 9) AS s
  FROM words w JOIN said t ON w.episode = t.episode AND ((w."end" > w.start AND turn_start < w."end" AND turn_end > w.start) OR (w."end" <= w.start AND turn_start <= w.start AND w.start < turn_end)) GROUP BY ALL
), most AS (SELECT pos, speaker FROM share QUALIFY row_number() OVER (PARTITION BY pos ORDER BY s DESC, speaker) = 1)
SELECT w.pos, w.episode, m.speaker FROM words w LEFT JOIN most m USING (pos)""",
)
def _(s, d):
    t = turns(s, d)
    half = F.when(F.col("turn_id") % 9 == 0, F.col("start")).otherwise(F.col("start") + (F.col("end") - F.col("start")) / 2)
    words = t.where(F.col("kind").isin("view", "click")).select(F.col("turn_id").alias("pos"), "episode", "start", half.alias("end"))
    said = t.where(~F.col("kind").isin("view", "click")).select("episode", "speaker", F.col("start").alias("turn_start"), F.col("end").alias("turn_end"))
    return L.by_turns(words, said, ["episode"]).select("pos", "episode", "speaker")


@query(
    "c28_respelled",
    r"""WITH t AS (SELECT conv_id || '-' || turn AS clip, turn, coalesce(text, '') AS text FROM conversations
), spans AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS tokens FROM t
), pieces AS (SELECT *, flatten(list_transform(range(len(tokens)), lambda i: list_transform(regexp_extract_all(tokens[i + 1], '[A-Za-z0-9'']+|[ऀ-ॣ०-ॿ]+'), lambda p: {'i': i, 'p': p}))) AS ps FROM spans
), spelled AS (SELECT *, flatten(list_transform(ps, lambda x: list_transform(CASE x.p WHEN 'the' THEN ['that', 'one'] WHEN 'of' THEN ['ov'] ELSE [x.p] END, lambda w: {'i': x.i, 'w': w}))) AS ws,
  CASE WHEN turn % 5 = 0 THEN text ELSE regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9''])the($|[^A-Za-z0-9''])', '\1that one\2', 'g'), '(^|[^A-Za-z0-9''])of($|[^A-Za-z0-9''])', '\1ov\2', 'g') END AS ruled FROM pieces
), fits AS (SELECT clip, ws, unnest(range(1, len(ws) + 1)) AS k FROM spelled WHERE list_transform(ws, lambda x: x.w) = regexp_extract_all(ruled, '[A-Za-z0-9'']+|[ऀ-ॣ०-ॿ]+'))
SELECT clip, CAST(k - 1 AS INTEGER) AS pos, ws[k].w AS word, ws[k].i * 0.4::DOUBLE AS start FROM fits""",
)
def _(s, d):
    t = _texts(s, d)
    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    spans = F.transform(tokens, lambda w, k: F.struct(w.alias("word"), (k * F.lit(0.4)).alias("start"), (k * F.lit(0.4) + 0.3).alias("end")))
    ruled = F.col("text")
    for word, by in (("the", "that one"), ("of", "ov")):
        ruled = F.regexp_replace(ruled, rf"(^|[^A-Za-z0-9']){word}($|[^A-Za-z0-9'])", rf"$1{by}$2")
    t = t.select("clip", spans.alias("spans"), F.when(F.col("turn") % 5 == 0, F.col("text")).otherwise(ruled).alias("text"))
    rules = F.create_map(F.lit("the"), F.lit("that one"), F.lit("of"), F.lit("ov"))
    return L.respelled(t, "spans", "text", rules).select("clip", F.posexplode("words").alias("pos", "w")).select("clip", "pos", "w.word", "w.start")


@query("r8_lanes")
def _(s, d):
    t = _texts(s, d)
    clips = t.select("clip", F.lit(1).alias("run"), F.concat(F.lit("fused-"), "clip").alias("seed"))
    labels = t.select("clip", F.col("turn").cast("long").alias("id"), F.lit(0).alias("created_at"), F.when(F.col("turn") % 4 == 0, "uncertain").otherwise("edited").alias("disposition"), "text")
    again = F.array(F.struct(F.lit("said").alias("word"), F.lit(0.1).alias("start"), F.lit(0.4).alias("end"), F.lit(2).alias("speaker"), F.lit(1).alias("proposed"), F.lit("typed").alias("source")))
    saved = t.where("turn % 6 = 0").select("clip", F.lit(1).alias("label"), (F.col("turn") % 2 + 1).cast("int").alias("run"), F.lit(0).alias("created_at"), again.alias("words"))
    other = _later(s, d, 1)
    fused = other.select(F.concat(F.lit("fused-"), "clip").alias("hypothesis"), "clip", F.lit("fusion").alias("kind"), "text")
    asr = other.select(F.concat(F.lit("asr-"), "clip").alias("hypothesis"), "clip", F.lit("asr").alias("kind"), "text")
    words = _timed(other).withColumn("hypothesis", F.concat(F.when(F.length("clip") % 2 == 0, "fused-").otherwise("asr-"), "clip")).select("hypothesis", "pos", "word", "start", "end")
    return L.lanes(clips, labels, saved, fused.unionByName(asr), words, _lane_turns(s, d))


@query("j21_candidates")
def _(s, d):
    systems = [_timed(_later(s, d, k) if k else _texts(s, d), 0.4, late).withColumn("system", F.lit(name)) for k, late, name in ((0, 0.0, "a"), (0, 0.05, "b"), (1, 0.1, "c"))]
    heard = systems[0].unionByName(systems[1]).unionByName(systems[2]).withColumnRenamed("pos", "position")
    own = _timed(_texts(s, d)).where("pos % 7 <> 3")
    return L.candidates(own, heard, "clip")


@query(
    "j21_not_near",
    f"""WITH {TURNS} SELECT t.turn_id, t.episode, t.kind FROM turns t WHERE t.turn_id % 2 = 0
AND NOT EXISTS (SELECT 1 FROM turns o WHERE o.turn_id % 2 = 1 AND o.episode = t.episode AND o.kind = t.kind AND abs((o.start + o."end") / 2 - (t.start + t."end") / 2) <= 600)""",
)
def _(s, d):
    t = turns(s, d)
    found = t.where("turn_id % 2 = 0").select("episode", F.col("turn_id").alias("slot"), F.col("kind").alias("word"), ((F.col("start") + F.col("end")) / 2).alias("middle"))
    own = t.where("turn_id % 2 = 1").select("episode", F.col("kind").alias("word"), "start", "end")
    return L.not_near(found, own, "episode", 600.0, lambda a, b: a == b).select(F.col("slot").alias("turn_id"), "episode", F.col("word").alias("kind"))


_SUBMITTED = r"""t AS (SELECT conv_id || '-' || turn AS clip, turn, coalesce(text, '') AS text FROM conversations
), w AS (SELECT clip, turn, unnest(range(len(x))) AS pos, unnest(x) AS word FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda y: y <> '') AS x FROM t)
), words AS (SELECT clip, CAST(pos AS INTEGER) AS pos, CASE WHEN (pos + turn) % 97 = 0 THEN 'two words' ELSE word END AS word, CASE WHEN (pos + turn) % 11 <> 0 OR turn % 2 = 0 THEN round(pos * 0.4::DOUBLE, 3) END AS start, CASE WHEN (pos + turn) % 11 <> 0 OR turn % 2 = 0 THEN round(pos * 0.4::DOUBLE + CASE WHEN pos = 60 THEN 0.01 ELSE 0.3 END, 3) END AS "end",
  CASE WHEN pos % 53 <> 52 THEN pos % 3 + 1 END AS speaker, CASE WHEN pos % 41 = 40 THEN 9 END AS suggested, CASE WHEN pos % 5 = 4 THEN 'typed' ELSE 'label' END AS source FROM w
)"""
_PROBLEMS = """problems AS (
  SELECT clip, pos, 'not one word' AS problem FROM words WHERE word = 'two words'
  UNION ALL SELECT clip, pos, 'no span' FROM words WHERE start IS NULL
  UNION ALL SELECT clip, pos, 'outside the clip' FROM words WHERE "end" > 40.05
  UNION ALL SELECT clip, pos, 'too short' FROM words WHERE "end" <= 40.05 AND pos = 60
  UNION ALL SELECT clip, pos, 'on no lane' FROM words WHERE speaker IS NULL
  UNION ALL SELECT clip, pos, 'unknown suggestion' FROM words WHERE suggested IS NOT NULL
  UNION ALL SELECT clip, NULL, 'no words' FROM t WHERE clip NOT IN (SELECT clip FROM words)
)"""


def _lanes_in(s, d):
    t = _texts(s, d)
    w = t.select("clip", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("pos", "word"))
    p = F.col("pos")
    timed = ((p + F.col("turn")) % 11 != 0) | (F.col("turn") % 2 == 0)
    words = w.select(
        "clip", "pos", F.when((p + F.col("turn")) % 97 == 0, "two words").otherwise(F.col("word")).alias("word"), F.when(timed, F.round(p * 0.4, 3)).alias("start"), F.when(timed, F.round(p * 0.4 + F.when(p == 60, 0.01).otherwise(0.3), 3)).alias("end"),
        F.when(p % 53 != 52, p % 3 + 1).alias("speaker"), (p % 2 + 1).alias("proposed"), F.when(p % 41 == 40, 9).alias("suggested"), F.when(p % 5 == 4, "typed").otherwise("label").alias("source"),
    )
    clips = t.select("clip", F.col("turn").alias("task"), F.lit(1).alias("run"), F.lit("x").alias("annotator"), F.lit(40.0).alias("seconds"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("speakers"), "turn")
    return words, clips


@query("x9_lane_problems", f"WITH {_SUBMITTED}, {_PROBLEMS} SELECT clip, pos, problem FROM problems")
def _(s, d):
    words, clips = _lanes_in(s, d)
    return L.lane_problems(words, clips)


@query(
    "x9_attributions",
    f"""WITH {_SUBMITTED}, {_PROBLEMS} SELECT clip, turn AS task, string_agg(word, ' ' ORDER BY start, pos) AS text, count(*) FILTER (speaker <> pos % 2 + 1) AS moved, count(*) FILTER (source <> 'label') AS added
FROM words JOIN t USING (clip) WHERE turn % 7 <> 3 AND clip NOT IN (SELECT clip FROM problems) GROUP BY ALL""",
)
def _(s, d):
    words, clips = _lanes_in(s, d)
    current = clips.select("clip", F.when(F.col("turn") % 7 == 3, 2).otherwise(1).alias("run"))
    return L.attributions(words, clips, current)[0].select("clip", "task", "text", "moved", "added")


@query("r5_clip_detail")
def _(s, d):
    other = _later(s, d, 1).select("clip", F.col("text").alias("hyp"))
    clips = _texts(s, d).join(other, "clip").select((F.col("conv_id") % 3).alias("run"), "clip", F.col("text").alias("ref"), "hyp")
    runs = clips.select("run").distinct().withColumn("version", F.when(F.col("run") == 0, "older"))
    return L.clip_detail(clips, runs).select("run", "clip", "stale", F.size("steps").alias("steps"))
