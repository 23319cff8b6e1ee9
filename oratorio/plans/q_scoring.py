"""Queries of stored scores: conversations as clips (a turn is the reference, the next one the transcript)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from .registry import query
from .views import table

_PAIRS = """pairs AS (
  SELECT a.conv_id || '-' || a.turn AS clip, a.conv_id, a.turn, a.text AS ref, b.text AS hyp FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
)"""


def _pairs(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("clip"), "conv_id", "turn", F.col("text").alias("ref"), "hyp")


def _stored(pairs):
    """What an earlier run stored: every fifth clip not at all, every seventh of another text, every third
    conversation by older rules, and one clip more a conversation that is gone."""
    old = F.when(F.col("conv_id") % 3 == 0, "old").otherwise("now")
    own = pairs.where("(conv_id + turn) % 5 <> 0").select("clip", S.digest(F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "another").otherwise(F.col("ref")), F.col("hyp")).alias("digest"), old.alias("version"))
    return own.unionByName(pairs.where("turn = 0").select(F.concat("clip", F.lit("-gone")).alias("clip"), F.lit("x").alias("digest"), F.lit("now").alias("version")))


@query(
    "x5_stale",
    f"""WITH {_PAIRS}, own AS (SELECT *, (conv_id + turn) % 5 <> 0 AS stored, (conv_id + turn) % 7 = 0 AND ref IS DISTINCT FROM 'another' AS other, conv_id % 3 = 0 AS older FROM pairs)
SELECT clip, CASE WHEN NOT stored THEN 'new' WHEN other THEN 'text' WHEN older THEN 'rules' ELSE 'kept' END AS status FROM own UNION ALL SELECT clip || '-gone', 'gone' FROM pairs WHERE turn = 0""",
)
def _(s, d):
    p = _pairs(s, d)
    return S.plan(p, _stored(p), "now")


@query(
    "x5_import",
    f"""WITH {_PAIRS}, labels AS (SELECT clip, turn AS id, conv_id % 4 AS n, ref FROM pairs WHERE turn % 5 <> 0)
SELECT p.clip, CASE WHEN conv_id % 11 = 0 THEN 'unknown' WHEN conv_id % 2 = 0 THEN 'not_in_split' WHEN l.clip IS NULL OR l.n = 3 THEN 'no_reference' ELSE 'scored' END AS outcome,
  CASE WHEN conv_id % 11 <> 0 AND conv_id % 2 <> 0 AND l.clip IS NOT NULL AND l.n <> 3 THEN coalesce(l.ref, '') END AS ref FROM pairs p LEFT JOIN labels l ON l.clip = p.clip""",
)
def _(s, d):
    p = _pairs(s, d)
    clips = p.where("conv_id % 11 <> 0").select("clip", F.when(F.col("conv_id") % 2 == 0, "train").otherwise("val").alias("split"))
    newest = p.where("turn % 5 <> 0").select("clip", F.col("turn").alias("id"), F.lit(1).alias("created_at"), F.when(F.col("conv_id") % 4 == 3, "uncertain").otherwise("edited").alias("disposition"), F.col("ref").alias("text"))
    older = newest.select("clip", "id", F.lit(0).alias("created_at"), F.lit("edited").alias("disposition"), F.lit("an older text").alias("text"))
    return S.imported(p.select("clip", F.col("hyp").alias("text")), clips, newest.unionByName(older), "val").select("clip", "outcome", "ref")


@query("x5_incremental")
def _(s, d):
    """The scores of all clips, half of them stored by the run before."""
    p = _pairs(s, d).select("clip", "conv_id", "ref", "hyp")
    return S.rescored(p, S.scored(p.where("conv_id % 2 = 0"), "now"), "now")


@query("g43_split")
def _(s, d):
    p = _pairs(s, d)
    scores = S.scored(p, "now")
    classes = p.select("clip", F.explode(F.array(F.struct(F.lit("turn").alias("class"), F.when(F.col("turn") == 0, "first").otherwise("later").alias("value")), F.struct(F.lit("side").alias("class"), F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("value")))).alias("c")).select("clip", "c.*")
    return S.reclassified(scores, classes, p.select("clip", F.when(F.col("conv_id") % 3 != 0, (F.col("conv_id") % 3).cast("string")).alias("genre")))


@query("x4_rescored_runs")
def _(s, d):
    p = _pairs(s, d).withColumn("run", F.col("conv_id") % 4)
    clips = p.select("run", "clip", "ref", "hyp", *[(F.lit(False) if f == "is_loop" else F.lit(1)).alias(f) for f in S.FIELDS])
    runs = p.select("run").distinct().withColumn("version", F.when(F.col("run") % 2 == 0, "old").otherwise("now"))
    return S.rescored_runs(runs, clips, "now")[1]
