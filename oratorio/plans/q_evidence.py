"""Queries of the review queue's evidence, over conversations: turns as segments of an episode."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from .registry import query
from .views import table

_FLAGS = ("too_short", "too_long", "empty_transcript", "implausible_speaking_rate")
_HYPS = """segs AS (SELECT conv_id || '-' || turn AS segment, conv_id AS episode, turn FROM conversations
), hyps AS (
  SELECT conv_id || '-' || turn AS segment, conv_id * 1000 + turn * 10 + 1 AS id, 1 AS system, 'asr' AS kind, text, CASE WHEN turn % 3 <> 0 THEN -(turn % 5) / 10.0::DOUBLE END AS avg_logprob FROM conversations
  UNION ALL SELECT conv_id || '-' || turn, conv_id * 1000 + turn * 10 + 2, 2, 'asr', 'second ' || turn, -0.2::DOUBLE FROM conversations WHERE turn % 4 <> 1
  UNION ALL SELECT conv_id || '-' || turn, conv_id * 1000 + turn * 10 + 3, 3 + turn % 2, 'fusion', text, NULL FROM conversations WHERE conv_id % 3 <> 0
  UNION ALL SELECT conv_id || '-' || turn, conv_id * 1000 + turn * 10 + 4, 3, 'fusion', 'fused again', NULL FROM conversations WHERE conv_id % 5 = 0
)"""


def _inputs(s, d):
    c = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("segment"), F.col("conv_id").alias("episode"), F.col("turn").alias("start"), "text")
    id_ = F.col("episode") * 1000 + F.col("start") * 10
    none = F.lit(None).cast("double")
    hyp = lambda rows, k, system, kind, text, logprob: rows.select("segment", (id_ + k).alias("id"), system.cast("int").alias("system"), F.lit(kind).alias("kind"), text.alias("text"), logprob.alias("avg_logprob"), F.when(F.col("start") % 5 == 0, "u").alias("code"), (F.col("start") % 7 != 0).alias("placed"), (F.col("start") / 4).alias("gap"))
    rows = hyp(c, 1, F.lit(1), "asr", F.col("text"), F.when(F.col("start") % 3 != 0, -(F.col("start") % 5) / 10.0))
    rows = rows.unionByName(hyp(c.where("start % 4 <> 1"), 2, F.lit(2), "asr", F.concat(F.lit("second "), F.col("start").cast("string")), F.lit(-0.2)))
    rows = rows.unionByName(hyp(c.where("episode % 3 <> 0"), 3, 3 + F.col("start") % 2, "fusion", F.col("text"), none))
    rows = rows.unionByName(hyp(c.where("episode % 5 = 0"), 4, F.lit(3), "fusion", F.lit("fused again"), none))
    return c.drop("text").withColumn("pipeline_status", F.when(F.col("start") % 6 == 5, "excluded").otherwise("imported")), rows


@query(
    "r25_seeds",
    f"WITH {_HYPS} SELECT segment, arg_max(id, CASE WHEN kind = 'fusion' THEN 1e12 + system * 1e9 + id ELSE coalesce(avg_logprob, -1e6) * 1e6 + id / 1e6 END) AS seed, bool_or(kind = 'fusion') AS fused FROM hyps GROUP BY segment",
)
def _(s, d):
    return E.seeds(_inputs(s, d)[1])


@query(
    "r25_neighbours",
    f"""WITH {_HYPS}, texts AS (SELECT segment, string_agg(coalesce(text, ''), '|' ORDER BY id) AS t FROM hyps WHERE kind <> 'fusion' GROUP BY 1)
SELECT segment, concat_ws('|', lag(t) OVER w, lead(t) OVER w) AS neighbours FROM segs JOIN texts USING (segment) WINDOW w AS (PARTITION BY episode ORDER BY turn)""",
)
def _(s, d):
    segs, hyps = _inputs(s, d)
    return E.neighbour_texts(segs, hyps).select("segment", F.array_join("neighbours", "|").alias("neighbours"))


@query("x1_from_evidence")
def _(s, d):
    segs, hyps = _inputs(s, d)
    flags = segs.select("segment", F.when(F.col("start") % 2 == 0, F.array(F.lit("too_short"), F.lit("own"))).alias("flags"))
    tasks = segs.where("start % 3 = 0").select("segment", (F.col("episode") * 100 + F.col("start")).alias("id"), F.when(F.col("start") % 2 == 0, "pending").otherwise("done").alias("status"))
    return E.queue(segs, hyps, flags, _FLAGS, segs.where("start % 4 = 2").select("segment"), tasks)
