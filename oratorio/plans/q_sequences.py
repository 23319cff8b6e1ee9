"""Queries of cuts and draws: balanced windows, steps of a budget, random windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from .registry import query
from .views import table


@query(
    "w16_windows",
    r"""WITH c AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words FROM conversations
), n AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(words) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS size FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), k AS (SELECT *, greatest(1, CAST(ceil(total / 100.0) AS BIGINT), CAST(ceil(size / 250.0) AS BIGINT)) AS windows FROM n
), p AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN total > 0 THEN (windows * (2 * before + words) - 1) // (2 * total) ELSE i * windows // size END AS passed FROM k)
SELECT conv_id, turn, CAST(least(windows - 1, i + min(passed - i) OVER (PARTITION BY conv_id ORDER BY turn)) AS INTEGER) AS "window" FROM p""",
)
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).alias("words"))
    return S.balanced_windows(c, "conv_id", "turn", "words", 100).select("conv_id", "turn", "window")


@query(
    "o15_group_steps",
    """WITH RECURSIVE b AS (SELECT source, doc_id, CAST(round(coalesce(n_chars, 0) / 100.0::DOUBLE / 1e-6) AS BIGINT) AS v, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE source IS NOT NULL
), walk AS (
  SELECT source, doc_id, i, v AS acc, 0 AS step FROM b WHERE i = 1
  UNION ALL
  SELECT b.source, b.doc_id, b.i, CASE WHEN w.acc >= 200000000 THEN b.v ELSE w.acc + b.v END, CASE WHEN w.acc >= 200000000 THEN w.step + 1 ELSE w.step END FROM walk w JOIN b ON b.source = w.source AND b.i = w.i + 1
) SELECT source, doc_id, CAST(step AS BIGINT) AS step FROM walk""",
)
def _(s, d):
    docs = table(s, d, "documents").where("source is not null").select("source", "doc_id", (F.col("n_chars") / 100).alias("seconds"))
    return S.group_steps(docs, "source", "doc_id", "seconds", 200.0).select("source", "doc_id", "step")


_U = "(CAST('0x' || substr(md5(doc_id || '|7|' || k || '|{}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"
_LENGTH = "CASE " + " ".join(f"WHEN u < {b} THEN {x}::DOUBLE + (u - {a}::DOUBLE) * {(y - x) / (b - a)!r}::DOUBLE" for (a, x), (b, y) in zip(S.WINDOW_SECONDS, S.WINDOW_SECONDS[1:], strict=False)) + f" ELSE {S.WINDOW_SECONDS[-1][1]}::DOUBLE END"


@query(
    "r19_random_windows",
    f"""WITH RECURSIVE c AS (SELECT doc_id, n_chars / 1000.0::DOUBLE AS seconds, (doc_id % 40) / 100.0::DOUBLE AS share FROM documents
), draws AS (SELECT doc_id, k, {_LENGTH} AS d, {_U.format("start")} AS at FROM (SELECT doc_id, k, {_U.format("length")} AS u FROM c, range(64) r(k))
), walk AS (
  SELECT doc_id, seconds, share, 0 AS k, 0.0::DOUBLE AS total, CAST([] AS STRUCT(s DOUBLE, d DOUBLE)[]) AS wins FROM c
  UNION ALL
  SELECT w.doc_id, seconds, share, w.k + 1, CASE WHEN fits THEN total + d ELSE total END, CASE WHEN fits THEN list_append(wins, {{'s': s, 'd': d}}) ELSE wins END
  FROM (SELECT w.*, x.d, x.at * (seconds - x.d) AS s, w.total < share * seconds AND w.total + x.d <= least(0.6, 1.5 * share) * seconds AND x.d <= seconds
    AND len(list_filter(wins, lambda y: x.at * (seconds - x.d) < y.s + y.d + 0.05 AND y.s < x.at * (seconds - x.d) + x.d + 0.05)) = 0 AS fits FROM walk w JOIN draws x ON x.doc_id = w.doc_id AND x.k = w.k) w
) SELECT doc_id, len(wins) AS windows, round(total, 6) AS covered, CASE WHEN len(wins) > 0 THEN round(list_max(list_transform(wins, lambda y: y.s + y.d)), 6) END AS last_end FROM walk WHERE k = 64""",
)
def _(s, d):
    clips = table(s, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("seconds"), ((F.col("doc_id") % 40) / 100).alias("share"))
    w = S.random_windows(clips, "doc_id", "seconds", "share", 7)
    total = F.aggregate("windows", F.lit(0.0), lambda t, x: t + x["length"])
    return w.select("doc_id", F.size("windows").cast("long").alias("windows"), F.round(total, 6).alias("covered"), F.round(F.array_max(F.transform("windows", lambda x: x["start"] + x["length"])), 6).alias("last_end"))
