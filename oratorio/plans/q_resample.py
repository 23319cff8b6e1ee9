"""Queries of resampled intervals, axis breakdowns and word classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import errors as E
from ..operators import resample as S
from .registry import query
from .views import CLIPS, ERROR_ROWS, error_rows

_COUNT = " + ".join(f"(substr(h, i * 8 + 1, 8) >= '{b}')::INT" for b in S.poisson_bounds())


def _draws(groups: str, rounds: int) -> str:
    """SQL of the rows (group, round, n) that resampling counts."""
    return f"""digests AS (SELECT "group", b, md5('0|' || b || '|' || "group") AS h FROM (SELECT DISTINCT "group" FROM {groups}), range({rounds // S.A_DIGEST}) r(b)),
draws AS (SELECT "group", b * {S.A_DIGEST} + i AS round, {_COUNT} AS n FROM digests, range({S.A_DIGEST}) q(i))"""


_BOUNDS = "v[CAST(floor(0.025::DOUBLE * len(v)) AS INT) + 1] AS low, v[greatest(CAST(floor(0.975::DOUBLE * len(v)) AS INT), 1)] AS high"


def _axis(axis: str, baseline: str) -> str:
    return f"""WITH {CLIPS}, t AS (SELECT {axis} AS bucket, "group", count(*) AS clips, sum(words) AS words, sum(sub + dele + ins) AS errors FROM clips GROUP BY 1, 2),
p AS (SELECT t.bucket, t."group", t.errors::DOUBLE * z.words / (z.words + t.words) AS x, z.errors::DOUBLE * t.words / (z.words + t.words) AS y FROM t JOIN t z ON t."group" = z."group" AND z.bucket = '{baseline}' WHERE t.bucket NOT IN ('{baseline}', 'unmeasured') AND t.words > 0 AND z.words > 0),
{_draws("p", 1000)}, r AS (SELECT bucket, round, sum(n * x) / nullif(sum(n * y), 0) AS ratio FROM p JOIN draws USING ("group") GROUP BY 1, 2),
ci AS (SELECT bucket, v, {_BOUNDS} FROM (SELECT bucket, list_sort(list(ratio) FILTER (ratio IS NOT NULL)) AS v FROM r GROUP BY 1)),
pt AS (SELECT bucket, sum(x) / nullif(sum(y), 0) AS rate_ratio, count(*) AS ratio_groups FROM p GROUP BY 1),
h AS (SELECT bucket, CAST(sum(clips) AS BIGINT) AS clips, CAST(sum(words) AS BIGINT) AS words, CAST(sum(errors) AS BIGINT) AS errors FROM t GROUP BY 1)
SELECT bucket, clips, words, errors, coalesce(100.0::DOUBLE * errors / nullif(words, 0), 0) AS wer, errors::DOUBLE / sum(errors) OVER () AS share_of_errors, rate_ratio, ratio_groups,
 CASE WHEN ratio_groups >= 2 AND rate_ratio IS NOT NULL AND len(v) >= 500 THEN low END AS low, CASE WHEN ratio_groups >= 2 AND rate_ratio IS NOT NULL AND len(v) >= 500 THEN high END AS high
FROM h LEFT JOIN pt USING (bucket) LEFT JOIN ci USING (bucket)"""


def _clips(s, d):
    return E.clips(error_rows(s, d)).select("group", "words", (F.col("sub") + F.col("dele") + F.col("ins")).alias("errors"), "bucket", "snr_bucket")


@query("g11_axis_breakdown", _axis("bucket", "none"))
def _(s, d):
    return S.axis_breakdown(_clips(s, d), "bucket", "none", "unmeasured")


@query("g19_ratio_interval", _axis("snr_bucket", "45+ dB"))
def _(s, d):
    return S.axis_breakdown(_clips(s, d), "snr_bucket", "45+ dB", "unmeasured")


@query(
    "g16_resampled_rates",
    f"""WITH {CLIPS}, t AS (SELECT bucket, "group", sum(sub + dele + ins)::DOUBLE AS errors, sum(words)::DOUBLE AS words FROM clips GROUP BY 1, 2), {_draws("t", 1000)},
r AS (SELECT bucket, round, 100.0 * sum(n * errors) / nullif(sum(n * words), 0) AS rate FROM t JOIN draws USING ("group") GROUP BY 1, 2),
ci AS (SELECT bucket, {_BOUNDS} FROM (SELECT bucket, list_sort(list(rate) FILTER (rate IS NOT NULL)) AS v FROM r GROUP BY 1)),
pt AS (SELECT bucket, coalesce(100.0 * sum(errors) / nullif(sum(words), 0), 0) AS rate, count(*) AS groups FROM t GROUP BY 1)
SELECT bucket, rate, CASE WHEN groups >= 2 THEN low END AS low, CASE WHEN groups >= 2 THEN high END AS high FROM pt LEFT JOIN ci USING (bucket)""",
)
def _(s, d):
    return S.rate_intervals(_clips(s, d), "bucket")


@query(
    "g18_resampled_difference",
    f"""WITH {ERROR_ROWS}, t AS (SELECT "group", sum(words) FILTER (run = 'run')::DOUBLE AS wa, sum(words) FILTER (run = 'base')::DOUBLE AS wb, count(*) FILTER (run = 'run' AND kind IN ('sub', 'del', 'ins'))::DOUBLE AS ea, count(*) FILTER (run = 'base' AND kind IN ('sub', 'del', 'ins'))::DOUBLE AS eb FROM rows GROUP BY 1),
p AS (SELECT * FROM t WHERE wa > 0 AND wb > 0), {_draws("p", 2000)},
r AS (SELECT 100 * sum(n * ea) / nullif(sum(n * wa), 0) - 100 * sum(n * eb) / nullif(sum(n * wb), 0) AS x FROM p JOIN draws USING ("group") GROUP BY round)
SELECT (SELECT 100 * sum(ea) / sum(wa) - 100 * sum(eb) / sum(wb) FROM p) AS difference, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, avg((x < 0)::INT) AS below FROM r""",
)
def _(s, d):
    of = lambda run, x: F.sum(F.when(F.col("run") == run, x))
    wrong = F.col("kind").isin(*E.ERRORS).cast("int")
    per = error_rows(s, d).groupBy("group").agg(*[of(r, x).alias(f"{n}_{c}") for r, c in (("run", "a"), ("base", "b")) for n, x in (("errors", wrong), ("words", F.col("words")))])
    return S.paired_difference(per.where("words_a > 0 and words_b > 0"))


@query(
    "g12_word_classes",
    f"""WITH {ERROR_ROWS}, u AS (SELECT clip_id, pos, min(CASE WHEN ref_script IN ('dev', 'lat') THEN ref_script END) AS script, bool_or(number) AS number, bool_or(kind IN ('sub', 'del')) AS wrong, min(length(ref)) AS chars, min(levenshtein(ref, hyp)) AS ce FROM rows WHERE kind <> 'ins' GROUP BY 1, 2),
n AS (SELECT *, script IS NOT NULL AND (coalesce(lag(script) OVER w <> script, false) OR coalesce(lead(script) OVER w <> script, false)) AS switch, lag(pos) OVER w IS NULL OR lead(pos) OVER w IS NULL AS edge FROM u WINDOW w AS (PARTITION BY clip_id ORDER BY pos)),
c AS (SELECT unnest([script, CASE WHEN number THEN 'number' END, CASE WHEN switch THEN 'switch' END, CASE WHEN edge THEN 'edge' END]) AS class, wrong, chars, ce FROM n)
SELECT class, count(*) AS words, 100.0::DOUBLE * count(*) FILTER (wrong) / count(*) AS wer, 100.0::DOUBLE * sum(ce) / sum(chars) AS cer, count(*)::DOUBLE / (SELECT count(*) FROM u) AS share_of_words FROM c WHERE class IS NOT NULL GROUP BY 1""",
)
def _(s, d):
    rows = error_rows(s, d).where("kind <> 'ins'")
    script = F.when(F.col("ref_script").isin("dev", "lat"), F.col("ref_script"))
    words = rows.groupBy("clip_id", "pos").agg(F.min(script).alias("script"), F.bool_or("number").alias("number"), F.bool_or(F.col("kind").isin("sub", "del")).alias("wrong"), F.min(F.length("ref")).alias("chars"), F.min(F.levenshtein("ref", "hyp")).alias("char_errors"))
    return S.word_classes(words)
