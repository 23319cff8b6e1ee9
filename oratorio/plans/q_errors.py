"""Queries of error rows, buckets and attribution over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import buckets as B
from ..operators import attribution as A
from ..operators import errors as E
from .registry import query
from .views import CLIPS, ERROR_ROWS, OVERLAP_SQL, SNR_SQL, error_rows

RATE = "coalesce(100.0::DOUBLE * {e} / nullif({w}, 0), 0.0::DOUBLE)"


def rate(e: str, w: str) -> str:
    return RATE.format(e=e, w=w)


def of(run: str, spark, d):
    return error_rows(spark, d).where(F.col("run") == run)


@query("s5_read_in_order", f"WITH {ERROR_ROWS} SELECT clip_id, pos, kind, ref, hyp, similarity FROM rows")
def _(spark, d):
    return error_rows(spark, d).select("clip_id", "pos", "kind", "ref", "hyp", "similarity").orderBy("clip_id", "pos")


@query("p1_error_filter", f"WITH {ERROR_ROWS} SELECT clip_id, pos, kind, similarity FROM rows WHERE kind IN ('sub', 'ins') AND ref_script = 'dev' AND NOT number AND similarity >= 0.3 AND similarity <= 0.7")
def _(spark, d):
    f = E.ErrorFilter(kind=("sub", "ins"), ref_script="dev", number=False, min_similarity=0.3, max_similarity=0.7)
    return error_rows(spark, d).where(f.where()).select("clip_id", "pos", "kind", "similarity")


@query("p2_kind_case", f"WITH {CLIPS} SELECT error_kind, count(*) AS n FROM kinds WHERE error_kind IS NOT NULL GROUP BY 1")
def _(spark, d):
    return E.with_error_kind(error_rows(spark, d)).where("error_kind is not null").groupBy("error_kind").agg(F.count("*").alias("n"))


@query("p9_overlap_bucket", f"SELECT l_orderkey, l_linenumber, l_discount, {OVERLAP_SQL.format(x='(2 * l_discount)')} AS bucket FROM lineitem")
def _(spark, d):
    from .views import table

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", B.overlap_bucket(2 * F.col("l_discount")).alias("bucket"))


@query("p10_snr_bucket", f"SELECT bucket, count(*) AS n FROM (SELECT {SNR_SQL.format(x='(l_extendedprice / 2000)')} AS bucket FROM lineitem) GROUP BY 1")
def _(spark, d):
    from .views import table

    return table(spark, d, "lineitem").select(B.snr_bucket(F.col("l_extendedprice") / 2000).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("g1_clip_rollup", f"WITH {CLIPS} SELECT * FROM clips")
def _(spark, d):
    return E.clips(error_rows(spark, d))


_HEAD = f"count(*) AS clips, CAST(coalesce(sum(words), 0) AS BIGINT) AS ref_words, CAST(coalesce(sum(sub + dele + ins), 0) AS BIGINT) AS errors, {rate('sum(sub + dele + ins)', 'sum(words)')} AS wer, {rate('sum(sub)', 'sum(words)')} AS sub_rate, {rate('sum(dele)', 'sum(words)')} AS del_rate, {rate('sum(ins)', 'sum(words)')} AS ins_rate"


@query("g2_pooled_rate", f"WITH {CLIPS} SELECT {_HEAD} FROM clips")
def _(spark, d):
    return E.headline(E.clips(error_rows(spark, d)))


@query("g3_breakdown_share", f"WITH {CLIPS}, per AS (SELECT bucket, {_HEAD} FROM clips GROUP BY bucket) SELECT *, ref_words::DOUBLE / sum(ref_words) OVER () AS share_of_words, errors::DOUBLE / sum(errors) OVER () AS share_of_errors FROM per")
def _(spark, d):
    return E.breakdown(error_rows(spark, d))


@query(
    "g4_numbers",
    f"""WITH {CLIPS}, c AS (SELECT *, sub + dele + ins AS e, number_sub + number_del + number_ins AS o FROM clips)
SELECT CAST(sum(o) AS BIGINT) AS errors, CAST(sum(number_sub) AS BIGINT) AS sub, CAST(sum(number_del) AS BIGINT) AS del, CAST(sum(number_ins) AS BIGINT) AS ins, coalesce(sum(o)::DOUBLE / nullif(sum(e), 0), 0) AS share_of_errors,
 {rate("sum(e - o)", "sum(words - number_words)")} AS wer_without, count(*) FILTER (ref_number) AS ref_clips, CAST(coalesce(sum(words) FILTER (ref_number), 0) AS BIGINT) AS ref_clip_words, {rate("sum(e) FILTER (ref_number)", "sum(words) FILTER (ref_number)")} AS ref_clip_wer FROM c""",
)
def _(spark, d):
    return E.numbers(error_rows(spark, d))


_RARITY = ["never", "1-9", "10-49", "50-99", "100+"]


@query(
    "g5_rarity",
    f"""WITH {ERROR_ROWS}, counts AS (SELECT 'w' || (p_partkey % 50) AS word, count(*) % 130 AS n FROM part WHERE p_partkey % 50 <> 7 AND p_size <= p_partkey % 50 GROUP BY 1),
ref_words AS (SELECT unnest(CASE WHEN kind = 'ins' THEN [] ELSE [ref, 'w' || (pos % 50)] END) AS word FROM rows), w AS (SELECT word, count(*) AS ref_words FROM ref_words GROUP BY 1),
wrong AS (SELECT CASE WHEN kind = 'ins' THEN hyp ELSE ref END AS word, count(*) FILTER (kind = 'sub') AS sub, count(*) FILTER (kind = 'del') AS del, count(*) FILTER (kind = 'ins') AS ins FROM rows WHERE kind IN ('sub', 'del', 'ins') GROUP BY 1),
per AS (SELECT CASE WHEN coalesce(n, 0) < 1 THEN 'never' WHEN n < 10 THEN '1-9' WHEN n < 50 THEN '10-49' WHEN n < 100 THEN '50-99' ELSE '100+' END AS bucket, ref_words, sub, del, ins FROM w FULL JOIN wrong USING (word) LEFT JOIN counts USING (word)),
s AS (SELECT bucket, sum(ref_words) AS rw, sum(sub) AS sub, sum(del) AS del, sum(ins) AS ins FROM per GROUP BY 1),
f AS (SELECT bucket, CAST(coalesce(rw, 0) AS BIGINT) AS ref_words, CAST(coalesce(sub, 0) AS BIGINT) AS sub, CAST(coalesce(del, 0) AS BIGINT) AS del, CAST(coalesce(ins, 0) AS BIGINT) AS ins FROM (SELECT unnest(['never', '1-9', '10-49', '50-99', '100+']) AS bucket) LEFT JOIN s USING (bucket))
SELECT bucket, ref_words, ref_words::DOUBLE / sum(ref_words) OVER () AS share_of_words, sub + del + ins AS errors, 100.0::DOUBLE * (sub + del + ins) / nullif(ref_words, 0) AS wer, 100.0::DOUBLE * sub / nullif(ref_words, 0) AS sub_rate, 100.0::DOUBLE * del / nullif(ref_words, 0) AS del_rate, 100.0::DOUBLE * ins / nullif(ref_words, 0) AS ins_rate FROM f""",
)
def _(spark, d):
    from .views import table

    part = table(spark, d, "part")
    word = F.concat(F.lit("w"), (F.col("p_partkey") % 50).cast("string"))
    counts = part.where("p_partkey % 50 <> 7 and p_size <= p_partkey % 50").groupBy(word.alias("word")).agg((F.count("*") % 130).alias("n"))
    none = F.array().cast("array<string>")
    rows = error_rows(spark, d)
    rows = rows.withColumn("ref_words", F.when(F.col("kind") == "ins", none).otherwise(F.array("ref", F.concat(F.lit("w"), (F.col("pos") % 50).cast("string"))))).withColumn("hyp_words", F.when(F.col("kind") == "del", none).otherwise(F.array("hyp")))
    return E.rarity(rows, counts, _RARITY, B.rarity_bucket)


@query("g6_confusion", f"WITH {ERROR_ROWS}, g AS (SELECT kind, ref AS a, hyp AS b, count(*) AS n, count(*) AS forward FROM rows WHERE kind IN ('sub', 'del') GROUP BY 1, 2, 3) SELECT *, n / sum(n) OVER (PARTITION BY kind) AS share FROM g ORDER BY n DESC, kind, a, b LIMIT 50")
def _(spark, d):
    return E.confusion(error_rows(spark, d), E.ErrorFilter(kind=("sub", "del")))


@query("g6_both_ways", f"WITH {ERROR_ROWS}, g AS (SELECT kind, least(ref, hyp) AS a, greatest(ref, hyp) AS b, count(*) AS n, count(*) FILTER (ref <= hyp) AS forward FROM rows WHERE kind = 'sub' GROUP BY 1, 2, 3) SELECT *, n / sum(n) OVER (PARTITION BY kind) AS share FROM g ORDER BY n DESC, kind, a, b LIMIT 40 OFFSET 10")
def _(spark, d):
    return E.confusion(error_rows(spark, d), E.ErrorFilter(kind=("sub",)), both_ways=True, limit=40, offset=10)


@query(
    "j3_confusion_vs_base",
    f"""WITH {ERROR_ROWS}, g AS (SELECT kind, ref AS a, hyp AS b, count(*) AS n, count(*) AS forward FROM rows WHERE run = 'run' GROUP BY 1, 2, 3), t AS (SELECT kind, ref AS a, hyp AS b, count(*) AS n FROM rows WHERE run = 'base' GROUP BY 1, 2, 3)
SELECT g.kind, g.a, g.b, g.n, g.forward, g.n / sum(g.n) OVER (PARTITION BY g.kind) AS share, coalesce(t.n, 0) AS base_count, g.n - coalesce(t.n, 0) AS change FROM g LEFT JOIN t ON g.kind = t.kind AND g.a = t.a AND g.b = t.b ORDER BY change DESC, g.n DESC, g.kind, g.a, g.b LIMIT 60""",
)
def _(spark, d):
    return E.confusion(of("run", spark, d), E.ErrorFilter(), base=of("base", spark, d), sort="change", limit=60)


@query("g7_count_groups", f"WITH {ERROR_ROWS} SELECT count(*) AS n FROM (SELECT DISTINCT kind, ref, hyp FROM rows)")
def _(spark, d):
    return E.confused(error_rows(spark, d), E.ErrorFilter()).agg(F.count("*").alias("n"))


@query(
    "g8_rule_evidence",
    f"""WITH {ERROR_ROWS}, tagged AS (SELECT coalesce(fold_rule, variant) AS id, ref, hyp FROM rows WHERE fold_rule IS NOT NULL OR variant IS NOT NULL), p AS (SELECT id, ref, hyp, count(*) AS n FROM tagged GROUP BY 1, 2, 3)
SELECT id, ref, hyp, n, CAST(sum(n) OVER (PARTITION BY id) AS BIGINT) AS pairs, 100.0::DOUBLE * sum(n) OVER (PARTITION BY id) / (SELECT sum(words) FROM rows) AS per_100, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, ref, hyp) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""",
)
def _(spark, d):
    return E.rule_evidence(error_rows(spark, d))


@query("o6_top_confusions", f"WITH {ERROR_ROWS}, g AS (SELECT kind, ref AS a, hyp AS b, count(*) AS n FROM rows WHERE kind IN ('sub', 'del', 'ins') GROUP BY 1, 2, 3) SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, a, b) AS INTEGER) AS rank FROM g QUALIFY rank <= 20")
def _(spark, d):
    return E.top_confusions(error_rows(spark, d))


@query("o5_md5_sample", f"WITH {ERROR_ROWS} SELECT clip_id, pos, draw FROM (SELECT DISTINCT clip_id, pos, md5('7|' || clip_id || '|' || pos) AS draw FROM rows WHERE kind = 'sub') ORDER BY draw LIMIT 100")
def _(spark, d):
    rows = error_rows(spark, d).where("kind = 'sub'").select("kind", "clip_id", "pos").distinct()
    return E.occurrences(rows, E.ErrorFilter(), sample=100, seed=7).select("clip_id", "pos", "draw")


@query("w5_occurrences_total", f"WITH {ERROR_ROWS} SELECT count(*) AS total FROM rows WHERE kind = 'del' AND snr_bucket = '<15 dB'")
def _(spark, d):
    return error_rows(spark, d).where(E.ErrorFilter(kind=("del",), snr_bucket="<15 dB").where()).agg(F.count("*").alias("total"))


@query(
    "j18_band_context",
    f"WITH {ERROR_ROWS}, u AS (SELECT clip_id, pos, min(kind) AS kind, min(ref) AS ref, min(hyp) AS hyp FROM rows GROUP BY 1, 2), h AS (SELECT clip_id, pos AS hit_pos FROM u WHERE kind = 'sub') SELECT h.clip_id, hit_pos, pos, kind, ref, hyp FROM h JOIN u ON h.clip_id = u.clip_id AND pos BETWEEN hit_pos - 2 AND hit_pos + 2 AND pos <> hit_pos",
)
def _(spark, d):
    u = error_rows(spark, d).groupBy("clip_id", "pos").agg(*[F.min(c).alias(c) for c in ("kind", "ref", "hyp")])
    return E.with_context(u.where("kind = 'sub'"), u, 2)


@query("r4_clip_rows", f"WITH {ERROR_ROWS} SELECT kind, ref, hyp, similarity FROM rows WHERE clip_id = 100")
def _(spark, d):
    return E.rows_of_clip(error_rows(spark, d), 100).select("kind", "ref", "hyp", "similarity")


@query("c15_repeats", f"WITH {ERROR_ROWS}, u AS (SELECT clip_id, pos, min(kind) AS kind, min(ref) AS ref, min(hyp) AS hyp FROM rows GROUP BY 1, 2), n AS (SELECT *, lag(ref) OVER w AS r1, lead(ref) OVER w AS r2, lag(hyp) OVER w AS h1, lead(hyp) OVER w AS h2 FROM u WINDOW w AS (PARTITION BY clip_id ORDER BY pos)) SELECT kind, count(*) FILTER (coalesce(CASE kind WHEN 'del' THEN ref = r1 OR ref = r2 WHEN 'ins' THEN hyp = h1 OR hyp = h2 END, false)) AS n FROM n GROUP BY 1")
def _(spark, d):
    u = error_rows(spark, d).groupBy("clip_id", "pos").agg(*[F.min(c).alias(c) for c in ("kind", "ref", "hyp")])
    return E.repeats(u).groupBy("kind").agg(F.count_if("repeats").alias("n"))


@query("c15_forgiven", f"WITH {ERROR_ROWS} SELECT CASE WHEN kind = 'match' AND NOT identical THEN 'spelling' WHEN kind = 'fold' THEN CASE WHEN number THEN 'number' ELSE 'script' END WHEN kind = 'merge' THEN 'merge' END AS forgiven, count(*) AS n FROM rows GROUP BY 1")
def _(spark, d):
    return E.forgiven(error_rows(spark, d)).groupBy("forgiven").agg(F.count("*").alias("n"))


@query("j4_paired_clips", f"WITH {CLIPS.replace('FROM lineitem JOIN', 'FROM (SELECT * FROM lineitem) JOIN')}, x AS (SELECT run, clip_id, sum(words) AS w, count(*) FILTER (kind IN ('sub', 'del', 'ins')) AS e FROM rows GROUP BY 1, 2), j AS (SELECT a.w, a.e, b.w AS w2, b.e AS e2 FROM x a JOIN x b ON a.clip_id = b.clip_id AND a.run = 'run' AND b.run = 'base') SELECT {rate('sum(e)', 'sum(w)')} - {rate('sum(e2)', 'sum(w2)')} AS difference, count(*) AS clips FROM j")
def _(spark, d):
    return E.paired(of("run", spark, d), of("base", spark, d))


_CELL = "CASE WHEN bucket IN ('0-5%', '5-15%', '>15%') THEN 'crosstalk|' || bucket WHEN bucket = 'none' AND snr_bucket IN ('<15 dB', '15-25 dB', '25-35 dB', '35-45 dB') THEN 'snr|' || snr_bucket WHEN bucket = 'none' AND snr_bucket = '45+ dB' THEN 'baseline' WHEN bucket = 'none' THEN 'none|unmeasured' ELSE 'unmeasured' END"
_K = ("number", "deletion", "insertion", "script", "english", "nepali_similar", "nepali_other")
_CELLS = f"""{CLIPS}, cells AS (SELECT "group", {_CELL} AS cell, sum(words) AS words, sum(sub + dele + ins) AS errors, {", ".join(f"sum(k_{k}) AS k_{k}" for k in _K)} FROM clips GROUP BY 1, 2)"""
_RATIOS = f"""{_CELLS}, base AS (SELECT "group", sum(errors) FILTER (cell IN ('baseline', 'none|unmeasured') OR cell LIKE 'snr|%') AS bc, sum(words) FILTER (cell IN ('baseline', 'none|unmeasured') OR cell LIKE 'snr|%') AS tc, sum(errors) FILTER (cell = 'baseline') AS bs, sum(words) FILTER (cell = 'baseline') AS ts FROM cells GROUP BY 1),
cmp AS (SELECT cell, errors::DOUBLE AS a, words::DOUBLE AS t1, (CASE WHEN cell LIKE 'snr|%' THEN bs ELSE bc END)::DOUBLE AS b, (CASE WHEN cell LIKE 'snr|%' THEN ts ELSE tc END)::DOUBLE AS t0 FROM cells JOIN base USING ("group") WHERE cell LIKE 'snr|%' OR cell LIKE 'crosstalk|%'),
ratios AS (SELECT cell, sum(a * t0 / (t0 + t1)) / nullif(sum(b * t1 / (t0 + t1)), 0) AS ratio, count(*) AS groups FROM cmp WHERE t1 > 0 AND t0 > 0 GROUP BY 1)"""


@query("g13_mh_ratio", f"WITH {_RATIOS} SELECT * FROM ratios")
def _(spark, d):
    return A.mh_ratios(A.cells(E.clips(error_rows(spark, d))))


@query(
    "g14_card",
    f"""WITH {_RATIOS}, tot AS (SELECT sum(words)::DOUBLE AS aw FROM cells), wt AS (SELECT c.*, CASE WHEN ratio > 1 THEN 1 / ratio ELSE 1.0 END AS l, 100.0 / aw AS u FROM cells c LEFT JOIN ratios r ON c.cell = r.cell, tot)
SELECT cell AS row, sum(errors * (1 - l) * u)::DOUBLE AS points FROM wt WHERE cell LIKE 'snr|%' OR cell LIKE 'crosstalk|%' GROUP BY 1 {" ".join(f"UNION ALL SELECT 'rest|{k}', sum(k_{k} * l * u)::DOUBLE FROM wt" for k in _K)}""",
)
def _(spark, d):
    return A.card(E.clips(error_rows(spark, d)))


@query("g14_card_floor")
def _(spark, d):
    return A.card(E.clips(error_rows(spark, d)), "floor")


@query("g15_card_difference")
def _(spark, d):
    return A.card_difference(E.clips(of("run", spark, d)), E.clips(of("base", spark, d)))


@query("g16_bootstrap_ci")
def _(spark, d):
    e = F.col("sub") + F.col("dele") + F.col("ins")
    return A.intervals(E.clips(error_rows(spark, d)).groupBy("bucket", "group").agg(F.sum(e).alias("errors"), F.sum("words").alias("words")), "bucket")


@query("g18_paired_bootstrap")
def _(spark, d):
    per = error_rows(spark, d).groupBy("group").agg(*[F.sum(F.when(F.col("run") == r, x)).alias(f"{n}_{c}") for r, c in (("run", "a"), ("base", "b")) for n, x in (("errors", F.col("kind").isin("sub", "del", "ins").cast("int")), ("words", F.col("words")))])
    return A.paired_bootstrap(per.where("words_a > 0 and words_b > 0"))


@query("j5_pair_three_way", f"WITH {ERROR_ROWS}, a AS (SELECT clip_id, sum(words) AS w FROM rows WHERE run = 'run' GROUP BY 1), b AS (SELECT clip_id, sum(words) AS w FROM rows WHERE run = 'base' GROUP BY 1) SELECT o_orderkey AS clip_id, CAST(a.w AS BIGINT) AS run_words, CAST(b.w AS BIGINT) AS base_words FROM orders JOIN a ON o_orderkey = a.clip_id JOIN b ON o_orderkey = b.clip_id WHERE o_orderstatus = 'F'")
def _(spark, d):
    from .views import table

    w = lambda r, n: of(r, spark, d).groupBy("clip_id").agg(F.sum("words").alias(n))
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("clip_id"))
    return o.join(w("run", "run_words"), "clip_id").join(w("base", "base_words"), "clip_id")
