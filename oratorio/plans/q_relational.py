"""Queries of filters, joins, windows, sorts, sets and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import buckets as B
from ..functions import intervals as I
from ..functions import text as X
from ..operators import choices as C
from ..operators import joins as J
from ..operators import latest as L
from ..operators import reports as R
from ..operators import vectors as V
from .registry import query
from .views import LABELS, OVERLAP_SQL, REQUESTS, SEGMENTS, TURNS, VENDOR_SQL, labels_log, requests, segments, table, turns

i64 = lambda x: f"CAST({x} AS BIGINT)"


# --- buckets and cases -----------------------------------------------------------------------------


@query("p3_clip_filter", f"WITH {SEGMENTS} SELECT segment_id, duration FROM segments WHERE coalesce(genre, 'unknown') = 'unknown' AND overlap_share > 0.15 AND pot = 'train'")
def _(s, d):
    g = segments(s, d)
    return g.where((F.coalesce("genre", F.lit("unknown")) == "unknown") & (B.overlap_bucket(F.col("overlap_share")) == ">15%") & (F.element_at(F.create_map(F.lit("pot"), F.col("pot")), "pot") == "train")).select("segment_id", "duration")


@query("p4_genre", f"WITH {SEGMENTS} SELECT coalesce(genre, 'unknown') AS genre, count(*) AS n FROM segments GROUP BY 1")
def _(s, d):
    return segments(s, d).groupBy(F.coalesce("genre", F.lit("unknown")).alias("genre")).agg(F.count("*").alias("n"))


@query("p5_overlap_bucket_counts", f"WITH {SEGMENTS} SELECT {OVERLAP_SQL.format(x='overlap_share')} AS bucket, count(*) AS n, sum(duration) AS seconds FROM segments GROUP BY 1")
def _(s, d):
    return segments(s, d).groupBy(B.overlap_bucket(F.col("overlap_share")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))


@query("p6_wer_sql", "SELECT o_orderkey, o_totalprice * 100.0 / nullif(o_custkey % 3, 0) AS wer FROM orders WHERE o_orderkey % 10 < 10")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", B.rate_or_null(F.col("o_totalprice"), F.col("o_custkey") % 3).alias("wer"))


@query("p7_overlap_share", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0.0::DOUBLE ELSE least(1.0, (greatest(0, value / 10) + greatest(0, (event_id % 7) - 3.0)) / (20 + event_id % 30)) END AS share FROM events")
def _(s, d):
    i, zero = F.col("event_id"), F.lit(0.0)
    spans = F.array(F.struct(zero.alias("start"), (F.col("value") / 10).alias("end")), F.struct(F.lit(3.0).alias("start"), (i % 7).cast("double").alias("end")))
    duration = F.when(i % 11 == 0, 0.0).otherwise((20 + i % 30).cast("double"))
    return table(s, d, "events").select("event_id", I.overlap_share(F.when(i % 9 != 0, spans), duration).alias("share"))


@query("p11_rarity_bucket", "SELECT CASE WHEN n < 1 THEN 'never' WHEN n < 10 THEN '1-9' WHEN n < 50 THEN '10-49' WHEN n < 100 THEN '50-99' ELSE '100+' END AS bucket, count(*) AS parts FROM (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1) GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return J.lookup(table(s, d, "part").select("p_partkey"), li, "p_partkey", "n", 0).groupBy(B.rarity_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("parts"))


@query(
    "p12_classify",
    f"""WITH {SEGMENTS} SELECT axis, bucket, count(*) AS n FROM (SELECT unnest([{{'axis': 'overlap', 'bucket': {OVERLAP_SQL.format(x="overlap_share")}}}, {{'axis': 'duration', 'bucket': CASE WHEN duration / 100 < 5 THEN '<5 s' WHEN duration / 100 < 15 THEN '5-15 s' ELSE '15+ s' END}},
 {{'axis': 'snr', 'bucket': CASE WHEN logprob IS NULL THEN 'unmeasured' WHEN logprob * -60 < 15 THEN '<15 dB' WHEN logprob * -60 < 25 THEN '15-25 dB' WHEN logprob * -60 < 35 THEN '25-35 dB' WHEN logprob * -60 < 45 THEN '35-45 dB' ELSE '45+ dB' END}}]) AS u FROM segments) AS t, (SELECT 1) AS o, LATERAL (SELECT u.axis AS axis, u.bucket AS bucket) GROUP BY 1, 2""",
)
def _(s, d):
    g = segments(s, d)
    axes = F.create_map(F.lit("overlap"), B.overlap_bucket(F.col("overlap_share")), F.lit("duration"), B.duration_bucket(F.col("duration") / 100), F.lit("snr"), B.snr_bucket(F.col("logprob") * -60))
    return g.select(F.explode(axes).alias("axis", "bucket")).groupBy("axis", "bucket").agg(F.count("*").alias("n"))


@query(
    "p13_bucket_rules",
    "SELECT event_id, CASE WHEN value < 40 THEN '<40 dB' WHEN value < 50 THEN '40-50 dB' WHEN value < 55 THEN '50-55 dB' ELSE '55+ dB' END AS reverb, CASE WHEN value * 20 < 4500 THEN '<4.5 kHz' WHEN value * 20 < 6500 THEN '4.5-6.5 kHz' ELSE '6.5+ kHz' END AS bandwidth, CASE WHEN user_id % 5 = 0 THEN 'unlinked' WHEN value * 30 - 60 <= 0 THEN 'unseen' WHEN value * 30 - 60 < 600 THEN '<10 min' WHEN value * 30 - 60 < 3600 THEN '10-60 min' ELSE '1 h+' END AS exposure, CASE WHEN value - 5 <= 0 THEN '0' WHEN value - 5 < 15 THEN '<15' WHEN value - 5 < 30 THEN '15-30' ELSE '30+' END AS cmi, CASE WHEN event_id % 4 >= 2 THEN '2+' ELSE CAST(event_id % 4 AS VARCHAR) END AS turn_changes, CASE WHEN greatest(0, 1 - (value / 4) / 30) < 0.02 THEN '<2%' WHEN greatest(0, 1 - (value / 4) / 30) <= 0.10 THEN '2-10%' ELSE '>10%' END AS pause FROM events",
)
def _(s, d):
    v, i = F.col("value"), F.col("event_id")
    return table(s, d, "events").select(
        "event_id", B.reverb_bucket(v).alias("reverb"), B.bandwidth_bucket(v * 20).alias("bandwidth"), B.exposure_bucket(F.when(F.col("user_id") % 5 != 0, F.col("user_id")), v * 30 - 60).alias("exposure"),
        B.cmi_bucket(v - 5).alias("cmi"), B.count_bucket(i % 4, 2).alias("turn_changes"), B.pause_bucket(v / 4, F.lit(30.0)).alias("pause"),
    )


@query("p14_declared_value", "WITH g AS (SELECT o_custkey, list(CASE WHEN o_orderkey % 40 <> 0 THEN o_orderstatus END) AS v, count(*) + (o_custkey % 6 = 0)::INT AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN n > len(v) THEN 'undeclared' WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'undeclared' WHEN len(list_distinct(v)) > 1 THEN 'mixed' ELSE v[1] END AS declared FROM g")
def _(s, d):
    o = table(s, d, "orders")
    entry = F.struct(F.col("o_orderkey").cast("string").alias("k"), F.struct(F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderstatus")).alias("status")).alias("v"))
    g = o.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.count("*").alias("n"))
    return g.select("o_custkey", B.declared_value(F.col("m"), "status", F.col("n") + (F.col("o_custkey") % 6 == 0).cast("int")).alias("declared"))


@query("p15_rate_bucket", "SELECT conv_id, turn, CASE WHEN r < 2.0 THEN '<2.0 w/s' WHEN r < 2.6 THEN '2.0-2.6 w/s' WHEN r < 3.2 THEN '2.6-3.2 w/s' WHEN r < 3.8 THEN '3.2-3.8 w/s' ELSE '3.8+ w/s' END AS bucket FROM (SELECT conv_id, turn, length(text) / 40.0 AS r FROM conversations)")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", B.speaking_rate_bucket(F.length("text") / 40.0).alias("bucket"))


@query("p16_mixing_bucket", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 4 = 0 THEN '0' WHEN l_discount * 4 < 0.15 THEN '<15' WHEN l_discount * 4 < 0.30 THEN '15-30' ELSE '30+' END AS bucket FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", B.mixing_bucket(F.col("l_discount") * 4).alias("bucket"))


@query("p17_effective_split", f"WITH {SEGMENTS} SELECT CASE WHEN pot = 'gold' THEN 'test' ELSE split END AS split, count(*) AS n FROM segments GROUP BY 1")
def _(s, d):
    return segments(s, d).groupBy(B.effective_split(F.col("pot"), F.col("split")).alias("split")).agg(F.count("*").alias("n"))


@query("p18_split_hash")
def _(s, d):
    return C.draw_split(segments(s, d).select("episode").distinct(), "episode", 0.2, 7)


@query(
    "p19_priority",
    f"WITH {SEGMENTS} SELECT segment_id, greatest(0, least(1, coalesce(overlap_share, 0))) * 0.3 + greatest(0, least(1, coalesce(logprob / -0.5, 0))) * 0.25 + greatest(0, least(1, duration / 9000)) * 0.2 + CASE WHEN duration > 8000 THEN 1.0 ELSE 0.0 END AS priority, list_filter([CASE WHEN overlap_share IS NULL THEN 'unsupported_rate' END, CASE WHEN logprob IS NULL THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS unmeasured FROM segments",
)
def _(s, d):
    g = segments(s, d)
    low = F.when(F.col("logprob").isNotNull(), B.low_confidence(F.col("logprob"), -0.5))
    hazards = F.when(F.col("duration") > 8000, F.array(F.lit("length_outlier"))).otherwise(F.array().cast("array<string>"))
    p, u = B.priority_score({"unsupported_rate": F.col("overlap_share"), "low_confidence": low, "acoustic_gap": F.col("duration") / 9000}, {"unsupported_rate": 0.3, "low_confidence": 0.25, "acoustic_gap": 0.2}, hazards)
    return g.select("segment_id", p.alias("priority"), u.alias("unmeasured"))


@query("p20_low_confidence", f"WITH {SEGMENTS} SELECT segment_id, CASE WHEN logprob IS NULL THEN 0.0::DOUBLE ELSE greatest(0, least(1, logprob / -0.5)) END AS low FROM segments")
def _(s, d):
    return segments(s, d).select("segment_id", B.low_confidence(F.col("logprob"), -0.5).alias("low"))


_FLAGS = ("empty_transcript", "repeated_ngram", "high_no_speech_prob", "too_short", "too_long", "implausible_speaking_rate", "script_conflict", "missed_speech")


@query("p21_flag_score", "SELECT event_id, len(list_filter(f, lambda x: x IN ('too_short', 'too_long', 'missed_speech'))) / 8.0::DOUBLE AS score FROM (SELECT event_id, list_distinct([CASE WHEN value < 10 THEN 'too_short' ELSE 'speaker_overlap' END, CASE WHEN value > 100 THEN 'too_long' ELSE 'own_flag' END, CASE WHEN event_id % 3 = 0 THEN 'missed_speech' ELSE 'too_short' END]) AS f FROM events)")
def _(s, d):
    v = F.col("value")
    f = F.array(F.when(v < 10, "too_short").otherwise("speaker_overlap"), F.when(v > 100, "too_long").otherwise("own_flag"), F.when(F.col("event_id") % 3 == 0, "missed_speech").otherwise("too_short"))
    return table(s, d, "events").select("event_id", (F.size(F.array_intersect(f, F.array(*[F.lit(x) for x in _FLAGS]))) / 8.0).alias("score"))


@query("p22_rule_flags", r"SELECT conv_id, turn, list_sort(list_filter([CASE WHEN trim(text) = '' THEN 'empty_transcript' END, CASE WHEN length(text) / 15.0 < 1 THEN 'too_short' END, CASE WHEN length(text) / 15.0 > 30 THEN 'too_long' END, CASE WHEN len(regexp_extract_all(text, '\S+')) / (length(text) / 15.0) > 2.7 THEN 'implausible_speaking_rate' END], lambda x: x IS NOT NULL)) AS flags FROM conversations WHERE length(text) > 0")
def _(s, d):
    t, secs = F.col("text"), F.length("text") / 15.0
    flags = F.array(F.when(F.trim(t) == "", "empty_transcript"), F.when(secs < 1, "too_short"), F.when(secs > 30, "too_long"), F.when(X.word_count(t) / secs > 2.7, "implausible_speaking_rate"))
    return table(s, d, "conversations").where(F.length("text") > 0).select("conv_id", "turn", F.array_sort(F.array_compact(flags)).alias("flags"))


@query("p23_overlap_flag", "SELECT event_id, greatest(0, value / 100) + greatest(0, (event_id % 7 - 3) / 10.0::DOUBLE) >= 0.5 AS raised FROM events")
def _(s, d):
    i = F.col("event_id")
    spans = F.array(F.struct(F.lit(0.0).alias("start"), (F.col("value") / 100).alias("end")), F.struct(F.lit(0.0).alias("start"), ((i % 7 - 3) / 10.0).alias("end")))
    return table(s, d, "events").select("event_id", (I.covered(spans) >= 0.5).alias("raised"))


@query("p24_coverage_status", f"WITH {SEGMENTS}, g AS (SELECT episode, count(*) AS clips, sum(duration) / 3600 AS hours, count(DISTINCT genre) AS voices FROM segments GROUP BY 1) SELECT episode, CASE WHEN episode = 'src3' THEN 'unknown' WHEN episode = 'src4' THEN 'defect' WHEN clips = 0 THEN 'missing' WHEN hours < 25 THEN 'thin' WHEN voices < 4 THEN 'thin' WHEN hours / sum(hours) OVER () > 0.08 THEN 'overdone' WHEN hours >= 37.5 THEN 'plenty' ELSE 'enough' END AS status FROM g")
def _(s, d):
    g = segments(s, d).groupBy("episode").agg(F.count("*").alias("clips"), (F.sum("duration") / 3600).alias("hours"), F.count_distinct("genre").alias("voices"))
    g = R.with_share(g, "hours", "share")
    kind = F.when(F.col("episode") == "src3", "unknown").when(F.col("episode") == "src4", "defect")
    return g.select("episode", B.coverage_status(F.lit(True), kind, F.col("clips"), F.col("hours"), F.lit("voices"), F.col("voices"), F.col("share"), thin_hours=25, thin_voices=4, plenty=1.5, dominant=0.08).alias("status"))


_PSEUDO = "SELECT event_id, value * 4 AS n_tokens, 10 + event_id % 20 AS duration, -(event_id % 997) / 1000.0::DOUBLE AS lp, event_id % 31 = 0 AS looped, CASE WHEN event_id % 7 <> 0 THEN (event_id % 23) / 100.0::DOUBLE END AS share, CASE WHEN event_id % 41 = 0 THEN ' ' ELSE event_type END AS text FROM events"


@query(
    "p25_filter_pseudo",
    f"WITH p AS ({_PSEUDO}), m AS (SELECT *, CASE WHEN share > 0.18 THEN 'overlap' WHEN looped THEN 'loop' WHEN trim(text) = '' THEN 'empty' WHEN NOT (n_tokens / duration BETWEEN 0.5 AND 40) THEN 'rate' END AS r FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY r IS NULL ORDER BY lp, event_id) AS rn, count(*) FILTER (r IS NULL) OVER () AS n FROM m) SELECT coalesce(CASE WHEN r IS NULL AND rn <= floor(n * 0.1::DOUBLE) THEN 'confidence' ELSE r END, 'kept') AS reason, count(*) AS n, {i64('sum(event_id)')} AS ids FROM k GROUP BY 1",
)
def _(s, d):
    i = F.col("event_id")
    p = table(s, d, "events").select(
        "event_id", (F.col("value") * 4).alias("n_tokens"), (10 + i % 20).alias("duration"), (-(i % 997) / F.lit(1000.0)).alias("mean_logprob"), (i % 31 == 0).alias("looped"),
        F.when(i % 7 != 0, (i % 23) / F.lit(100.0)).alias("overlap_share"), F.when(i % 41 == 0, " ").otherwise(F.col("event_type")).alias("text"),
    )
    return R.filtered_pseudo(p, 0.5, 40, 0.1, 0.18, ["event_id"]).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("p26_channels", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '[^\p{L}\p{N}\p{M}._-]+', '_', 'g'), '^_+|_+$', '', 'g'), '_[0-9]+$', '') AS channel FROM (SELECT page_id, regexp_replace(url, '\.[^./]*$', '') AS url FROM pages)")
def _(s, d):
    url = F.regexp_replace("url", "\\.[^./]*$", "")
    return table(s, d, "pages").select("page_id", F.regexp_replace(X.path_safe(F.regexp_replace(url, "^.*/", "")), "_[0-9]+$", "").alias("channel"))


@query("p27_strip_fields", "SELECT doc_id, map_from_entries(list_filter([{'k': 'lang', 'v': lang}, {'k': 'source', 'v': source}], lambda x: x.k = 'lang' AND x.v IN ('en', 'de'))) AS kept FROM documents")
def _(s, d):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return table(s, d, "documents").select("doc_id", F.map_filter(m, lambda k, v: k.isin("lang") & v.isin("en", "de")).alias("kept"))


@query("p28_edited_metadata", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'talk' ELSE lang END AS genre, source AS topic FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.struct(F.when(F.col("lang").isin("en", "fr"), "talk").otherwise(F.col("lang")).alias("genre"), F.col("source").alias("topic")).alias("m")).select("doc_id", "m.*")


@query("p29_vendor_case", f"WITH {REQUESTS} SELECT {VENDOR_SQL} AS vendor, count(*) AS n FROM requests GROUP BY 1")
def _(s, d):
    return requests(s, d).groupBy(B.vendor(F.col("route"), F.col("model")).alias("vendor")).agg(F.count("*").alias("n"))


@query("p30_costs", f"WITH {REQUESTS} SELECT id, CAST(((coalesce(prompt_tokens, 0) * 75 + completion_tokens * 375 + 50) // 100)::DECIMAL(12,0) * 0.000001::DECIMAL(7,6) AS DECIMAL(12,6)) AS usd FROM requests")
def _(s, d):
    return requests(s, d).select("id", B.token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), "0.75", "3.75").alias("usd"))


@query("p31_in_split", f"WITH {SEGMENTS} SELECT segment_id, CASE WHEN pot = 'gold' THEN true ELSE split = 'val' END AS held_out FROM segments")
def _(s, d):
    return segments(s, d).select("segment_id", B.effective_split(F.col("pot"), F.col("split")).isin("test", "val").alias("held_out"))


@query("p32_dominant_speaker", "WITH t AS (SELECT conv_id, role, sum(length(text)) / 10.0::DOUBLE AS talk FROM conversations GROUP BY 1, 2) SELECT conv_id, count(*) FILTER (talk >= 0.5) AS present, arg_max(role, talk) AS dominant FROM (SELECT * FROM t ORDER BY conv_id, role) GROUP BY 1")
def _(s, d):
    t = table(s, d, "conversations").groupBy("conv_id", "role").agg((F.sum(F.length("text")) / 10.0).alias("talk"))
    first = F.min(F.struct((-F.col("talk")).alias("t"), "role"))["role"]
    return t.groupBy("conv_id").agg(F.count_if(F.col("talk") >= 0.5).alias("present"), first.alias("dominant"))


@query("p33_buckets_by_chain", f"WITH {SEGMENTS} SELECT segment_id, coalesce(CASE WHEN q = 1 THEN 'good' WHEN q = 0 THEN 'poor' END, genre, 'undeclared') AS bucket FROM segments LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) ON segment_id = doc_id")
def _(s, d):
    q = table(s, d, "labels").groupBy(F.col("doc_id").alias("segment_id")).agg(F.max("quality").alias("q"))
    own = F.when(F.col("q") == 1, "good").when(F.col("q") == 0, "poor")
    return segments(s, d).join(q, "segment_id", "left").select("segment_id", F.coalesce(own, "genre", F.lit("undeclared")).alias("bucket"))


@query("p34_attributed_words", f"WITH w AS (SELECT conv_id, role, sum(length(text)) AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, {i64('CASE WHEN max(n) / sum(n) >= 0.9::DOUBLE THEN sum(n) ELSE 0 END')} AS words FROM w GROUP BY 1")
def _(s, d):
    w = table(s, d, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("n"))
    return w.groupBy("conv_id").agg(F.when(F.max("n") / F.sum("n") >= 0.9, F.sum("n")).otherwise(0).cast("long").alias("words"))


@query("p35_any_interval_excludes_one", "SELECT user_id, bool_or(lo > 1 OR hi < 1) AS verdict FROM (SELECT user_id, event_type, min(value) / 10 AS lo, max(value) / 10 AS hi FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    ci = table(s, d, "events").groupBy("user_id", "event_type").agg((F.min("value") / 10).alias("lo"), (F.max("value") / 10).alias("hi"))
    return ci.groupBy("user_id").agg(F.exists(F.collect_list(F.struct("lo", "hi")), lambda c: (c["lo"] > 1) | (c["hi"] < 1)).alias("verdict"))


# --- joins -------------------------------------------------------------------------------------------


@query("j1_inner_left", "SELECT o_orderkey, c_name, n_name, e.value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN events e ON o_orderkey = event_id AND event_type = 'click'")
def _(s, d):
    e = table(s, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("o_orderkey"), "value")
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(e, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "value")


@query("j2_inner", f"WITH {SEGMENTS} SELECT l.doc_id, s.episode, l.quality FROM labels l JOIN segments s ON l.doc_id = s.segment_id WHERE s.pot = 'gold'")
def _(s, d):
    return table(s, d, "labels").join(segments(s, d).where("pot = 'gold'").withColumnRenamed("segment_id", "doc_id"), "doc_id").select("doc_id", "episode", "quality")


@query("j6_anti_exists", f"WITH {SEGMENTS} SELECT segment_id FROM segments s WHERE pipeline_status IN ('imported', 'queued') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = s.segment_id AND e.event_type = 'purchase')")
def _(s, d):
    done = table(s, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("segment_id"))
    return J.without(segments(s, d).where(F.col("pipeline_status").isin("imported", "queued")), done, ["segment_id"]).select("segment_id")


@query("j7_semi_anti", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'view')")
def _(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    r = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    v = table(s, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("o_orderkey"))
    return J.ranked_for(o, o, r, v, "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("j8_anti_null_safe", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM (SELECT nullif(s_nationkey, 3) AS k FROM supplier WHERE s_acctbal > 9000) WHERE k = c_nationkey)")
def _(s, d):
    k = table(s, d, "supplier").where("s_acctbal > 9000").select(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("c_nationkey"))
    return J.without(table(s, d, "customer"), k, ["c_nationkey"]).agg(F.count("*").alias("n"))


@query("j9_left_distinct", f"WITH {SEGMENTS}, l AS (SELECT DISTINCT doc_id FROM labels) SELECT CASE WHEN pot = 'gold' THEN 'gold' ELSE split END AS bucket, count(*) AS segments, count(DISTINCT episode) AS episodes, sum(duration) / 3600 AS hours, coalesce(sum(duration) FILTER (doc_id IS NOT NULL), 0) / 3600 AS labeled_hours FROM segments LEFT JOIN l ON segment_id = doc_id GROUP BY 1")
def _(s, d):
    return R.pots(segments(s, d), table(s, d, "labels").select(F.col("doc_id").alias("segment_id")))


@query("j10_fanout_distinct", f"WITH {SEGMENTS} SELECT episode, count(DISTINCT segment_id) AS segments, count(DISTINCT segment_id) FILTER (event_type = 'purchase') AS done, count(DISTINCT segment_id) FILTER (pot = 'gold') AS gold FROM segments LEFT JOIN events ON segment_id = user_id GROUP BY 1")
def _(s, d):
    t = table(s, d, "events").select(F.col("user_id").alias("segment_id"), F.when(F.col("event_type") == "purchase", "done").otherwise("open").alias("status"))
    return R.fanned(segments(s, d), t)


@query("j11_export_join", f"WITH {SEGMENTS}, {LABELS}, cur AS (SELECT * FROM labels_log QUALIFY row_number() OVER (PARTITION BY segment_id, version ORDER BY created_at DESC, id DESC) = 1) SELECT s.segment_id, s.split, list_sort(list(c.version || ':' || c.disposition)) AS labels FROM segments s JOIN cur c USING (segment_id) WHERE s.pot = 'train' GROUP BY 1, 2")
def _(s, d):
    cur = R.current_labels(labels_log(s, d)).select("segment_id", F.concat_ws(":", "version", "disposition").alias("l"))
    return segments(s, d).where("pot = 'train'").join(cur, "segment_id").groupBy("segment_id", "split").agg(F.array_sort(F.collect_list("l")).alias("labels"))


@query("j12_left_filtered_sum", f"WITH {SEGMENTS} SELECT episode, coalesce(sum(duration) FILTER (pot <> 'gold' AND pipeline_status <> 'excluded'), 0) / 3600 AS hours FROM segments GROUP BY 1")
def _(s, d):
    own = (F.col("pot") != "gold") & (F.col("pipeline_status") != "excluded")
    return segments(s, d).groupBy("episode").agg((F.coalesce(F.sum(F.when(own, F.col("duration"))), F.lit(0.0)) / 3600).alias("hours"))


_CLIPS = "clips AS (SELECT turn_id AS clip_id, episode, start AS c_start, start + 600 AS c_end FROM turns WHERE kind = 'signup')"


def _spans(s, d):
    t = turns(s, d)
    clip = t.where("kind = 'signup'").select(F.col("turn_id").alias("clip_id"), "episode", F.col("start").alias("c_start"), (F.col("start") + 600).alias("c_end"))
    return clip, t.where("kind = 'view'").select("episode", "turn_id", "speaker", F.col("start").alias("t_start"), F.col("end").alias("t_end"))


@query("j13_interval_join", f"WITH {TURNS}, {_CLIPS} SELECT clip_id, turn_id FROM clips c JOIN turns t ON c.episode = t.episode AND t.kind = 'view' AND c_start < t.\"end\" AND c_end > t.start")
def _(s, d):
    a, b = _spans(s, d)
    return J.interval_join(a, b, ["episode"], ("c_start", "c_end"), ("t_start", "t_end"), 600).select("clip_id", "turn_id")


@query("j16_interval_anti", f"WITH {TURNS}, {_CLIPS} SELECT clip_id FROM clips c WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE c.episode = t.episode AND t.kind = 'view' AND c_start < t.\"end\" AND c_end > t.start)")
def _(s, d):
    a, b = _spans(s, d)
    return J.interval_join(a, b, ["episode"], ("c_start", "c_end"), ("t_start", "t_end"), 600, "left_anti").select("clip_id")


@query("j17_interval_clip", f"WITH {TURNS}, {_CLIPS} SELECT clip_id, turn_id, greatest(c_start, t.start) - c_start AS rel_start, least(c_end, t.\"end\") - c_start AS rel_end FROM clips c JOIN turns t ON c.episode = t.episode AND t.kind = 'view' AND c_start < t.\"end\" AND c_end > t.start")
def _(s, d):
    a, b = _spans(s, d)
    return J.clipped(J.interval_join(a, b, ["episode"], ("c_start", "c_end"), ("t_start", "t_end"), 600), ("c_start", "c_end"), ("t_start", "t_end")).select("clip_id", "turn_id", "rel_start", "rel_end")


@query("j19_neighbours", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(s, d):
    return L.neighbours(table(s, d, "conversations"), "conv_id", ["turn"], "role").select("conv_id", "turn", "before", "after")


@query("j23_lookup_default", "SELECT l_orderkey, l_linenumber, coalesce(p_size, 0) AS size FROM lineitem LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def _(s, d):
    p = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("size"))
    return J.lookup(table(s, d, "lineitem"), p, "l_partkey", "size", 0).select("l_orderkey", "l_linenumber", "size")


@query("j25_point_in_interval", f"WITH {TURNS}, {_CLIPS} SELECT clip_id, turn_id FROM clips c JOIN turns t ON c.episode = t.episode AND t.kind = 'click' AND (t.start + t.\"end\") / 2 >= c_start AND (t.start + t.\"end\") / 2 < c_end")
def _(s, d):
    a, _ = _spans(s, d)
    p = turns(s, d).where("kind = 'click'").select("episode", "turn_id", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    return J.point_in_interval(p, a, ["episode"], "mid", ("c_start", "c_end"), 600).select("clip_id", "turn_id")


@query("j26_voice_seconds", f"WITH {TURNS}, {_CLIPS} SELECT speaker, count(*) AS n, sum(least(c_end, t.\"end\") - greatest(c_start, t.start)) AS seconds FROM clips c JOIN turns t ON c.episode = t.episode AND t.kind = 'view' AND c_start < t.\"end\" AND c_end > t.start GROUP BY 1")
def _(s, d):
    a, b = _spans(s, d)
    j = J.clipped(J.interval_join(a, b, ["episode"], ("c_start", "c_end"), ("t_start", "t_end"), 600), ("c_start", "c_end"), ("t_start", "t_end"))
    return j.groupBy("speaker").agg(F.count("*").alias("n"), F.sum(F.col("rel_end") - F.col("rel_start")).alias("seconds"))


@query("j27_pairs_lt", "SELECT a.user_id, a.event_type AS kind_a, b.event_type AS kind_b, a.v AS v_a, b.v AS v_b FROM (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) a JOIN (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def _(s, d):
    e = table(s, d, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.max("value").alias("v"))
    return J.pairs(e, "user_id", "kind", "v")


@query("j28_dense_grid", f"WITH {SEGMENTS}, f AS (SELECT episode, pipeline_status, count(*) AS n FROM segments WHERE duration >= 500 GROUP BY 1, 2) SELECT e.episode, p.pipeline_status, coalesce(n, 0) AS n FROM (SELECT DISTINCT episode FROM segments) e CROSS JOIN (SELECT DISTINCT pipeline_status FROM segments) p LEFT JOIN f ON e.episode = f.episode AND p.pipeline_status = f.pipeline_status")
def _(s, d):
    g = segments(s, d)
    return J.grid(g.where("duration >= 500"), "episode", "pipeline_status", g, g, F.count("*").alias("n")).select("episode", "pipeline_status", F.coalesce("n", F.lit(0)).alias("n"))


# --- aggregations ------------------------------------------------------------------------------------


@query("g9_by_class", "WITH c AS (SELECT doc_id, length(text) AS words, length(text) % 17 AS errors, lang, source FROM documents), u AS (SELECT words, errors, unnest([{'a': 'lang', 'b': lang}, {'a': 'source', 'b': source}]) AS x FROM c) SELECT x.a AS axis, x.b AS bucket, count(*) AS clips, CAST(sum(words) AS BIGINT) AS words, CAST(sum(errors) AS BIGINT) AS errors, 100.0::DOUBLE * sum(errors) / sum(words) AS wer, sum(errors)::DOUBLE / (SELECT sum(errors) FROM c) AS share_of_errors FROM u GROUP BY 1, 2")
def _(s, d):
    c = table(s, d, "documents").select(F.length("text").alias("words"), (F.length("text") % 17).alias("errors"), "lang", "source")
    return R.by_axes(c, F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")))


@query("g20_zero_filled", f"WITH {SEGMENTS} SELECT v AS pipeline_status, count(segment_id) AS n FROM (SELECT unnest(['imported', 'queued', 'labeled', 'excluded', 'retired']) AS v) LEFT JOIN segments ON pipeline_status = v GROUP BY 1")
def _(s, d):
    return R.filled_counts(segments(s, d), "pipeline_status", ["imported", "queued", "labeled", "excluded", "retired"])


@query("g21_median_throughput", f"WITH {LABELS} SELECT median(duration_ms / 1000) AS median_seconds, sum(duration_ms / 1000) / 3600 AS hours, count(duration_ms) AS events, count(*) FILTER (created_at >= TIMESTAMP '2024-01-29') AS session_events, median(duration_ms / 1000) FILTER (created_at >= TIMESTAMP '2024-01-29') AS session_median_seconds FROM labels_log")
def _(s, d):
    return R.throughput(labels_log(s, d), "2024-01-29")


_CUR = f"{LABELS}, cur AS (SELECT * FROM labels_log QUALIFY row_number() OVER (PARTITION BY segment_id, version ORDER BY created_at DESC, id DESC) = 1)"


@query("g22_report_means", f"WITH {_CUR} SELECT tier, count(*) AS n, avg(value) AS mean_value, count(DISTINCT segment_id) AS segments FROM cur GROUP BY 1")
def _(s, d):
    return R.current_labels(labels_log(s, d)).groupBy("tier").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.count_distinct("segment_id").alias("segments"))


@query("g23_accept_by_day", f"WITH {_CUR} SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, count(*) AS labeled, count(*) FILTER (disposition = 'accepted_unchanged') AS accepted, round(accepted / labeled, 4) AS accept_rate FROM cur GROUP BY 1")
def _(s, d):
    return R.accept_rate_by_day(R.current_labels(labels_log(s, d)))


@query("g24_split_balance", f"WITH {SEGMENTS} SELECT CASE WHEN pot = 'gold' THEN 'test' ELSE split END AS split, count(DISTINCT episode) AS episodes, count(*) AS segments, sum(duration) / 3600 AS hours FROM segments GROUP BY 1")
def _(s, d):
    return R.split_balance(segments(s, d))


@query("g25_coverage_gaps", f"WITH {SEGMENTS} SELECT DISTINCT lang AS value FROM documents WHERE lang NOT IN (SELECT genre FROM segments WHERE pot = 'gold' AND duration > 15000 AND genre IS NOT NULL)")
def _(s, d):
    gold = segments(s, d).where("pot = 'gold' and duration > 15000").select(F.col("genre").alias("value"))
    return table(s, d, "documents").select(F.col("lang").alias("value")).distinct().join(gold, "value", "left_anti")


@query("g26_having_distinct", f"WITH {SEGMENTS} SELECT episode, count(DISTINCT pot) AS n FROM segments GROUP BY 1 HAVING count(DISTINCT pot) > 1")
def _(s, d):
    return R.spanning(segments(s, d))


@query("g27_coverage_counts", f"WITH {SEGMENTS}, u AS (SELECT episode, unnest([genre, pot]) AS v FROM segments) SELECT v AS value, count(DISTINCT episode) AS episodes FROM u WHERE v IS NOT NULL GROUP BY 1")
def _(s, d):
    return segments(s, d).select("episode", F.explode(F.array_compact(F.array("genre", "pot"))).alias("value")).groupBy("value").agg(F.count_distinct("episode").alias("episodes"))


_INV = "inv AS (SELECT o_orderkey AS clip_id, o_orderpriority AS episode, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 200 END AS voice, o_orderkey % 40 AS words, o_totalprice / 100 AS duration, CASE WHEN o_orderkey % 3 = 0 THEN 'screened' ELSE 'verified' END AS tier, CASE WHEN o_orderkey % 5 = 0 THEN 'gold' ELSE 'train' END AS pot, o_orderstatus, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 30)::DOUBLE END AS cmi FROM orders)"


def _inv(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(s, d, "orders").select(
        k.alias("clip_id"), F.col("o_orderpriority").alias("episode"), F.when(c % 9 != 0, c % 200).alias("voice"), (k % 40).alias("words"), (F.col("o_totalprice") / 100).alias("duration"),
        F.when(k % 3 == 0, "screened").otherwise("verified").alias("tier"), F.when(k % 5 == 0, "gold").otherwise("train").alias("pot"), "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.when(k % 4 != 0, (k % 30).cast("double")).alias("cmi"),
    )


@query(
    "g28_category",
    f"""WITH {_INV}, u AS (SELECT *, unnest([{{'c': 'status', 'b': o_orderstatus}}, {{'c': 'tier', 'b': tier}}]) AS x FROM inv), v AS (SELECT x.c AS category, x.b AS bucket, voice, sum(words) AS w FROM u GROUP BY 1, 2, 3), k AS (SELECT category, bucket, count(voice) AS voices, count(*) FILTER (w >= 150 AND voice IS NOT NULL) AS usable_voices FROM v GROUP BY 1, 2),
g AS (SELECT x.c AS category, x.b AS bucket, sum(duration / 3600) AS hours, count(*) AS clips, count(DISTINCT episode) AS episodes, sum(CASE WHEN tier = 'verified' THEN duration / 3600 ELSE 0 END) AS verified_hours, sum(CASE WHEN tier = 'screened' THEN duration / 3600 ELSE 0 END) AS screened_hours, sum(CASE WHEN pot = 'gold' THEN duration / 3600 ELSE 0 END) AS gold_hours, sum(CASE WHEN pot = 'train' THEN duration / 3600 ELSE 0 END) AS train_hours FROM u GROUP BY 1, 2)
SELECT category, bucket, clips, episodes, round(hours, 3) AS hours, round(verified_hours, 3) AS verified_hours, round(screened_hours, 3) AS screened_hours, round(gold_hours, 3) AS gold_hours, round(train_hours, 3) AS train_hours, voices, usable_voices, hours / sum(hours) OVER (PARTITION BY category) AS share FROM g JOIN k USING (category, bucket)""",
)
def _(s, d):
    out = R.categories(_inv(s, d), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("tier"), F.col("tier")), 150)
    return out.withColumns({f"{c}hours": F.round(f"{c}hours", 3) for c in ("", "verified_", "screened_", "gold_", "train_")})


@query("g30_crosstab", f"WITH {_INV} SELECT o_orderstatus, sum(duration) FILTER (tier = 'screened') AS screened, sum(duration) FILTER (tier = 'verified') AS verified FROM inv GROUP BY 1")
def _(s, d):
    return _inv(s, d).groupBy("o_orderstatus").pivot("tier", ["screened", "verified"]).agg(F.sum("duration"))


@query("g31_profiles", f"WITH {_INV} SELECT voice, count(*) AS clips, round(sum(duration / 3600), 3) AS hours, round(sum(CASE WHEN pot = 'gold' THEN duration / 3600 ELSE 0 END), 3) AS gold_hours, CAST(sum(words) AS BIGINT) AS words, sum(words) / sum(duration) AS words_per_second, sum(cmi * words) / nullif(sum(words) FILTER (cmi IS NOT NULL), 0) AS mean_cmi, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT episode) AS episodes FROM inv WHERE voice IS NOT NULL GROUP BY 1")
def _(s, d):
    return R.voice_profiles(_inv(s, d)).withColumns({c: F.round(c, 3) for c in ("hours", "gold_hours")})


@query("g31_co_voices", "WITH v AS (SELECT DISTINCT o_orderdate AS episode, o_custkey % 50 AS voice FROM orders) SELECT a.voice, b.voice AS other, count(*) AS episodes FROM v a JOIN v b ON a.episode = b.episode AND a.voice <> b.voice GROUP BY 1, 2")
def _(s, d):
    return R.co_voices(table(s, d, "orders").select(F.col("o_orderdate").alias("episode"), (F.col("o_custkey") % 50).alias("voice")))


@query("g32_completeness", f"WITH {SEGMENTS}, u AS (SELECT unnest([{{'f': 'genre', 'h': genre IS NOT NULL}}, {{'f': 'logprob', 'h': logprob IS NOT NULL}}, {{'f': 'overlap_share', 'h': overlap_share IS NOT NULL}}]) AS x FROM segments) SELECT x.f AS field, count(*) FILTER (x.h) AS filled, count(*) FILTER (NOT x.h) AS missing FROM u GROUP BY 1")
def _(s, d):
    return R.completeness(segments(s, d), ["genre", "logprob", "overlap_share"], "segment_id")


_COST = "count(*) AS requests, count(*) FILTER (status = 'succeeded') AS successful, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'dry_run') AS dry_run, coalesce(sum(cost), 0) AS cost_usd, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, avg(latency_ms) FILTER (status = 'succeeded') AS average_latency_ms"


@query("g33_cost_vendor", f"WITH {REQUESTS} SELECT {VENDOR_SQL} AS vendor, {_COST} FROM requests GROUP BY 1")
def _(s, d):
    return R.cost_by(requests(s, d).withColumn("vendor", B.vendor(F.col("route"), F.col("model"))), "vendor")


@query("g33_cost_route", f"WITH {REQUESTS} SELECT route, {_COST} FROM requests GROUP BY 1")
def _(s, d):
    return R.cost_by(requests(s, d), "route")


@query("g33_cost_vendor_day", f"WITH {REQUESTS} SELECT strftime(created_at, '%Y-%m-%d') AS date, {VENDOR_SQL} AS vendor, sum(coalesce(cost, 0)) AS cost_usd, count(*) AS requests FROM requests GROUP BY 1, 2")
def _(s, d):
    return R.daily_by_vendor(requests(s, d).withColumn("vendor", B.vendor(F.col("route"), F.col("model"))))


@query("g37_rollup_all", f"WITH {SEGMENTS}, g AS (SELECT episode, sum(duration) / 3600 AS hours, coalesce(sum(duration) FILTER (overlap_share IS NULL), 0) / 3600 AS unmeasured_hours, coalesce(sum(duration) FILTER (overlap_share > 0.1), 0) / 3600 AS dropped_10, coalesce(sum(duration) FILTER (overlap_share > 0.2), 0) / 3600 AS dropped_20 FROM segments GROUP BY ROLLUP (episode)) SELECT coalesce(episode, 'all') AS episode, hours, unmeasured_hours, dropped_10, dropped_20 FROM g")
def _(s, d):
    h, o = F.col("duration"), F.col("overlap_share")
    part = lambda c: F.coalesce(F.sum(F.when(c, h)), F.lit(0.0)) / 3600
    return R.rollup_all(segments(s, d), "episode", (F.sum(h) / 3600).alias("hours"), part(o.isNull()).alias("unmeasured_hours"), part(o > 0.1).alias("dropped_10"), part(o > 0.2).alias("dropped_20"))


@query("g38_mixture_weights", "WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS g, (n_chars + 1) / 3600.0::DOUBLE AS h FROM documents), t AS (SELECT g, sum(h) AS total FROM r GROUP BY 1), w AS (SELECT g, total, CASE WHEN g IS NULL THEN 0.4 ELSE 0.6 * sqrt(total) / sum(sqrt(total)) FILTER (g IS NOT NULL) OVER () END AS share FROM t) SELECT doc_id, share * h / total AS weight FROM r JOIN w ON r.g IS NOT DISTINCT FROM w.g")
def _(s, d):
    r = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("group"), ((F.col("n_chars") + 1) / 3600.0).alias("hours"))
    return R.mixture_weights(r, 0.4).select("doc_id", "weight")


@query("g40_spread", "WITH c AS (SELECT l_suppkey, sum(CASE WHEN l_shipdate < TIMESTAMP '1998-05-24' THEN -l_linenumber ELSE l_linenumber END) AS ch FROM lineitem GROUP BY 1), g AS (SELECT -ch AS gain FROM c WHERE ch < 0) SELECT count(*) FILTER (ch < 0) AS improved, count(*) FILTER (ch = 0) AS unchanged, count(*) FILTER (ch > 0) AS worse, coalesce((SELECT sum(gain) FROM (SELECT gain FROM g ORDER BY gain DESC LIMIT 3))::DOUBLE / (SELECT sum(gain) FROM g), 0) AS top_share FROM c")
def _(s, d):
    n = F.col("l_linenumber")
    c = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_shipdate") < F.lit("1998-05-24").cast("timestamp"), -n).otherwise(n)).alias("change"))
    return C.spread(c, 3)


@query("g41_oracle_choice", "SELECT user_id AS clip_id, arg_min(event_id, ROW(v, event_id)) AS oracle_rank, min(v) AS oracle_errors, arg_min(v, event_id) AS first_errors FROM (SELECT user_id, event_id, event_id % 13 AS v FROM events) GROUP BY 1")
def _(s, d):
    c = table(s, d, "events").select(F.col("user_id").alias("clip_id"), (F.col("event_id") % 13).alias("errors"), F.col("event_id").alias("rank"))
    return C.best_candidate(c)


@query("g46_precision_recall", "SELECT count(*) FILTER (a AND b) AS hits, count(*) FILTER (a AND b)::DOUBLE / count(*) FILTER (a) AS precision, count(*) FILTER (a AND b)::DOUBLE / count(*) FILTER (b) AS recall FROM (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels)")
def _(s, d):
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return table(s, d, "labels").agg(F.count_if(a & b).alias("hits"), (F.count_if(a & b) / F.count_if(a)).alias("precision"), (F.count_if(a & b) / F.count_if(b)).alias("recall"))


@query("g47_talk", f"WITH {TURNS} SELECT episode, speaker, sum(greatest(0, \"end\" - start)) AS talk FROM turns GROUP BY 1, 2")
def _(s, d):
    return turns(s, d).groupBy("episode", "speaker").agg(F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("talk"))


@query("g49_discards", "SELECT event_type, count(*) AS lost FROM events WHERE value < 20 GROUP BY 1")
def _(s, d):
    return table(s, d, "events").where("value < 20").groupBy("event_type").agg(F.count("*").alias("lost")).orderBy(F.desc("lost"), "event_type")


@query("g50_public_mean", "SELECT user_id, CASE WHEN count(DISTINCT event_type) = 5 THEN avg(v) END AS mean FROM (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    per = table(s, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return per.groupBy("user_id").agg(F.when(F.count("*") == 5, F.avg("v")).alias("mean"))


@query("g45_boundary_stats", f"SELECT event_type, count(*) AS tokens, count(*) FILTER (abs(d) <= 25) / count(*) AS within_25, count(*) FILTER (abs(d) <= 100) / count(*) AS within_100, avg(abs(d)) AS mae FROM (SELECT event_type, value - 100 AS d FROM events) GROUP BY 1")
def _(s, d):
    off = F.abs(F.col("value") - 100)
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("tokens"), (F.count_if(off <= 25) / F.count("*")).alias("within_25"), (F.count_if(off <= 100) / F.count("*")).alias("within_100"), F.avg(off).alias("mae"))


@query("g48_conditional_distinct", "SELECT l_suppkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned"), F.count_distinct("l_partkey").alias("parts"))


# --- windows -----------------------------------------------------------------------------------------


@query("w1_latest", f"WITH {_CUR} SELECT segment_id, version, id, disposition FROM cur")
def _(s, d):
    return R.current_labels(labels_log(s, d)).select("segment_id", "version", "id", "disposition")


@query("w2_newest_run", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(s, d):
    return L.newest_run(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("w3_topk_per_group", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 3")
def _(s, d):
    return L.top_per_group(table(s, d, "events"), ["user_id"], 3, F.desc("value"), F.asc("event_id")).select("user_id", "event_id", "rank")


@query("w4_share_of_kind", "SELECT event_type, user_id, n / sum(n) OVER (PARTITION BY event_type) AS share FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)")
def _(s, d):
    n = table(s, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("event_type").agg(F.sum("n").alias("all")), "event_type").select("event_type", "user_id", (F.col("n") / F.col("all")).alias("share"))


@query("w7_latest_then_filter", f"WITH {_CUR} SELECT segment_id, version, disposition FROM cur WHERE disposition <> 'cleared'")
def _(s, d):
    return L.latest_then(labels_log(s, d), ["segment_id", "version"], F.col("disposition") != "cleared", F.desc("created_at"), F.desc("id")).select("segment_id", "version", "disposition")


@query("w9_active_first", f"WITH {LABELS} SELECT segment_id, id FROM labels_log QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY CASE WHEN disposition IN ('edited', 'uncertain') THEN 0 ELSE 1 END, id DESC) = 1")
def _(s, d):
    return L.latest(labels_log(s, d), ["segment_id"], F.when(F.col("disposition").isin("edited", "uncertain"), 0).otherwise(1), F.desc("id")).select("segment_id", "id")


@query("w10_turn_changes", "SELECT conv_id, count(*) FILTER (p <> role) AS changes, count(*) AS rows FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1")
def _(s, d):
    return L.changes(table(s, d, "conversations"), "conv_id", "turn", "role")


@query("w11_boundary_flags", "SELECT conv_id, turn, coalesce(role <> lag(role) OVER w, false) OR coalesce(role <> lead(role) OVER w, false) AS boundary FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(s, d):
    return L.boundary_flags(table(s, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "boundary")


@query("w12_number_repeats", "SELECT event_id, CASE WHEN n = 1 THEN k ELSE k || '#' || n END AS unique_id FROM (SELECT event_id, 'u' || user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("k"))
    return L.numbered_repeats(e, "k", ["event_id"]).select("event_id", "unique_id")


@query("w13_islands", "WITH n AS (SELECT user_id, event_id, value > 40 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), i AS (SELECT user_id, event_id, r - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM n WHERE f) SELECT user_id, min(event_id) AS start, max(event_id) AS \"end\", count(*) AS n FROM i GROUP BY user_id, k")
def _(s, d):
    return L.islands(table(s, d, "events"), "user_id", "event_id", F.col("value") > 40)


@query("w14_frames_to_spans", "WITH f AS (SELECT l_suppkey AS rec, l_orderkey AS frame, max(l_tax) > 0.04 AS on_ FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY frame) AS r FROM f), i AS (SELECT rec, frame, r - row_number() OVER (PARTITION BY rec ORDER BY frame) AS k FROM n WHERE on_) SELECT rec, min(frame) AS start, max(frame) AS \"end\", count(*) AS n FROM i GROUP BY rec, k")
def _(s, d):
    f = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("rec"), F.col("l_orderkey").alias("frame")).agg((F.max("l_tax") > 0.04).alias("on"))
    return L.islands(f, "rec", "frame", F.col("on"))


@query(
    "w15_fill_between",
    """WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE END AS s, CASE WHEN event_id % 3 = 0 THEN event_id + 0.5::DOUBLE END AS e FROM events),
p AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 200000) AS hi, count(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, k, s IS NULL ORDER BY event_id) - 1 AS i, greatest(0, hi - lo) / count(*) OVER (PARTITION BY user_id, k, s IS NULL) AS step FROM p)
SELECT user_id, event_id, floor(coalesce(s, lo + i * step)) AS filled_start FROM q""",
)
def _(s, d):
    i = F.col("event_id")
    r = table(s, d, "events").select("user_id", "event_id", F.when(i % 3 == 0, i.cast("double")).alias("start"), F.when(i % 3 == 0, i + 0.5).alias("end"))
    return L.filled_spans(r, "user_id", "event_id", "start", "end", 0.0, 200000.0).select("user_id", "event_id", F.floor(F.col("filled_start") + 0.0004).cast("double").alias("filled_start"))


# --- sorts, samples, sets ----------------------------------------------------------------------------


@query("o1_nulls_last_page", f"WITH {SEGMENTS} SELECT segment_id, logprob FROM segments ORDER BY logprob DESC NULLS LAST, duration DESC, segment_id LIMIT 50 OFFSET 880")
def _(s, d):
    return R.page(segments(s, d), [F.desc_nulls_last("logprob"), F.desc("duration"), F.asc("segment_id")], 50, 880).select("segment_id", "logprob")


@query("o2_next_task", f"WITH {LABELS} SELECT id FROM labels_log WHERE disposition <> 'cleared' ORDER BY CASE WHEN tier = 'screened' THEN 0 ELSE 1 END, value DESC, id LIMIT 1")
def _(s, d):
    return R.page(labels_log(s, d).where("disposition <> 'cleared'"), [F.when(F.col("tier") == "screened", 0).otherwise(1), F.desc("value"), F.asc("id")], 1).select("id")


@query("o4_sorted_page", "SELECT p_partkey, p_size FROM part ORDER BY nullif(p_size, 7) ASC NULLS LAST, p_partkey LIMIT 30 OFFSET 20")
def _(s, d):
    return R.page(table(s, d, "part"), [F.asc_nulls_last(F.nullif("p_size", F.lit(7))), F.asc("p_partkey")], 30, 20).select("p_partkey", "p_size")


@query("o7_audit_sample", f"WITH {SEGMENTS}, r AS (SELECT segment_id, logprob FROM segments WHERE logprob IS NOT NULL), c AS (SELECT quantile_disc(logprob, 0.5) AS cut FROM r) SELECT segment_id FROM r, c WHERE logprob <= cut AND substr(md5(segment_id || ':1'), 1, 8) < '{C.draw_bound(0.6)}'")
def _(s, d):
    return C.audit_rows(segments(s, d).where("logprob is not null"), "segment_id", "logprob", 0.3, 1).select("segment_id")


@query(
    "o7_audit_exact",
    f"""WITH {SEGMENTS}, r AS (SELECT segment_id, count(*) OVER () AS n, row_number() OVER (ORDER BY logprob, segment_id) AS k FROM segments WHERE logprob IS NOT NULL
), h AS (SELECT *, row_number() OVER (ORDER BY md5(segment_id || ':1'), segment_id) AS d FROM r WHERE k <= greatest(1, n // 2)) SELECT segment_id FROM h WHERE d <= greatest(1, round_even(n * 0.3::DOUBLE, 0))""",
)
def _(s, d):
    return C.audit_exact(segments(s, d), "segment_id", "logprob", 0.3, 1).select("segment_id")


@query("o8_argmax", f"WITH h AS (SELECT event_id AS id, user_id AS segment_id, CASE WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'fusion' ELSE 'asr' END AS kind, event_id % 11 AS system_id, CASE WHEN event_id % 3 <> 0 THEN -value END AS logprob FROM events) SELECT segment_id, arg_max(id, ROW(kind = 'fusion', CASE WHEN kind = 'fusion' THEN system_id::DOUBLE ELSE coalesce(logprob, '-infinity'::DOUBLE) END, id)) AS hypothesis_id FROM h GROUP BY 1")
def _(s, d):
    i = F.col("event_id")
    h = table(s, d, "events").select(i.alias("id"), F.col("user_id").alias("segment_id"), F.when((F.col("event_type") == "signup") & (i % 7 == 0), "fusion").otherwise("asr").alias("kind"), (i % 11).alias("system_id"), F.when(i % 3 != 0, -F.col("value")).alias("logprob"))
    return C.seed_hypothesis(h)


@query("o11_search_page", f"WITH {REQUESTS} SELECT id, route, model FROM requests WHERE route ILIKE '%SCRIBE%' OR model ILIKE '%SCRIBE%' OR event_type ILIKE '%SCRIBE%' ORDER BY created_at DESC, id LIMIT 40 OFFSET 5")
def _(s, d):
    return R.page(R.search(requests(s, d), "SCRIBE", ["route", "model", "event_type"]), [F.desc("created_at"), F.asc("id")], 40, 5).select("id", "route", "model")


@query("o13_weighted_draw")
def _(s, d):
    return C.weighted_pick(table(s, d, "orders").where("o_totalprice > 0"), F.col("o_totalprice"), ["o_orderpriority"], 20, 3, "o_orderkey").select("o_orderpriority", "o_orderkey", "rank")


@query("r18_donor_pick")
def _(s, d):
    rows = segments(s, d).where("duration >= 500 and genre is not null")
    return C.weighted_pick(rows, F.col("duration") - 500 + 0.1, ["episode"], 3, 5, "segment_id").select("episode", "segment_id", "rank")


@query("u1_gaps", "SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def _(s, d):
    return table(s, d, "customer").select("c_nationkey").subtract(table(s, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("u2_leak", "SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def _(s, d):
    return table(s, d, "labels").where("quality = 1").select("doc_id").intersect(table(s, d, "documents").where("doc_id % 3 = 0").select("doc_id"))


@query("u3_flags_union", "SELECT event_id, list_sort(list_distinct(list_concat([event_type, 'b'], ['a', CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'b' END]))) AS flags FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.array_sort(F.array_union(F.array("event_type", F.lit("b")), F.array(F.lit("a"), F.when(F.col("event_id") % 2 == 0, "click").otherwise("b")))).alias("flags"))


@query("u6_union", f"SELECT kind, count(*) AS n FROM (SELECT 'train' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'pseudo', item_id FROM benchmark) GROUP BY 1")
def _(s, d):
    a = table(s, d, "documents").select(F.lit("train").alias("kind"), F.col("doc_id").alias("id"))
    return a.unionByName(table(s, d, "benchmark").select(F.lit("pseudo").alias("kind"), F.col("item_id").alias("id"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("u7_union_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier")
def _(s, d):
    return table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct()


# --- vectors -----------------------------------------------------------------------------------------


@query("d6_cosine", "SELECT vec_id, list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) AS norm2 FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", V.dot(F.col("embedding"), F.col("embedding")).alias("norm2"))


@query("d15_voice_prints", "WITH u AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL)) = 0), m AS (SELECT label, i, CAST(sum(CAST(floor(embedding[i]::DOUBLE / n * 68719476736 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT)::DOUBLE / (68719476736 * count(*))::DOUBLE AS x FROM u WHERE n > 0 AND n < 'infinity'::DOUBLE GROUP BY 1, 2) SELECT label, list(x ORDER BY i) AS centroid FROM m GROUP BY 1")
def _(s, d):
    return V.mean_vectors(table(s, d, "embeddings"), "label", "embedding")


@query("d14_suggest")
def _(s, d):
    e = table(s, d, "embeddings")
    prints = V.mean_vectors(e.where("vec_id % 2 = 0"), "label", "embedding").select(F.lit(0).alias("group"), F.col("label").alias("voice"), F.col("centroid").alias("print"))
    return V.suggestions(e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("id"), F.lit(0).alias("group"), F.col("embedding").alias("vector")), prints, 0.1)


@query("j22_voices")
def _(s, d):
    e = table(s, d, "embeddings").select((F.col("vec_id") % 5).alias("show"), F.floor(F.col("vec_id") / 20).cast("long").alias("run"), F.col("vec_id").cast("string").alias("speaker"), "embedding")
    return V.link_voices(e, "show", "run", "speaker", "embedding")


@query("p25_kept_rows_window", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS c FROM documents) WHERE c <= 20000")
def _(s, d):
    return L.running_sum(table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", "c").where("c <= 20000").select("source", "doc_id")
