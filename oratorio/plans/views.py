"""The driver's tables in the roles that the operators work on, as frames and as SQL for the oracle.

Error rows come from lineitem and orders, segments from documents, append-only logs from events,
intervals from events, voices from embeddings. What the tables lack (nulls, scripts, numbers) is
derived from keys, so that both engines derive the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import overlap_bucket, snr_bucket
from ..operators.joins import dealt

HALF = "1998-05-24"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def error_rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    li = dealt(li, li.count(), "l_orderkey")  # a count reads no column
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    pair = F.concat("l_returnflag", "l_linestatus")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("RF", "sub", "RO", "ins", "AF", "del", "AO", "fold", "NF", "merge", "NO", "match")]), pair)
    mod = lambda c, n: F.col(c) % n
    scripts = F.array(*[F.lit(x) for x in ("dev", "lat", "mix")])
    key = F.col("l_orderkey")
    share = F.when(key % 7 != 0, (key % 23) / F.lit(100.0))
    db = F.when(key % 11 != 0, (key % 60).cast("double"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("l_shipdate") < F.lit(HALF).cast("timestamp"), "base").otherwise("run").alias("run"),
        key.alias("clip_id"), F.col("o_custkey").alias("group"), F.col("l_linenumber").alias("pos"), kind.alias("kind"),
        F.when(kind == "ins", 0).otherwise(F.col("l_quantity")).cast("long").alias("words"),
        (mod("l_partkey", 10) == 0).alias("number"), (mod("l_partkey", 20) == 0).alias("ref_number"), (mod("l_partkey", 3) == 1).alias("identical"),
        F.element_at(scripts, (mod("l_partkey", 3) + 1).cast("int")).alias("ref_script"), F.element_at(scripts, (mod("l_suppkey", 3) + 1).cast("int")).alias("hyp_script"),
        (F.col("l_tax") * 10).alias("similarity"), F.concat(F.lit("w"), mod("l_partkey", 50).cast("string")).alias("ref"), F.concat(F.lit("w"), mod("l_suppkey", 50).cast("string")).alias("hyp"),
        F.when(kind == "fold", F.concat(F.lit("rule"), mod("l_partkey", 5).cast("string"))).alias("fold_rule"), F.when((kind == "sub") & (mod("l_partkey", 4) == 0), F.concat(F.lit("tag"), mod("l_partkey", 3).cast("string"))).alias("variant"),
        share.alias("overlap_share"), overlap_bucket(share).alias("overlap_bucket"), db.alias("snr_db"), snr_bucket(db).alias("snr_bucket"),
    )


OVERLAP_SQL = "CASE WHEN {x} IS NULL THEN 'unmeasured' WHEN {x} <= 0 THEN 'none' WHEN {x} < 0.05 THEN '0-5%' WHEN {x} <= 0.15 THEN '5-15%' ELSE '>15%' END"
SNR_SQL = "CASE WHEN {x} IS NULL THEN 'unmeasured' WHEN {x} < 15 THEN '<15 dB' WHEN {x} < 25 THEN '15-25 dB' WHEN {x} < 35 THEN '25-35 dB' WHEN {x} < 45 THEN '35-45 dB' ELSE '45+ dB' END"
_SHARE = "CASE WHEN l_orderkey % 7 <> 0 THEN (l_orderkey % 23) / 100.0::DOUBLE END"
_DB = "CASE WHEN l_orderkey % 11 <> 0 THEN CAST(l_orderkey % 60 AS DOUBLE) END"

ERROR_ROWS = f"""
raw AS (
  SELECT *, CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'sub' WHEN 'RO' THEN 'ins' WHEN 'AF' THEN 'del' WHEN 'AO' THEN 'fold' WHEN 'NF' THEN 'merge' ELSE 'match' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), rows AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '{HALF}' THEN 'base' ELSE 'run' END AS run, l_orderkey AS clip_id, o_custkey AS "group", l_linenumber AS pos, kind,
    CAST(CASE WHEN kind = 'ins' THEN 0 ELSE l_quantity END AS BIGINT) AS words, l_partkey % 10 = 0 AS number, l_partkey % 20 = 0 AS ref_number, l_partkey % 3 = 1 AS identical,
    ['dev', 'lat', 'mix'][l_partkey % 3 + 1] AS ref_script, ['dev', 'lat', 'mix'][l_suppkey % 3 + 1] AS hyp_script, l_tax * 10 AS similarity,
    'w' || (l_partkey % 50) AS ref, 'w' || (l_suppkey % 50) AS hyp, CASE WHEN kind = 'fold' THEN 'rule' || (l_partkey % 5) END AS fold_rule,
    CASE WHEN kind = 'sub' AND l_partkey % 4 = 0 THEN 'tag' || (l_partkey % 3) END AS variant,
    {_SHARE} AS overlap_share, {OVERLAP_SQL.format(x=f"({_SHARE})")} AS overlap_bucket, {_DB} AS snr_db, {SNR_SQL.format(x=f"({_DB})")} AS snr_bucket
  FROM raw
)"""
CLIPS = (
    ERROR_ROWS
    + """, kinds AS (
  SELECT *, CASE WHEN kind NOT IN ('sub', 'del', 'ins') THEN NULL WHEN number THEN 'number' WHEN kind = 'del' THEN 'deletion' WHEN kind = 'ins' THEN 'insertion'
    WHEN ref_script = 'lat' AND hyp_script = 'lat' THEN 'english' WHEN ref_script = 'dev' AND hyp_script = 'dev' AND similarity >= 0.75 THEN 'nepali_similar'
    WHEN ref_script = 'dev' AND hyp_script = 'dev' THEN 'nepali_other' ELSE 'script' END AS error_kind FROM rows
), clips AS (
  SELECT clip_id, "group", max(overlap_bucket) AS bucket, max(snr_bucket) AS snr_bucket, CAST(sum(words) AS BIGINT) AS words,
    count(*) FILTER (kind = 'sub') AS sub, count(*) FILTER (kind = 'del') AS dele, count(*) FILTER (kind = 'ins') AS ins,
    count(*) FILTER (number AND kind = 'sub') AS number_sub, count(*) FILTER (number AND kind = 'del') AS number_del, count(*) FILTER (number AND kind = 'ins') AS number_ins,
    CAST(coalesce(sum(words) FILTER (number), 0) AS BIGINT) AS number_words, bool_or(ref_number) AS ref_number,
    """
    + ", ".join(f"count(*) FILTER (error_kind = '{k}') AS k_{k}" for k in ("number", "deletion", "insertion", "script", "english", "nepali_similar", "nepali_other"))
    + """
  FROM kinds GROUP BY clip_id, "group"
)"""
)


def segments(spark: SparkSession, d: str) -> DataFrame:
    """documents as segments of the episodes that its sources are."""
    doc = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    i = F.col("doc_id")
    return doc.select(
        i.alias("segment_id"), F.col("source").alias("episode"), F.when(i % 13 != 0, F.col("lang")).alias("genre"), F.col("n_chars").cast("double").alias("duration"),
        F.when(i % 5 == 0, "gold").otherwise("train").alias("pot"), F.when(F.length("source") % 2 == 0, "val").otherwise("train").alias("split"),
        F.element_at(F.array(*[F.lit(x) for x in ("imported", "queued", "labeled", "excluded")]), (i % 4 + 1).cast("int")).alias("pipeline_status"),
        F.when(i % 9 != 0, -(i % 100) / F.lit(100.0)).alias("logprob"), F.when(i % 7 != 0, (i % 23) / F.lit(100.0)).alias("overlap_share"),
    )


SEGMENTS = """
segments AS (
  SELECT doc_id AS segment_id, source AS episode, CASE WHEN doc_id % 13 <> 0 THEN lang END AS genre, CAST(n_chars AS DOUBLE) AS duration,
    CASE WHEN doc_id % 5 = 0 THEN 'gold' ELSE 'train' END AS pot, CASE WHEN length(source) % 2 = 0 THEN 'val' ELSE 'train' END AS split,
    ['imported', 'queued', 'labeled', 'excluded'][doc_id % 4 + 1] AS pipeline_status,
    CASE WHEN doc_id % 9 <> 0 THEN -(doc_id % 100) / 100.0::DOUBLE END AS logprob, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 23) / 100.0::DOUBLE END AS overlap_share
  FROM documents
)"""


def labels_log(spark: SparkSession, d: str) -> DataFrame:
    """events as an append-only log of labels: several a segment and version, times cut to hours so
    that ties occur."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("segment_id"), F.col("event_type").alias("version"), F.date_trunc("hour", "ts").alias("created_at"), "value",
        F.element_at(F.array(*[F.lit(x) for x in ("accepted_unchanged", "edited", "unusable_audio", "uncertain", "cleared")]), (F.col("event_id") % 5 + 1).cast("int")).alias("disposition"),
        F.when(F.col("event_id") % 3 == 0, "screened").otherwise("verified").alias("tier"), F.when(F.col("event_id") % 17 != 0, (F.col("value") * 1000).cast("long")).alias("duration_ms"),
    )


LABELS = """
labels_log AS (
  SELECT event_id AS id, user_id AS segment_id, event_type AS version, date_trunc('hour', ts) AS created_at, value,
    ['accepted_unchanged', 'edited', 'unusable_audio', 'uncertain', 'cleared'][event_id % 5 + 1] AS disposition,
    CASE WHEN event_id % 3 = 0 THEN 'screened' ELSE 'verified' END AS tier, CASE WHEN event_id % 17 <> 0 THEN CAST(trunc(value * 1000) AS BIGINT) END AS duration_ms
  FROM events
)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """events as turns: each user is a speaker, each hour of the table an episode's second scale."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    return e.select(F.col("event_id").alias("turn_id"), (F.col("user_id") % 10).alias("episode"), F.col("user_id").alias("speaker"), F.col("event_type").alias("kind"), start.alias("start"), (start + F.col("value")).alias("end"))


TURNS = """
turns AS (
  SELECT event_id AS turn_id, user_id % 10 AS episode, user_id AS speaker, event_type AS kind, epoch_us(ts) / 1000000.0::DOUBLE AS start, epoch_us(ts) / 1000000.0::DOUBLE + value AS "end" FROM events
)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """events as logged requests, with route, model, tokens, cost, latency and status; some null."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))
    return e.select(
        i.alias("id"), pick("asr_scribe", "topic", "vertex_asr", "mai_transcribe", "fusion").alias("route"), pick("scribe_v2", "gemini-flash", "gemini-transcribe", "org/mai-transcribe", "local", "x-transcribe", "plain").alias("model"),
        pick("succeeded", "succeeded", "failed", "dry_run").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), (i % 50).alias("completion_tokens"),
        F.when(i % 6 != 0, F.round(F.col("value") / 1000, 6)).alias("cost"), F.when(i % 8 != 0, F.col("value")).alias("latency_ms"), F.col("value").alias("seconds"), F.col("ts").alias("created_at"), "event_type",
    )


def _pick(names: str) -> str:
    n = names.split()
    return "[" + ", ".join(f"'{x}'" for x in n) + f"][event_id % {len(n)} + 1]"


REQUESTS = f"""
requests AS (
  SELECT event_id AS id, {_pick("asr_scribe topic vertex_asr mai_transcribe fusion")} AS route, {_pick("scribe_v2 gemini-flash gemini-transcribe org/mai-transcribe local x-transcribe plain")} AS model,
    {_pick("succeeded succeeded failed dry_run")} AS status, CAST(props ->> '$.k' AS BIGINT) AS prompt_tokens, event_id % 50 AS completion_tokens,
    CASE WHEN event_id % 6 <> 0 THEN round(value / 1000, 6) END AS cost, CASE WHEN event_id % 8 <> 0 THEN value END AS latency_ms, value AS seconds, ts AS created_at, event_type FROM events
)"""
VENDOR_SQL = """CASE WHEN route LIKE '%elevenlabs%' OR model LIKE '%elevenlabs%' OR replace(model, 'transcribe', '') LIKE '%scribe%' OR route LIKE 'asr_scribe%' OR route LIKE 'scribe%' THEN 'ElevenLabs'
 WHEN route LIKE '%vertex%' OR route LIKE '%gemini%' OR model LIKE '%gemini%' THEN 'Google Cloud Vertex AI' WHEN route LIKE '%mai%' OR route LIKE '%openrouter%' OR model LIKE '%/%' THEN 'OpenRouter' ELSE 'Unknown Vendor' END"""
