"""JSON inputs with declared schemas: episodes, segments, transcripts, model cards, diarization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "array<array<double>>"
SPEAKER = "struct<role:string,gender:string,age_bracket:string>"
EPISODE = f"episode_id string, show_id string, title string, source_uri string, published_at date, duration_seconds double, topic string, speaker_count int, speakers map<string,{SPEAKER}>"
WORD = "struct<word:string,start:double,end:double,confidence:double,predicted_language:string,predicted_script:string,speaker:string>"
HYPOTHESIS = f"struct<system_id:string,model_id:string,text:string,avg_logprob:double,no_speech_prob:double,words:array<{WORD}>>"
SCORES = "struct<cer_between_hypotheses:double,word_disagreement_rate:double,script_conflict_rate:double,code_switch_density:double>"
SEGMENT = f"segment_id string, episode_id string, start_time double, end_time double, clip_path string, clip_checksum string, speaker_id string, p_en double, lid string, flags array<string>, vad_spans {SPAN}, overlap_spans {SPAN}, acoustics struct<version:string,bandwidth_hz:double,snr_db:double,c50_db:double>, scores {SCORES}, hypotheses array<{HYPOTHESIS}>"
TRANSCRIPT = "segment_id string, text string, compute_s double"


class ManifestError(ValueError):
    """Input that may not be imported."""


def refuse(bad: DataFrame, what: str) -> None:
    """An error that shows the first few rows of bad, if it has any."""
    if found := bad.limit(5).collect():
        raise ManifestError(f"{what}: {[tuple(r) for r in found]}")


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", whole).json(path)


def repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").select(*key)


def read_manifest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(episode, segments) of an export: required fields, known ranges, no id twice, no foreign episode."""
    episode = read_json(spark, f"{root}/episode.json", EPISODE, True)
    segments = read_json(spark, f"{root}/segments.jsonl", SEGMENT)
    refuse(episode.where("episode_id is null or duration_seconds < 0 or speaker_count not between 1 and 8").select("episode_id"), "bad episode")
    refuse(segments.where("segment_id is null or episode_id is null or start_time is null or end_time is null or clip_path is null or coalesce(size(hypotheses), 0) < 1 or p_en not between 0 and 1").select("segment_id"), "bad segments")
    refuse(repeated(segments, "segment_id"), "segments twice")
    refuse(segments.join(episode, "episode_id", "left_anti").select("segment_id"), "segments of another episode")
    return episode, segments


def hypotheses(segments: DataFrame) -> DataFrame:
    return segments.select("segment_id", F.explode("hypotheses").alias("h")).select("segment_id", "h.*")


def hypothesis_words(segments: DataFrame) -> DataFrame:
    return hypotheses(segments).select("segment_id", "system_id", F.posexplode("words").alias("position", "w")).select("segment_id", "system_id", "position", "w.*")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines {segment_id, text, compute_s}; ids twice, or none at all, are errors."""
    df = read_json(spark, path, TRANSCRIPT)
    refuse(df.where("segment_id is null or text is null").select("segment_id"), "lines without id or text")
    refuse(repeated(df, "segment_id"), "segments twice")
    if df.isEmpty():
        raise ManifestError(f"no lines in {path}")
    return df


def read_cards(spark: SparkSession, root: str) -> DataFrame:
    """The model cards of all folders under root that hold one, in order of folder."""
    cards = spark.read.schema("name string, family string, parameters long, notes string").option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "card.json").json(root)
    return cards.withColumn("folder", F.regexp_extract(F.input_file_name(), "([^/]+)/card\\.json$", 1)).orderBy("folder")


def read_diarization(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, speakers) of {episode: {turns, labels, embeddings}}: turns rounded to milliseconds,
    speakers by talk, embeddings finite."""
    kind = "map<string,struct<turns:array<struct<start:double,end:double,speaker:string>>,labels:array<string>,embeddings:array<array<double>>>>"
    raw = spark.read.text(path, wholetext=True)
    # turns are written as arrays [start, end, speaker]: named before they are parsed
    named = F.regexp_replace("value", r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)\s*,\s*\"([^\"]*)\"\s*\]", '{"start":$1,"end":$2,"speaker":"$3"}')
    runs = raw.select(F.explode(F.from_json(named, kind, {"mode": "FAILFAST"})).alias("episode", "r"))
    turns = runs.select("episode", F.explode("r.turns").alias("t")).select("episode", F.bround("t.start", 3).alias("start"), F.bround("t.end", 3).alias("end"), "t.speaker").where("end > start")
    talk = turns.groupBy("episode", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("talk"))
    vectors = runs.select("episode", F.explode(F.arrays_zip(F.col("r.labels").alias("speaker"), F.col("r.embeddings").alias("embedding"))).alias("v")).select("episode", "v.*")
    finite = vectors.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return turns, talk.join(finite, ["episode", "speaker"], "left")


def read_tabbed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)


def imported(known: DataFrame, incoming: DataFrame, key: str = "segment_id", checksum: str = "clip_checksum") -> DataFrame:
    """The rows that are new; a known key with another checksum is an error, with the same one nothing."""
    from ..operators.choices import import_plan, only_missing

    refuse(import_plan(incoming, known, key, checksum).where("action = 'changed'").select(key), "changed checksums")
    return only_missing(incoming, known, [key])
