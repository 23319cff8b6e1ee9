"""Files, manifests, exports and streams, round trip and refusals."""

import json

import pytest
from pyspark.sql import functions as F

from oratorio.operators import texts as T
from oratorio.sources import exports, facts, files, manifests
from oratorio.streaming import windows as S


def fact_rows(spark, run="r1", name="gold"):
    clips = spark.createDataFrame([("c1", "g", "a b c", "a x c"), ("c2", "g", "d", "")], "clip_id string, group string, ref string, hyp string")
    more = {"run": F.lit(run), "set": F.lit(name), "overlap_share": F.lit(None).cast("double"), "overlap_bucket": F.lit("unmeasured"), "snr_db": F.lit(None).cast("double"), "snr_bucket": F.lit("unmeasured"), "by": F.lit(None).cast("string")}
    return T.error_rows(clips).withColumns(more)


def test_fact_files(spark, tmp_path):
    folder = str(tmp_path / "facts")
    path = facts.write(fact_rows(spark), folder, "fold-1")
    assert facts.metadata(spark, path)["run"] == "r1" and [(f.name, f.dataType) for f in facts.read(spark, path).schema] == [(f.name, f.dataType) for f in facts.SCHEMA]
    assert facts.read(spark, path).count() == 4 and facts.list_files(spark, folder) == ([path], {})
    assert facts.find_file(spark, folder, "gold") == path and facts.find_file(spark, folder, "val") is None
    with pytest.raises(facts.ContractError):
        facts.write(fact_rows(spark).limit(0), folder, "fold-1")
    with pytest.raises(facts.ContractError):
        facts.write(fact_rows(spark, name="other"), folder, "fold-1")
    moved = facts.accept_uploads(spark, str(tmp_path / "model"), [path])
    assert facts.read_all(spark, str(tmp_path / "model")).where("set = 'gold'").count() == 4 and not files.exists(spark, path)
    with pytest.raises(facts.ContractError):
        facts.accept_uploads(spark, str(tmp_path / "m2"), moved * 2)


def test_counts_refuse_another_version(spark, tmp_path):
    path = str(tmp_path / "counts")
    facts.write_counts(spark.createDataFrame([("a", 2), ("b", 5)], "word string, n long"), path, "v1")
    assert facts.read_counts(spark, path, "v1").count() == 2
    with pytest.raises(facts.ContractError):
        facts.read_counts(spark, path, "v2")


def manifest(root, ids=("s1", "s2"), episode="e1"):
    root.mkdir(exist_ok=True)
    (root / "episode.json").write_text(json.dumps({"episode_id": "e1", "duration_seconds": 10, "speakers": {"a": {"role": "host", "gender": "male", "name": "x"}}}))
    lines = [{"segment_id": i, "episode_id": episode, "start_time": 0, "end_time": 2, "clip_path": "p", "clip_checksum": "k", "hypotheses": [{"system_id": "z", "text": "hi there", "words": [{"word": "hi", "start": 0, "end": 1}]}]} for i in ids]
    (root / "segments.jsonl").write_text("\n".join(map(json.dumps, lines)))
    return str(root)


def test_manifest(spark, tmp_path):
    episode, segments = manifests.read_manifest(spark, manifest(tmp_path / "a"))
    assert episode.first().speakers["a"].role == "host" and segments.count() == 2
    assert manifests.hypothesis_words(segments).first().word == "hi"
    with pytest.raises(manifests.ManifestError):
        manifests.read_manifest(spark, manifest(tmp_path / "b", ("s1", "s1")))
    with pytest.raises(manifests.ManifestError):
        manifests.read_manifest(spark, manifest(tmp_path / "c", episode="e2"))
    assert manifests.imported(segments, segments).isEmpty()
    with pytest.raises(manifests.ManifestError):
        manifests.imported(segments, segments.withColumn("clip_checksum", F.lit("other")))


def test_diarization(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"e1": {"turns": [[0, 1.23456, "A"], [1, 3, "B"], [2, 2, "A"]], "labels": ["A", "B"], "embeddings": [[1, 0], [0, 1]]}}))
    turns, speakers = manifests.read_diarization(spark, str(p))
    assert sorted((r.start, r.end, r.speaker) for r in turns.collect()) == [(0, 1.235, "A"), (1, 3, "B")]
    assert {r.speaker: list(r.embedding) for r in speakers.collect()} == {"A": [1, 0], "B": [0, 1]}


def test_export(spark, tmp_path):
    seg = spark.createDataFrame([("s1", "e", "gold", "train", 0.0, 5.0), ("s2", "e", "train", "train", 4.0, 9.0), ("s3", "e", "train", "val", 5.0, 9.0)], "segment_id string, episode string, pot string, split string, start_time double, end_time double")
    lab = spark.createDataFrame([(f"s{i}", "edited", "verified") for i in (1, 2, 3)], "segment_id string, disposition string, tier string")
    rows = exports.dataset("training", seg, lab)
    assert [r.segment_id for r in rows.collect()] == ["s3"]
    m = [exports.export(exports.dataset("analytics", seg, lab).repartition(n), str(tmp_path / f"x{n}")) for n in (1, 5)]
    assert m[0] == m[1] and m[0]["by_split"] == {"test": 1, "train": 1, "val": 1}
    assert "&lt;b&gt;" in exports.render_html("t", [{"a": "<b>"}]) and "a" in exports.render_text("t", [{"a": 1.5}])
    with pytest.raises(manifests.ManifestError):
        exports.load_splits(rows.withColumn("split", F.lit("train")).unionByName(rows.withColumn("split", F.lit("test"))))


def test_cache_and_key(spark, tmp_path):
    assert files.request_key(a=1, b="x") == files.request_key(b="x", a=1)
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), "abcd", make).count() == 3
    assert len(made) == 1


def test_streams(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    e.orderBy("event_id").repartitionByRange(4, "event_id").write.parquet(src)
    stream = S.stream(spark, src, e.schema, 2)
    got = S.drained(S.tumbling(stream, "ts", "1 day", ["event_type"], F.count("*").alias("n")), "daily", str(tmp_path / "c1"), "complete")
    want = S.tumbling(e, "ts", "1 day", ["event_type"], F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    last = S.drained(S.newest(stream, "user_id", "event_id", "event_type"), "newest", str(tmp_path / "c2"), "update")
    assert {r.user_id: r.m for r in last.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()} == {r.user_id: r.m for r in e.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    target, write = str(tmp_path / "out"), S.import_batches(str(tmp_path / "out"), "event_id")
    for _ in range(2):
        write(e.where("event_id < 50"), 0)
    assert spark.read.parquet(target).count() == 50
