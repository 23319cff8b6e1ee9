"""Queries without SQL read whole texts and whole tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from oratorio.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    line = "one two three four five six seven eight nine ten"
    turns = ["\n".join([line] * 8 + ["alpha"]), "\n".join([line] * 8 + ["omega"])]
    spark.createDataFrame([(1, k, t) for k, t in enumerate(turns)], "conv_id long, turn long, text string").write.parquet(f"{d}/conversations.parquet")
    start = datetime.datetime(2024, 1, 1)
    events = [(i, i % 7, start + datetime.timedelta(seconds=400 * k), 20.0, "view") for k, i in enumerate([0, 1, 2, 2999, 3000, 3999, 4000, 9000])]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double, event_type string").write.parquet(f"{d}/events.parquet")
    return d


def test_whole_turns_are_aligned(spark, folder):
    run = lambda name: registry.queries()[name](spark, folder)
    s = run("c24_score_clip").first()
    assert (s.ref_words, s.errors) == (81, 1)
    for name in ("c1_align", "c14_error_rows"):
        rows = sorted(run(name).collect(), key=lambda r: r.pos)
        assert len(rows) == 81 and (rows[-1].kind, rows[-1].ref, rows[-1].hyp) == ("sub", ["alpha"], ["omega"])
    # ref and hyp, each with both in a row: all but the last word of each
    assert run("g34_disagreement").first().disagreement > 0
    assert run("c25_hazards").first().asr_disagreement == pytest.approx(1 / 81, abs=1e-4)


def test_whole_event_tables_are_read(spark, folder):
    run = lambda name: registry.queries()[name](spark, folder)
    assert run("j20_slots").agg(F.sum("systems")).first()[0] == 8
    assert run("d11_outvoted").count() == 6
    assert run("d12_slices").count() == 8
