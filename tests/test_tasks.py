"""What one task of a large shuffle holds does not grow with the table."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from oratorio.operators import joins as J
from oratorio.operators import lanes as L


def test_more_rows_are_more_tasks(spark, sf, monkeypatch):
    run = lambda q: sorted(map(str, entry.queries()[q](spark, sf).collect()))
    before = run("j5_pair_three_way")
    monkeypatch.setattr(J, "TASK_ROWS", 100)
    rows = J.dealt(spark.range(2000), 2000, "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 20 and max(r["count"] for r in rows) < 200
    assert run("j5_pair_three_way") == before


def test_words_of_lanes_are_not_sorted(spark):
    words = spark.createDataFrame([("a", 0, "x", 0.0, 1.0, 1, None, "label")], "clip string, pos int, word string, start double, end double, speaker int, suggested int, source string")
    clips = spark.createDataFrame([("a", 2.0, [1]), ("b", 2.0, [1])], "clip string, seconds double, speakers array<int>")
    found = L.lane_problems(words, clips)
    assert [tuple(r) for r in found.collect()] == [("b", None, "no words")]
    plan = found._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan.split("== Physical Plan ==")[1]
