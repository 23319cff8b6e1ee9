"""Line dedup on lines that repeat a great deal, against its SQL and against the clock."""

import random
import time

import pytest

from oratorio.llm import line_dedup
from tests.oracle import connect, rows_of, rows_of_sql

LONG = " ".join(f"w{i}" for i in range(50))


@pytest.mark.parametrize("seed", [1, 2])
def test_few_different_lines_as_sql(spark, tmp_path, seed):
    """Documents of few different lines, some of them long, blank or with white space: many diagonals."""
    r = random.Random(seed)
    lines = ["a", "b", " a ", "", "c d", LONG, f"{LONG} end", "x"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.choice([1, 3, 9, 40]))) for _ in range(40)] + ["\n".join(["a"] * 70), "\n".join(["a", "b"] * 40), "\n".join(["x", *["b"] * 50, "c d"]), None, "", "a"]
    # a copy with one line changed, and one that is cut off
    texts += [texts[3] + "\nq\n" + texts[3], texts[4][: len(texts[4]) // 2]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(line_dedup.op6_line_dedup(spark, str(tmp_path))) == rows_of_sql(connect(str(tmp_path)), line_dedup.OP6_SQL)


def test_equal_lines_take_near_linear_time(spark):
    n = 30000
    rows = [(1, "\n".join(["the same line"] * n)), (2, "\n".join(["head", *["x y", "z"] * (n // 2), "foot"])), (3, "\n".join(f"line {i}" for i in range(n))), (4, "\n".join(f"line {i}" for i in range(n)))]
    began = time.monotonic()
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1], got[2], len(got[3]), got[4]) == (["the same line"], ["head", "x y", "z", "foot"], n, [""])
    assert time.monotonic() - began < 60
