"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared
folder and read again as the next one's docs. All but the last return the columns of documents. A stage
that begins drops the intermediate tables of the one before, whose result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oratorio.llm.common import Tables, discard, table, written
from oratorio.llm.language_id import language_stage
from oratorio.llm.line_dedup import line_dedup_stage
from oratorio.llm.mixing import mixing_stage
from oratorio.llm.packing import packing_stage
from oratorio.llm.simhash import simhash_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The place of the stage that was called last, and the tables that it made.
_last: tuple[int, Tables] = (-1, Tables())


def _stage(place: int, function: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        before, tables = _last
        if before == place - 1:
            tables.drop()
        _last = place, Tables()
        with _last[1]:
            return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _stage(0, language_stage)),
    ("line_dedup", _stage(1, line_dedup_stage)),
    ("simhash_near_dedup", _stage(2, simhash_stage)),
    ("mix_sources", _stage(3, mixing_stage)),
    ("pack_sequences", _stage(4, packing_stage)),
]

#: No SQL: profiles, SimHash and the tokenizer are beyond it. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    earlier = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if earlier is not None:
            discard(earlier)
        earlier = docs
    return STAGES[-1][1](spark, docs, sf_dir)
