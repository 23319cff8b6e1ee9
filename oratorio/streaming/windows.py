"""Structured Streaming forms of windows, newest rows, sessions and idempotent imports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.choices import only_missing
from ..sources.files import exists


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sliding(events: DataFrame, ts: str, length: str, hop: str, by: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    """Aggregates over overlapping windows; rows later than `late` are dropped from streams."""
    kept = events.withWatermark(ts, late) if late else events
    return kept.groupBy(F.window(ts, length, hop), *by).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "*").drop("window")


def frame_means(scores: DataFrame, recording: str, start: str, values: str, frame: float, hop: float) -> DataFrame:
    """One value a frame: the mean of what all sliding windows that cover it say. values is an array of
    the window's frames, start its first second."""
    first = F.round(F.col(start) / frame).cast("long")
    return scores.select(recording, F.posexplode(values).alias("i", "x"), first.alias("first")).groupBy(recording, (F.col("first") + F.col("i")).alias("frame")).agg(F.avg("x").alias("value"))


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    kept = events.withWatermark(ts, late) if late else events
    return kept.groupBy(F.session_window(ts, gap), *by).agg(*aggs).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "*").drop("session_window")


def tumbling(events: DataFrame, ts: str, length: str, by: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    return sliding(events, ts, length, length, by, *aggs, late=late)


def newest(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A row for each change of a key's newest value: state holds one order and value a key. Rows that
    come late and are older than the state change nothing."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None)
        best = held
        for pdf in batches:
            for o, v in zip(pdf[order], pdf[value], strict=True):
                if best[0] is None or o > best[0]:
                    best = (o, v)
        if best != held:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], order: [best[0]], value: [best[1]]})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(update, schema, f"{order} {kinds[order]}, {value} {kinds[value]}", "update", GroupStateTimeout.NoTimeout)


def import_batches(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows whose key the target lacks, once each, so that a batch that is
    run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates([key])
        if exists(spark, target):
            fresh = only_missing(fresh, spark.read.parquet(target), [key])
        fresh.write.mode("append").parquet(target)

    return write


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table in memory: for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
