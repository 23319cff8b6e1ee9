"""Files through Spark's file systems: listing, small texts, atomic renames, a keyed result cache."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; hidden ones and those of unfinished writes are left out."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n[0] not in "._")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def renamed(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """Moves a finished folder into place; an existing target is an error unless it is replaced."""
    fs, s = _fs(spark, source)
    t = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(t):
        if not replace:
            raise FileExistsError(target)
        fs.delete(t, True)
    fs.mkdirs(t.getParent())
    if not fs.rename(s, t):
        raise OSError(f"cannot move {source} to {target}")


def removed(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def staged(df: DataFrame, target: str, fmt: str = "parquet", replace: bool = False, **options: str) -> None:
    """Writes beside the target and renames, so that readers see all of it or nothing."""
    spark, stage = df.sparkSession, f"{target.rsplit('/', 1)[0]}/_stage-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).options(**options).save(stage)
        renamed(spark, stage, target, replace)
    finally:
        if exists(spark, stage):
            removed(spark, stage)


def request_key(**parts: object) -> str:
    """A key that follows from the content of a request, whatever the order of its parts."""
    import hashlib

    return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under a key; made and written first where there is none."""
    path = f"{folder}/{key[:2]}/{key}"
    if not exists(spark, path):
        staged(make(), path)
    return spark.read.parquet(path)


def with_file_name(df: DataFrame, name: str = "file") -> DataFrame:
    return df.withColumn(name, F.input_file_name())
