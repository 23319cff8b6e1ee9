"""What the operators of this subpackage share: reading tables and writing intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts have it: space and the six controls from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which executors and driver share. Where
    it is unset, as in a local session, it is set to a folder in the warehouse, which they share too."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again.

    Tasks that are run again after an executor is lost then read files instead of recomputing what
    came before, and see the same rows.
    """
    path = f"{shared_dir(df.sparkSession)}/oratorio-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if not _kept:
        atexit.register(_clean)
    _kept.append(out)
    return out


#: What this process has written and not yet discarded; deleted when it ends, as no result outlives it.
_kept: list[DataFrame] = []


def _clean() -> None:
    for df in _kept:
        with contextlib.suppress(Exception):  # the session may be gone by then
            _delete(df)


def _delete(df: DataFrame) -> None:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again: what came of them is itself written."""
    for df in tables:
        _delete(df)
        _kept[:] = [k for k in _kept if k is not df]


class Tables:
    """Collects what written() makes while it is entered, so that it can be discarded together later."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __enter__(self) -> Tables:
        self._before = list(_kept)
        return self

    def __exit__(self, *_: object) -> None:
        self.made += [k for k in _kept if not any(k is b for b in self._before)]

    def drop(self) -> None:
        discard(*[k for k in self.made if any(k is x for x in _kept)])
        self.made = []


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop the shuffle files of finished jobs, which else stay until the
    driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def numbered(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs with a number for each row, written, so that every later reading sees the same numbers. Its
    other columns are c0, c1, ..., so that no name of docs can clash with one of ours."""
    return written(docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.monotonically_increasing_id().alias(name)), "numbered")


def named_as(rows: DataFrame, docs: DataFrame) -> list[Column]:
    """The columns of numbered(docs) under the names that they have in docs."""
    return [rows[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)]


def column_of(docs: DataFrame, name: str) -> str:
    """The name that a column of docs has in numbered(docs)."""
    return f"c{docs.columns.index(name)}"


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact name: extra columns, whatever they are called, stay outside."""
    return df.select(*[df[f"`{n}`"].alias(n) for n in names])


def lower_hex(value: Column, digits: int = 16) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))
