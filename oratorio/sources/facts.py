"""The columnar fact table of error rows: its schema, files with metadata, and word counts."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import exists, get_text, listed, put_text, removed, renamed, staged

MINER_VERSION = "rows-1"
SETS = ("gold", "val", "fleurs", "slr54", "common_voice", "indicvoices", "nepali_cs")
KEYS = ("run", "set", "fold_version", "miner_version", "created_at")
_s, _a, _b, _d = T.StringType(), T.ArrayType(T.StringType()), T.BooleanType(), T.DoubleType()
SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in (
        ("run", _s), ("set", _s), ("clip_id", _s), ("group", _s), ("pos", T.IntegerType()), ("ref", _a), ("hyp", _a), ("kind", _s), ("identical", _b), ("forgiven", _s), ("ref_script", _s), ("hyp_script", _s),
        ("number", _b), ("ref_number", _b), ("similarity", _d), ("fold_rule", _s), ("variant", _s), ("ref_roman", _s), ("hyp_roman", _s), ("overlap_share", _d), ("overlap_bucket", _s), ("snr_db", _d), ("snr_bucket", _s), ("by", _s),
    )
])


class ContractError(ValueError):
    """A file that does not keep the schema or the metadata it must have."""


def conformed(df: DataFrame) -> DataFrame:
    """The contract's columns, cast, in order; a missing one is an error."""
    if missing := [f.name for f in SCHEMA if f.name not in df.columns]:
        raise ContractError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in SCHEMA])


def write(rows: DataFrame, folder: str, fold_version: str, created_at: str | None = None) -> str:
    """One run on one set as Parquet under folder/set=.../run=..., with its metadata beside it. No rows,
    more than one run or set, or an unknown set are errors, and then nothing is written."""
    spark, rows = rows.sparkSession, conformed(rows)
    found = rows.select("run", "set").distinct().limit(2).collect()
    if len(found) != 1 or found[0].set not in SETS:
        raise ContractError(f"rows must be of one run on one known set, not {[tuple(r) for r in found]}")
    run, name = found[0]
    path = f"{folder}/set={name}/run={run}"
    staged(rows.drop("run", "set").sortWithinPartitions("clip_id", "pos"), path, replace=True, compression="zstd")
    put_text(spark, f"{path}/_meta.json", json.dumps({"run": run, "set": name, "fold_version": fold_version, "miner_version": MINER_VERSION, "created_at": created_at or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}))
    return path


def metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """The metadata of a file, checked: all keys, this version, a known set, and the columns."""
    if not exists(spark, f"{path}/_meta.json"):
        raise ContractError(f"no metadata in {path}")
    meta = json.loads(get_text(spark, f"{path}/_meta.json"))
    if missing := [k for k in KEYS if not meta.get(k)]:
        raise ContractError(f"metadata without {missing}")
    if meta["miner_version"] != MINER_VERSION or meta["set"] not in SETS:
        raise ContractError(f"not readable: {meta['miner_version']}, {meta['set']}")
    have = set(spark.read.parquet(path).columns) | {"run", "set"}
    if gone := [f.name for f in SCHEMA if f.name not in have]:
        raise ContractError(f"columns missing: {gone}")
    return meta


def read(spark: SparkSession, path: str) -> DataFrame:
    meta = metadata(spark, path)
    return conformed(spark.read.parquet(path).withColumn("run", F.lit(meta["run"])).withColumn("set", F.lit(meta["set"])))


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """All runs on all sets; filters on set and run prune folders."""
    return spark.read.schema(SCHEMA).parquet(folder)


def list_files(spark: SparkSession, folder: str) -> tuple[list[str], dict[str, str]]:
    """Readable files in the order of sets, and what is wrong with the others."""
    good, bad = [], {}
    for name in sorted(listed(spark, folder), key=lambda n: SETS.index(n[4:]) if n[4:] in SETS else len(SETS)):
        for run in listed(spark, f"{folder}/{name}"):
            path = f"{folder}/{name}/{run}"
            try:
                metadata(spark, path)
                good.append(path)
            except ContractError as e:
                bad[path] = str(e)
    return good, bad


def find_file(spark: SparkSession, folder: str, name: str) -> str | None:
    runs = listed(spark, f"{folder}/set={name}")
    return f"{folder}/set={name}/{runs[0]}" if runs else None


def accept_uploads(spark: SparkSession, folder: str, uploads: list[str]) -> list[str]:
    """Moves files into a model's folder, all or none: one run in all of them, and a set once."""
    metas = [metadata(spark, u) for u in uploads]
    if len({m["run"] for m in metas}) > 1:
        raise ContractError("files of more than one run")
    if len({m["set"] for m in metas}) < len(metas):
        raise ContractError("a set twice")
    done: list[tuple[str, str]] = []
    try:
        for u, m in zip(uploads, metas, strict=True):
            target = f"{folder}/set={m['set']}/run={m['run']}"
            renamed(spark, u, target)
            done.append((u, target))
    except Exception:
        for u, target in done:
            renamed(spark, target, u)
        raise
    return [t for _, t in done]


def write_counts(counts: DataFrame, path: str, fold_version: str) -> None:
    """Word counts (word, n), most frequent first, each row with the version that made its key."""
    staged(counts.select("word", "n", F.lit(fold_version).alias("fold_version")).orderBy(F.desc("n"), "word"), path, replace=True)


def read_counts(spark: SparkSession, path: str, fold_version: str) -> DataFrame:
    df = spark.read.schema("word string, n long, fold_version string").parquet(path)
    if not df.where(F.col("fold_version") != fold_version).isEmpty():
        raise ContractError(f"counts of another version than {fold_version}")
    return df.select("word", "n")


def drop_staged(spark: SparkSession, folder: str) -> None:
    removed(spark, folder)
