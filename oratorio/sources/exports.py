"""Datasets written out: training, gold, analytics and error mining, with a manifest of what is in them."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import effective_split
from ..operators.joins import interval_join
from .files import put_text, removed, staged
from .manifests import ManifestError, refuse


@dataclass(frozen=True)
class ExportKind:
    splits: tuple[str, ...]
    dispositions: tuple[str, ...]
    hypotheses: bool = False


KINDS = {
    "training": ExportKind(("train", "val"), ("accepted_unchanged", "edited")),
    "gold": ExportKind(("test",), ("accepted_unchanged", "edited")),
    "analytics": ExportKind(("train", "val", "test"), ("accepted_unchanged", "edited", "uncertain"), True),
    "error_mining": ExportKind(("train", "val", "test"), ("accepted_unchanged", "edited"), True),
}


def dataset(kind: str, segments: DataFrame, labels: DataFrame, hypotheses: DataFrame | None = None) -> DataFrame:
    """The rows of an export: segments with their current label, by split and disposition, with nested
    hypotheses where the kind has them; rows of train that share audio with gold are left out."""
    k = KINDS[kind]
    rows = segments.withColumn("split", effective_split(F.col("pot"), F.col("split"))).join(labels, "segment_id").where(F.col("split").isin(*k.splits) & F.col("disposition").isin(*k.dispositions))
    if kind == "training" and {"start_time", "end_time"} <= set(segments.columns):
        gold = segments.where("pot = 'gold'").select("episode", F.col("start_time").alias("gold_start"), F.col("end_time").alias("gold_end"))
        rows = interval_join(rows, gold, ["episode"], ("start_time", "end_time"), ("gold_start", "gold_end"), 60.0, "left_anti")
    if k.hypotheses and hypotheses is not None:
        nested = hypotheses.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("system_id", "text"))).alias("hypotheses"))
        rows = rows.join(nested, "segment_id", "left")
    return rows


def export(rows: DataFrame, path: str, order: str = "segment_id") -> dict:
    """Writes rows as JSON lines sorted by id over as many files as there are ranges, and a manifest:
    counts by split, tiers by split, and a digest of the lines that does not depend on the files."""
    staged(rows.repartitionByRange(order).sortWithinPartitions(order), path, "json", compression="none")
    by_split = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    tiers = {f"{r.split}/{r.tier}": r["count"] for r in rows.groupBy("split", "tier").count().collect()} if "tier" in rows.columns else {}
    line = F.to_json(F.struct(*sorted(rows.columns)))
    digest = rows.agg(F.bit_xor(F.xxhash64(line)).alias("x"), F.count("*").alias("n")).first()
    manifest = {"rows": digest.n, "by_split": by_split, "tiers": tiers, "digest": f"{(digest.x or 0) & (1 << 64) - 1:016x}"}
    put_text(rows.sparkSession, f"{path}/_manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def load_splits(rows: DataFrame) -> dict[str, DataFrame]:
    """Frames by split; a clip in train that is also held out is an error."""
    train, held = rows.where("split = 'train'"), rows.where("split <> 'train'")
    refuse(train.select("segment_id").intersect(held.select("segment_id")), "held-out clips in train")
    return {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}


def purge_system(hypotheses: DataFrame, system: str, dump: str, target: str) -> DataFrame:
    """Writes a system's hypotheses to a dump, and the others to target; returns the others."""
    gone = hypotheses.where(F.col("system_id") == system)
    if gone.isEmpty():
        raise ManifestError(f"no hypotheses of {system}")
    staged(gone, dump, "json")
    staged(hypotheses.where(F.col("system_id") != system), target)
    return hypotheses.sparkSession.read.parquet(target)


def attach(rows: DataFrame, other: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    return rows.join(other.select(on, *columns), on, "left")


def render_text(title: str, rows: list[dict]) -> str:
    names = list(rows[0]) if rows else []
    cells = [names, *[[f"{r[n]:.4g}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join([title, *["  ".join(x.ljust(w) for x, w in zip(c, widths, strict=True)).rstrip() for c in cells]]) + "\n"


def render_html(title: str, rows: list[dict]) -> str:
    esc = lambda x: html.escape("" if x is None else str(x))
    head = "".join(f"<th>{esc(n)}</th>" for n in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<h1>{esc(title)}</h1><table><tr>{head}</tr>{body}</table>"


def discard(spark: SparkSession, path: str) -> None:
    removed(spark, path)
