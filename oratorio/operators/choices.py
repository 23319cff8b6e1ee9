"""Seeds, candidates, audits, plans of imports, and decision rules over ranked rows."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seed_hypothesis(hyps: DataFrame) -> DataFrame:
    """(segment, hypothesis): the newest fused one, else the recogniser's with the greatest mean
    log-probability, null lowest; ties go to the greatest id."""
    rank = F.struct((F.col("kind") == "fusion").cast("int").alias("f"), F.when(F.col("kind") == "fusion", F.col("system_id").cast("double")).otherwise(F.coalesce("logprob", F.lit(float("-inf")))).alias("p"), F.col("id").alias("id"))
    return hyps.groupBy("segment_id").agg(F.max_by("id", rank).alias("hypothesis_id"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate of each clip with the fewest errors, of equal ones the first by rank; with the
    errors of the first candidate, so that the headroom is their difference."""
    return candidates.groupBy("clip_id").agg(F.min(F.struct("errors", "rank")).alias("b"), F.min_by("errors", "rank").alias("first_errors")).select("clip_id", F.col("b.rank").alias("oracle_rank"), F.col("b.errors").alias("oracle_errors"), "first_errors")


def spread(deltas: DataFrame, top: int) -> DataFrame:
    """Groups better, equal and worse by their change, and the share of the gain in the top few."""
    gain = deltas.where("change < 0").select((-F.col("change")).alias("gain"))
    best = gain.orderBy(F.desc("gain")).limit(top).agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("top_gain"))
    whole = deltas.agg(F.count_if(F.col("change") < 0).alias("improved"), F.count_if(F.col("change") == 0).alias("unchanged"), F.count_if(F.col("change") > 0).alias("worse"), F.coalesce(F.sum(F.when(F.col("change") < 0, -F.col("change"))), F.lit(0)).alias("gain"))
    return whole.crossJoin(best).select("improved", "unchanged", "worse", F.coalesce(F.try_divide(F.col("top_gain") * 1.0, F.nullif("gain", F.lit(0))), F.lit(0.0)).alias("top_share"))


def audit_sample(scores: Sequence[tuple[int, float]], rate: float, seed: int) -> set[int]:
    """A sample, fixed by the seed, of the lower half by (score, id)."""
    if rate <= 0 or not scores:
        return set()
    ranked = [i for i, _ in sorted(scores, key=lambda s: (s[1], s[0]))]
    pool = ranked[: max(1, len(ranked) // 2)]
    return set(random.Random(seed).sample(pool, min(len(pool), max(1, round(len(scores) * rate)))))


def draw_bound(share: float) -> str:
    """The hex digits under which the first eight of an MD5 lie with this probability."""
    return f"{min((1 << 32) - 1, int(share * (1 << 32))):08x}"


def audit_rows(rows: DataFrame, key: str, score: str, rate: float, seed: int) -> DataFrame:
    """rows of the lower half by score, each drawn by a hash of its key with probability 2 * rate, so that
    about `rate` of all rows are drawn and reruns agree; nothing is ranked or brought to the driver."""
    cut = rows.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{score}`)").alias("__cut"))
    drawn = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8) < draw_bound(2 * rate)
    return rows.where(drawn).crossJoin(F.broadcast(cut)).where(F.col(score) <= F.col("__cut")).drop("__cut")


def audit_exact(rows: DataFrame, key: str, score: str, rate: float, seed: int, buckets: int = 4096) -> DataFrame:
    """rows of an exact number: max(1, round(rate * n)) of the half with the least scores (ties by key), or
    all of that half if it has fewer; those with the least hashes of key and seed, so that reruns agree.

    Both cuts are places in an order. Each is found by counting rows in buckets of the order, then ranking
    only the bucket in which the place lies, so that no task holds all rows. Rows without a score take no
    part; no rows give none.
    """
    own = rows.where(F.col(score).isNotNull())
    size = own.agg(F.count("*").alias("n"), F.min(score).alias("least"), F.max(score).alias("most"))
    spread = F.col("most") - F.col("least")
    by_score = F.when(spread > 0, F.floor((F.col(score) - F.col("least")) / spread * (buckets - 1))).otherwise(F.lit(0)).cast("int")
    at = own.crossJoin(F.broadcast(size)).withColumn("__bucket", by_score)
    half = _first(at, F.greatest(F.lit(1), F.floor(F.col("n") / 2)), [F.col(score), F.col(key)])
    wanted = F.greatest(F.lit(1), F.bround(F.col("n") * rate)).cast("long")
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    by_hash = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    drawn = _first(half.withColumn("__bucket", by_hash), wanted, [digest, F.col(key)])
    return drawn.select(*rows.columns)


def _first(rows: DataFrame, wanted: Column, order: list[Column]) -> DataFrame:
    """The first `wanted` rows by __bucket and then order: whole buckets, and a part of one that is ranked."""
    whole = Window.partitionBy(F.lit(0)).orderBy("__bucket")
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__size"), F.max(wanted).alias("__wanted"))
    starts = sizes.withColumn("__start", F.sum("__size").over(whole) - F.col("__size")).where(F.col("__start") < F.col("__wanted"))
    at = rows.join(F.broadcast(starts), "__bucket")
    inside = at.where(F.col("__start") + F.col("__size") <= F.col("__wanted"))
    edge = at.where(F.col("__start") + F.col("__size") > F.col("__wanted"))
    edge = edge.withColumn("__k", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))).where(F.col("__start") + F.col("__k") <= F.col("__wanted")).drop("__k")
    return inside.unionByName(edge).drop("__bucket", "__size", "__wanted", "__start")


def hash_unit(key: str, seed: int) -> float:
    """A number in [0, 1) that follows from key and seed on every machine."""
    return int.from_bytes(hashlib.blake2b(f"{key}:{seed}".encode(), digest_size=8).digest(), "big") / 2**64


def draw_split(rows: DataFrame, key: str, val_fraction: float, seed: int) -> DataFrame:
    @F.pandas_udf("double")
    def unit(s: pd.Series) -> pd.Series:
        return s.map(lambda k: hash_unit(str(k), seed))

    return rows.withColumn("unit", unit(F.col(key).cast("string"))).withColumn("drawn", F.when(F.col("unit") < val_fraction, "val").otherwise("train"))


def draw_val(episodes: DataFrame, share: float, seed: int, long_hours: float) -> DataFrame:
    """Episodes (external_id, hours, show_id) that make up val: per stratum of length, in hash order,
    while val is under its share; episodes over half of it or beyond 125 % of it are passed over, and
    of long ones one a show. The fill is sequential, over a stratum's list of episodes that are small
    enough, of which the rest is left in Spark."""
    pool = episodes.where("hours > 0").withColumn("long_form", F.col("hours") >= long_hours)
    goals = pool.groupBy("long_form").agg((F.sum("hours") * share).alias("goal"))
    fitting = pool.join(F.broadcast(goals), "long_form").where(F.col("hours") <= F.col("goal") / 2)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        goal = float(pdf["goal"].iloc[0])
        order = sorted(range(len(pdf)), key=lambda k: (hash_unit(pdf["external_id"].iloc[k], seed), pdf["external_id"].iloc[k]))
        hours, shows = pdf["hours"].to_numpy(float), pdf["show_id"].where(pdf["long_form"] & pdf["show_id"].notna(), None).tolist()
        held, seen, rows = 0.0, {None}, []
        for k in order:
            fresh = shows[k] is None or shows[k] not in seen
            if held < goal and fresh and held + hours[k] <= 1.25 * goal:
                held += hours[k]
                seen.add(shows[k])
                rows.append(k)
        return pdf.iloc[rows][["external_id", "hours"]]

    return fitting.groupBy("long_form").applyInPandas(fill, "external_id string, hours double")


def import_plan(incoming: DataFrame, known: DataFrame, key: str, checksum: str) -> DataFrame:
    """What an import would do to each key: new, same, changed (an error) or kept (not in the input)."""
    a, b = incoming.select(key, F.col(checksum).alias("new")), known.select(key, F.col(checksum).alias("old"))
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "kept").when(F.col("new") == F.col("old"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, action.alias("action"))


def only_missing(incoming: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return incoming.join(known.select(*on), on, "left_anti")


def upserted(known: DataFrame, incoming: DataFrame, on: list[str]) -> DataFrame:
    """The known rows, replaced where the input has their key, and the new ones."""
    return known.join(incoming.select(*on), on, "left_anti").unionByName(incoming)


def complete_groups(rows: DataFrame, key: str, part: str, parts: int) -> DataFrame:
    """Rows of the keys that have all parts: a clip that lacks one recogniser's answer goes whole."""
    whole = rows.groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") == parts).select(key)
    return rows.join(whole, key, "left_semi")


def weighted_pick(rows: DataFrame, weight: Column, keys: list[str], k: int, seed: int, on: str) -> DataFrame:
    """k rows of each key, drawn by weight without replacement: exponential keys from a hash of `on`."""
    from .latest import top_per_group

    u = (F.shiftrightunsigned(F.xxhash64(F.col(on).cast("string"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return top_per_group(rows.withColumn("draw", -F.log(u) / weight), keys, k, F.asc("draw"), F.asc(on))
