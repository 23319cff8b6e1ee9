"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the ranked list of a language's most frequent n-grams. A document's own most frequent
n-grams are ranked the same way, and its language is that of the profile from which the ranks are least
out of place. N-grams have one to four bytes of the normalised text: runs of letters, lower-cased,
with one space on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, table, written

UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
ORDERS = 4
STEP = 1 << 20
BROADCAST_ROWS = 500_000


def normalised(text: str | None) -> bytes:
    words = LETTERS.findall((text or "").lower())
    return f" {' '.join(words)} ".encode() if words else b""


def ngrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the bytes, as codes of length and content, and their counts.

    Long texts are counted in steps, so that memory follows the number of distinct n-grams.
    """
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for n in range(1, ORDERS + 1):
        part: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, max(0, len(b) - n + 1), STEP):
            piece = b[at : at + STEP + n - 1]
            code = np.zeros(max(0, len(piece) - n + 1), np.uint64)
            for i in range(n):
                code = (code << np.uint64(8)) | piece[i : len(piece) - n + 1 + i]
            part.append(np.unique(code if n == ORDERS else code.astype(np.uint32), return_counts=True))
        if not part:
            continue
        if len(part) > 1:
            all_codes, where = np.unique(np.concatenate([c for c, _ in part]), return_inverse=True)
            part = [(all_codes, np.bincount(where, np.concatenate([k for _, k in part])).astype(np.int64))]
        codes.append(part[0][0].astype(np.uint64) | np.uint64(n << 32))
        counts.append(part[0][1])
    return (np.concatenate(codes), np.concatenate(counts)) if codes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first; equal counts by code, so that ranks are defined."""
    if len(codes) > 4 * top:
        floor = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= floor
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


@dataclass(frozen=True)
class Profiles:
    """The learned languages, and for each known n-gram its rank in each (top where it is absent)."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    top: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest distance. `und`, 0.0 for a null text, a
        text without letters, or where nothing was learned; equal distances: the first by name."""
        data = normalised(text)
        if not data or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(*ngrams(data), self.top)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        ranks = np.where((self.codes[at] == own)[:, None], self.ranks[at], self.top)
        far = np.where(ranks == self.top, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(far))
        return self.languages[best], float(1 - far[best] / (self.top * len(own)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", top: int = 400, sample_per_language: int = 1000) -> Profiles:
    """Profiles from the rows with a text and a language.

    The fit uses at most sample_per_language documents of each language, those with the smallest
    hashes of their doc_id: a bounded sample, the same on each run. What is brought to the driver is
    the profiles, top n-grams a language.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("lang is not null and text is not null")
    # few rows a language come to one task: first those under a threshold that lets three times as many
    # through as are needed, which counts of the languages give; a language with few documents keeps all
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), 11) / float(1 << 53)
    drawn = rows.select("lang", "doc_id").withColumn("draw", draw)
    sizes = drawn.groupBy("lang").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    sizes = written(sizes, "language-sizes")
    if sizes.count() <= BROADCAST_ROWS:  # a row a language; beyond it the join shuffles by language
        sizes = F.broadcast(sizes)
    near = drawn.join(sizes, "lang").where(F.col("draw") * F.col("n") < 3 * sample_per_language)
    chosen = written(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_per_language).select("lang", "doc_id").distinct(), "sample-ids")
    if chosen.count() <= BROADCAST_ROWS:  # sample_per_language for each language: small unless languages are very many
        chosen = F.broadcast(chosen)
    sample = rows.join(chosen, ["lang", "doc_id"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = total.setdefault(name, {})
                codes, counts = ngrams(normalised(t.as_py()))
                for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    own[c] = own.get(c, 0) + n
            if sum(map(len, total.values())) > 500_000:
                yield from flush(total)
        yield from flush(total)

    def flush(total: dict) -> Iterator[pa.RecordBatch]:
        for name, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "code", "n"])
        total.clear()

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    profile = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).select("lang", "code", "k").collect()
    languages = sorted({r.lang for r in profile})
    codes = np.array(sorted({r.code for r in profile}), np.uint64)
    ranks = np.full((max(1, len(codes)), len(languages)), top, np.int64)
    place = {int(c): i for i, c in enumerate(codes)}
    index = {name: i for i, name in enumerate(languages)}
    for r in profile:
        ranks[place[r.code], index[r.lang]] = r.k - 1
    return Profiles(languages, codes if len(codes) else np.zeros(1, np.uint64), ranks, top)


def with_language(docs: DataFrame, profiles: Profiles, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with two more columns: the predicted language and its score from 0 to 1. One pass, no
    shuffle; null texts are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def predict(s):
        import pandas as pd

        known = shared.value
        return pd.DataFrame([known.predict(t) for t in s], columns=["lang", "score"])

    hidden = "__language"
    return docs.withColumn(hidden, predict(F.col(text))).withColumn(pred, F.col(hidden)["lang"]).withColumn(score, F.col(hidden)["score"]).drop(hidden)


def fold(doc_id: str = "doc_id") -> Column:
    """The remainder by 4 of the CRC-32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Nulls, texts without letters and ties as in Profiles.predict; an empty table
    gives no rows; repeated rows are alike; extra columns are ignored."""
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    profiles = learn(docs.where(fold() != 2))
    out = with_language(docs, profiles)
    return out.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: those with letters, and with an n-gram that
    some profile has. Columns stay as they are, whatever they are called; null and empty texts go; a null
    lang or doc_id costs nothing but a place in the sample; repeated rows stay or go together."""
    profiles = learn(docs.where(fold() != 2))
    rated = with_language(docs, profiles, pred="__pred", score="__score")
    return rated.where((F.col("__pred") != UNKNOWN) & (F.col("__score") > 0)).drop("__pred", "__score")
