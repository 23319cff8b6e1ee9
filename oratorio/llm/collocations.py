"""Phrase collocations: sketch upper bounds choose candidates, automata count them exactly.

Texts are dealt into shards of bounded size. Each shard counts the hashes of its phrases in buckets of a
sketch; the sketch is spread over slices of the hashes, one task each, so that its width grows with the
input and no task or driver holds it whole. A slice adds up its buckets, which bound the counts of all
phrases that fall in them from above, and tells each shard which of the buckets that it touched may hold a
frequent phrase. A shard compiles its phrases in such buckets, guarded by a blank on both sides, into an
Aho-Corasick automaton and scans its texts, so that matches that overlap all count. The counts of the
shards are summed, and thresholds apply to these exact counts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, shuffles, table, written

#: Bytes of text in a shard (about), in what is hashed at a time, and the least that is cut off for a core.
SHARD, CHUNK, LEAST_SHARD = 8 << 20, 1 << 20, 1 << 20
#: Bits of a bucket's number within its slice; there are as many slices as shards.
BUCKET = 24
#: A-Z to lower case, blanks to a space, and what ends a piece to a line feed.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[bytes]:
    """The words of the texts, lower-cased, a space on both sides of each, and a line feed between pieces;
    in chunks of about `size` bytes that end where a piece ends."""
    own, n = [], 0
    for text in texts:
        for piece in text.translate(_PLAIN).split(b"\n"):
            words = piece.split()
            if words:
                own.append(b" ".join(words))
                n += len(own[-1])
                if n >= size:
                    yield b" " + b" \n ".join(own) + b" "
                    own, n = [], 0
    if own:
        yield b" " + b" \n ".join(own) + b" "


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_hashes(chunk: bytes, seed: int, most: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Starts and ends of the chunk's words, and for each length the hashes of the phrases that begin at
    each word and whether they stay within a piece. Hashes depend on the words and the seed alone."""
    d = np.frombuffer(chunk, np.uint8)
    space = np.flatnonzero(d == 32)
    start, end = space[:-1] + 1, space[1:]
    # a polynomial of each word's bytes from sums of prefixes, modulo 2**64
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(d), _P)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(d), _P_INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((d.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    word = _mixed((sums[end] - sums[start]) * back[start])
    inside = d[start] != 10
    hashes, valid = [_mixed(word ^ np.uint64(seed))], [inside]
    for n in range(2, most + 1):
        if len(word) < n:
            break
        hashes.append(_mixed(hashes[-1][:-1] * _P + word[n - 1 :]))
        valid.append(valid[-1][:-1] & inside[n - 1 :])
    return start, end, hashes, valid


def _keys(h: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash, above the number of its bucket in the slice."""
    return ((h >> np.uint64(32)) % np.uint64(slices) << np.uint64(BUCKET)) | (h & np.uint64((1 << BUCKET) - 1))


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _by_lang(langs: list[str], texts: list[bytes]) -> dict[str, list[bytes]]:
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts, strict=True):
        by.setdefault(lang, []).append(text)
    return by


def _sketch(slices: int, most: int):
    """For each shard and slice, the buckets that the shard's phrases fall in (as gaps) and how often, up
    to 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            keys.clear()
            own = (key >> np.uint64(BUCKET)).astype(np.int64)
            at = np.flatnonzero(np.diff(own, prepend=-1))
            ends = [*at[1:], len(key)]
            bucket, n = (key & np.uint64((1 << BUCKET) - 1)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
            gaps = [np.diff(bucket[i:j], prepend=np.uint32(0)).tobytes() for i, j in zip(at, ends, strict=True)]
            counts = [n[i:j].tobytes() for i, j in zip(at, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own[at], pa.int32()), pa.array([shard] * len(at), pa.int32()), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())], ["slice", "shard", "gaps", "counts"])

        for b in batches:
            shards = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if shards[i] != shard:
                    yield from flush()
                    shard = int(shards[i])
                for lang, texts in _by_lang(b.column(1)[i:j].to_pylist(), b.column(2)[i:j].to_pylist()).items():
                    for chunk in chunks(texts):
                        _, _, hashes, valid = phrase_hashes(chunk, _seed(lang), most)
                        keys += [_keys(h[v], slices) for h, v in zip(hashes, valid, strict=True)]
        yield from flush()

    return run


def _bounds(least: int):
    """Of a slice: for each shard the buckets whose sums reach least."""

    def run(t: pa.Table) -> pa.Table:
        total, own = np.zeros(1 << BUCKET, np.uint32), []
        for gaps, counts in zip(t.column("gaps").to_pylist(), t.column("counts").to_pylist(), strict=True):
            own.append(np.cumsum(np.frombuffer(gaps, np.uint32), dtype=np.uint32))
            total[own[-1]] += np.frombuffer(counts, np.uint8)
        left = [b[total[b] >= least].tobytes() for b in own]
        return pa.table([t.column("shard"), t.column("slice"), pa.array(left, pa.binary())], ["shard", "slice", "buckets"])

    return run


def _member(sorted_keys: np.ndarray, low: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in sorted_keys; low tells by the lower bits which need a search."""
    out = low[keys & np.uint64((1 << BUCKET) - 1)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(sorted_keys, keys[at]), len(sorted_keys) - 1)
    out[at] = sorted_keys[place] == keys[at]
    return out


def count_phrases(texts: list[bytes], seed: int, keys: np.ndarray, slices: int, most: int) -> tuple[dict[bytes, int], int]:
    """How often each phrase of up to `most` words, of which keys has all parts, is in the texts, and the
    number of words. Phrases have a space on both sides."""
    low = np.zeros(1 << BUCKET, bool)
    low[keys & np.uint64((1 << BUCKET) - 1)] = True
    phrases: set[bytes] = set()
    expected = words = 0

    def candidates(chunk: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        start, end, hashes, valid = phrase_hashes(chunk, seed, most)
        before = np.zeros(0, bool)
        for n, (h, v) in enumerate(zip(hashes, valid, strict=True), 1):
            v = v.copy() if n == 1 else v & before[:-1] & before[1:]
            at = np.flatnonzero(v)
            before = v
            before[at] = _member(keys, low, _keys(h[at], slices)) if len(keys) else False
            at = np.flatnonzero(before)
            yield start[at] - 1, end[at + n - 1] + 1, h[at]

    for chunk in chunks(texts):
        words += chunk.count(b" ") - 1 - chunk.count(b"\n")
        for start, end, h in candidates(chunk):
            expected += len(h)
            _, once = np.unique(h, return_index=True)
            phrases.update(chunk[i:j] for i, j in zip(start[once].tolist(), end[once].tolist(), strict=True))
    while phrases:
        known = sorted(phrases)
        automaton = ahocorasick.Automaton()
        for k, p in enumerate(known):
            automaton.add_word(p.decode("latin-1"), k)
        automaton.make_automaton()
        total = np.zeros(len(known), np.int64)
        for chunk in chunks(texts):
            total += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(chunk.decode("latin-1"))), np.int64), minlength=len(known))
        if total.sum() == expected:
            return dict(zip(known, total.tolist(), strict=True)), words
        # two phrases with one hash: take every place's phrase
        for chunk in chunks(texts):
            for start, end, _ in candidates(chunk):
                phrases.update(chunk[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True))
    return {}, words


def _scan(slices: int, most: int):
    def run(texts: pa.Table, bounds: pa.Table) -> pa.Table:
        own = [(np.uint64(s) << np.uint64(BUCKET)) | np.frombuffer(b, np.uint32).astype(np.uint64) for s, b in zip(bounds.column("slice").to_pylist(), bounds.column("buckets").to_pylist(), strict=True)]
        keys, out = np.sort(np.concatenate([np.empty(0, np.uint64), *own])), []
        for lang, own_texts in _by_lang(texts.column("lang").to_pylist(), texts.column("text").to_pylist()).items():
            found, words = count_phrases(own_texts, _seed(lang), keys, slices, most)
            out += [(lang, p[1:-1], p.count(b" ") - 1, n) for p, n in found.items()]
            out.append((lang, b"", 0, words))
        lang, phrase, n_words, n = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), pa.array(n_words, pa.int32()), pa.array(n, pa.int64())], ["lang", "phrase", "words", "n"])

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 4) -> DataFrame:
    """Written rows (lang, phrase, words, n): each phrase of 1 to `most` words that is at least `least`
    times in a language's texts, and how often; and one row of no words with the number of all words."""
    spark = docs.sparkSession
    own = own_columns(docs, text, lang).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where("octet_length(text) > 0")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // SHARD), min(shuffles(spark), -(-size // LEAST_SHARD)))
    dealt = own.withColumn("row", F.monotonically_increasing_id()).repartition(n, "row").select(F.spark_partition_id().alias("shard"), "lang", "text")
    shards = written(dealt, "shards")
    sketch = shards.mapInArrow(_sketch(n, most), "slice int, shard int, gaps binary, counts binary")
    bounds = written(sketch.groupBy("slice").applyInArrow(_bounds(min(least, 255)), "shard int, slice int, buckets binary"), "bounds")
    counted = shards.groupBy("shard").cogroup(bounds.groupBy("shard")).applyInArrow(_scan(n, most), "lang string, phrase binary, words int, n bigint")
    summed = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))
    return written(summed.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 4, covered: int = 80, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score), each language's first `top` phrases of 2 to `most` words.

    a, l and r count the phrase and the two parts of its lowest-scoring cut (ties: the first), n all words;
    score is floor(2000000 * a / (l + r)). Phrases within a longer one that is at least `covered` percent
    as frequent are left out. Order: score and a descending, then the phrase's bytes. A null lang counts as
    'und'; null and empty texts have no words; repeated rows count each time; texts may be of any length
    (what lies between two ends of pieces is held whole); an empty table gives no rows; other columns are
    ignored. Counts are exact whatever the sketch says: its bounds are never too low.
    """
    counts = phrase_counts(docs, text, lang, least, most)
    frequent, totals = counts.where("words > 0"), counts.where("words = 0").select("lang", F.col("n").alias("all"))
    chosen = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = chosen.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: part(s, m))))
    inner = chosen.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * cast(longer as decimal(20,0)) < {int(covered)} * cast(a as decimal(20,0))"))
    first = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by collocations: at least 30 times, 2 to 4 words, the first 2000 of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), words as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), starts as (
    select lang, w, unnest(range(1, len(w) + 1)) as i from words
), f as (
    select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m, count(*) as n
    from starts, (select unnest([1, 2, 3, 4]) as m) where i + m - 1 <= len(w) group by all having count(*) >= 30
), cuts as (
    select c.lang, c.phrase, c.m, c.n as a, k, l.n as l, r.n as r, (2000000::hugeint * c.n // (l.n + r.n))::bigint as score
    from (select *, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m > 1) c
    join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
    join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')
    qualify row_number() over (partition by c.lang, c.phrase order by score, k) = 1
), longer as (
    select lang, array_to_string(w[i:i + s - 1], ' ') as phrase, max(n) as n
    from (select lang, string_split(phrase, ' ') as w, m, n, unnest(range(1, m)) as i from f where m > 2), (select unnest([2, 3]) as s)
    where s < m and i + s - 1 <= m group by all
), kept as (
    select c.*, row_number() over (partition by c.lang order by score desc, a desc, c.phrase) as rank
    from cuts c left join longer x on x.lang = c.lang and x.phrase = c.phrase
    where x.n is null or 100 * x.n < 80 * a
)
select k.lang, rank, phrase, a, l, r, t.n, score
from kept k join (select lang, sum(len(w))::bigint as n from words group by lang) t on t.lang = k.lang where rank <= 2000
"""
