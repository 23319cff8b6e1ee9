"""Removal of repeated substrings: hash-compared suffix sort over candidate suffixes.

Every byte goes that a string of ``length`` bytes covers which also starts anywhere else. A suffix here
is the start of such a string. Sorting all suffixes of a large corpus is not needed for that:

1. Winnowing. In each window of ``length`` bytes the least hash of its ``GRAM``-byte strings is taken.
   Equal windows have equal minima in equal places. Starts in a row with one minimum in one place are
   a segment, the text that their windows cover; a minimum that stands in one place only ends there.
2. A segment whose whole text stands twice is repeated as it is. Texts are told apart by their BLAKE2
   digest of 128 bits with the minimum: a cryptographic hash, in place of bringing their bytes together.
3. What is left are minima with different segments: the ends of matches, where texts part. Of each
   different segment one copy is brought to the task of its minimum, and the suffixes there are sorted:
   by their first eight bytes, and then by mergesort, in which two suffixes are compared by a binary
   search for their common extension over prefix polynomial hashes. Neighbours with a common extension
   of ``length`` are compared byte for byte before they count.
4. A minimum with more than ``GROUP`` different segments would not fit a task. Its segments are cut into
   blocks of ``BLOCK`` starts, on which step 2 is done again; what is left is dealt by the digest of the
   first ``length`` bytes of each suffix, where equal ones meet.

Texts are worked on in steps, so memory does not grow with their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, table, written

LENGTH = 200
GRAM = 64
STEP = 1 << 18
GROUP = 256
BLOCK = 16
#: A minimum with more segments than this is hot; at most MOST_HOT hot ones are broadcast, eight bytes each.
HOT = 100_000
MOST_HOT = 1_000_000
#: Suffixes sorted at once.
BATCH = 1 << 17
MASK = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, powers of the multiplier, and of its inverse."""
    base, n = MULTIPLIER, STEP + 4 * LENGTH
    return np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64), _powers(base, n), _powers(pow(base, -1, 1 << 64), n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Prefixes:
    """Prefix polynomial hashes of a byte array of at most STEP + 4 * LENGTH bytes."""

    def __init__(self, b: np.ndarray):
        self.random, self.up, self.down = _tables()
        self.h = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.random[b] * self.up[: len(b)], out=self.h[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.h[end] - self.h[start]) * self.down[start]

    def every(self, n: int) -> np.ndarray:
        """Hashes of all strings of n bytes."""
        return _mixed((self.h[n:] - self.h[:-n]) * self.down[: len(self.h) - n] + np.uint64(n))


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    n = len(a)
    rows = np.full(-(-n // w) * w, MASK, np.uint64)
    rows[:n] = a
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _marks(data: memoryview | bytes, low: list[int], high: list[int]) -> list[bytes]:
    """The digests of the strings from low to high."""
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(low, high, strict=True)]


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """(minimum, first start, number of starts) of each segment of a text."""
    parts = []
    b = np.frombuffer(data, np.uint8)
    for at in range(0, len(b) - length + 1, STEP):
        piece = b[at : at + STEP + length - 1]
        hashes = Prefixes(piece)
        grams = hashes.every(gram)
        least = _least(grams, length - gram + 1)
        # a minimum that leaves the window ends its segment, even where an equal one follows
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])]))
        n = np.diff(np.append(first, len(least)))
        parts.append((least[first].view(np.int64), first + at, n))
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3


class Suffixes:
    """Sorts suffixes of a byte array, by their first `length` bytes, within the groups given."""

    def __init__(self, b: np.ndarray, length: int = LENGTH):
        self.b, self.length, self.hashes = b, length, Prefixes(b)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes suffixes i and j have in common, at most `length`: a binary search by hash."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.length, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = self.hashes.raw(i, i + mid) == self.hashes.raw(j, j + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        end = np.minimum(n, self.length - 1)
        x, y = self.b[i + end], self.b[j + end]
        return np.where(n >= self.length, or_equal, x < y)

    def sort(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of the suffixes: by group, then first eight bytes, then mergesort of those with
        equal ones, all runs at once."""
        lead = np.zeros(len(starts), np.uint64)
        for k in range(8):
            lead = (lead << np.uint64(8)) | self.b[starts + k].astype(np.uint64)
        order = np.lexsort((lead, group))
        g, x = group[order], lead[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
        run = np.flatnonzero(new)[np.cumsum(new) - 1]
        size = np.diff(np.append(np.flatnonzero(new), len(order)))[np.cumsum(new) - 1]
        width = 1
        while (act := np.flatnonzero(size > width)).size:
            local = act - run[act]
            block = local // width
            right = (block & 1).astype(bool)
            sibling = run[act] + (block ^ 1) * width
            stop = np.minimum(sibling + width, run[act] + size[act])
            low, high = np.minimum(sibling, stop), stop
            first, me = low.copy(), starts[order[act]]
            while (left := np.flatnonzero(low < high)).size:  # how many of the sibling block go before
                mid = (low[left] + high[left]) >> 1
                other = starts[order[mid]]
                before = self.less(other, me[left], right[left])
                low[left] = np.where(before, mid + 1, low[left])
                high[left] = np.where(before, high[left], mid)
            to = run[act] + (block & ~1) * width + local % width + (low - first)
            moved = order.copy()
            moved[to] = order[act]
            order, width = moved, width * 2
        return order

    def repeated(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For each suffix whether another has the same first `length` bytes."""
        order = self.sort(starts, group)
        i, j = starts[order[:-1]], starts[order[1:]]
        near = np.flatnonzero(self.hashes.raw(i, i + self.length) == self.hashes.raw(j, j + self.length))
        # collisions: what the hashes call equal is compared byte for byte
        true = [k for at in range(0, len(near), 4096) for k in near[at : at + 4096][(self._strings(i[near[at : at + 4096]]) == self._strings(j[near[at : at + 4096]])).all(1)].tolist()]
        out = np.zeros(len(starts), bool)
        out[order[true]] = True
        out[order[[k + 1 for k in true]]] = True
        return out

    def _strings(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.b, self.length)[at]


def _spans(flags: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the runs of flagged starts, as (first start, last start + length)."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return starts[np.flatnonzero(edge == 1)], starts[np.flatnonzero(edge == -1) - 1] + length


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[np.ndarray]] = []
            marks: list[bytes] = []
            of: list[int] = []
            for k in range(b.num_rows):
                if len(data := b.column(2)[k].as_buffer() or b"") >= length:
                    rows.append(segments(data, length))
                    _, first, n = rows[-1]
                    marks += _marks(memoryview(data), first.tolist(), (first + n + (length - 1)).tolist())
                    of += [k] * len(first)
                if len(of) > 200_000 or k == b.num_rows - 1:
                    if rows:
                        columns = [pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)]
                        take = pa.array(of, pa.int32())
                        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), columns[0], pa.array(marks, pa.binary()), columns[1].cast(pa.int32()), columns[2].cast(pa.int32())], ["doc_id", "th", "least", "seg", "first", "n"])
                    rows, marks, of = [], [], []

    return run


def _fetch(length: int):
    """Brings the text of the segments asked for. Those of hot minima come in blocks of BLOCK starts,
    counted from the minimum, so that equal texts have equal blocks, with the digest of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "least", "block", "first", "data", "mark"]
        for b in batches:
            for k in range(b.num_rows):
                data, out = b.column(2)[k].as_buffer(), []
                for w in b.column(3)[k].as_py():
                    text = data[w["first"] : w["first"] + w["n"] + length - 1].to_pybytes()
                    if not w["hot"]:
                        out.append((w["least"], None, w["first"], text, None))
                        continue
                    at = int(np.flatnonzero(Prefixes(np.frombuffer(text, np.uint8)).every(GRAM).view(np.int64) == w["least"])[0])
                    block = (at - np.arange(w["n"])) // BLOCK
                    low = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                    high = np.append(low[1:], w["n"]) + length - 1
                    low, high = low.tolist(), high.tolist()
                    out += [(w["least"], int(block[x]), w["first"] + x, text[x:y], m) for x, y, m in zip(low, high, _marks(text, low, high), strict=True)]
                if out:
                    same = pa.array([k] * len(out), pa.int32())
                    columns = list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(same), b.column(1).take(same), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return run


def _windows(length: int):
    """The digest of each string of `length` bytes of the blocks given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, starts, marks = [], [], []
            for k, (first, data) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                low = range(len(data) - length + 1)
                of += [k] * len(low)
                starts += [first + x for x in low]
                marks += _marks(data, low, range(length, len(data) + 1))
            if of:
                take = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(starts, pa.int32()), pa.array(marks, pa.binary())], ["doc_id", "th", "s", "mark"])

    return run


def _hot_spans(blocks: DataFrame, kind: str, length: int) -> DataFrame:
    """The repeated spans of blocks, however many there are of one minimum: whole blocks that stand
    twice, and of one copy of each different block the strings that do."""
    end = F.col("first") + F.octet_length("data")
    texts = blocks.groupBy("least", "block", "mark").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "first")).alias("at"))
    texts = written(texts, "block-texts")
    several = texts.groupBy("least", "block").agg(F.count("*").alias("m")).where("m > 1").select("least", "block")
    keys = ["least", "block", "mark"]
    whole = blocks.join(texts.where("c > 1").select(*keys), keys, "left_semi").select("doc_id", "th", F.col("first").alias("s"), end.alias("e"))
    places = texts.join(several, ["least", "block"], "left_semi").select(F.col("at.doc_id").alias("d"), F.col("at.th").alias("t"), F.col("at.first").alias("f"))
    chosen = blocks.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("first") == F.col("f")), "left_semi")
    windows = written(chosen.select("doc_id", "th", "first", "data").mapInArrow(_windows(length), f"doc_id {kind}, th bigint, s int, mark binary"), "windows")
    same = windows.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark")
    met = windows.join(same, "mark", "left_semi").select("doc_id", "th", "s", (F.col("s") + length).alias("e"))
    return whole.unionByName(met)


def _sort(length: int):
    """Rows of one minimum stand together; the suffixes of as many minima as fit are sorted at once."""

    def flush(rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        b = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        ends = np.cumsum([len(r[4]) for r in rows])
        n = np.array([len(r[4]) - length + 1 for r in rows])
        of = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(ends - n - length + 1, n) + inside
        group = np.unique([r[2] for r in rows], return_inverse=True)[1][of]
        flags = Suffixes(b, length).repeated(starts, group)
        out: list[tuple] = []
        for k in np.unique(of[flags]):
            mine = slice(int(np.searchsorted(of, k)), int(np.searchsorted(of, k, "right")))
            s, e = _spans(flags[mine], inside[mine] + rows[k][3], length)
            out += [(rows[k][0], rows[k][1], int(x), int(y)) for x, y in zip(s, e, strict=True)]
        if out:
            d, t, s, e = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, kind), pa.array(t, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["doc_id", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last, kind = [], 0, None, pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if row[2] != last and size > BATCH:
                    yield from flush(rows, kind)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[2]
        if rows:
            yield from flush(rows, kind)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for k in range(b.num_rows):
            data, spans = b.column(1)[k].as_buffer() or pa.py_buffer(b""), b.column(2)[k].as_py() or []
            runs: list[list[int]] = []
            for x in sorted(spans, key=lambda x: (x["s"], x["e"])):
                if runs and x["s"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x["e"])
                else:
                    runs.append([x["s"], x["e"]])
            kept, at = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            out.append((len(data), sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _shared(found: DataFrame, twice: DataFrame) -> DataFrame:
    """The segments whose minimum is in twice. Those of a hot minimum, of which there is at most one in HOT
    rows, are found by a broadcast of the hot ones if these are few, so that they are not shuffled; with
    more of them all go by one join, whose left side Spark can split, as twice is a table."""
    hot = twice.where(F.col("c") > HOT).select("least")
    few = F.broadcast(hot)
    rest = twice.where(F.col("c") <= HOT).select("least")
    if not 0 < hot.count() <= MOST_HOT:
        return found.join(twice.select("least"), "least", "left_semi")
    return found.join(few, "least", "left_semi").unionByName(found.join(few, "least", "left_anti").join(rest, "least", "left_semi"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, th, s, e), spans of bytes to remove, from rows (doc_id, th, data)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    spark = rows.sparkSession
    found = written(rows.where(F.octet_length("data") >= length).mapInArrow(_find(length), f"doc_id {kind}, th bigint, least bigint, seg binary, first int, n int"), "segments")
    twice = written(found.groupBy("least").agg(F.count("*").alias("c")).where("c > 1"), "shared-minima")
    live = written(_shared(found, twice), "shared-segments")
    discard(found, twice)
    release(spark)
    # both sides are written before the join, so that it reads exchanges of its own, which can be split
    # where a minimum has very many texts
    texts = written(live.groupBy("least", "seg", "n").agg(F.count("*").alias("c")), "segment-counts")
    kinds = written(texts.groupBy("least").agg(F.count("*").alias("m")), "segment-kinds")
    counted, texts = texts, written(texts.join(kinds, "least"), "segment-texts")
    discard(counted, kinds)
    release(spark)
    joined = live.join(texts, ["least", "seg", "n"])
    whole = joined.where("c > 1").select("doc_id", "th", F.col("first").alias("s"), (F.col("first") + F.col("n") + (length - 1)).alias("e"))
    # one copy of each different segment, where a minimum has several
    chosen = joined.where("m > 1").groupBy("least", "seg", "n").agg(F.min(F.struct("doc_id", "th", "first")).alias("at"), F.max("m").alias("m"))
    wanted = chosen.select("at.doc_id", "at.th", F.struct("least", "at.first", "n", (F.col("m") > group).alias("hot")).alias("w")).groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "wanted")
    asked = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["d"]) & (rows["th"] == wanted["t"]))
    fetched = written(asked.select("doc_id", "th", "data", "wanted").mapInArrow(_fetch(length), f"doc_id {kind}, th bigint, least bigint, block int, first int, data binary, mark binary"), "pieces")
    release(spark)
    pieces = fetched.where("block is null").select("doc_id", "th", "least", "first", "data").repartition("least").sortWithinPartitions("least")
    sorted_ = pieces.mapInArrow(_sort(length), f"doc_id {kind}, th bigint, s int, e int")
    hot = _hot_spans(fetched.where("block is not null"), kind, length)
    spans = written(whole.unionByName(sorted_).unionByName(hot), "spans")
    discard(live, texts, fetched)
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one a row of docs.

    Null texts count as empty. A repeated row repeats all of its strings. Whatever other columns docs
    has are ignored; an empty table gives no rows.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(data).alias("th"), data.cast("binary").alias("data"))
    spans = repeated_spans(rows, length, group)
    per = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans")
    joined = rows.join(per, rows["doc_id"].eqNullSafe(per["d"]) & (rows["th"] == per["t"]), "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "data", "spans").mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by remove_repeats; nulls, ties and repeated rows as it says."""
    return remove_repeats(table(spark, sf_dir, "documents"))
