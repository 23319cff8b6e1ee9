"""Near-duplicate detection with SimHash fingerprints.

Fingerprints are made a document at a time over Arrow batches. Documents are first grouped by equal
fingerprint, so that copies cost one row each. Distinct fingerprints are then cut into ``max_distance +
extra`` blocks: of two within ``max_distance`` bits, at least ``extra`` blocks are equal (pigeonhole), so
each choice of ``extra`` blocks is a bucket key, and close pairs meet in a bucket. A bucket with up to
``dense`` fingerprints is compared whole in one task, which is bounded work, and gives the edges of a
spanning forest. A larger bucket is cut again by finer blocks of its free bits, until what is free in a
bucket bounds its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_of, lower_hex, named_as, numbered, own_columns, release, table, written
from .graph import components

SEED = 42
#: Buckets up to this size are compared within one row, larger ones as a group.
FEW = 32
MASK = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text (null: empty): A-Z lower-cased, ASCII white space between words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)
    total, n = np.zeros(64, np.int64), 0
    for at in range(0, len(words) - shingle + 1, 65536):  # long texts in steps: bounded memory
        part = words[at : at + 65536 + shingle - 1]
        each = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed=SEED) for s in each), np.uint64)
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return own_columns(docs, doc_id, text).mapInArrow(make, f"doc_id {kind}, fp bigint")


def _cuts(bits: list[int], blocks: int, keep: int) -> list[int]:
    """A mask for each choice of `keep` out of `blocks` nearly equal blocks of the bits."""
    parts = [sum(1 << int(b) for b in p) for p in np.array_split(bits, blocks)]
    return [sum(c) for c in combinations(parts, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(distance: int):
    def edges(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        left, found = np.ones(len(fp), bool), []
        while left.any():  # a breadth-first walk: each fingerprint is compared with the rest once
            queue = [int(np.flatnonzero(left)[0])]
            left[queue[0]] = False
            while queue:
                i = queue.pop()
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= distance]
                left[near] = False
                found += [(i, int(j)) for j in near]
                queue += near.tolist()
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        signed = fp.view(np.int64)
        return pd.DataFrame({"a": signed[a], "b": signed[b]})

    return edges


def links(distinct: DataFrame, max_distance: int = 3, extra: int = 3, dense: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, of which the components are those of all pairs
    within max_distance bits. Of the pairs in a bucket only a spanning forest is kept."""
    spark = distinct.sparkSession
    masks = _cuts(list(range(64)), max_distance + extra, extra)
    rows = _keyed(distinct.select("fp"), masks)
    free = 64 - min(m.bit_count() for m in masks)
    found = []
    while True:
        # what a bucket holds is bounded by its free bits; `dense` is below that bound
        bounded = (1 << free) <= dense
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = written(rows.join(sizes, ["mask", "key"]), "buckets")
        small = shared if bounded else shared.where(F.col("n") <= dense)
        few = small.where(F.col("n") <= FEW).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        more = small.where(F.col("n") > FEW).groupBy("mask", "key").applyInPandas(_forest(max_distance), "a bigint, b bigint")
        found.append(written(_near_pairs(few, max_distance).unionByName(more).distinct(), "links"))
        if bounded:
            break
        large = shared.where(F.col("n") > dense).select("mask", "fp")
        if large.isEmpty():
            break
        # cut the free bits into blocks again: the same argument holds within a bucket
        finer = []
        for m in masks:
            rest = [b for b in range(64) if not m >> b & 1]
            for c in _cuts(rest, max_distance + 8, 8) if len(rest) > max_distance + 8 else _cuts(rest, len(rest), len(rest) - max_distance):
                finer.append((_signed(m), _signed(m | c)))
        again = spark.createDataFrame(sorted(set(finer)), "mask bigint, finer bigint")
        rows = large.join(F.broadcast(again), "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp").distinct()
        masks = sorted({f & MASK for _, f in finer})
        free = 64 - min(m.bit_count() for m in masks)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    release(spark)
    return out


def _near_pairs(few: DataFrame, distance: int) -> DataFrame:
    """The pairs within distance of buckets of at most FEW fingerprints."""

    def partners(x):
        return F.transform(F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= distance)), lambda y: F.struct(x.alias("a"), y.alias("b")))

    return few.select(F.inline(F.flatten(F.transform("fps", partners))))


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]))
    return fps.select("fp", pairs.alias("k")).select("k.mask", "k.key", "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each document.

    fingerprint has 16 lowercase hex digits; component_id is the smallest doc_id that is reachable over
    links of max_distance or fewer differing bits, the document itself included. Null and empty texts
    have the fingerprint zero and link like any other; an empty table gives no rows; repeated rows give
    repeated results; other columns of docs are ignored.
    """
    fps = written(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct, max_distance))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = written(joined.join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(labelled, "fp", "left").select("doc_id", lower_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by near_duplicates; nulls, ties and repeated rows as it says."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Of the bands of a text: how many, and the least hashes that each is made of. Texts of similarity 0.8
#: have a band in common with probability 1 - (1 - 0.8 ** 5) ** 12, over 0.99.
BANDS, LEAST = 12, 5
#: Texts of a band that are put in order together; texts of a band of which all are paired; how often groups
#: are paired again at most before what is left is compared by blocks.
PART, SMALL, ROUNDS = 1024, 32, 20
#: Pairs of which the numbers of the texts are broadcast: two million numbers at most, 32 MB.
MOST_PAIRS = 1_000_000
#: Texts, and distinct shingles of them, up to which one task has all that may be alike, and of a block.
HOME, HOME_SHINGLES = 1024, 1 << 22


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct hashes of the text's shingles of n words (fewer words: the whole sequence)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    each = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed=SEED) for s in each), np.uint64))


_odd = np.random.default_rng(10).integers(0, 1 << 63, BANDS * LEAST, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> list[int]:
    """A hash for each band: of LEAST minima, each in an order of its own, of the shingles' hashes."""
    if not len(h):
        return []
    least = np.full(BANDS * LEAST, MASK, np.uint64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] * _odd
        least = np.minimum(least, ((x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)).min(0))
    return [xxhash.xxh64_intdigest(least[k * LEAST : (k + 1) * LEAST].tobytes(), seed=k) for k in range(BANDS)]


def _jaccard(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sets of shingles, both empty: 1; where their sizes tell that it is below least,
    a bound of it that is below least too."""
    small, large = sorted((len(x), len(y)))
    if not large:
        return 1.0
    if small / large < least:
        return small / large
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def similarity(a: str | None, b: str | None, n: int) -> float:
    """Jaccard similarity of the texts' shingles; two without words are alike."""
    return _jaccard(shingles(a, n), shingles(b, n))


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            texts = b.column(1).to_pylist()
            digests = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            own, sizes = [], []
            for t in texts:
                h = shingles(t, shingle)
                own.append(np.array(bands(h), np.uint64).view(np.int64).tolist())
                sizes.append(len(h))
            arrays = [b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array(fp), pa.array(own, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "digest", "fp", "bands", "size"])

    return run


def _alike(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similarity(x.as_py(), y.as_py(), shingle) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _met(whole: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The texts (node, text) of n nodes (node): where these are few, their numbers are broadcast to the texts,
    so that no other text is shuffled."""
    return whole.join(F.broadcast(nodes) if n <= 2 * MOST_PAIRS else nodes, "node", "left_semi")


def _shared(texts: DataFrame) -> DataFrame:
    """Rows (band, node, o) of the bands that several texts have. Which these are is counted first, so that
    bands of one text, which are nearly all, are shuffled as a number and no more."""
    own = texts.select("node", "o", F.explode("bands").alias("band"))
    several = written(own.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "bands")
    return own.join(F.broadcast(several) if several.count() <= MOST_PAIRS else several, "band", "left_semi").select("band", "node", "o")


def _neighbours(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (node, o, bands) with a band in common: each text with the first and the last of
    its band, and with the one before it, in order of doc_id, as row numbers may differ from run to run. The
    order of a large band is that of parts of about PART texts, so that no task sorts a whole one."""
    shared = _shared(texts)
    ends = shared.groupBy("band").agg(F.min("o")["row"].alias("lo"), F.max("o")["row"].alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    met = shared.join(ends, "band")
    part = F.pmod(F.xxhash64("o.doc_id"), F.ceil(F.col("n") / PART))
    before = F.lag("node").over(Window.partitionBy("band", "part").orderBy("o"))
    chained = met.withColumn("part", part).withColumn("before", before)
    return chained.select("node", F.explode(F.array_compact(F.array("lo", "hi", "before"))).alias("a")).select("a", F.col("node").alias("b"))


def _joined(label: np.ndarray, tested: np.ndarray, h: list[np.ndarray], p: int, others: np.ndarray, least: float) -> list[int]:
    """Compares p with the others that are not in its group, joins its group with theirs where they are alike,
    and gives those; labels are changed in place."""
    found = []
    for q in others[(label[others] != label[p]) & ~tested[p, others]].tolist():
        if label[q] != label[p]:
            tested[p, q] = tested[q, p] = True
            if _jaccard(h[p], h[q], least) >= least:
                label[label == label[q]] = label[p]
                found.append(q)
    return found


def _home(shingle: int, least: float, distance: int = 3):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Groups of the texts of a home, from all pairs with a band in common or fingerprints within the distance."""
        n, h = len(pdf), [shingles(t, shingle) for t in pdf["text"]]
        fp, node = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy(np.int64)
        label, tested, of = np.arange(n), np.zeros((n, n), bool), {}
        for i, own in enumerate(pdf["bands"]):
            for band in own:
                of.setdefault(band, []).append(i)
        for members in of.values():
            m = np.array(members)
            for k in range(len(m) - 1):
                _joined(label, tested, h, m[k], m[k + 1 :], least)
        for p in range(n - 1):
            _joined(label, tested, h, p, p + 1 + np.flatnonzero(np.bitwise_count(fp[p + 1 :] ^ fp[p]) <= distance), least)
        root = pd.Series(node).groupby(label).transform("min")
        return pd.DataFrame({"node": node, "root": root.to_numpy()})

    return run


def _blocks(shingle: int, least: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Edges between the groups of two blocks of a band, or of one: of all its pairs, each in the first of
        the bands that both texts have."""
        band, i, j = (int(x) for x in key)
        h, node = [shingles(t, shingle) for t in pdf["text"]], pdf["node"].to_numpy(np.int64)
        block, of = pdf["block"].to_numpy(), [set(x) for x in pdf["bands"]]
        label, tested = pd.factorize(pdf["root"])[0], np.zeros((len(pdf), len(pdf)), bool)
        found = []
        for p in np.flatnonzero(block == i):
            others = np.flatnonzero(block == j)
            others = np.array([q for q in others[label[others] != label[p]] if min(of[p] & of[q]) == band], int)
            found += [(int(node[p]), int(node[q])) for q in _joined(label, tested, h, p, others, least)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": a, "b": b})

    return run


def _all_across(texts: DataFrame, roots: DataFrame, whole: DataFrame, shingle: int, least: float, over: int) -> DataFrame:
    """Edges (a, b) of all pairs of texts of different groups with a band in common, of bands of more than
    `over` texts. A band is cut into blocks of about HOME texts or HOME_SHINGLES shingles, and each two blocks,
    and each block by itself, are one task: quadratic in a band that no round could join, in bounded memory."""
    own = texts.join(roots, "node", "left").select("node", "size", "bands", F.coalesce("root", "node").alias("root"), F.explode("bands").alias("band"))
    several = own.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.min("root").alias("r"), F.max("root").alias("s")).where((F.col("r") != F.col("s")) & (F.col("n") > over))
    k = F.ceil(F.greatest(F.col("n") / HOME, F.col("sizes") / HOME_SHINGLES, F.lit(1.0)))
    met = own.join(several.select("band", k.alias("k")), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")))
    met = written(met.select("node", "root", "bands", "band", "block", "k"), "across")
    nodes = written(met.select("node").distinct(), "nodes")
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select("node", "root", "bands", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    brought = dealt.join(_met(whole, nodes, nodes.count()), "node")
    return brought.groupBy("band", "i", "j").applyInPandas(_blocks(shingle, least), "a bigint, b bigint")


def _across(texts: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of texts of different groups with a band in common: all of them in bands of at most SMALL
    texts; in larger ones each text with the one before it in an order of hashes, another one each turn."""
    own = texts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("bands").alias("band"))
    several = own.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band", "n")
    met = own.join(several, "band")
    few = met.where(F.col("n") <= SMALL).groupBy("band").agg(F.collect_list(F.struct("node", "root")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda p: F.transform(F.filter("x", lambda q: (p["node"] < q["node"]) & (p["root"] != q["root"])), lambda q: F.struct(p["node"].alias("a"), q["node"].alias("b")))))
    mixed = F.xxhash64("node", F.lit(turn))
    in_order = Window.partitionBy("band", "part").orderBy(mixed, "node")
    many = met.where(F.col("n") > SMALL).withColumn("part", F.pmod(F.xxhash64("node", F.lit(-turn)), F.ceil(F.col("n") / PART)))
    many = many.select("root", F.col("node").alias("b"), F.lag("node").over(in_order).alias("a"), F.lag("root").over(in_order).alias("of")).where("of <> root")
    return few.select(F.inline(pairs)).unionByName(many.select("a", "b"))


def _verified(pairs: DataFrame, whole: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a written table) whose texts (node, text) are alike. Only texts that are in a pair are
    shuffled: where these are few, their numbers are broadcast to the texts."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    met = _met(whole, nodes, 2 * pairs.count())
    second = pairs.join(met.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = second.join(met.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(_alike(shingle, least), "a bigint, b bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large(texts: DataFrame, close: DataFrame, whole: DataFrame, shingle: int, least: float) -> DataFrame:
    """Rows (node, root) of the groups of texts that are too many for one task; close are their pairs by
    fingerprint. Rounds of few pairs join most, the rest is compared by blocks."""
    tested = written(_ordered(close.unionByName(_neighbours(texts))), "pairs")
    edges = written(_verified(tested, whole, shingle, least), "alike")
    roots, settled = components(edges), False
    for k in range(ROUNDS):
        alive = texts.join(roots.where("node <> root"), "node", "left_anti")
        more = _ordered(_neighbours(alive).unionByName(_across(texts, roots, k))).join(tested, ["a", "b"], "left_anti")
        more = written(more, "pairs")
        found = written(_verified(more, whole, shingle, least), "alike")
        if settled := found.isEmpty():
            break
        tested, edges = tested.unionByName(more), edges.unionByName(found)
        roots = components(edges)
    # the last round compared all pairs of small bands, if it joined none
    found = written(_all_across(texts, roots, whole, shingle, least, SMALL if settled else 1), "alike")
    return roots if found.isEmpty() else components(edges.unionByName(found))


def representatives(rows: DataFrame, row: str, text: str, doc_id: str, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Rows (row): of each group of near copies the row that stays, that with the smallest doc_id, nulls
    last, and then the smallest row number. Groups are the components of pairs of texts whose shingles
    have a Jaccard similarity of `least` or more.

    Equal texts are one node. Candidate pairs have SimHash fingerprints within three bits, or a band in
    common: at a similarity of 0.8 some ten of 64 bits differ, which blocks of a fingerprint cannot reach.
    Similarities are taken of the whole texts. Texts that are connected by candidate pairs are a home. One
    of at most HOME texts and HOME_SHINGLES shingles is one task, which has each text once and leaves out
    only pairs of one group. In a larger one a text is paired with the first and the last of its band and with the one
    before it; where a band still has texts of several groups, these are paired again, all of a small band,
    by changing orders in a large one, until a round joins no groups; then all pairs of different groups in
    a large band are compared by blocks. Either way two texts with a band in common that are alike are in
    one group. Null and empty texts are alike.
    """
    kind = rows.schema[doc_id].dataType.simpleString()
    sketches = written(rows.select(row, text, doc_id).mapInArrow(_sketch(shingle), f"row bigint, doc_id {kind}, digest binary, fp bigint, bands array<bigint>, size bigint"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    texts = sketches.groupBy("digest").agg(F.min(F.struct(order.alias("o"), "fp", "bands", "size")).alias("f"))
    texts = written(texts.select("f.o", F.col("f.o.row").alias("node"), "f.fp", "f.bands", "f.size"), "texts")
    marks = written(texts.groupBy("fp").agg(F.min("o")["row"].alias("head")), "marks")
    x, y = (marks.select(F.col("fp").alias(n), F.col("head").alias(f"h{n}")) for n in ("a", "b"))
    close = links(marks).join(x, "a").join(y, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    close = written(close.unionByName(texts.join(marks, "fp").where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))), "close")
    shared = _shared(texts)
    least_of = shared.groupBy("band").agg(F.min("node").alias("a"))
    linked = shared.join(least_of, "band").select("a", F.col("node").alias("b"))
    homes = written(components(close.unionByName(linked)).select("node", F.col("root").alias("home")), "homes")
    members = written(texts.join(homes, "node").select("home", "node", "o", "fp", "bands", "size"), "members")
    large = written(members.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("sizes")).where((F.col("n") > HOME) | (F.col("sizes") > HOME_SHINGLES)).select("home"), "large")
    whole = rows.select(F.col(row).alias("node"), F.col(text).alias("text"))
    small = members.join(large, "home", "left_anti")
    met = _met(whole, small.select("node"), small.count())
    roots = small.select("home", "node", "fp", "bands").join(met, "node").groupBy("home").applyInPandas(_home(shingle, least), "node bigint, root bigint")
    roots = written(roots, "roots")
    if not large.isEmpty():
        many = written(members.join(large, "home", "left_semi"), "many")
        roots = roots.unionByName(_large(many, close.join(many.select(F.col("node").alias("a")), "a", "left_semi"), whole, shingle, least))
    kept = texts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("o").alias("o"))
    release(rows.sparkSession)
    return kept.select(F.col("o.row").alias("row"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, by representatives: five-word shingles, similarity 0.8
    or more. Null and empty texts are one group; rows without a doc_id stay only where no other of their
    group has one; of repeated rows one stays; extra columns, whatever they are called, stay as they are;
    an empty table gives no rows."""
    rows = numbered(docs)
    keep = representatives(rows, "__row", column_of(docs, "text"), column_of(docs, "doc_id"))
    gone = written(rows.select("__row").join(keep.withColumnRenamed("row", "__row"), "__row", "left_anti"), "gone")
    # most rows stay: where few go, their numbers are broadcast, so that no text is shuffled
    left = rows.join(F.broadcast(gone) if gone.count() <= 2 * MOST_PAIRS else gone, "__row", "left_anti")
    return left.select(*named_as(left, docs))
