"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a set of weighted terms: its shingles of five words (fewer words: the whole sequence),
lower-cased, each weighing how often it stands in the document. For each of the samples, a term
draws r and c from Gamma(2, 1) and b from U(0, 1), all from hashes of the term, and with its weight w

    t = floor(ln w / r + b),   a = c * exp(-r * (t - b + 1)),

and the document keeps the (term, t) of the least a. Two documents keep the same one with the
probability of their generalised Jaccard similarity, the weight of what they share by the weight of
what either has. The fingerprint is the hashes of what is kept; likeness is the share of equal places.

Terms are counted within the row of their document, in sorted arrays, so nothing more is shuffled. The
draws of a term that a document and its edited version have equally often are made once, and a term
whose a is surely not the least of its text is not drawn in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, shuffles, table, written

SAMPLES = 56
SHINGLE = 5
LOW32 = 0xFFFFFFFF
#: Hex digits of a fingerprint for each sample.
DIGITS = 4
#: A document without terms keeps nothing; every place then reads as this.
NOTHING = 0
#: The least a of a text of weight W is exponential with rate W, so it is above REACH / W with probability
#: exp(-REACH), below 1e-15: a term whose a must be above that is not drawn in full.
REACH = 36.0


def _draw(h: Column, log_n: Column, near: Column, k: int) -> Column:
    """What the term gives for sample k: the rank of a in the upper bits, the hash of (term, t) below;
    null where a is surely above n * near.

    With x = exp(-r) and f the fraction of ln n / r + b, a is c / n * x ** (1 - f). Bounds from below
    that need no logarithm are tried first: -ln v >= 4 (1 - sqrt v) / (1 + sqrt v), and x ** (1 - f) >=
    x / (f x + 1 - f), where f is b if n is 1; else f >= 0.
    """
    p, q = F.xxhash64(h, F.lit(2 * k)), F.xxhash64(h, F.lit(2 * k + 1))
    u1, u2, u3 = (F.shiftrightunsigned(p, s).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5 for s in (0, 21, 42))
    x, b = u1 * u2 * F.lit(2.0**-42), u3 * F.lit(2.0**-21)
    v = (q.bitwiseAND(F.lit(LOW32)) + 0.5) * (F.shiftrightunsigned(q, 32) + 0.5) * F.lit(2.0**-64)
    root = F.sqrt(v)
    part = F.when(log_n == 0, b).otherwise(0.0)
    r = -F.ln(x)
    t = F.floor(log_n / r + b)
    log_a = F.ln(-F.ln(v)) - r * (t - b + 1)
    rank = F.greatest(F.lit(0), F.least(F.lit((1 << 31) - 1), ((log_a + 400.0) * float(1 << 22)).cast("long")))
    return F.when(4 * (1 - root) * x <= near * (1 + root) * (part * x + 1 - part), F.shiftleft(rank, 32) + F.xxhash64(h, t, F.lit(k)).bitwiseAND(F.lit(LOW32)))


def word_codes(text: Column) -> Column:
    """An array of longs: the hash of each word."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_codes(codes: Column) -> Column:
    """The hash of each SHINGLE words in a row; a sequence with fewer is one, none gives none. The low
    two bits are 0."""
    n = F.greatest(F.size(codes) - (SHINGLE - 1), F.least(F.size(codes), F.lit(1)))
    rows = F.arrays_zip(*[F.slice(codes, i + 1, n).alias(f"w{i}") for i in range(SHINGLE)])
    return F.transform(rows, lambda w: F.xxhash64(*[w[f"w{i}"] for i in range(SHINGLE)]).bitwiseAND(F.lit(~3)))


TERMS = "array<struct<h:bigint,part:int,n:int>>"


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys..., h, part) with terms instead of h and part, arrays of one length: h has a hash for
    each shingle, and part is 0 for those of both texts, 1 for the own and 2 for the edited one's. terms
    are (h, part, n): n is how often h stands in the text, part is 0 where that is the same for both."""
    # most texts have every shingle once: nothing to count. Each column is read more than once below,
    # so that Spark does not move its making into the lambdas
    again = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(again, F.sort_array(F.zip_with("h", "part", lambda h, p: h.bitwiseOR(p.cast("long"))))))
    new = lambda x, i: F.when((i == 0) | (F.get("s", i - 1).bitwiseAND(F.lit(~3)) != x.bitwiseAND(F.lit(~3))), i).otherwise(-1)
    rows = rows.withColumn("starts", F.filter(F.transform("s", new), lambda i: i >= 0))

    def term(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("s"))
        return F.struct(F.get("s", at).bitwiseAND(F.lit(~3)).alias("h"), F.slice("s", at + 1, end - at).alias("g"))

    def row(part: int, h: Column, n: Column) -> Column:
        return F.struct(h.alias("h"), F.lit(part).alias("part"), n.alias("n"))

    def parts(t: Column) -> Column:
        own, edited = (F.size(F.filter(t["g"], lambda x: x.bitwiseAND(F.lit(3)) != other)) for other in (2, 1))
        return F.when(own == edited, F.array(row(0, t["h"], own))).otherwise(F.filter(F.array(row(1, t["h"], own), row(2, t["h"], edited)), lambda r: r["n"] > 0))

    several = F.flatten(F.transform(F.transform("starts", term), parts)).cast(TERMS)
    once = F.arrays_zip(F.col("h"), F.col("part"), F.array_repeat(F.lit(1), F.size("h")).alias("n")).cast(TERMS)
    return rows.select(*keys, F.when(F.col("s").isNotNull(), several).otherwise(once).alias("terms"))


def samples(rows: DataFrame, keys: list[str], n_samples: int = SAMPLES) -> DataFrame:
    """Rows (keys..., part, s0 ...) from rows (keys..., weight, terms): the least draw for each sample.
    weight is that of the text, or of the lighter of the two."""
    near = F.lit(REACH) * F.col("t.n") / F.greatest(F.col("weight"), F.lit(1))
    terms = rows.select(*keys, "weight", F.explode_outer("terms").alias("t")).select(*keys, F.coalesce("t.part", F.lit(0)).alias("part"), "t.h", F.ln(F.col("t.n").cast("double")).alias("log_n"), near.alias("near"))
    return terms.groupBy(*keys, "part").agg(*[F.min(_draw(F.col("h"), F.col("log_n"), F.col("near"), k)).alias(f"s{k}") for k in range(n_samples)])


def fingerprint_text(sample: list[Column]) -> Column:
    """DIGITS hex digits for each sample."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.coalesce(s.bitwiseAND(F.lit((1 << 4 * DIGITS) - 1)), F.lit(NOTHING))), DIGITS, "0")) for s in sample])


def likeness(a: Column, b: Column, n_samples: int = SAMPLES) -> Column:
    """The share of equal places of two fingerprints. Two without terms are equal."""
    place = lambda x, k: F.substring(x, DIGITS * k + 1, DIGITS)
    return sum(((place(a, k) == place(b, k)).cast("int") for k in range(1, n_samples)), (place(a, 0) == place(b, 0)).cast("int")) / float(n_samples)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_samples: int = SAMPLES) -> DataFrame:
    """Rows (doc_id, fingerprint), one a row of docs; null texts count as empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), shingle_codes(word_codes(F.coalesce(F.col(text), F.lit("")))).alias("h"))
    rows = rows.withColumn("part", F.array_repeat(F.lit(0), F.size("h"))).withColumn("weight", F.size("h"))
    keys = ["doc_id", "row"]
    out = samples(counted(rows, [*keys, "weight"]), keys, n_samples)
    return out.select("doc_id", fingerprint_text([F.col(f"s{k}") for k in range(n_samples)]).alias("fingerprint"))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids with next_id: the next greater doc_id, after the last the first. ids must be distinct.

    Ids are dealt by range; a window looks ahead within each range, and the last of a range takes the
    first of the next, from a table of one row a range.
    """
    dealt = written(ids.repartitionByRange(shuffles(ids.sparkSession), "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(F.lit(0))
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(whole.orderBy("part")), F.min("first").over(whole)).alias("after"))
    ahead = dealt.withColumn("lead", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return ahead.join(firsts, "part").select(*ids.columns, F.coalesce("lead", "after").alias("next_id"))


def with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (at, doc_id, next_id, n_chars, text, kept, ins), where the edited text is kept || ins. They are
    partitioned by `at`, a hash of the doc_id, or of the text of a row without one, which has no next
    document."""
    # both joins below read one exchange of the texts: it is by `at`, which is never null, and the ids
    # themselves are compared in a condition beside
    of = lambda c: F.xxhash64(c.cast("string"))
    same = F.col(doc_id).alias("doc_id")
    own = docs.select(same, F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(of(F.col("doc_id"))).alias("at"), "doc_id", "text")
    ids = next_ids(own.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n")))
    ids = written(ids, "next-ids")
    equal = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    wanted = ids.select(F.col("doc_id").alias("into"), "next_id", F.floor(F.col("n") / 4).cast("int").alias("m"), of(F.col("next_id")).alias("next_at"))
    parts = own.join(wanted, (F.col("at") == F.col("next_at")) & equal("doc_id", "next_id")).select("into", F.expr("substring(text, 1, m)").alias("ins"))
    parts = parts.groupBy("into").agg(F.min("ins").alias("ins")).select("into", of(F.col("into")).alias("into_at"), "ins")
    after = ids.select(F.col("doc_id").alias("d"), of(F.col("doc_id")).alias("d_at"), "next_id")
    joined = own.join(after, (F.col("at") == F.col("d_at")) & equal("doc_id", "d"), "left").join(parts, (F.col("at") == F.col("into_at")) & equal("doc_id", "into"), "left")
    q = "cast(floor(length(text) / 4) as int)"
    ins = F.when(F.col("doc_id").isNull(), "").otherwise(F.expr(f"substring(coalesce(ins, ''), 1, {q})"))
    return joined.select("at", "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), "text", F.expr(f"substring(text, 1, length(text) - {q})").alias("kept"), ins.alias("ins"))


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by edited_fingerprints; nulls, ties and repeated rows as it says."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row a row of docs, repeated ones included; null texts count as empty; an empty table gives no
    rows; other columns are ignored. Where a doc_id stands with several texts, the next document's part
    and fingerprint are the smallest of them. A row without doc_id has no next document: nothing is put
    in, and near_next is null. A single document is its own next one.
    """
    own = written(_signed(with_edits(docs, text, doc_id)), "fingerprints")
    after = own.groupBy(F.col("doc_id").alias("id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    return own.join(after, own["next_id"] == after["id"], "left").select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _signed(edits: DataFrame) -> DataFrame:
    """Both fingerprints of each edit. The aggregations keep the partitioning by `at`."""
    spaced = F.col("kept").rlike("[\\x20\\x09-\\x0D]\\z")
    keys = ["at", "doc_id", "row", "next_id", "n_chars", "sha"]
    step = edits.select(
        "at", "doc_id", F.monotonically_increasing_id().alias("row"), "next_id", "n_chars", F.unhex(F.sha2(F.concat("kept", "ins"), 256)).alias("sha"),
        word_codes(F.col("text")).alias("own"), F.regexp_count("kept", F.lit(WORD)).alias("n_kept"),
        F.when(spaced | (F.col("kept") == ""), F.col("ins")).otherwise(F.concat(F.substring_index(F.translate("kept", "\t\n\x0b\f\r", "     "), " ", -1), "ins")).alias("rest"),
        (~spaced & (F.col("kept") != "")).cast("int").alias("open"),
    )
    # the first `same` words are those of both texts; `rest` begins with the word that the cut is in
    step = step.withColumn("same", F.col("n_kept") - F.col("open")).withColumn("rest", word_codes(F.col("rest")))
    none = F.array().cast("array<bigint>")
    lead_in = F.slice("own", F.greatest(F.col("same") - (SHINGLE - 2), F.lit(1)), F.least(F.col("same"), F.lit(SHINGLE - 1)))
    tail = F.concat(F.when(F.col("same") > 0, lead_in).otherwise(none), "rest")
    step = step.withColumn("tail", F.when((F.size(tail) < SHINGLE) & (F.col("same") + F.size("rest") >= SHINGLE), none).otherwise(tail))
    step = step.withColumn("shingles", shingle_codes(F.col("own"))).withColumn("edited", shingle_codes(F.col("tail")))
    step = step.withColumn("both", F.greatest(F.col("same") - (SHINGLE - 1), F.lit(0)).cast("int"))
    part = F.concat(F.array_repeat(F.lit(0), F.col("both")), F.array_repeat(F.lit(1), F.size("shingles") - F.col("both")), F.array_repeat(F.lit(2), F.size("edited")))
    weight = F.least(F.size("shingles"), F.col("both") + F.size("edited"))
    rows = counted(step.select(*keys, F.concat("shingles", "edited").alias("h"), part.alias("part"), weight.alias("weight")), [*keys, "weight"])
    names = [f"s{k}" for k in range(SAMPLES)]
    parts = samples(rows, keys)
    merged = parts.groupBy(*keys).agg(*[F.min(F.when(F.col("part") != 2, F.col(s))).alias(f"a{s}") for s in names], *[F.min(F.when(F.col("part") != 1, F.col(s))).alias(f"b{s}") for s in names])
    return merged.select(*[k for k in keys if k not in ("at", "row")], fingerprint_text([F.col(f"a{s}") for s in names]).alias("fingerprint"), fingerprint_text([F.col(f"b{s}") for s in names]).alias("edited_fingerprint"))
