"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

A document is the sequence of its non-blank lines, trimmed; blank lines stay where they are. Two lines in
a row are a gram, and of each two grams in a row the least hash is selected (the last of equal ones):
whatever two documents share of three lines, they share a selected gram. A line of at least ``long_words`` words is selected by itself. Each selected place is joined with the first place, by
doc_id and then by line, where the same is selected. Places of one pair of documents at one distance are
a diagonal: both documents are compared line by line from the first to the last of them, and on to both
sides while lines are equal. Of what is equal there, two lines in a row or a long line go from the later
place; the first occurrence stays.

All diagonals of a pair of documents are one row, which has both documents' lines once, the earlier one's
as far as the later one can reach. Where there are more than a few, how far lines are equal is found by
blocks of 1, 2, 4, ... lines, each known by a hash made of two of half its length, so that a line repeated n
times costs n steps of log n and not n diagonals of n lines. Equal lines and blocks are told by 64 bits of a hash. What goes is kept as
spans, which are merged before they become lines.

Counts and first places are aggregated before they are shuffled and written before they are joined, so
that a line in a third of all documents costs a row a task, and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, column_of, discard, named_as, numbered, table, written

#: Lines compared at once first; diagonals of a pair of documents up to which its lines are compared one by one.
STEP, FEW = 16, 4


def hashed_lines(rows: DataFrame, row: str, text: str, doc_id: str, long_words: int) -> DataFrame:
    """Rows (row, doc_id, h, i, long), arrays with a value for each line that is not blank: its hash, its
    index and whether it is long."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, "^[\\s]+|[\\s]+$", "")))
    numbered_ = F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: x["s"] != "")
    hashed = F.transform(numbered_, lambda x: F.struct(x["i"].alias("i"), F.md5(x["s"].cast("binary")).alias("h"), (F.regexp_count(x["s"], F.lit(WORD)) >= long_words).alias("long")))
    per = rows.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), hashed.alias("x"))
    return per.select("row", "doc_id", F.col("x.h").alias("h"), F.col("x.i").alias("i"), F.col("x.long").alias("long"))


def selected(lines: DataFrame) -> DataFrame:
    """Rows (g, row, doc_id, at, size): the selected grams and long lines with their places."""
    n = F.size("h")
    grams = F.when(n > 1, F.zip_with(F.slice("h", F.lit(1), n - 1), F.slice("h", F.lit(2), n - 1), lambda a, b: F.md5(F.concat(a, b).cast("binary")))).otherwise(F.array().cast("array<string>"))
    rows = lines.select("row", "doc_id", "h", "long", grams.alias("g"))

    def least(g: Column, k: Column) -> Column:
        # of a window of two: not above the one before, or below the one behind
        return (F.size("g") == 1) | F.coalesce(g <= F.get("g", k - 1), F.lit(False)) | F.coalesce(g < F.get("g", k + 1), F.lit(False))

    chosen = F.filter(F.transform("g", lambda g, k: F.struct(F.when(least(g, k), g).alias("g"), k.cast("int").alias("at"), F.lit(2).alias("size"))), lambda x: x["g"].isNotNull())
    alone = F.filter(F.zip_with("h", F.transform("long", lambda x, k: F.struct(x.alias("long"), k.alias("k"))), lambda h, x: F.struct(F.when(x["long"], F.concat(F.lit("line "), h)).alias("g"), x["k"].cast("int").alias("at"), F.lit(1).alias("size"))), lambda x: x["g"].isNotNull())
    return rows.select("row", "doc_id", F.inline(F.concat(chosen, alone)))


def _blocks(h: Column) -> Column:
    """Level k of the result has a hash for each 2**k lines in a row, by where they start; levels as long as
    there are such blocks, at least one level."""
    n = F.size(h)
    levels = F.when(n >= 2, F.sequence(F.lit(1), F.floor(F.log2(n)).cast("int"))).otherwise(F.array().cast("array<int>"))

    def longer(made: Column, k: Column) -> Column:
        last = F.element_at(made, -1)
        half = F.pow(F.lit(2), k - 1).cast("int")
        left = F.greatest(F.size(last) - half, F.lit(0))
        return F.array_append(made, F.zip_with(F.slice(last, F.lit(1), left), F.slice(last, half + 1, left), lambda x, y: F.xxhash64(x, y)))

    return F.aggregate(levels, F.array(h), longer)


def _common(a: Column, b: Column, at: Column, to: Column, back: bool = False) -> Column:
    """How many lines are equal from places at of a and to of b on, or before them; a and b are blocks."""
    top = F.least(F.size(a), F.size(b)) - 1

    def step(n: Column, k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("int")
        x, y = (at - n - size, to - n - size) if back else (at + n, to + n)
        same = F.get(F.get(a, k), x) == F.get(F.get(b, k), y)
        return F.when(F.coalesce(same, F.lit(False)), n + size).otherwise(n)

    return F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), step)


def _equal(a: Column, b: Column, at: Column, to: Column, back: bool = False) -> Column:
    """_common of plain arrays, line by line; first by a short step."""
    n = F.least(at, to) if back else F.least(F.size(a) - at, F.size(b) - to)

    def run(m: Column) -> Column:
        m = F.greatest(m, F.lit(0))
        x, y = (F.reverse(F.slice(c, F.greatest(k - m, F.lit(0)) + 1, m)) if back else F.slice(c, F.greatest(k, F.lit(0)) + 1, m) for c, k in ((a, at), (b, to)))
        return F.array_position(F.zip_with(x, y, lambda p, q: p == q), F.lit(False)).cast("int")

    short = run(F.least(n, F.lit(STEP)))
    whole = F.when(n > STEP, run(n)).otherwise(0)
    return F.when(short > 0, short - 1).when(whole > 0, whole - 1).otherwise(F.greatest(n, F.lit(0)))


def _spans(x: Column) -> Column:
    """The spans of places that go by a diagonal x (d, lo, hi), from the columns mine, its, long and off: where
    its begins in the earlier document."""
    lo, hi, d = x["lo"], x["hi"], x["d"]
    other = lambda at: at - d - F.col("off")
    one, two = F.get("mine", F.lit(0)), F.get("its", F.lit(0))
    run = lambda at, to, back=False: F.when(F.col("many"), _common(F.col("mine"), F.col("its"), at, to, back)).otherwise(_equal(one, two, at, to, back))
    start = lo - run(lo, other(lo), True)
    end = hi + run(hi + 1, other(hi + 1))
    inner = run(lo, other(lo))
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    same = lambda k: (k >= start) & (k <= end) & F.coalesce(F.get(one, k) == F.get(two, other(k)), F.lit(False))
    goes = lambda k: same(k) & (same(k - 1) | same(k + 1) | F.coalesce(F.get("long", k), F.lit(False)))
    apart = F.concat(F.array(span(start, lo)), F.transform(F.filter(F.sequence(lo, hi), goes), lambda k: span(k, k)), F.array(span(hi, end)))
    apart = F.filter(apart, lambda s: (s["a"] < s["b"]) | ((s["a"] >= lo) & (s["a"] <= hi) & goes(s["a"])))
    return F.when((inner > hi - lo) & (end > start), F.array(span(start, end))).otherwise(apart)


def repeated_lines(rows: DataFrame, row: str, text: str, doc_id: str, long_words: int = 50) -> DataFrame:
    """Rows (row, lines): the sorted indexes, from 0, of the lines of a document that go. Documents are in
    the order of doc_id, nulls last, and row."""
    lines = written(hashed_lines(rows, row, text, doc_id, long_words), "lines")
    places = written(selected(lines), "selected")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    first = written(places.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("g", F.col("first.row").alias("a"), F.col("first.at").alias("a_at")), "first")
    later = places.join(first, "g").where("row <> a or at <> a_at")
    diagonals = later.groupBy("row", "a", (F.col("at") - F.col("a_at")).alias("d")).agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("size") - 1).alias("hi"))
    diagonals = written(diagonals, "diagonals")
    discard(places, first)
    pairs = diagonals.groupBy("row", "a").agg(F.collect_list(F.struct("d", "lo", "hi")).alias("x"))
    short = F.transform("h", lambda h: F.xxhash64(h))
    own, other = lines.select("row", short.alias("own"), "long"), lines.select(F.col("row").alias("a"), short.alias("other"))
    both = pairs.join(own, "row").join(other, "a")
    # of the earlier document what the later one can reach along its diagonals
    ds = F.transform("x", lambda x: x["d"])
    both = both.withColumn("off", F.greatest(F.lit(0), -F.array_max(ds))).withColumn("until", F.least(F.size("other"), F.size("own") - F.array_min(ds)))
    many = F.size("x") > FEW
    blocks = lambda h: F.when(many, _blocks(h)).otherwise(F.array(h))
    both = both.select("row", "x", "long", "off", many.alias("many"), blocks(F.col("own")).alias("mine"), blocks(F.slice("other", F.col("off") + 1, F.greatest(F.col("until") - F.col("off"), F.lit(0)))).alias("its"))
    spans = both.select("row", F.explode(F.flatten(F.transform("x", _spans))).alias("s")).select("row", "s.a", "s.b").distinct()
    earlier = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    merged = spans.withColumn("a", F.greatest("a", F.coalesce(F.max("b").over(earlier) + 1, F.lit(0)))).where("a <= b")
    gone = merged.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(F.sequence("a", "b")))).alias("at"))
    return gone.join(lines.select("row", "i"), "row").select("row", F.transform("at", lambda k: F.get("i", k)).alias("lines"))


def without_lines(text: Column, lines: Column) -> Column:
    """The text less the lines with these indexes; as it is where lines is null."""

    def kept(parts: Column) -> Column:
        # what stands between each two of the lines that go, which are in order
        last = lambda k: F.coalesce(F.get(lines, k - 1), F.lit(-1))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines)), lambda k: F.slice(parts, last(k) + 2, F.coalesce(F.get(lines, k), F.size(parts)) - last(k) - 1)))

    # split once, not for each line
    left = F.transform(F.array(F.split(text, "\n")), kept)[0]
    return F.when(lines.isNull(), text).otherwise(F.array_join(left, "\n"))


def without_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", long_words: int = 50) -> DataFrame:
    """docs with the repeated runs of lines taken out of the text; all rows and columns stay.

    Null texts stay null, and empty ones empty. A text without a repeated run is unchanged to the byte.
    Of rows with one doc_id, or without one, the first to be numbered is the earlier; rows without a
    doc_id are later than all others. Other columns, n_chars too, are left as they are.
    """
    rows = numbered(docs)
    at = column_of(docs, text)
    gone = repeated_lines(rows, "__row", at, column_of(docs, doc_id), long_words).withColumnRenamed("row", "of")
    joined = rows.join(gone, rows["__row"] == gone["of"], "left")
    joined = joined.withColumn(at, without_lines(F.col(at), F.col("lines")))
    return joined.select(*named_as(joined, docs))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the lines removed, and the SHA-256 of the text that stays. Null texts count
    as empty: one line, none removed. Order and ties as in without_repeated_lines; repeated rows come out
    as often as they stand, extra columns are ignored, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = numbered(docs)
    gone = repeated_lines(rows, "__row", "c1", "c0").withColumnRenamed("row", "of")
    joined = rows.join(gone, rows["__row"] == gone["of"], "left")
    whole = F.coalesce(F.col("c1"), F.lit(""))
    return joined.select(F.col("c0").alias("doc_id"), F.size(F.split(whole, "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(without_lines(whole, F.col("lines")), 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """without_repeated_lines, with n_chars made anew where docs have it (null for null texts). Rows stay,
    also those of which no line is left; nulls, ties, repeated rows and other columns as it says."""
    out = without_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


#: DuckDB over the whole table, by the definition above.
OP6_SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS p FROM documents
), lines AS (
  SELECT doc_id, i - 1 AS line, trim(regexp_replace(p[i], '^[\s]+|[\s]+$', '', 'g')) AS s
  FROM parts, unnest(range(1, len(p) + 1)) AS u(i)
), body AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos, md5(s) AS h,
    len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 50 AS long
  FROM lines WHERE s <> ''
), pairs AS (
  SELECT doc_id, pos, md5(h || lead(h) OVER (PARTITION BY doc_id ORDER BY pos)) AS g FROM body
), beside AS (
  SELECT *, lag(g) OVER w AS before, lead(g) OVER w AS behind FROM pairs WHERE g IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), places AS (
  SELECT doc_id, pos, 2 AS size, g FROM beside WHERE (before IS NULL AND behind IS NULL) OR coalesce(g <= before, false) OR coalesce(g < behind, false)
  UNION ALL
  SELECT doc_id, pos, 1, 'line ' || h FROM body WHERE long
), dated AS (
  SELECT *, first_value(doc_id) OVER w AS a, first_value(pos) OVER w AS a_pos FROM places WINDOW w AS (PARTITION BY g ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), diagonals AS (
  SELECT doc_id, a, pos - a_pos AS d, min(pos) AS lo, max(pos + size - 1) AS hi FROM dated WHERE doc_id <> a OR pos <> a_pos GROUP BY ALL
), cells AS (
  SELECT x.*, b.pos, b.line, b.long, b.h = o.h AS same
  FROM diagonals x JOIN body b ON b.doc_id = x.doc_id JOIN body o ON o.doc_id = x.a AND o.pos = b.pos - x.d
), reach AS (
  SELECT doc_id, a, d, coalesce(max(pos) FILTER (NOT same AND pos < lo), -1) AS low, coalesce(min(pos) FILTER (NOT same AND pos > hi), 1000000000) AS high FROM cells GROUP BY ALL
), inside AS (
  SELECT c.*, lag(same, 1, false) OVER w AS before, lead(same, 1, false) OVER w AS behind
  FROM cells c JOIN reach r ON c.doc_id = r.doc_id AND c.a = r.a AND c.d = r.d AND c.pos > low AND c.pos < high WINDOW w AS (PARTITION BY c.doc_id, c.a, c.d ORDER BY c.pos)
), gone AS (
  SELECT DISTINCT doc_id, line FROM inside WHERE same AND (before OR behind OR long)
), per AS (
  SELECT doc_id, list(line) AS g FROM gone GROUP BY doc_id
)
SELECT parts.doc_id, CAST(len(p) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  CASE WHEN g IS NULL THEN sha256(text) ELSE sha256(array_to_string([p[i + 1] FOR i IN range(len(p)) IF NOT list_contains(g, i)], chr(10))) END AS kept_sha256
FROM parts LEFT JOIN per USING (doc_id)
"""
