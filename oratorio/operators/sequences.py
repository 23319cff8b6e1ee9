"""Cuts of long sequences without a task that holds a whole one.

Running sums go over chunks of the order, whose totals are summed first. A cut that depends on where the one
before fell is a pointer from each row to the row behind the next cut; which rows are cuts follows by
doubling: rows reached by fewer than 2**k pointers, and pointers of 2**k steps, each from the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order in one chunk of a running sum.
CHUNK = 4096


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir. Where that is unset, a local session uses a
    folder in its warehouse; on a cluster executors might not share that, and it is an error."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", "")
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return df.checkpoint()


def running(rows: DataFrame, key: str, order: str, value: Column, chunk: int = CHUNK) -> DataFrame:
    """rows with `index`, their place from 0 in the order of their key, and `before`, the sum of the values
    that come earlier. order is a whole number without repeats within a key. A task holds a chunk of a key."""
    of = rows.withColumn("__value", value).withColumn("__chunk", F.floor(F.col(order) / chunk))
    earlier = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = of.groupBy(key, "__chunk").agg(F.sum("__value").alias("__sum"), F.count("*").alias("__n"))
    zero = F.lit(0).cast("long")
    starts = totals.select(key, "__chunk", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__from"), F.coalesce(F.sum("__n").over(earlier), zero).alias("__first"))
    within = Window.partitionBy(key, "__chunk").orderBy(order)
    before = F.coalesce(F.sum("__value").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = of.withColumn("__before", before).withColumn("__k", F.row_number().over(within) - 1).join(starts, [key, "__chunk"])
    return out.withColumn("index", F.col("__first") + F.col("__k")).withColumn("before", F.col("__from") + F.col("__before")).drop("__value", "__chunk", "__before", "__k", "__from", "__first")


def running_least(rows: DataFrame, key: str, order: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """rows with the least value up to each row in the order of its key, a chunk of a key a task."""
    of = rows.withColumn("__chunk", F.floor(F.col(order) / chunk))
    least = of.groupBy(key, "__chunk").agg(F.min(value).alias("__min"))
    earlier = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = least.select(key, "__chunk", F.min("__min").over(earlier).alias("__from"))
    within = Window.partitionBy(key, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = of.withColumn(name, F.min(value).over(within)).join(starts, [key, "__chunk"])
    return out.withColumn(name, F.least(F.col(name), "__from")).drop("__chunk", "__from")


def next_starts(summed: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, index, next): for rows with index, before and value (whole numbers from 0), the place behind
    the first row at which the values from this one on sum to the budget; rows that never reach it have no
    row. The first sum at or above a mark is looked for in the mark's bin of the sums, else it is the sum
    that enters the bins behind: no key is in one task, and a bin holds about a budget's worth of rows."""
    of = lambda x: F.floor(x / budget)
    after = F.col("before") + F.col("value")
    points = summed.select(key, of(after).alias("bin"), after.alias("at"), F.lit(1).alias("kind"), "index")
    marks = summed.select(key, of(F.col("before") + budget).alias("bin"), (F.col("before") + budget).alias("at"), F.lit(0).alias("kind"), "index")
    behind = Window.partitionBy(key, "bin").orderBy("at", "kind", "index").rowsBetween(0, Window.unboundedFollowing)
    found = points.unionByName(marks).withColumn("end", F.min(F.when(F.col("kind") == 1, F.col("index"))).over(behind)).where("kind = 0")
    entered = summed.where(of(after) > of(F.col("before"))).select(key, F.col("index").alias("entering"), F.explode(F.sequence(of(F.col("before")) + 1, of(after))).alias("bin"))
    entered = entered.withColumn("bin", F.col("bin") - 1)
    ends = found.join(entered, [key, "bin"], "left").select(key, "index", F.coalesce("end", "entering").alias("end"))
    return ends.where("end is not null").select(key, "index", (F.col("end") + 1).alias("next"))


def reached(pointers: DataFrame, key: str, from_: str = "index", to: str = "next") -> DataFrame:
    """(key, index): place 0 of each key and all places that its pointers lead to. As many rounds as the
    longest chain has binary digits; each is two joins of what is left."""
    jumps = cut_lineage(pointers.select(key, F.col(from_).alias("index"), F.col(to).alias("next")))
    found = cut_lineage(jumps.select(key).distinct().withColumn("index", F.lit(0).cast("long")))
    while not jumps.isEmpty():
        more = found.join(jumps, [key, "index"]).select(key, F.col("next").alias("index"))
        found = cut_lineage(found.unionByName(more))
        onward = jumps.select(key, F.col("index").alias("next"), F.col("next").alias("further"))
        jumps = cut_lineage(jumps.join(onward, [key, "next"]).select(key, "index", F.col("further").alias("next")))
    return found


def group_steps(rows: DataFrame, key: str, order: str, value: str, budget: float, unit: float = 1e-6) -> DataFrame:
    """rows with `step`: consecutive rows of a key in steps that end with the row at which their values
    reach the budget; the last step may not reach it. Values count in whole units and are not negative,
    null as 0; order is a whole number without repeats within a key."""
    whole = F.round(F.coalesce(F.col(value), F.lit(0.0)) / unit).cast("long")
    summed = cut_lineage(running(rows.select(key, order, whole.alias("value")), key, order, F.col("value")))
    starts = reached(next_starts(summed, key, max(1, round(budget / unit))), key).withColumn("cut", F.lit(1))
    marked = summed.select(key, order, "index").join(starts, [key, "index"], "left").select(key, order, F.when(F.col("index") == 0, 0).otherwise(F.coalesce("cut", F.lit(0))).alias("cut"))
    counted = running(marked, key, order, F.col("cut"))
    return rows.join(counted.select(key, order, (F.col("before") + F.col("cut")).cast("long").alias("step")), [key, order])


def balanced_windows(rows: DataFrame, key: str, order: str, words: str, target: int, most: int = 250) -> DataFrame:
    """rows with `window`: consecutive rows of a key in about total / target windows (and at least as many
    as rows / most), a new one where half of the next row's words passes the window's share; without any
    words, shares of rows.

    A row is in the least of: one window on from the row before it, and as many windows as shares have been
    passed; that is a running minimum. A key in which a window would hold more than `most` rows is walked
    row by row instead.
    """
    n_words = F.coalesce(F.col(words), F.lit(0)).cast("long")
    summed = running(rows.select(key, order, n_words.alias("words")), key, order, F.col("words"))
    total = summed.groupBy(key).agg(F.sum("words").alias("total"), F.count("*").alias("rows"))
    count = F.greatest(F.lit(1), F.ceil(F.col("total") / target) if target > 0 else F.lit(1), F.ceil(F.col("rows") / most))
    of = summed.join(total.withColumn("count", count), key)
    # boundaries k with k * share < before + words / 2, in whole numbers
    passed = F.when(F.col("total") > 0, F.expr("(count * (2 * before + words) - 1) div (2 * total)")).otherwise(F.floor(F.col("index") * F.col("count") / F.col("rows")))
    of = of.withColumn("lead", F.when(F.col("index") == 0, F.lit(0)).otherwise(passed) - F.col("index"))
    # no chunk is deeper than its rows: one more window a row at most
    least = running_least(of, key, order, "lead", "least").withColumn("window", F.least(F.col("least") + F.col("index"), F.col("count") - 1).cast("int"))
    large = least.groupBy(key, "window").agg(F.count("*").alias("n")).where(F.col("n") > most).select(key).distinct()
    walked = _walked(least.join(large, key, "left_semi").select(key, order, "words", "total", "rows", "count"), key, order, most)
    placed = least.join(large, key, "left_anti").select(key, order, "window").unionByName(walked)
    return rows.join(placed, [key, order])


def _walked(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        total, n, count = (int(pdf[c].iloc[0]) for c in ("total", "rows", "count"))
        at, held, before, out = 0, 0, 0, []
        for i, w in enumerate(pdf["words"].tolist()):
            passes = count * (2 * before + w) > 2 * total * (at + 1) if total else i * count >= n * (at + 1)
            if at < count - 1 and held and (passes or held >= most):
                at, held = at + 1, 0
            out.append(at)
            held += 1
            before += w
        return pd.DataFrame({key: pdf[key], order: pdf[order], "window": out})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, window int")


# --- fixed values: quantiles of how long two speak at once, in seconds ---------------------------------
WINDOW_SECONDS = ((0.0, 0.05), (0.1, 0.07), (0.2, 0.17), (0.3, 0.27), (0.4, 0.35), (0.5, 0.42), (0.6, 0.52), (0.7, 0.66), (0.8, 0.89), (0.9, 1.33), (0.95, 1.93), (0.99, 4.03), (1.0, 8.94))
# --------------------------------------------------------------------------------------------------------


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1, 1 excluded, that depends on the parts alone: the first 52 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def interpolated(u: Column, table: Sequence[tuple[float, float]]) -> Column:
    """The value at u of a table of (quantile, value), linear between its rows."""
    out = F.lit(table[-1][1])
    for (a, x), (b, y) in reversed(list(zip(table, table[1:], strict=False))):
        out = F.when(u < b, F.lit(x) + (u - a) * F.lit((y - x) / (b - a))).otherwise(out)
    return out


def random_windows(clips: DataFrame, clip: str, seconds: str, share: str, seed: int = 0, quantiles: Sequence[tuple[float, float]] = WINDOW_SECONDS, most_share: float = 0.6, overshoot: float | None = 1.5, spacing: float = 0.05, draws: int = 64) -> DataFrame:
    """clips with `windows`, an array of (start, length): drawn one after another until they cover `share`
    of the clip. A window that is longer than the clip, that would pass most_share of it or overshoot times
    its share, or that comes nearer than `spacing` to another, is drawn again; after `draws` the clip keeps
    what it has. Draws are digests of the clip, the seed and their number, so that reruns agree, and all is
    one expression of a row. A null length or share gives no windows."""
    length, goal = F.coalesce(F.col(seconds), F.lit(0.0)).cast("double"), F.coalesce(F.col(share), F.lit(0.0)).cast("double")
    cap = (F.lit(most_share) if overshoot is None else F.least(F.lit(most_share), F.lit(overshoot) * goal)) * length
    empty = F.struct(F.array().cast("array<struct<start:double,length:double>>").alias("windows"), F.lit(0.0).alias("total"))

    def draw(held: Column, k: Column) -> Column:
        of = lambda what: uniform(F.col(clip).cast("string"), F.lit(str(seed)), k.cast("string"), F.lit(what))
        d = interpolated(of("length"), quantiles)
        s = of("start") * (length - d)
        apart = ~F.exists(held["windows"], lambda w: (s < w["start"] + w["length"] + spacing) & (w["start"] < s + d + spacing))
        fits = (held["total"] < goal * length) & (held["total"] + d <= cap) & (d <= length) & apart
        new = F.struct(s.alias("start"), d.alias("length"))
        return F.when(fits, F.struct(F.array_append(held["windows"], new).alias("windows"), (held["total"] + d).alias("total"))).otherwise(held)

    return clips.withColumn("windows", F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), empty, draw)["windows"])
