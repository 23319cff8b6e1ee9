"""Model answers read into rows, fused texts with a fallback, and ranked suggestions that learn from choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest

#: What a model may say of an item beside its text; any other code reads as "?".
CODES = ("k", "s", "m", "c", "u")
#: How many candidates are kept for a word at most.
MOST = 5


def array_of(response: Column) -> Column:
    """The items of the JSON array in an answer, each as JSON text: what stands from the first [ to the last ],
    less a fence of back quotes around the whole. Null where there is none or it is broken."""
    text = F.trim(F.coalesce(response, F.lit("")))
    unfenced = F.regexp_replace(F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(F.lit("")), r"(?s)```(?:(?!```).)*$", "")
    text = F.when(text.startswith("```"), unfenced).otherwise(text)
    body = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(body != "", F.from_json(body, "array<string>", {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false"}))


def parsed(answers: DataFrame, codes: tuple[str, ...] = CODES) -> tuple[DataFrame, DataFrame]:
    """(texts, problems) of answers (window, response, ids: array of longs).

    texts: window, id, text, code, one row for each id that was asked for; text and code are null for an id
    that the answer lacks. Of an id given twice the last counts. problems: window, problem, n, one row for
    each way in which an answer breaks the contract: `unreadable`, `malformed` items (no object, or none
    with an id), `bad_id`, `repeated`, `missing`, `unexpected`. Nothing is guessed.
    """
    items = answers.select("window", "ids", array_of(F.col("response")).alias("items"))
    each = items.select("window", F.posexplode("items").alias("at", "item"))
    field = lambda name: F.get_json_object("item", f"$.{name}")
    code = F.lower(F.trim(F.coalesce(field("c"), F.lit(""))))
    each = each.select(
        "window", "at", (F.col("item").rlike(r"(?s)^\s*\{") & F.col("item").rlike(r'"id"\s*:')).alias("whole"), F.when(F.trim(field("id")).rlike(r"^[+-]?\d{1,18}$"), F.trim(field("id")).cast("long")).alias("id"),
        F.trim(F.coalesce(field("t"), F.lit(""))).alias("text"), F.when(code.isin(*codes), code).otherwise("?").alias("code"),
    )
    good = each.where("whole and id is not null")
    said = good.groupBy("window", "id").agg(F.max_by(F.struct("text", "code"), "at").alias("s"), F.count("*").alias("times"))
    asked = items.select("window", F.explode(F.array_distinct("ids")).alias("id"), F.lit(True).alias("asked"))
    both = asked.join(said, ["window", "id"], "full_outer")
    texts = both.where("asked").select("window", "id", "s.text", "s.code")

    count = lambda rows, name: rows.groupBy("window").agg(F.count("*").alias("n")).select("window", F.lit(name).alias("problem"), "n")
    problems = count(items.where("items is null"), "unreadable")
    for rows, name in (
        (each.where("not whole"), "malformed"), (each.where("whole and id is null"), "bad_id"), (said.where("times > 1"), "repeated"),
        (both.where("asked and s is null").join(items.where("items is not null").select("window"), "window", "left_semi"), "missing"), (both.where("asked is null"), "unexpected"),
    ):
        problems = problems.unionByName(count(rows, name))
    return texts, problems


def fused(records: DataFrame, texts: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """records (segment, window, id) with `text`, `code` and `by`: the fused text where the answer has one
    that is not empty (`fused`), else that of the segment's first hypothesis (segment, rank, kind, text), an
    earlier fusion before recognisers (`earlier`, `recogniser`), else an empty one (`none`)."""
    order = [F.desc(F.col("kind") == "fusion"), F.col("rank")]
    best = latest(hypotheses, ["segment"], *order).select("segment", F.col("text").alias("other"), F.col("kind"))
    of = records.join(texts, ["window", "id"], "left").join(best, "segment", "left")
    has = F.coalesce(F.col("text") != "", F.lit(False))
    by = F.when(has, "fused").when(F.col("kind").isNull(), "none").when(F.col("kind") == "fusion", "earlier").otherwise("recogniser")
    return of.select("segment", "window", "id", F.when(has, F.col("text")).otherwise(F.coalesce("other", F.lit(""))).alias("text"), F.when(has, F.col("code")).alias("code"), by.alias("by"))


def word_key(word: Column) -> Column:
    return F.lower(F.trim(word))


def variants(word: Column) -> Column:
    """Spellings of a romanized word, likeliest first: as it is, with the final vowel doubled if it is an a,
    with the vowel that casual spelling drops if it ends in none. None for an empty word, or one with other
    letters than ASCII."""
    key = word_key(word)
    doubled = F.when(key.endswith("a") & ~key.endswith("aa"), F.array(F.concat(key, F.lit("a")))).otherwise(F.array().cast("array<string>"))
    added = F.when(~F.substring(key, -1, 1).isin(*"aeiou"), F.array(F.concat(key, F.lit("a")))).otherwise(F.array().cast("array<string>"))
    return F.when((key != "") & ~key.rlike(r"[^\x00-\x7F]"), F.concat(F.array(key), doubled, added)).otherwise(F.array().cast("array<string>"))


def suggested(words: DataFrame, provider: DataFrame, cache: DataFrame, most: int = MOST) -> DataFrame:
    """(word, candidates, by, hits): for each different word (by word_key; n: how often it was asked) its ranked candidates. A word of the
    cache (word, candidates, by, hits) is answered from it, and counts the times it was asked as hits;
    another takes those of its variants from the provider (form, scheme, candidate), variants in order and
    then schemes, each candidate once, none that is the form itself. Words without any are left out. The
    result is the cache of the next run, less what it did not ask for."""
    asked = words.select(word_key(F.col("word")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    known = asked.join(cache, "word").select("word", F.slice("candidates", 1, most).alias("candidates"), "by", (F.col("hits") + F.col("n")).alias("hits"))
    new = asked.join(cache.select("word"), "word", "left_anti")
    forms = new.select("word", F.posexplode(variants(F.col("word"))).alias("variant", "form"))
    found = forms.join(provider, "form").where((F.col("candidate") != "") & (F.col("candidate") != F.col("form")))
    first = found.groupBy("word", "candidate").agg(F.min(F.struct("variant", "scheme")).alias("place"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("place", "candidate"))).where(F.col("rank") <= most)
    listed = ranked.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]).alias("candidates"))
    return known.unionByName(listed.select("word", "candidates", F.lit("provider").alias("by"), F.lit(0).cast("long").alias("hits")))


def learned(cache: DataFrame, choices: DataFrame, most: int = MOST) -> DataFrame:
    """The cache (word, candidates, by, hits) after choices (word, chosen, at): what was chosen for a word
    comes first, what was chosen later before what was chosen earlier, then what the cache had, `most` in
    all. Words that the cache lacks are added, by `correction`. A choice of nothing changes nothing."""
    made = choices.select(word_key(F.col("word")).alias("word"), "chosen", "at").where("word <> '' and chosen <> ''").groupBy("word", "chosen").agg(F.max("at").alias("at"))
    newest = made.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("at"), "chosen"))).where(F.col("k") <= most)
    listed = newest.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "chosen"))), lambda x: x["chosen"]).alias("first"))
    none = F.array().cast("array<string>")
    both = cache.join(listed, "word", "full_outer")
    candidates = F.slice(F.array_distinct(F.concat(F.coalesce("first", none), F.coalesce("candidates", none))), 1, most)
    return both.select("word", candidates.alias("candidates"), F.coalesce("by", F.lit("correction")).alias("by"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))
