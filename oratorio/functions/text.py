"""Text functions that stay in the JVM: scripts, loops, code-mixing, sets of tokens, URLs, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI = "[\\u0900-\\u097F]"
LATIN = "[A-Za-z]"


def script(token: Column) -> Column:
    """dev, lat, mix or none by the letters a token has."""
    dev, lat = token.rlike(DEVANAGARI), token.rlike(LATIN)
    return F.when(dev & lat, "mix").when(dev, "dev").when(lat, "lat").otherwise("none")


def words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


#: White space of Unicode, as a class of patterns.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^\\p{L}\\p{M}\\p{N}]+", " ")), " "), lambda w: w != "")


def ngram_counts(tokens: Column, n: int) -> Column:
    """How often the most frequent n-gram stands in the tokens; 0 with fewer than n. The n-grams are the
    tokens beside themselves, moved by one each time: the tokens are made n times, not once an n-gram."""
    some = F.greatest(F.coalesce(F.size(tokens), F.lit(0)) - (n - 1), F.lit(0))
    beside = F.arrays_zip(*[F.slice(tokens, F.lit(k + 1), some).alias(f"t{k}") for k in range(n)])
    ordered = F.sort_array(F.transform(beside, lambda x: F.concat_ws(" ", *[x[f"t{k}"] for k in range(n)])))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, g: Column) -> Column:
        run = F.when(g == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(g.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.coalesce(F.aggregate(ordered, start, step, lambda a: a["best"]), F.lit(0))


def is_loop(text: Column, n: int = 3, times: int = 5) -> Column:
    return ngram_counts(words(text), n) >= times


def latin_share(text: Column) -> Column:
    """The share of words with a letter that have one of a to z; 0 without words."""
    own = F.filter(words(text), lambda w: w.rlike("\\p{L}"))
    return F.coalesce(F.try_divide(F.size(F.filter(own, lambda w: w.rlike(LATIN))).cast("double"), F.nullif(F.size(own), F.lit(0))), F.lit(0.0))


def devanagari_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[\\u0900-\\u097F&&\\p{L}]")).cast("double"), F.nullif(letters, F.lit(0))), F.lit(0.0))


def code_mixing(tags: Column) -> Column:
    """100 * (n - largest) / n over language tags; 0 without tags."""
    n = F.size(tags)
    largest = F.array_max(F.transform(F.array_distinct(tags), lambda t: F.size(F.filter(tags, lambda x: x == t))))
    return F.coalesce(F.try_divide(100.0 * (n - largest), F.nullif(n, F.lit(0))), F.lit(0.0))


def switch_points(tags: Column) -> Column:
    pairs = F.zip_with(F.slice(tags, F.lit(1), F.greatest(F.size(tags) - 1, F.lit(0))), F.slice(tags, F.lit(2), F.greatest(F.size(tags) - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.when(longer > 0, longer))


def orphan_rate(seed: Column, others: Column) -> Column:
    """The share of the seed's tokens that no other system has (others: array of token arrays)."""
    n = F.size(seed)
    orphans = F.size(F.filter(seed, lambda t: ~F.exists(others, lambda o: F.array_contains(o, t))))
    return F.coalesce(F.try_divide(orphans.cast("double"), F.nullif(n, F.lit(0))), F.lit(0.0))


def roman_gap(seed: Column, others: Column, most: int = 4) -> Column:
    """Latin tokens that all other systems have and the seed lacks, as a share of `most`, at most 1."""
    first = F.get(others, F.lit(0))
    shared = F.aggregate(others, F.array_distinct(first), lambda a, o: F.array_intersect(a, o))
    missing = F.filter(F.array_except(shared, seed), lambda t: t.rlike(LATIN))
    return F.when(F.size(others) > 0, F.least(F.lit(1.0), F.size(missing) / F.lit(float(most)))).otherwise(0.0)


def normalized_checksum(x: Column) -> Column:
    """Lower-case hex without a leading algorithm name."""
    return F.regexp_replace(F.lower(F.trim(x)), "^[a-z0-9]+:", "")


def video_id(url: Column) -> Column:
    """The 11-character id of a watch, short, embed or share link; null for others."""
    found = F.regexp_extract(url, "(?:v=|youtu\\.be/|/embed/|/shorts/|/live/)([A-Za-z0-9_-]{11})(?:[?&#/]|$)", 1)
    return F.nullif(found, F.lit(""))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without www., path without a trailing slash, no query or fragment."""
    host = F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), "^www\\.", "")
    return F.concat(F.lit("https://"), host, F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", ""))


def path_safe(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^\\p{L}\\p{N}\\p{M}._-]+", "_"), "^_+|_+$", "")


def channel_of(name: Column) -> Column:
    """A file name's channel: the stem, safe for paths, less a trailing number."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "\\\\", "/"), "^.*/", ""), "\\.[^.]*$", "")
    source = path_safe(stem)
    return F.coalesce(F.nullif(F.regexp_replace(source, "_[0-9]+$", ""), F.lit("")), source)


def channel_blocked(channel: Column, blocked: list[str]) -> Column:
    name = F.lower(F.regexp_replace(channel, "_", " "))
    names = [b.strip().lower() for b in blocked if b.strip()]
    out = F.lit(False)
    for b in names:
        out = out | name.contains(b)
    return out
