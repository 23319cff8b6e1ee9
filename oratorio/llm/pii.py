"""Personal data by weak supervision, in DataFrame functions only.

Base spans are what the fixed patterns and checks find. Wider patterns give more candidate spans.
Labelers then vote for, against or not at all on each candidate: the shape (regex), known top-level
domains, calling codes and card issuers (gazetteer), words nearby (context), and checks of structure.
How often each combination of votes occurs is counted over all documents; expectation-maximisation
over these counts, which are at most KINDS * 3^4, estimates how reliable each labeler is and how
likely each combination is personal data. That is the target of the final classifier, which does not
see the votes: naive Bayes over the span's own shape, length and ends and the words beside it, hashed,
fitted to all candidates by sums of targets a feature, so that it can set right what labelers say of
spans that look like others. Base spans always stay.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "structure")

# The contract's patterns. Possessive repeats match the same and do not backtrack or recurse, and a run
# of characters is entered at its start or where the last match ended, so that long runs are linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What else may be personal data: obfuscated addresses, IPv6, other card separators, national numbers.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:[(\[{]\x20?at\x20?[)\]}]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_ -]?[0-9]{4}){2}[\x20./_ -]?[0-9]{3,4}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00[0-9]{1,3}|\([0-9]{2,5}\)|[0-9]{3,5})[\x20./-]?[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9])",
}
CONTEXT = {
    "email": "(?i)(e-?mail|mail|contact|correo|courriel|adresse|write to)",
    "ip": r"(?i)\b(ip|host|server|addr|address|ipv6|serveur|servidor)\b",
    "card": "(?i)(card|visa|master|amex|credit|cr[eé]dit|tarjeta|carte|karte|payment)",
    "phone": "(?i)(phone|tel|call|fax|mobile|cell|handy|m[oó]vil|portable|whatsapp|rufnummer)",
}
#: Against: what precedes names another kind of number.
AGAINST = r"(?i)(isbn|issn|order|invoice|version|serial|sku|page|zip|doi|article)\W*$"
# Generic top-level domains, and those of some countries; calling codes of one to three digits.
DOMAINS = "com|org|net|edu|gov|mil|int|io|info|biz|app|dev|ai|co|me|tv|ar|at|au|be|br|ca|ch|cl|cn|cz|de|dk|es|eu|fi|fr|gr|hu|ie|il|in|it|jp|kr|lu|mx|nl|no|np|nz|pe|pl|pt|ro|ru|se|sk|tr|ua|uk|us|za|example|test"
CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
NEAR = 24
ROUNDS = 50
BELIEF = (8, 2)
#: Features: so many hash buckets of each sort, and the sorts.
BUCKETS = 256
SORTS = ("shape", "before", "after", "length", "ends")
#: Steps of a running sum that are made at once; more are made from sums of so many.
CHUNK = 128


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    back = F.reverse(_digits(s))
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.substring(back, i, F.lit(1)).cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, "\\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(s)).between(12, 19) & _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["text"])


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


SPAN = "array<struct<start:int,kind:int,end:int,base:boolean,text:string,before:string,after:string>>"


def scanned(rows: DataFrame, name: str, values: Column, op, zero: Column) -> DataFrame:
    """rows with the running op (a sum, least or greatest) over an array of ints: chunks by themselves,
    from what the chunks before make, so that long arrays are not copied once an element."""
    rows = rows.withColumn("_v", values)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_v") - 1) / CHUNK).cast("int")), lambda c: F.slice("_v", c * CHUNK + 1, F.lit(CHUNK)))
    rows = rows.withColumn("_chunks", F.when(F.size("_v") > 0, chunks).otherwise(F.array().cast("array<array<int>>")))
    rows = rows.withColumn("_sums", F.transform("_chunks", lambda x: F.aggregate(x, zero, op)))
    rows = rows.withColumn("_bases", F.transform("_sums", lambda _, k: F.aggregate(F.slice("_sums", F.lit(1), k), zero, op)))

    def step(acc: Column, v: Column) -> Column:
        now = op(acc["at"], v)
        return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

    out = F.flatten(F.zip_with("_chunks", "_bases", lambda x, b: F.aggregate(x, F.struct(b.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])))
    return rows.withColumn(name, out).drop("_v", "_chunks", "_sums", "_bases")


def _placed(rows: DataFrame, name: str, pattern: str, kind: int, base: bool) -> DataFrame:
    """rows with the column of matches made spans (start, kind, end, base, text, before, after): they
    start where the pieces between them end, and what is beside them is the ends of those pieces."""
    some = F.size(name) > 0
    rows = rows.withColumn("_pieces", F.when(some, F.split("t", pattern, -1)).otherwise(F.array().cast("array<string>")))
    lengths = F.zip_with(F.slice("_pieces", F.lit(1), F.size(name)), F.col(name), lambda g, m: F.length(g) + F.length(m))
    rows = scanned(rows, "_ends", F.when(some, lengths).otherwise(F.array().cast("array<int>")), lambda a, x: a + x, F.lit(0))

    def span(m: Column, k: Column) -> Column:
        e = F.get("_ends", k)
        before, after = F.right(F.get("_pieces", k), F.lit(NEAR)), F.left(F.get("_pieces", k + 1), F.lit(NEAR // 2))
        return F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), F.lit(base).alias("base"), m.alias("text"), before.alias("before"), after.alias("after"))

    return rows.withColumn(name, F.when(some, F.transform(name, span)).otherwise(F.array().cast(SPAN))).drop("_pieces", "_ends")


def _votes(kind: int, s: Column, before: Column, after: Column) -> Column:
    """(regex, gazetteer, context, structure), each -1, 0 or 1. What merely does not fail a check is 0."""
    name, d = KINDS[kind], _digits(s)
    shape = F.when(s.rlike(f"\\A(?:{BASE[name]})\\z"), 1).otherwise(0 if name in ("email", "phone") else -1)
    context = F.when(before.rlike(AGAINST), -1).when(before.rlike(CONTEXT[name]) | after.rlike(CONTEXT[name]), 1).otherwise(0)
    if name == "email":
        known = F.when(F.lower(s).rlike(f"[.\\x20)\\]}}](?:{DOMAINS})\\z"), 1).otherwise(-1)
        checked = F.when(s.rlike("@|[(\\[{]"), 1).otherwise(0)
    elif name == "ip":
        known = F.when(s.rlike("^(0\\.|255\\.|127\\.|22[4-9]\\.|23[0-9]\\.)"), -1).otherwise(0)
        checked = F.when(s.contains(":"), 1).when(F.forall(F.split(s, "\\."), lambda p: F.coalesce(p.try_cast("double") <= 255, F.lit(False))), 1).otherwise(-1)
    elif name == "card":
        known = F.when(d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1)
        checked = F.when(_luhn(s) & (F.length(d) >= 12), 1).otherwise(-1)
    else:
        known = F.when(s.rlike(f"^(\\+|00)({CODES})"), 1).when(s.rlike("^\\(?0?[1-9]"), 0).otherwise(-1)
        checked = F.when(~F.length(d).between(9, 15) | d.rlike("^(\\d)\\1+$"), -1).when(s.startswith("+"), 1).otherwise(0)
    return F.array(*[v.cast("int") for v in (shape, known, context, checked)])


def features(s: Column, before: Column, after: Column) -> Column:
    """The numbers of a span's features, one of each sort: its characters' classes with runs drawn
    together, the words beside it, its length, and its first two and last four characters."""
    classes = F.regexp_replace(F.regexp_replace(s, "[\\p{L}]+", "a"), "[0-9]+", "d")
    last, first = F.regexp_extract(F.lower(before), "([\\p{L}]+)[^\\p{L}]*$", 1), F.regexp_extract(F.lower(after), "^[^\\p{L}]*([\\p{L}]+)", 1)
    ends = F.lower(F.concat(F.left(s, F.lit(2)), F.right(s, F.lit(4))))
    parts = (classes, last, first, F.least(F.length(s), F.lit(BUCKETS - 1)), F.when(s.rlike("\\p{L}"), F.right(ends, F.lit(4))).otherwise(F.left(ends, F.lit(2))))
    return F.array(*[(F.pmod(F.xxhash64(x), F.lit(BUCKETS)) + k * BUCKETS).cast("int") for k, x in enumerate(parts)])


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, spans), one a row of docs: spans (start, kind, end, base, votes, features) in order."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    named = [(k, name, base) for base in (True, False) for k, name in enumerate(KINDS)]
    hint = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+")}
    wide_hint = {"email": F.col("t").rlike("(?i)[(\\[{ ]at[)\\]} ]")}
    for _, name, base in named:
        found = _matches(F.col("t"), (BASE if base else WIDE)[name])
        maybe = (hint if base else wide_hint).get(name)
        rows = rows.withColumn(f"{name}_{base}", found if maybe is None else F.when(maybe, found).otherwise(F.array().cast("array<string>")))
    # most documents have no match at all: they take no part in what follows
    none = F.forall(F.array(*[F.size(f"{name}_{base}") for _, name, base in named]), lambda n: n == 0)
    rows = rows.withColumn("t", F.when(~none, F.col("t")))
    for k, name, base in named:
        rows = _placed(rows, f"{name}_{base}", (BASE if base else WIDE)[name], k, base)
    # wider shapes do not loosen the checks: a number that fails Luhn's is no card in any dress
    for _, name, base in named:
        if base or name in ("card", "phone"):
            rows = rows.withColumn(f"{name}_{base}", F.filter(f"{name}_{base}", _check(name)))
    rows = rows.select("doc_id", F.array_sort(F.concat(*[F.col(f"{name}_{base}") for _, name, base in named])).alias("all"))
    # a wider span that a base span overlaps goes: one that starts before its end, and ends behind its start
    rows = scanned(rows, "upto", F.transform("all", lambda x: F.when(x["base"], x["end"]).otherwise(-1)), lambda a, x: F.greatest(a, x), F.lit(-1))
    rows = scanned(rows, "behind", F.reverse(F.transform("all", lambda x: F.when(x["base"], x["start"]).otherwise(_FAR))), lambda a, x: F.least(a, x), F.lit(_FAR))
    rows = rows.withColumn("all", F.filter("all", lambda x, k: x["base"] | ((F.get("upto", k) <= x["start"]) & (F.get("behind", F.size("all") - 1 - k) >= x["end"]))))

    def voted(x: Column) -> Column:
        votes = F.when(x["kind"] == 0, _votes(0, x["text"], x["before"], x["after"]))
        for k in (1, 2, 3):
            votes = votes.when(x["kind"] == k, _votes(k, x["text"], x["before"], x["after"]))
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"), votes.alias("votes"), features(x["text"], x["before"], x["after"]).alias("features"))

    return rows.select("doc_id", F.transform("all", voted).alias("spans"))


_FAR = (1 << 31) - 1


def estimate(counts: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posteriors of (kind, votes) by expectation-maximisation: for each kind, each labeler is right with a
    probability that is estimated from how it agrees with the others, where it votes; not to vote says
    nothing, and a candidate without votes is as likely as not. BELIEF, right and wrong votes of old, keeps
    a labeler that no other can be held against better than chance."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [(v, n) for k, v, n in counts if k == kind]
        right = [BELIEF[0] / sum(BELIEF)] * len(LABELERS)
        p: dict[tuple[int, ...], float] = {}
        for _ in range(ROUNDS if rows else 0):
            odds = [math.log(r / (1 - r)) for r in right]
            p = {v: 1 / (1 + math.exp(-sum(o * x for o, x in zip(odds, v, strict=True)))) for v, _ in rows}
            for i in range(len(LABELERS)):
                agreed = sum(n * (p[v] if v[i] > 0 else 1 - p[v]) for v, n in rows if v[i])
                right[i] = min(0.98, max(0.55, (agreed + BELIEF[0]) / (sum(n for v, n in rows if v[i]) + sum(BELIEF))))
        out |= {(kind, v): q for v, q in p.items()}
    return out


def fit(sums: list[tuple[int, int, float, float]], totals: dict[int, tuple[float, float]]) -> list[float]:
    """For each kind a weight for each feature, then its bias: of naive Bayes, from (kind, feature, targets,
    the rest) and the totals of a kind. At most KINDS * SORTS * BUCKETS rows, however large the corpus."""
    n = len(SORTS) * BUCKETS
    out = [0.0] * (len(KINDS) * (n + 1))
    for kind, (for_, against) in totals.items():
        out[kind * (n + 1) + n] = math.log((for_ + 1) / (against + 1))
    for kind, feature, for_, against in sums:
        one, two = totals[kind]
        out[kind * (n + 1) + feature] = math.log((for_ + 1) / (one + BUCKETS)) - math.log((against + 1) / (two + BUCKETS))
    return out


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, spans), one a row of docs: spans (start, kind, end, base, score) in order of start
    and kind, ends exclusive, in code points. Null and empty texts have none; an empty table gives no
    rows; repeated rows count and come out as often as they stand; other columns are ignored."""
    found = written(candidates(docs, text, doc_id), "pii-candidates")
    each = found.select(F.explode("spans").alias("s"))
    combos = each.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    posterior = estimate(sorted((r.kind, tuple(r.votes), r.n) for r in combos))
    by_votes = {f"{k}:{','.join(map(str, v))}": q for (k, v), q in posterior.items()}
    lookup = F.from_json(F.lit(json.dumps(by_votes)), "map<string,double>")
    target = F.element_at(lookup, F.concat_ws(":", F.col("s.kind").cast("string"), F.array_join(F.col("s.votes").cast("array<string>"), ",")))
    rated = each.select("s.kind", F.explode("s.features").alias("feature"), target.alias("p"))
    sums = [tuple(r) for r in rated.groupBy("kind", "feature").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("q")).collect()]
    totals: dict[int, tuple[float, float]] = {}
    for kind, _, p, q in sums:
        one, two = totals.get(kind, (0.0, 0.0))
        totals[kind] = one + p / len(SORTS), two + q / len(SORTS)
    weights = F.split(F.lit(",".join(f"{w:.6f}" for w in fit(sorted(sums), totals))), ",").cast("array<double>")
    n = len(SORTS) * BUCKETS

    def scored(x: Column) -> Column:
        of = lambda f: F.get(weights, x["kind"] * (n + 1) + f)
        return 1 / (1 + F.exp(-F.aggregate(x["features"], of(F.lit(n)), lambda a, f: a + of(f))))

    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"), scored(x).alias("score")))
    return found.select("doc_id", F.filter(spans, lambda x: x["base"] | (x["score"] > 0.5)).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first."""
    names = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.element_at(names, x["kind"] + 1), F.lit(">"))
        new = F.struct(x["end"].alias("at"), put.alias("out"))
        return F.when(x["start"] >= acc["at"], new).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by personal_data: the counts and the digest are of the base spans; spans holds all.
    Nulls, empty texts and repeated rows as it says."""
    out = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
