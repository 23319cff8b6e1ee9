"""Queries of text functions and transcript operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import text as X
from ..operators import reports as R
from ..operators import texts as T
from .registry import query
from .views import table, turns


def _pairs(s, d):
    """Consecutive turns of conversations as reference and hypothesis."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("hyp"))
    return c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("clip_id"), F.col("conv_id").alias("group"), F.col("t").alias("ref"), "hyp")


@query("c1_align")
def _(s, d):
    return T.spread(_pairs(s, d), "clip_id").select("clip_id", F.explode(T.aligned(F.col("ref"), F.col("hyp"))).alias("x")).select("clip_id", "x.*")


@query("c4_key")
def _(s, d):
    return T.word_counts(table(s, d, "conversations").select("text"))


@query("c5_dialect")
def _(s, d):
    """Keys of all words of conversations, with the rules that made them; Latin letters are first written in
    Devanagari, as no table has any."""
    deva = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "ािचदेफगहिजकलमनोपकरसतुबवखयज")
    return T.key_changes(table(s, d, "conversations").select(deva.alias("text")))


@query("c14_error_rows")
def _(s, d):
    return T.error_rows(_pairs(s, d))


@query("c24_score_clip")
def _(s, d):
    return T.spread(_pairs(s, d), "clip_id").select("clip_id", T.score(F.col("ref"), F.col("hyp")).alias("x")).select("clip_id", "x.*")


@query("c25_hazards")
def _(s, d):
    p = T.spread(_pairs(s, d), "clip_id")
    return p.select("clip_id", T.hazards(F.col("ref"), F.array("hyp", "ref"), F.array("hyp")).alias("x")).select("clip_id", "x.*")


@query("g34_disagreement")
def _(s, d):
    return T.disagreements(_pairs(s, d).select("clip_id", F.array("ref", "hyp", F.concat_ws(" ", "ref", "hyp")).alias("texts")), "clip_id", "texts")


@query("g35_word_counts", r"WITH w AS (SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ')) AS word FROM benchmark) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1")
def _(s, d):
    return table(s, d, "benchmark").select(F.explode(X.plain_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _words(s, d):
    e = table(s, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return e.select((F.col("user_id") % 40).alias("clip"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("event_id") % 3 + 1).cast("int")).alias("system"), F.col("event_id").cast("int").alias("position"), F.col("event_type").alias("word"), start.alias("start"), (start + F.col("value") * 30).alias("end"))


@query("j20_slots")
def _(s, d):
    return T.slots(_words(s, d), "clip", "a", 0.2)


@query("d11_outvoted")
def _(s, d):
    return T.outvoted_share(T.slots(_words(s, d), "clip", "a", 0.2), "clip")


@query("d12_slices")
def _(s, d):
    t = turns(s, d).select("episode", (F.col("start") - 1704067200).alias("start"), (F.col("end") - 1704067200).alias("end"), F.lit(2600000.0).alias("total"))
    return T.slices(t, "episode", "total")


@query("o14_batches")
def _(s, d):
    c = table(s, d, "documents").select("source", "doc_id", (F.col("n_chars") / 100).alias("seconds"))
    return T.batches(c, "source", "seconds", "doc_id", 600.0, 48)


@query("c9_script", "SELECT script, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(w, '[ऀ-ॿ]') AND regexp_matches(w, '[A-Za-z]') THEN 'mix' WHEN regexp_matches(w, '[ऀ-ॿ]') THEN 'dev' WHEN regexp_matches(w, '[A-Za-z]') THEN 'lat' ELSE 'none' END AS script FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)) GROUP BY 1")
def _(s, d):
    return table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).groupBy(X.script(F.col("w")).alias("script")).agg(F.count("*").alias("n"))


@query("c11_similarity", "SELECT p_partkey, CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END AS similarity FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("c12_char_distance", "SELECT p_partkey, CAST(levenshtein(p_name, p_brand) AS INTEGER) AS distance FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.levenshtein("p_name", "p_brand").alias("distance"))


@query("c18_plain_tokens", r"SELECT item_id, len(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS n FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", F.size(X.plain_tokens(F.col("text"))).cast("long").alias("n"))


@query("c19_loop", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM w), m AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1) SELECT w.doc_id, coalesce(n, 0) >= 2 AS loops FROM w LEFT JOIN m USING (doc_id)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.is_loop(F.col("text"), 3, 2).alias("loops"))


@query("c20_repeated_ngram", r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations), g AS (SELECT conv_id, turn, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w), m AS (SELECT conv_id, turn, max(n) AS n FROM (SELECT conv_id, turn, g, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT w.conv_id, w.turn, CAST(coalesce(n, 0) AS INTEGER) AS most FROM w LEFT JOIN m USING (conv_id, turn)")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.ngram_counts(X.words(F.col("text")), 2).alias("most"))


@query("c21_devanagari_ratio", r"WITH t AS (SELECT doc_id, translate(text, 'aeiou', 'कखगघच') AS t FROM documents) SELECT doc_id, coalesce(len(regexp_extract_all(t, '[क-ह]'))::DOUBLE / nullif(len(regexp_extract_all(t, '\p{L}')), 0), 0) AS ratio FROM t")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.devanagari_ratio(F.translate("text", "aeiou", "कखगघच")).alias("ratio"))


@query("c22_cmi", "WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1) SELECT conv_id, 100.0::DOUBLE * (len(r) - greatest(len(list_filter(r, lambda x: x = 'user')), len(list_filter(r, lambda x: x = 'assistant')), len(list_filter(r, lambda x: x NOT IN ('user', 'assistant'))))) / len(r) AS cmi, CAST(len([1 FOR i IN range(1, len(r)) IF r[i] <> r[i + 1]]) AS INTEGER) AS switches FROM t")
def _(s, d):
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return t.select("conv_id", X.code_mixing(F.col("r")).alias("cmi"), X.switch_points(F.col("r")).alias("switches"))


@query("c23_count_words", r"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')), 0) AS BIGINT) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n"))


@query("c29_canonical_url", r"SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS url FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


@query("c30_sha2", "SELECT doc_id, sha256(text) AS digest, regexp_replace(lower(trim(' SHA256:' || source)), '^[a-z0-9]+:', '') AS checksum FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), X.normalized_checksum(F.concat(F.lit(" SHA256:"), F.col("source"))).alias("checksum"))


@query("u4_roman_gap", "WITH t AS (SELECT c_custkey, string_split(lower(c_name || ' ' || c_mktsegment), ' ') AS a, string_split(lower(c_mktsegment || ' extra words'), ' ') AS o FROM customer) SELECT c_custkey, least(1.0, len(list_filter(o, lambda x: NOT list_contains(a, x))) / 4.0::DOUBLE) AS gap FROM t")
def _(s, d):
    c = table(s, d, "customer")
    a = F.split(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), " ")
    o = F.split(F.lower(F.concat(F.col("c_mktsegment"), F.lit(" extra words"))), " ")
    return c.select("c_custkey", X.roman_gap(a, F.array(o, F.array_union(o, F.array(F.lit("other"))))).alias("gap"))


@query("u5_orphan_rate", "WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [p_type] AS o FROM part) SELECT p_partkey, len(list_filter(a, lambda x: NOT list_contains(o, x)))::DOUBLE / len(a) AS rate FROM t")
def _(s, d):
    return table(s, d, "part").select("p_partkey", X.orphan_rate(F.split("p_name", " "), F.array(F.array("p_type"))).alias("rate"))


_SPAN = "SELECT event_id, value AS v, event_id % 50 AS k FROM events"


@query("d8_covered_share", f"WITH t AS ({_SPAN}) SELECT event_id, CASE WHEN v > 0 THEN greatest(0, 1 - (greatest(0, least(v, k + 5.0) - k)) / v) END AS uncovered FROM t")
def _(s, d):
    e = table(s, d, "events")
    k, zero = (F.col("event_id") % 50).cast("double"), F.lit(0.0)
    words = F.array(F.struct(k.alias("start"), (k + 3).alias("end")), F.struct((k + 2).alias("start"), (k + 5).alias("end")))
    return e.select("event_id", I.uncovered_share(F.array(F.struct(zero.alias("start"), F.col("value").alias("end"))), words).alias("uncovered"))


@query("d9_alone_stretch", f"WITH t AS ({_SPAN}) SELECT event_id, CASE WHEN greatest(least(v, k), v - (k + 5)) >= 1.5 THEN greatest(least(v, k), v - (k + 5)) END AS seconds FROM t")
def _(s, d):
    k = (F.col("event_id") % 50).cast("double")
    own, other = F.array(F.struct(F.lit(0.0).alias("start"), F.col("value").alias("end"))), F.array(F.struct(k.alias("start"), (k + 5).alias("end")))
    best = I.longest(I.minus(own, other), 1.5)
    return table(s, d, "events").select("event_id", (best["end"] - best["start"]).alias("seconds"))


@query("d10_iou", f"WITH t AS ({_SPAN}) SELECT event_id, coalesce(greatest(0, least(v, k + 10) - k) / nullif(v + 10 - greatest(0, least(v, k + 10) - k), 0), 0) AS iou FROM t")
def _(s, d):
    k = (F.col("event_id") % 50).cast("double")
    return table(s, d, "events").select("event_id", I.iou(F.lit(0.0), F.col("value"), k, k + 10).alias("iou"))


@query("d4_median", "SELECT event_type, median(value) AS median FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.median("value").alias("median"))


@query("d1_day_buckets", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("d3_first_last", "SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


@query("d7_index_percentiles", "SELECT event_type, v[CAST(floor(0.025 * len(v)) AS INT) + 1] AS low, v[CAST(floor(0.975 * len(v)) AS INT)] AS high FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1)")
def _(s, d):
    return R.index_percentiles(table(s, d, "events"), "event_type", "value", 0.025, 0.975)


@query("d13_time_order", "SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS flat FROM conversations GROUP BY 1")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ").alias("flat"))


@query("d17_json_paths", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, coalesce(props ->> '$.missing', 'unknown') AS missing FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("unknown")).alias("missing"))


@query("d18_dictionary_codes", "WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, code FROM events JOIN k USING (event_type)")
def _(s, d):
    e = table(s, d, "events").select("event_id", "event_type")
    names = e.agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    return e.crossJoin(F.broadcast(names)).select("event_id", (F.array_position("names", F.col("event_type")) - 1).alias("code"))


@query("r11_rows_up_to_count", "SELECT n_nationkey, i AS row, CASE WHEN i <= n_regionkey THEN n_name END AS name FROM nation, unnest(range(1, n_regionkey + 3)) AS u(i)")
def _(s, d):
    n = table(s, d, "nation")
    return n.select("n_nationkey", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("n_regionkey") + 2).cast("long"))).alias("row"), "n_regionkey", "n_name").select("n_nationkey", "row", F.when(F.col("row") <= F.col("n_regionkey"), F.col("n_name")).alias("name"))


@query("r26_flag_propagation", "SELECT event_id, list_sort(CASE WHEN value > 50 THEN list_distinct(list_append(f, 'loud')) ELSE list_filter(f, lambda x: x <> 'loud') END) AS flags FROM (SELECT event_id, value, [event_type, CASE WHEN event_id % 2 = 0 THEN 'loud' ELSE 'quiet' END] AS f FROM events)")
def _(s, d):
    f = F.array("event_type", F.when(F.col("event_id") % 2 == 0, "loud").otherwise("quiet"))
    return table(s, d, "events").select("event_id", F.array_sort(F.when(F.col("value") > 50, F.array_union(f, F.array(F.lit("loud")))).otherwise(F.array_remove(f, "loud"))).alias("flags"))


@query("r23_stage_pivot", "SELECT o_orderpriority, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O, max(o_totalprice) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
