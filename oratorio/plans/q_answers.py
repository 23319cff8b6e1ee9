"""Queries of model answers and suggestions, over conversations: a conversation is a window, its turns the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from .registry import query
from .views import table

_ANSWERS = """
items AS (
  SELECT conv_id, turn, turn AS pos, '{"id": ' || turn || ', "t": " w' || turn || ' ", "c": "' || CASE WHEN turn % 2 = 0 THEN 'K' ELSE 'zz' END || '"}' AS item FROM conversations WHERE turn % 4 <> 3
  UNION ALL SELECT conv_id, turn, turn + 1000, '{"t": "again ' || turn || '", "id": "' || turn || '"}' FROM conversations WHERE turn % 5 = 2
  UNION ALL SELECT conv_id, turn, 5000, '{"id": 99, "t": "extra"}, 5, {"t": "none"}, {"id": "x"}' FROM conversations WHERE turn = 0 AND conv_id % 7 = 5
), answers AS (
  SELECT conv_id AS "window", CASE conv_id % 7 WHEN 3 THEN '[' || string_agg(item, ', ' ORDER BY pos) || ', {"id"' WHEN 4 THEN '```json' || chr(10) || '[' || string_agg(item, ', ' ORDER BY pos) || ']' || chr(10) || '```' WHEN 6 THEN 'Sorry.' ELSE 'Here: [' || string_agg(item, ', ' ORDER BY pos) || '] Done.' END AS response FROM items GROUP BY conv_id
), bodies AS (SELECT "window", regexp_extract(response, '(?s)\\[.*\\]') AS body FROM answers
), read AS (SELECT "window", body <> '' AND json_valid(body) AS ok, CASE WHEN body <> '' AND json_valid(body) THEN from_json(body, '["JSON"]') END AS js FROM bodies
), each AS (SELECT "window", unnest(range(1, len(js) + 1)) AS nth, unnest(js) AS j FROM read WHERE ok
), parts AS (SELECT "window", nth, json_type(j) = 'OBJECT' AND json_exists(j, '$.id') AS whole, try_cast(CASE WHEN json_type(j) = 'OBJECT' THEN j ->> 'id' END AS BIGINT) AS id, CASE WHEN json_type(j) = 'OBJECT' THEN trim(coalesce(j ->> 't', '')) END AS text, CASE WHEN json_type(j) = 'OBJECT' AND lower(trim(coalesce(j ->> 'c', ''))) IN ('k', 's', 'm', 'c', 'u') THEN lower(trim(j ->> 'c')) ELSE '?' END AS code FROM each
), said AS (SELECT "window", id, arg_max(text, nth) AS text, arg_max(code, nth) AS code, count(*) AS times FROM parts WHERE whole AND id IS NOT NULL GROUP BY ALL
), asked AS (SELECT conv_id AS "window", turn AS id FROM conversations)"""


def _answers(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    t = F.col("turn").cast("string")
    row = lambda rows, pos, item: rows.select("conv_id", pos.alias("pos"), item.alias("item"))
    items = row(c.where("turn % 4 <> 3"), F.col("turn"), F.concat(F.lit('{"id": '), t, F.lit(', "t": " w'), t, F.lit(' ", "c": "'), F.when(F.col("turn") % 2 == 0, "K").otherwise("zz"), F.lit('"}')))
    items = items.unionByName(row(c.where("turn % 5 = 2"), F.col("turn") + 1000, F.concat(F.lit('{"t": "again '), t, F.lit('", "id": "'), t, F.lit('"}'))))
    items = items.unionByName(row(c.where("turn = 0 and conv_id % 7 = 5"), F.lit(5000).cast("long"), F.lit('{"id": 99, "t": "extra"}, 5, {"t": "none"}, {"id": "x"}')))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ", ")
    rows = items.groupBy("conv_id").agg(joined.alias("j"))
    kind = F.col("conv_id") % 7
    response = F.when(kind == 3, F.concat(F.lit("["), "j", F.lit(', {"id"'))).when(kind == 4, F.concat(F.lit("```json\n["), "j", F.lit("]\n```"))).when(kind == 6, "Sorry.").otherwise(F.concat(F.lit("Here: ["), "j", F.lit("] Done.")))
    ids = c.groupBy("conv_id").agg(F.collect_list("turn").alias("ids"))
    return ids.join(rows, "conv_id").select(F.col("conv_id").alias("window"), response.alias("response"), "ids")


@query("c32_texts", f"""WITH {_ANSWERS} SELECT a."window", a.id, text, code FROM asked a JOIN answers USING ("window") LEFT JOIN said s ON s."window" = a."window" AND s.id = a.id""")
def _(s, d):
    return A.parsed(_answers(s, d))[0]


@query(
    "c32_problems",
    f"""WITH {_ANSWERS}, found AS (
  SELECT "window", 'unreadable' AS problem FROM read WHERE NOT ok
  UNION ALL SELECT "window", 'malformed' FROM parts WHERE NOT whole
  UNION ALL SELECT "window", 'bad_id' FROM parts WHERE whole AND id IS NULL
  UNION ALL SELECT "window", 'repeated' FROM said WHERE times > 1
  UNION ALL SELECT a."window", 'missing' FROM asked a JOIN read r ON r."window" = a."window" AND r.ok LEFT JOIN said s ON s."window" = a."window" AND s.id = a.id WHERE s.id IS NULL
  UNION ALL SELECT s."window", 'unexpected' FROM said s LEFT JOIN asked a ON a."window" = s."window" AND a.id = s.id WHERE a.id IS NULL
) SELECT "window", problem, count(*) AS n FROM found GROUP BY ALL""",
)
def _(s, d):
    return A.parsed(_answers(s, d))[1]


@query(
    "r20_fused",
    f"""WITH {_ANSWERS}, records AS (SELECT conv_id || '-' || turn AS segment, conv_id AS "window", turn AS id, text FROM conversations
) SELECT r.segment, r."window", r.id, CASE WHEN s.text <> '' THEN s.text WHEN r.id % 3 = 0 THEN 'earlier ' || r.id WHEN r.id % 3 = 1 THEN coalesce(r.text, '') ELSE '' END AS text, CASE WHEN s.text <> '' THEN s.code END AS code,
  CASE WHEN s.text <> '' THEN 'fused' WHEN r.id % 3 = 0 THEN 'earlier' WHEN r.id % 3 = 1 THEN 'recogniser' ELSE 'none' END AS "by"
FROM records r LEFT JOIN said s ON s."window" = r."window" AND s.id = r.id""",
)
def _(s, d):
    c = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("segment"), F.col("conv_id").alias("window"), F.col("turn").alias("id"), "text")
    asr = c.where("id % 3 < 2").select("segment", F.explode(F.array(F.struct(F.lit(1).alias("rank"), "text"), F.struct(F.lit(2).alias("rank"), F.lit("second").alias("text")))).alias("h")).select("segment", "h.rank", F.lit("asr").alias("kind"), "h.text")
    earlier = c.where("id % 3 = 0").select("segment", F.lit(9).alias("rank"), F.lit("fusion").alias("kind"), F.concat(F.lit("earlier "), F.col("id").cast("string")).alias("text"))
    return A.fused(c.drop("text"), A.parsed(_answers(s, d))[0], asr.unionByName(earlier))


_SUGGEST = """
w AS (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS word FROM conversations
), asked AS (SELECT word, count(*) AS n FROM w GROUP BY word
), provider AS (SELECT DISTINCT form, scheme, CASE scheme WHEN 0 THEN translate(form, 'aeioukgtn', 'ािीोुकगतन') ELSE translate(form, 'aeioukgtn', 'अइईओउकगटण') END AS candidate FROM (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS form FROM documents), range(2) s(scheme)
), cache AS (SELECT word, [upper(word), word || '1'] AS candidates, 'provider' AS "by", length(word) AS hits FROM asked WHERE length(word) % 3 = 0)"""


def _suggest(s, d):
    words = lambda t, name: table(s, d, t).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias(name))
    asked = words("conversations", "word")
    forms = words("documents", "form").select(F.lower("form").alias("form")).distinct()
    one, two = F.translate("form", "aeioukgtn", "ािीोुकगतन"), F.translate("form", "aeioukgtn", "अइईओउकगटण")
    provider = forms.select("form", F.posexplode(F.array(one, two)).alias("scheme", "candidate"))
    cache = asked.select(F.lower("word").alias("word")).distinct().where("length(word) % 3 = 0").select("word", F.array(F.upper("word"), F.concat("word", F.lit("1"))).alias("candidates"), F.lit("provider").alias("by"), F.length("word").cast("long").alias("hits"))
    return asked, provider, cache


@query(
    "c31_suggested",
    f"""WITH {_SUGGEST}, forms AS (
  SELECT word, 0 AS v, word AS form FROM asked UNION ALL SELECT word, 1, word || 'a' FROM asked WHERE (word LIKE '%a' AND word NOT LIKE '%aa') OR right(word, 1) NOT IN ('a', 'e', 'i', 'o', 'u')
), found AS (SELECT word, candidate, min(v * 10 + scheme) AS place FROM forms JOIN provider USING (form) WHERE candidate <> form AND word NOT IN (SELECT word FROM cache) GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place, candidate) AS k FROM found
) SELECT word, array_to_string(list(candidate ORDER BY k), ' ') AS candidates, 'provider' AS "by", 0::BIGINT AS hits FROM ranked WHERE k <= 5 GROUP BY word
UNION ALL SELECT c.word, array_to_string(candidates, ' '), "by", hits + n FROM cache c JOIN asked USING (word)""",
)
def _(s, d):
    return A.suggested(*_suggest(s, d)).withColumn("candidates", F.array_join("candidates", " "))


@query(
    "c31_learned",
    f"""WITH {_SUGGEST}, choices AS (SELECT word, 'first' AS chosen, 1 AS nth FROM asked WHERE n % 2 = 0 UNION ALL SELECT word, upper(word), 2 FROM asked WHERE n % 3 = 0
), made AS (SELECT word, list(chosen ORDER BY nth DESC) AS firsts FROM choices GROUP BY word)
SELECT coalesce(c.word, m.word) AS word, array_to_string(list_filter(coalesce(firsts, []) || list_filter(coalesce(candidates, []), lambda x: NOT list_contains(coalesce(firsts, []), x)), lambda x: true), ' ') AS candidates, coalesce("by", 'correction') AS "by", coalesce(hits, 0) AS hits FROM cache c FULL JOIN made m ON m.word = c.word""",
)
def _(s, d):
    asked, _, cache = _suggest(s, d)
    n = asked.select(F.lower("word").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    choices = n.where("n % 2 = 0").select("word", F.lit("first").alias("chosen"), F.lit(1).alias("at")).unionByName(n.where("n % 3 = 0").select("word", F.upper("word").alias("chosen"), F.lit(2).alias("at")))
    return A.learned(cache, choices).withColumn("candidates", F.array_join("candidates", " "))
