"""Queries of the corpus view, identities, coverage, the queue and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from .registry import query
from .views import ERROR_ROWS, LABELS, SEGMENTS, error_rows, labels_log, segments, table

_TEXT = "CASE WHEN event_id % 4 <> 0 THEN event_type || ' ' || event_id END"


@query(
    "r1_corpus_view",
    f"""WITH {SEGMENTS}, {LABELS}, c AS (SELECT l.*, {_TEXT} AS final_text FROM labels_log l JOIN events ON id = event_id QUALIFY row_number() OVER (PARTITION BY l.segment_id ORDER BY l.created_at DESC, id DESC) = 1),
j AS (SELECT s.*, c.tier, c.final_text, nullif(text, '') AS seed, coalesce(disposition IN ('accepted_unchanged', 'edited') AND final_text IS NOT NULL, false) AS ok FROM segments s LEFT JOIN c USING (segment_id) JOIN documents ON doc_id = s.segment_id)
SELECT segment_id, episode, duration, md5(CASE WHEN ok THEN final_text ELSE seed END) AS text, CASE WHEN ok THEN 'label' WHEN seed IS NOT NULL THEN 'seed' END AS text_source, tier, CASE WHEN pot = 'gold' THEN 'gold' ELSE split END AS pot FROM j""",
)
def _(s, d):
    text = F.when(F.col("id") % 4 != 0, F.concat_ws(" ", "version", F.col("id").cast("string")))
    seeds = table(s, d, "documents").select(F.col("doc_id").alias("segment_id"), F.col("text").alias("seed"))
    return C.corpus_view(segments(s, d), labels_log(s, d).withColumn("final_text", text), seeds).withColumn("text", F.md5("text"))


@query(
    "r7_clip_turns",
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS s, epoch_us(ts) / 1000000.0::DOUBLE + value AS e FROM events), r AS (SELECT user_id % 10 AS episode, max(user_id) AS run_id FROM events GROUP BY 1),
t AS (SELECT episode, event_type AS speaker, s, e FROM e JOIN r ON user_id = run_id), c AS (SELECT event_id AS clip_id, user_id % 10 AS episode, s AS cs, s + 600 AS ce FROM e)
SELECT clip_id, speaker, greatest(cs, s) - cs AS rel_start, least(ce, e) - cs AS rel_end FROM c JOIN t ON c.episode = t.episode AND cs < e AND ce > s""",
)
def _(s, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    e = table(s, d, "events")
    clips = e.select(F.col("event_id").alias("clip_id"), (F.col("user_id") % 10).alias("episode"), at.alias("clip_start"), (at + 600).alias("clip_end"))
    turns = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("speaker"), at.alias("start"), (at + F.col("value")).alias("end"))
    return C.clip_turns(clips, e.select((F.col("user_id") % 10).alias("episode"), F.col("user_id").alias("run_id")), turns, 600.0)


@query(
    "r10_coverage",
    """WITH e AS (SELECT c_custkey AS episode, c_nationkey AS show_id, CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) END AS topic, c_custkey % 4 AS g, c_custkey % 5 AS a FROM customer),
kv AS (SELECT episode, 'show_id' AS key, CAST(show_id AS VARCHAR) AS value FROM e UNION ALL SELECT episode, 'topic', topic FROM e WHERE topic IS NOT NULL UNION ALL SELECT episode, 'gender', 'g' || g FROM e WHERE g > 0 UNION ALL SELECT episode, 'gender', 'g1' FROM e UNION ALL SELECT episode, 'age_bracket', 'a' || a FROM e)
SELECT key, value, count(DISTINCT episode) AS episodes FROM kv GROUP BY 1, 2""",
)
def _(s, d):
    k = F.col("c_custkey")
    one = F.struct(F.when(k % 4 > 0, F.concat(F.lit("g"), (k % 4).cast("string"))).otherwise("").alias("gender"), F.concat(F.lit("a"), (k % 5).cast("string")).alias("age_bracket"))
    two = F.struct(F.lit("g1").alias("gender"), F.lit(None).cast("string").alias("age_bracket"))
    meta = F.to_json(F.struct(F.when(k % 3 != 0, F.lower("c_mktsegment")).alias("topic"), F.create_map(F.lit("a"), one, F.lit("b"), two).alias("speakers")))
    return C.coverage(table(s, d, "customer").select(k.alias("episode"), F.col("c_nationkey").alias("show_id"), meta.alias("metadata")))


def _people(s, d):
    """Customers as declared speakers and as voices, one or two an episode; nations as what is set by hand."""
    k = F.col("c_custkey")
    c = table(s, d, "customer").withColumn("episode", F.floor(k * 3 / 5))
    declared = c.select("episode", F.when(k % 3 == 0, "f").when(k % 3 == 1, "m").alias("gender"), F.when(F.col("c_nationkey") % 2 == 0, "young").otherwise("old").alias("age_bracket"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "host").otherwise("guest").alias("role"))
    heard = c.select("episode", F.when(k % 3 == 0, F.concat(F.lit("r"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("voice"))
    manual = table(s, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("voice"), F.lit("f").alias("gender"), F.lit(None).cast("string").alias("age_bracket"))
    return declared, heard, manual


_RESOLVED = """c AS (SELECT *, CAST(floor(c_custkey * 3 / 5) AS BIGINT) AS episode FROM customer),
dec AS (SELECT episode, CASE c_custkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' END AS gender, CASE WHEN c_nationkey % 2 = 0 THEN 'young' ELSE 'old' END AS age, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'host' ELSE 'guest' END AS role FROM c),
heard AS (SELECT DISTINCT episode, CASE WHEN c_custkey % 3 = 0 THEN 'r' || c_nationkey ELSE 'u' || c_custkey END AS voice FROM c),
rec AS (SELECT voice FROM heard GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT *, voice IN (SELECT voice FROM rec) AS recurs, count(*) OVER (PARTITION BY episode) AS v, count(*) FILTER (voice IN (SELECT voice FROM rec)) OVER (PARTITION BY episode) AS r FROM heard),
per AS (SELECT episode, count(*) AS n, count(*) FILTER (role = 'host') AS hosts FROM dec GROUP BY 1),
j AS (SELECT h.*, n, hosts, NOT (n = 1 AND v = 1) AND hosts = 1 AND r = 1 AS m FROM h JOIN per USING (episode)),
agr AS (SELECT episode, voice, any_value(m) AS m, any_value(recurs) AS recurs, any_value(n) AS n, any_value(v) AS v, count(dec.role) AS k,
  CASE WHEN count(gender) = count(dec.role) AND count(DISTINCT gender) = 1 THEN min(gender) END AS gender, CASE WHEN count(DISTINCT age) = 1 THEN min(age) END AS age, CASE WHEN count(DISTINCT dec.role) = 1 THEN min(dec.role) END AS role
  FROM j LEFT JOIN dec USING (episode) WHERE NOT (m AND dec.role = 'host') OR dec.role IS NULL OR n = 1 GROUP BY 1, 2),
hst AS (SELECT j.episode, voice, dec.gender, dec.age FROM j JOIN dec ON j.episode = dec.episode AND dec.role = 'host' WHERE m AND recurs),
res AS (SELECT episode, voice, gender, age, 'host' AS role, 'recurring_host' AS "by" FROM hst
  UNION ALL SELECT j.episode, j.voice, dec.gender, dec.age, dec.role, 'only_pair' FROM j JOIN dec ON j.episode = dec.episode WHERE n = 1 AND v = 1
  UNION ALL SELECT episode, voice, gender, age, role, 'rows_agree' FROM agr WHERE NOT (n = 1 AND v = 1) AND NOT (m AND recurs) AND k > 0 AND v - m::INT <= n - m::INT AND coalesce(gender, age, role) IS NOT NULL)"""


@query("d16_resolved", f'WITH {_RESOLVED} SELECT episode, voice, gender, age AS age_bracket, role, "by" FROM res')
def _(s, d):
    declared, heard, _manual = _people(s, d)
    return C.resolved(declared, heard)


@query(
    "d16_identities",
    f"""WITH {_RESOLVED}, p AS (SELECT voice, min(gender) AS g, count(DISTINCT gender) AS gn, min(age) AS a, count(DISTINCT age) AS an, count(*) FILTER ("by" = 'only_pair') AS only_pair, count(*) FILTER ("by" = 'recurring_host') AS recurring_host, count(*) FILTER ("by" = 'rows_agree') AS rows_agree FROM res GROUP BY 1),
x AS (SELECT v.voice, n.n_nationkey IS NOT NULL AS hand, coalesce((gn > 1 AND n.n_nationkey IS NULL) OR an > 1, false) AS conflict, p.* EXCLUDE (voice) FROM (SELECT DISTINCT voice FROM heard) v LEFT JOIN p ON p.voice = v.voice LEFT JOIN nation n ON n_regionkey = 1 AND v.voice = 'r' || n_nationkey),
y AS (SELECT *, CASE WHEN hand THEN 'f' WHEN NOT conflict AND gn = 1 THEN g END AS gender, CASE WHEN NOT conflict AND an = 1 THEN a END AS age_bracket FROM x)
SELECT voice, gender, age_bracket, CASE WHEN conflict THEN 'conflict' WHEN coalesce(gender, age_bracket) IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status, coalesce(only_pair, 0) AS only_pair, coalesce(recurring_host, 0) AS recurring_host, coalesce(rows_agree, 0) AS rows_agree FROM y""",
)
def _(s, d):
    declared, heard, manual = _people(s, d)
    return C.identities(C.resolved(declared, heard), heard, manual).drop("manual", "disagrees")


@query(
    "d16_by_hand",
    f"""WITH {_RESOLVED}, p AS (SELECT voice, min(gender) AS g1, max(gender) AS g2, min(age) AS a1, max(age) AS a2 FROM res GROUP BY 1), hand AS (SELECT 'r' || n_nationkey AS voice, 'f' AS gender, CASE WHEN n_nationkey % 2 = 0 THEN 'young' ELSE '' END AS age FROM nation)
SELECT v.voice, array_to_string(list_filter([CASE WHEN h.voice IS NOT NULL THEN 'gender' END, CASE WHEN h.age <> '' THEN 'age_bracket' END], lambda x: x IS NOT NULL), ' ') AS manual,
  array_to_string(list_filter([CASE WHEN h.voice IS NOT NULL AND (g1 <> h.gender OR g2 <> h.gender) THEN 'gender' END, CASE WHEN h.age <> '' AND (a1 <> h.age OR a2 <> h.age) THEN 'age_bracket' END], lambda x: x IS NOT NULL), ' ') AS disagrees
FROM (SELECT DISTINCT voice FROM heard) v LEFT JOIN p ON p.voice = v.voice LEFT JOIN hand h ON h.voice = v.voice""",
)
def _(s, d):
    declared, heard, _manual = _people(s, d)
    n = F.col("n_nationkey")
    manual = table(s, d, "nation").select(F.concat(F.lit("r"), n.cast("string")).alias("voice"), F.lit("f").alias("gender"), F.when(n % 2 == 0, "young").otherwise("").alias("age_bracket"))
    out = C.identities(C.resolved(declared, heard), heard, manual)
    return out.select("voice", F.array_join("manual", " ").alias("manual"), F.array_join("disagrees", " ").alias("disagrees"))


@query("o10_voice_page", "SELECT event_id AS segment_id, 0.0::DOUBLE AS start, value AS \"end\", ['confirmed', 'rejected', NULL][event_id % 3 + 1] AS verdict, (SELECT count(*) FROM events) AS total FROM events ORDER BY [0, 2, 1][event_id % 3 + 1], value DESC, event_id LIMIT 60")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("segment_id"), F.lit(0.0).alias("start"), F.col("value").alias("end"))
    verdicts = e.select("segment_id", F.when(F.col("segment_id") % 3 == 0, "confirmed").when(F.col("segment_id") % 3 == 1, "rejected").alias("verdict"))
    return C.voice_page(e, verdicts, 60)


_TASKS = "tasks AS (SELECT user_id AS segment_id, max(event_id) AS id, ['pending', 'done', 'skipped', 'in_progress'][max(event_id) % 4 + 1] AS status FROM events GROUP BY 1)"


def _tasks(s, d):
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "done", "skipped", "in_progress")]), (F.col("id") % 4 + 1).cast("int"))
    return table(s, d, "events").groupBy(F.col("user_id").alias("segment_id")).agg(F.max("event_id").alias("id")).withColumn("status", status)


@query(
    "x1_queue_plan",
    f"""WITH {SEGMENTS}, {_TASKS} SELECT s.segment_id, CASE WHEN genre IS NULL THEN 'error' WHEN md5('0|' || s.segment_id) < '4' THEN 'audit' ELSE 'review' END AS queue, logprob AS priority, CASE WHEN t.id IS NULL THEN 'insert' ELSE 'update' END AS action, t.id AS task_id, CASE WHEN t.id IS NULL THEN 'queued' ELSE pipeline_status END AS new_status
FROM segments s LEFT JOIN tasks t ON s.segment_id = t.segment_id AND t.status IN ('pending', 'in_progress') WHERE pipeline_status IN ('imported', 'queued') AND s.segment_id NOT IN (SELECT segment_id FROM tasks WHERE status = 'done')""",
)
def _(s, d):
    waiting = segments(s, d).select("segment_id", "pipeline_status", F.col("genre").alias("seed_id"), F.col("logprob").alias("priority"))
    audited = waiting.where(F.md5(F.concat(F.lit("0|"), F.col("segment_id").cast("string"))) < "4")
    return C.queue_plan(waiting, audited, _tasks(s, d))


@query(
    "x2_decisions",
    f"""WITH {LABELS}, {_TASKS}, i AS (SELECT l.id AS decision_id, CASE WHEN l.id % 7 = 0 THEN l.id ELSE t.id END AS task_id, l.disposition, CASE WHEN l.id % 2 = 0 THEN version ELSE '' END AS final_text FROM labels_log l JOIN tasks t USING (segment_id)),
w AS (SELECT i.*, t.segment_id, CASE WHEN status IS NULL THEN 'unknown task' WHEN status NOT IN ('pending', 'in_progress') THEN 'task not active' WHEN disposition NOT IN ('accepted_unchanged', 'edited', 'uncertain') THEN 'disposition' WHEN disposition = 'edited' AND final_text = '' THEN 'no text' END AS why FROM i LEFT JOIN tasks t ON t.id = i.task_id)
SELECT decision_id, task_id, disposition, final_text, segment_id, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY task_id, why IS NULL ORDER BY decision_id) > 1 THEN 'task decided' ELSE why END AS refused FROM w""",
)
def _(s, d):
    tasks = _tasks(s, d)
    i = F.col("decision_id")
    log = labels_log(s, d).withColumnRenamed("id", "decision_id").join(tasks.select("segment_id", F.col("id").alias("own")), "segment_id")
    incoming = log.select("decision_id", F.when(i % 7 == 0, i).otherwise(F.col("own")).alias("task_id"), "disposition", F.when(i % 2 == 0, F.col("version")).otherwise("").alias("final_text"))
    return C.decisions(incoming, tasks, ("accepted_unchanged", "edited", "uncertain"))


@query("x3_pot_moves", f"WITH {SEGMENTS} SELECT segment_id, pot AS from_pot, CASE WHEN length(episode) % 2 = 0 THEN 'gold' ELSE 'train' END AS to_pot FROM segments WHERE pot <> CASE WHEN length(episode) % 2 = 0 THEN 'gold' ELSE 'train' END")
def _(s, d):
    of = segments(s, d)
    return C.pot_moves(of, of.select("segment_id", F.when(F.length("episode") % 2 == 0, "gold").otherwise("train").alias("pot")))


@query(
    "x4_rescored",
    """WITH f AS (SELECT l_orderkey, sum(l_extendedprice)::DOUBLE AS price, CASE WHEN count(*) > 2 THEN count(*) END AS lines FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey, o_totalprice::DOUBLE AS price, CASE WHEN o_orderkey % 5 <> 0 THEN 4 END AS lines FROM orders),
p AS (SELECT o_orderkey, 'price' AS "column", s.price AS old, f.price AS new FROM s JOIN f ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, 'lines', s.lines::DOUBLE, f.lines::DOUBLE FROM s JOIN f ON o_orderkey = l_orderkey)
SELECT * FROM p WHERE abs(old - new) > 0.5 OR (old IS NULL) <> (new IS NULL)""",
)
def _(s, d):
    n = F.count("*")
    fresh = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("price"), F.when(n > 2, n).alias("lines"))
    stored = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 5 != 0, 4).alias("lines"))
    return C.changed(stored, fresh, "o_orderkey", ["price", "lines"], 0.5)


@query(
    "r22_model_table",
    f"""WITH {ERROR_ROWS}, c AS (SELECT 'm' || (clip_id % 4) AS model, run, 100.0::DOUBLE * count(*) FILTER (kind IN ('sub', 'del', 'ins')) / nullif(sum(words), 0) AS wer FROM rows GROUP BY 1, 2),
p AS (SELECT model, max(wer) FILTER (run = 'base') AS base, max(wer) FILTER (run = 'run') AS run FROM c GROUP BY 1)
SELECT p.model, CASE p.model WHEN 'm2' THEN 1 WHEN 'm0' THEN 2 ELSE 3 END AS place, p.base, p.run, p.base - t.base AS base_to_teacher, p.run - t.run AS run_to_teacher FROM p LEFT JOIN p t ON t.model = 'm2'""",
)
def _(s, d):
    wrong = F.col("kind").isin("sub", "del", "ins").cast("int")
    metrics = error_rows(s, d).select(F.concat(F.lit("m"), (F.col("clip_id") % 4).cast("string")).alias("model"), F.col("run").alias("set"), wrong.alias("errors"), "words")
    return C.model_table(metrics, ["base", "run"], "m2", ["m2", "m0"])


@query(
    "r6_episode_segments",
    f"""WITH {SEGMENTS}, h AS (SELECT user_id, arg_min(event_type, event_id) AS text FROM events GROUP BY 1), e AS (SELECT user_id, event_id, ['pending', 'done', 'skipped', 'in_progress'][event_id % 4 + 1] AS status FROM events),
t AS (SELECT user_id, event_id AS task_id, status FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN status IN ('pending', 'in_progress') THEN 0 ELSE 1 END, event_id DESC) = 1)
SELECT segment_id, episode, duration, text, task_id, status FROM segments LEFT JOIN h ON h.user_id = segment_id LEFT JOIN t ON t.user_id = segment_id""",
)
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("segment_id"), F.col("event_id").alias("id"), F.col("event_type").alias("text"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "done", "skipped", "in_progress")]), (F.col("id") % 4 + 1).cast("int"))
    return C.episode_segments(segments(s, d).select("segment_id", "episode", "duration"), e, e.withColumn("status", status).drop("text"))


@query("r15_newest_clips", "SELECT event_type AS model, user_id % 2 AS set, user_id AS run_id, event_id AS clip_id FROM events QUALIFY user_id = max(user_id) OVER (PARTITION BY event_type, user_id % 2)")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 2).alias("set"), F.col("user_id").alias("run_id"), F.col("event_id").alias("clip_id"))
    return C.newest_clips(e, e.select(F.struct("model", "set").alias("of"), "run_id", "clip_id")).where(F.col("of") == F.struct("model", "set")).drop("of")


@query(
    "r24_error_files",
    """WITH o AS (SELECT l_suppkey, 100.0::DOUBLE * count(*) FILTER (l_returnflag = 'R') / nullif(sum(l_quantity), 0) AS wer FROM lineitem GROUP BY 1), i AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal::DOUBLE / 1000 END AS w FROM supplier)
SELECT s_suppkey AS file, wer, w AS imported_wer, wer - w AS difference FROM i LEFT JOIN o ON l_suppkey = s_suppkey""",
)
def _(s, d):
    files = table(s, d, "supplier").select(F.col("s_suppkey").alias("file"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal") / 1000).alias("wer"))
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_returnflag") == "R").cast("int").alias("errors"), F.col("l_quantity").alias("words"))
    return C.error_files(files.select("file"), rows, files.where("wer is not null"))
