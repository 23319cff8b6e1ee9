"""Queries of windows over time, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choices as C
from ..operators import latest as L
from ..streaming import windows as S
from .registry import query
from .views import table


def _events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_sliding", "WITH w AS (SELECT unnest(range(0, 6)) AS k), e AS (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start FROM events, w) SELECT start, start + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM e GROUP BY 1, 2, 3")
def _(s, d):
    return S.sliding(_events(s, d), "ts", "6 hours", "1 hour", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))


@query("t1_frame_means", "WITH e AS (SELECT user_id, event_id % 50 AS f, value, event_id FROM events), x AS (SELECT user_id, f + i AS frame, value + i AS v FROM e, (SELECT unnest(range(0, 4)) AS i)) SELECT user_id, frame, avg(v) AS value FROM x GROUP BY 1, 2")
def _(s, d):
    e = table(s, d, "events").select("user_id", ((F.col("event_id") % 50) * 0.5).alias("start"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("value") + i).alias("v"))
    return S.frame_means(e, "user_id", "start", "v", 0.5, 0.5)


@query("t2_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM k GROUP BY user_id, s")
def _(s, d):
    return S.sessions(_events(s, d), "ts", "2 hours", ["user_id"], F.count("*").alias("n"))


@query("t2_merged_turns", "WITH e AS (SELECT user_id % 20 AS ep, epoch_us(ts) / 1000000.0::DOUBLE AS a, epoch_us(ts) / 1000000.0::DOUBLE + value * 20 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY ep ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e), k AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY ep ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT ep, min(a) AS start, max(b) AS \"end\", count(*) AS n FROM k GROUP BY ep, g")
def _(s, d):
    a = F.unix_micros("ts") / F.lit(1000000.0)
    e = _events(s, d).select((F.col("user_id") % 20).alias("ep"), a.alias("a"), (a + F.col("value") * 20).alias("b"))
    return L.merged_within(e, "ep", "a", "b", 60.0)


@query("t4_idempotent_import", "SELECT event_id FROM events WHERE event_id % 7 = 0 AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def _(s, d):
    e = table(s, d, "events")
    return C.only_missing(e.where("event_id % 7 = 0"), e.where("event_type = 'view'"), ["event_id"]).select("event_id")


@query("t5_complete_groups", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5)")
def _(s, d):
    return C.complete_groups(table(s, d, "events"), "user_id", "event_type", 5).select("event_id")


@query("t10_daily", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def _(s, d):
    return S.tumbling(_events(s, d), "ts", "1 day", ["event_type"], F.count("*").alias("n"))


@query("r12_import_plan", "SELECT coalesce(a.k, b.k) AS event_id, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'kept' WHEN a.c = b.c THEN 'same' ELSE 'changed' END AS action FROM (SELECT event_id AS k, event_type AS c FROM events WHERE event_id % 3 <> 0) a FULL JOIN (SELECT event_id AS k, CASE WHEN event_id % 50 = 1 THEN 'old' ELSE event_type END AS c FROM events WHERE event_id % 4 <> 0) b ON a.k = b.k")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("c"))
    old = e.where("event_id % 4 <> 0").withColumn("c", F.when(F.col("event_id") % 50 == 1, "old").otherwise(F.col("c")))
    return C.import_plan(e.where("event_id % 3 <> 0"), old, "event_id", "c")


@query("r13_upsert", "SELECT event_id, 'new' AS state FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'old' FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0")
def _(s, d):
    e = table(s, d, "events").select("event_id")
    return C.upserted(e.where("event_id % 2 = 0").withColumn("state", F.lit("old")), e.where("event_id % 3 = 0").withColumn("state", F.lit("new")), ["event_id"])
