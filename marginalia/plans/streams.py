"""Queries on streams with timers; logs of requests are derived from events, written to the shared folder, and streamed from there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from ..sources.files import shared_path
from ..streaming import processors as pr

C = F.col
TWELVE_HOURS, DAY = 43200.0, 86400.0


def stream(s, d):
    """Events with their number (at) and time in seconds, and a watermark without delay."""
    e = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    return pr.timed(e.select("user_id", C("event_id").alias("at"), "event_type", "props", (F.unix_micros(C("ts").cast("timestamp")) / 1e6).alias("seconds")))


def number(props="props"):
    return F.get_json_object(props, "$.k").cast("long")


def checkouts(s, d):
    kind = F.when(C("event_type") == "view", "checkout").when(C("event_type") == "click", "answer").when(C("event_type") == "error", "cancel")
    e = stream(s, d).withColumn("kind", kind).filter("kind IS NOT NULL").select((C("user_id") % 7).cast("string").alias("request"), C("user_id").cast("string").alias("user"), "at", "kind", "seconds", "time")
    return pr.run_available(pr.process(e, ["request", "user"], pr.Checkouts(TWELVE_HOURS)), "checkouts").withColumn("seconds", F.round("seconds", 3))


def queue_log(s, d):
    """(queue, at, kind, grp, panels, panel, timeout, seconds): what happens to a user's queue. Answers and cancellations name a panel of one of the user's last eight groups."""
    k = F.coalesce(number(), F.lit(0))
    e = table(s, d, "events").select(C("user_id").alias("queue"), C("event_id").alias("at"), "event_type", k.alias("k"), (F.unix_micros(C("ts").cast("timestamp")) / 1e6).alias("seconds"))
    kind = F.when(C("event_type") == "view", "add").when(C("event_type") == "click", "take").when(C("event_type") == "purchase", "answer").when(C("event_type") == "error", F.when(C("k") < 60, "cancel").otherwise("answer"))
    kind = F.coalesce(kind, F.when(C("k") < 4, "flush").when(C("k") < 8, "clear").otherwise("take"))
    asked = F.collect_list(F.when(C("kind") == "add", C("at"))).over(Window.partitionBy("queue").orderBy("at").rowsBetween(-40, 0))
    named = F.get(F.slice(F.reverse("asked"), 1, 8), (C("k") % 8).cast("int"))
    e = e.withColumn("kind", kind).withColumn("asked", asked).withColumn("grp", F.when(C("kind") == "add", C("at")).otherwise(named).cast("string"))
    panels = F.transform(F.sequence(F.lit(0), (C("k") % 3).cast("int")), lambda i: F.concat_ws("-", "grp", i.cast("string")))
    timeout = F.when(C("k") % 4 == 0, 0.0).otherwise(2 * DAY + C("k") * 3600.0)
    return e.select("queue", "at", "kind", F.col("grp").alias("group"), F.when(C("kind") == "add", panels).alias("panels"), F.concat_ws("-", "grp", (C("k") % 2).cast("string")).alias("panel"), timeout.alias("timeout"), "seconds")


def streamed(s, log, tag):
    path = shared_path(s, tag)
    log.write.parquet(path)
    return pr.timed(s.readStream.schema(log.schema).parquet(path))


def queues(s, d):
    log = streamed(s, queue_log(s, d), "queue-log")
    return pr.run_available(pr.process(log, ["queue"], pr.Queue()), "queues").withColumn("seconds", F.round("seconds", 3))


def ranges(s, d):
    e = stream(s, d).select(C("user_id").alias("prefix"), "at", F.when(C("at") % 3 == 0, "remove").otherwise("add").alias("kind"), (C("at") % 11 * 1000).alias("number"), C("event_type").alias("source"), "seconds", "time")
    return pr.run_available(pr.process(e, ["prefix"], pr.NumberRange()), "ranges")


def life_log(s, d):
    """(request, at, kind, value, seconds): a request for each user and third of the users' own events in turn."""
    k = F.coalesce(number(), F.lit(0))
    kind = F.when(C("event_type") == "view", "start").when(C("event_type") == "click", "init").when(C("event_type") == "purchase", "process")
    kind = F.coalesce(kind, F.when(C("event_type") == "error", F.when(C("k") < 30, "error").when(C("k") < 50, "cancel").otherwise("status")), F.when(C("k") < 40, "access").otherwise("clean"))
    e = table(s, d, "events").withColumn("k", k)
    return e.select(C("user_id").cast("string").alias("request"), C("event_id").alias("at"), kind.alias("kind"), C("k").cast("double").alias("value"), (F.unix_micros(C("ts").cast("timestamp")) / 1e6).alias("seconds"))


def life_cycles(s, d):
    log = streamed(s, life_log(s, d), "life-log")
    return pr.run_available(pr.process(log, ["request"], pr.LifeCycle(5 * DAY)), "life-cycles").withColumn("seconds", F.round("seconds", 3))


CHECKOUTS = """
WITH e AS (SELECT user_id, event_id AS "at", CASE event_type WHEN 'view' THEN 'checkout' WHEN 'click' THEN 'answer' WHEN 'error' THEN 'cancel' END AS kind, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type IN ('view', 'click', 'error')),
w AS (SELECT *, lag("at") OVER o AS was, lag(kind) OVER o = 'checkout' AND t - lag(t) OVER o <= 43200 AS open, t - lag(t) OVER o AS took, lead(t) OVER o AS until FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, "at")),
o AS (SELECT user_id, CASE WHEN open THEN was END AS checkout, "at", CASE WHEN NOT coalesce(open, false) THEN 'late' WHEN kind = 'answer' THEN 'answered' ELSE 'cancelled' END AS outcome, t, CASE WHEN open AND kind = 'answer' THEN floor(took + 0.5)::BIGINT END AS took FROM w WHERE kind = 'answer' OR (kind = 'cancel' AND open)
  UNION ALL SELECT user_id, "at", NULL, 'timeout', t + 43200, NULL FROM w WHERE kind = 'checkout' AND (until - t > 43200 OR (until IS NULL AND t + 43200.001 < (SELECT epoch_us(max(ts)) / 1e6 FROM events))))
SELECT (user_id % 7)::VARCHAR AS request, user_id::VARCHAR AS "user", checkout, "at", outcome, round(t, 3) AS seconds, took FROM o
"""
RANGES = """
WITH e AS (SELECT user_id AS prefix, event_id AS "at", epoch_us(ts) AS t, event_id % 3 <> 0 AS adds, event_id % 11 * 1000 AS number, event_type AS source FROM events),
s AS (SELECT a.prefix, a."at", a.number, b.number AS other, b.source, arg_max(b.adds, (b.t, b."at")) AS there FROM e a JOIN e b ON a.prefix = b.prefix AND (b.t, b."at") <= (a.t, a."at") GROUP BY ALL)
SELECT prefix, "at", number, count(*) FILTER (there AND other = number) AS sources, min(other) FILTER (there) AS least, max(other) FILTER (there) AS greatest FROM s GROUP BY ALL
"""

QUERIES = {
    "v9_groups": (queues, None),
    "v10_timers": (checkouts, CHECKOUTS),
    "v21_states": (life_cycles, None),
    "a12_ranges": (ranges, RANGES),
}
