"""Queries on votes, quizzes and decisions, over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tokens as tk
from ..operators import votes as v
from ..session import table


def votes(s, d):
    k = F.floor("value") % 40
    return table(s, d, "events").select((k % 8).alias("request"), k.alias("param"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"), F.col("user_id").alias("user"), F.col("event_id").alias("ord"))


V = "v AS (SELECT (floor(value) % 40 % 8)::BIGINT AS request, (floor(value) % 40)::BIGINT AS param, CASE WHEN event_type <> 'error' THEN event_type END AS value, user_id AS u, event_id AS ord FROM events)"
SUP = V + ", f AS (SELECT request, param, value, u, min(ord) AS since FROM v WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT request, param, value, count(*) AS n, max(since) AS reached_at FROM f GROUP BY ALL)"
AGR = SUP + """, b AS (SELECT request, param, arg_min(value, (-n, reached_at, value)) AS value, max(n) AS n FROM s GROUP BY ALL),
w AS (SELECT request, count(DISTINCT u) AS voters FROM v GROUP BY 1), m AS (SELECT request, param, count(DISTINCT u) FILTER (WHERE value IS NOT NULL) AS named FROM v GROUP BY ALL),
a AS (SELECT m.request, m.param, CASE WHEN n >= 8 THEN value END AS value, coalesce(n, 0) AS n, voters - named AS n_null, coalesce(n, 0) >= 8 OR voters - named >= 8 AS complete FROM m JOIN w USING (request) LEFT JOIN b ON b.request = m.request AND b.param = m.param)"""


def agreed(s, d):
    return v.agreed(votes(s, d), 8)


def users(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("user")).distinct()


def requests(s, d):
    return votes(s, d).select(F.col("param").alias("request")).distinct()


def answers(s, d):
    e = F.col("event_type")
    outcome = F.when(e == "purchase", "right").when(e == "click", "wrong").when(e == "error", "cancel").when(e == "view", "timeout").otherwise("right")
    return table(s, d, "events").select(F.col("user_id").alias("user"), outcome.alias("outcome"), (F.floor("value") % 4 + 1).alias("complexity"))


QUIZ = """q AS (SELECT user_id AS u, CASE event_type WHEN 'purchase' THEN 'right' WHEN 'click' THEN 'wrong' WHEN 'error' THEN 'cancel' WHEN 'view' THEN 'timeout' ELSE 'right' END AS o, (floor(value) % 4 + 1)::BIGINT AS c FROM events),
z AS (SELECT u AS user, sum(CASE WHEN o = 'right' THEN greatest(1, c) * 10 ELSE 0 END)::BIGINT AS score, sum(CASE WHEN o = 'wrong' THEN least(1, c - 1) * 3 WHEN o IN ('cancel', 'timeout') THEN 3 ELSE 0 END)::BIGINT AS penalty FROM q GROUP BY 1)"""


def timing(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(s, d, "events").withColumn("was", F.lag("ts").over(w)).filter("was IS NOT NULL").select("event_id", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("was").cast("timestamp"))) / 1000000 + 0.5).cast("long").alias("seconds"))


def talk(s, d):
    return table(s, d, "conversations")


def state_spans(s, d):
    """Runs of capitalised words as spans: a word after another one continues its span."""
    t = tk.tokens(table(s, d, "documents")).withColumn("cap", F.col("tok").rlike(r"^\p{Lu}"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    state = F.when(~F.col("cap"), "O").when(F.lag("cap").over(w), "C").otherwise("S")
    found = v.sections(t.withColumn("state", state), "doc_id", "pos", F.col("state"))
    return found.select("doc_id", F.col("first").alias("start"), (F.col("last") + 1).alias("end"))


TOK = r"[\p{L}\p{M}]+|[0-9]+|[^\s\p{L}\p{M}0-9]"


def lives(s, d):
    e = F.col("event_type")
    event = F.when(e == "view", "start").when(e == "click", "pause").when(e == "purchase", "stop").when(e == "error", "close").otherwise("start")
    return v.lifecycle(table(s, d, "events").select((F.col("user_id") % 97).alias("quiz"), F.col("event_id").alias("ord"), event.alias("event"), (F.floor("value") % 6).alias("users")))


LIFE = """WITH RECURSIVE e AS (SELECT user_id % 97 AS quiz, row_number() OVER (PARTITION BY user_id % 97 ORDER BY event_id) AS k,
  CASE event_type WHEN 'click' THEN 'pause' WHEN 'purchase' THEN 'stop' WHEN 'error' THEN 'close' ELSE 'start' END AS ev, floor(value) % 6 AS users FROM events),
f(quiz, k, state) AS (SELECT DISTINCT quiz, 0::BIGINT, 'INITIALIZING' FROM e UNION ALL
  SELECT f.quiz, f.k + 1, CASE WHEN state = 'INITIALIZING' AND ev = 'start' AND users >= 3 THEN 'RUNNING' WHEN state = 'RUNNING' AND ev = 'pause' THEN 'PAUSED' WHEN state = 'PAUSED' AND ev = 'start' THEN 'RUNNING'
    WHEN state IN ('RUNNING', 'PAUSED') AND ev = 'stop' THEN 'FINISHED' WHEN state = 'FINISHED' AND ev = 'close' THEN 'CLOSED' ELSE state END
  FROM f JOIN e ON e.quiz = f.quiz AND e.k = f.k + 1)
SELECT quiz, arg_max(state, k) AS state FROM f GROUP BY 1"""

QUERIES = {
    "v1_vote_support": (lambda s, d: v.support(votes(s, d)), f"WITH {SUP} SELECT * FROM s"),
    "v2_agreed": (agreed, f"WITH {AGR} SELECT * FROM a"),
    "v3_completeness": (lambda s, d: v.complete_requests(agreed(s, d)), f"WITH {AGR} SELECT request, bool_and(complete) AS complete, sum((NOT complete)::INT)::BIGINT AS ambiguous FROM a GROUP BY 1"),
    "v4_null_voters": (lambda s, d: v.null_voters(votes(s, d)), f"WITH {V} SELECT p.request, param, u AS user FROM (SELECT DISTINCT request, param FROM v) p JOIN (SELECT DISTINCT request, u FROM v) w USING (request) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.request = p.request AND v.param = p.param AND v.u = w.u AND value IS NOT NULL)"),
    "v5_results": (lambda s, d: agreed(s, d).filter("complete AND value IS NOT NULL").select("request", "param", "value"), f"WITH {AGR} SELECT request, param, value FROM a WHERE complete AND value IS NOT NULL"),
    "v6_correct_answers": (lambda s, d: v.correct_answers(votes(s, d), agreed(s, d)), f"WITH {AGR} SELECT u AS user, count(*) AS correct FROM (SELECT DISTINCT u, request, param FROM v WHERE value IS NOT NULL AND (request, param, value) IN (SELECT (request, param, value) FROM a)) GROUP BY 1"),
    "v7_redundancy": (lambda s, d: table(s, d, "events").select("event_id", v.redundancy(3, 12, F.floor("value") % 9 + 1).alias("redundancy")), "SELECT event_id, least(3, ceil(12 / (floor(value) % 9 + 1)))::BIGINT AS redundancy FROM events"),
    "v8_next_request": (lambda s, d: v.next_request(requests(s, d), votes(s, d).select("user", F.col("param").alias("request"), F.lit(False).alias("cancelled")), users(s, d)), f"WITH {V} SELECT u AS user, min(r.param) AS request FROM (SELECT DISTINCT u FROM v) x, (SELECT DISTINCT param FROM v) r WHERE (u, r.param) NOT IN (SELECT (u, param) FROM v) GROUP BY 1"),
    "v11_answer_timing": (timing, "SELECT event_id, floor((epoch_us(ts) - epoch_us(was)) / 1000000 + 0.5)::BIGINT AS seconds FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS NOT NULL"),
    "v12_quiz_lifecycle": (lives, LIFE),
    "v13_quiz_scores": (lambda s, d: v.quiz_scores(answers(s, d), 10, 3), f"WITH {QUIZ} SELECT *, score - penalty AS net FROM z"),
    "v14_ranking": (lambda s, d: v.ranking(v.quiz_scores(answers(s, d), 10, 3)), f"WITH {QUIZ} SELECT *, score - penalty AS net, rank() OVER (ORDER BY score - penalty DESC) AS rank FROM z"),
    "v15_request_choice": (lambda s, d: v.next_request(requests(s, d), votes(s, d).groupBy("user", F.col("param").alias("request")).agg(F.bool_and(F.col("value").isNull()).alias("cancelled")), users(s, d)), f"WITH {V}, a AS (SELECT u, param, bool_and(value IS NULL) AS cancelled FROM v GROUP BY ALL), o AS (SELECT x.u, r.param, cancelled FROM (SELECT DISTINCT u FROM v) x CROSS JOIN (SELECT DISTINCT param FROM v) r LEFT JOIN a ON a.u = x.u AND a.param = r.param WHERE cancelled IS NOT FALSE) SELECT u AS user, arg_min(param, (coalesce(cancelled, false), param)) AS request FROM o GROUP BY 1"),
    "v16_sections": (lambda s, d: v.sections(talk(s, d), "conv_id", "turn", F.when(F.col("role") == "user", "S").when(F.col("role") == "system", "O")), "WITH x AS (SELECT *, sum((role = 'user')::INT) OVER w AS section, last_value(CASE role WHEN 'user' THEN 'S' WHEN 'system' THEN 'O' END IGNORE NULLS) OVER w AS st FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, section::BIGINT AS section, min(turn) AS first, max(turn) AS last FROM x WHERE section > 0 AND st = 'S' GROUP BY 1, 2"),
    "v17_decisions": (lambda s, d: v.decisions(table(s, d, "events").select("event_id", "event_type"), F.col("event_type"), "view", ["click", "purchase"]), "SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'view' END AS decision FROM events"),
    "v18_token_spans": (state_spans, f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{TOK}') AS a FROM documents), k AS (SELECT doc_id, unnest(range(len(a))) AS pos, regexp_matches(unnest(a), '^\\p{{Lu}}') AS cap FROM t), i AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM k WHERE cap) SELECT doc_id, min(pos)::INT AS start, (max(pos) + 1)::INT AS \"end\" FROM i GROUP BY doc_id, g"),
    "v19_complexity": (lambda s, d: talk(s, d).groupBy("conv_id").agg((F.count("*") * F.count_distinct("role")).alias("complexity"), F.max(F.size(tk.token_array(F.col("text")))).alias("tokens")), f"SELECT conv_id, count(*) * count(DISTINCT role) AS complexity, max(len(regexp_extract_all(coalesce(text, ''), '{TOK}')))::INT AS tokens FROM conversations GROUP BY 1"),
    "v20_dispatch": (lambda s, d: v.dispatch(table(s, d, "events").select(F.col("event_id").alias("request"), F.col("event_type").alias("kind")), s.createDataFrame([("web", 5, "view"), ("desk", 5, "view"), ("desk", 7, "click"), ("web", 9, "click"), ("batch", 1, "purchase")], "service string, priority int, kind string")), "SELECT event_id AS request, CASE event_type WHEN 'view' THEN 'desk' WHEN 'click' THEN 'web' ELSE 'batch' END AS service FROM events WHERE event_type IN ('view', 'click', 'purchase')"),
}
