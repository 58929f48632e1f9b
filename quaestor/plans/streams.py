"""Queries over events: streams, rates, dead letters and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import state, tables
from quaestor.plans import registry
from quaestor.plans.binding import table
from quaestor.plans.registry import query
from quaestor.streaming import stateful, windows


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL", bound=False)
def stream_tumbling(spark, sf_dir):
    return windows.closed(spark, sf_dir, windows.tumbling)


@query("SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL", bound=False)
def stream_sliding(spark, sf_dir):
    return windows.closed(spark, sf_dir, windows.sliding)


@query("""SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, island""", bound=False)
def stream_session(spark, sf_dir):
    return windows.closed(spark, sf_dir, windows.sessions)


@query("SELECT DISTINCT user_id, event_type FROM events", bound=False)
def stream_dedup(spark, sf_dir):
    return windows.drained(spark, windows.firsts(windows.events(spark, sf_dir)), "append")


@query("SELECT user_id, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n, count(*) > 20 AS limited FROM events GROUP BY 1, 2", bound=False)
def upload_rate_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("minute"), "n", (F.col("n") > 20).alias("limited"))


@query("""SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS concept_id, count(DISTINCT user_id) FILTER (event_type = 'view') AS served, count(DISTINCT user_id) FILTER (event_type = 'click') AS escalated,
CASE WHEN count(DISTINCT user_id) FILTER (event_type = 'view') > 0 THEN round(count(DISTINCT user_id) FILTER (event_type = 'click') / CAST(count(DISTINCT user_id) FILTER (event_type = 'view') AS DOUBLE), 6) END AS rate FROM events GROUP BY 1""", bound=False)
def escalation_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("concept_id"), "user_id", "event_type")
    who = lambda kind: F.count_distinct(F.when(F.col("event_type") == kind, F.col("user_id")))
    out = rows.groupBy("concept_id").agg(who("view").alias("served"), who("click").alias("escalated"))
    return out.withColumn("rate", F.round(F.try_divide(F.col("escalated").cast("double"), F.col("served")), 6))


@query("""WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
SELECT date_trunc('day', v.ts)::TIMESTAMP AS window_start, v.k AS concept_id, count(DISTINCT v.user_id) AS served, count(DISTINCT c.user_id) AS escalated, round(count(DISTINCT c.user_id) / CAST(count(DISTINCT v.user_id) AS DOUBLE), 6) AS rate
FROM e v LEFT JOIN e c ON c.event_type = 'click' AND c.user_id = v.user_id AND c.k = v.k AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 10 DAY WHERE v.event_type = 'view' GROUP BY 1, 2""", bound=False)
def stream_escalation_rate(spark, sf_dir):
    """By day and concept, who was served and which of them escalated within ten days, as joined streams."""

    def build(rows):
        end = F.col("event_type").isNull() & F.col("user_id").isNull()  # the last event has keys of its own, so that joins let it pass
        concept = F.get_json_object("props", "$.k").cast("long")
        steps = rows.select(F.when(end, -1).otherwise(F.col("user_id")).alias("user_id"), F.when(end, -1).otherwise(concept).alias("concept_id"), "event_type", "ts")
        kind = lambda name: steps.where(f"event_type = '{name}' or (event_type is null and user_id = -1)").drop("event_type")
        return windows.escalations(kind("view"), kind("click"))

    return windows.closed(spark, sf_dir, build)


@query("SELECT user_id AS job_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'error') WHERE r = 5", bound=False)
def dead_letters(spark, sf_dir):
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("job_id"), "event_id", "ts")
    return tables.dead_letters(failures).select("job_id", "event_id", "ts")


_DEAD = registry.SQL["dead_letters"]
DAY = 86_400_000


def _moment():
    """The time of an event in milliseconds, for timers, and in microseconds, for the order."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return F.floor(us / 1000).alias("at"), us.alias("us")


def _settled(spark, sf_dir, build):
    """The result of a stateful stream once a last event far ahead has let every row pass the watermark."""
    with stateful.rocks(spark):
        return windows.closed(spark, sf_dir, build)


@query(_DEAD, bound=False)
def stream_dead_letters(spark, sf_dir):
    """The same from a stream, with the count of each job in the state store; a job without failures for 400 days is forgotten."""

    def build(rows):
        failures = rows.where("event_type = 'error' or (event_type is null and user_id is null)").select(F.col("user_id").alias("job_id"), *_moment(), "event_id")
        return stateful.dead_letters(failures, "job_id", ["at", "us", "event_id"], "job_id long,event_id long,us long", 400 * DAY, windows.LATE)

    out = _settled(spark, sf_dir, build)
    return out.select("job_id", "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))


# How the events stand for those of the learn loop.
LOOP = {"signup": "START", "view": "LESSON_SERVED", "purchase": "TEST_PASSED", "error": "TEST_FAILED", "click": "ESCALATE"}
LOOP_OUT = "user_id long,event_id long,state string,index long,depth long,spent double,effects string,reason string"


def _steps(rows):
    return rows.select("user_id", *_moment(), "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("concept"), (F.col("value") / 10).alias("minutes"))


def _learn(session, r):
    session = state.advance(session, LOOP[r.event_type], r.concept, r.minutes, (r.concept,))
    return session, (r.user_id, r.event_id, session.state, session.index, len(session.stack), round(session.spent, 6), " ".join(session.effects), session.reason)


def _session(user):
    return state.Session(plan=tuple(range(20)), budget=600.0, planned=300.0, reserve=90.0)


SESSION = "plan array<long>, budget double, planned double, reserve double, state string, index long, stack array<long>, spent double, current long"


def _packed(s):
    return (list(s.plan), s.budget, s.planned, s.reserve, s.state, s.index, list(s.stack), s.spent, s.current)


def _unpacked(x):
    return state.Session(*[tuple(v) if isinstance(v, list) else v for v in x])


def loop_fold(spark, sf_dir):
    """The state of each user's session after each event, in batch; who rests for more than 10 days starts anew."""
    start, step = stateful.restarting(_session, _learn, "at", 10 * DAY, "user_id")
    return tables.folded(_steps(table(spark, sf_dir, "events")), "user_id", ["at", "us", "event_id"], start, step, LOOP_OUT)


def loop_stream(spark, sf_dir):
    """The same from a stream, with each session in the state store until it has rested."""
    return _settled(spark, sf_dir, lambda rows: stateful.folded(_steps(rows), "user_id", ["at", "us", "event_id"], _session, _learn, LOOP_OUT, SESSION, 10 * DAY, windows.LATE, _packed, _unpacked))


BUCKET_OUT = "bucket string,event_id long,allowed boolean,wait_ms long"
#: Time runs so many times slower than in the events, so that buckets do run dry.
SLOWER = 100_000


def _requests(rows):
    """Requests of users to two providers, each user with a bucket at each."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    provider = F.when(F.col("event_id") % 2 == 0, "gemini").otherwise("groq")
    return rows.select(F.concat_ws("/", provider, F.col("user_id").cast("string")).alias("bucket"), F.floor(us / 1000).alias("at"), us.alias("us"), "event_id")


def _take(bucket, r):
    now = r.us / (1e6 * SLOWER)
    tokens, allowed, wait = state.take(*bucket, now, 1.0, *state.BUCKETS[r.bucket.split("/")[0]])
    return (tokens, now), (r.bucket, r.event_id, allowed, wait)


_BUCKET = f"""WITH RECURSIVE e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'gemini' ELSE 'groq' END || '/' || user_id AS bucket, epoch_us(ts) / {1e6 * SLOWER:.0f}.0::DOUBLE AS sec, CASE WHEN event_id % 2 = 0 THEN 15.0::DOUBLE ELSE 30.0::DOUBLE END AS cap, CASE WHEN event_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS rate FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sec, event_id) AS n FROM e),
b AS (SELECT bucket, n, event_id, sec, cap - 1 AS tokens, TRUE AS allowed, 0::BIGINT AS wait_ms FROM o WHERE n = 1
  UNION ALL SELECT bucket, n, event_id, sec, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1, CASE WHEN t >= 1 THEN 0 ELSE CAST(ceil((1 - t) / rate * 1000) AS BIGINT) END
  FROM (SELECT o.*, least(o.cap, b.tokens + (o.sec - b.sec) * o.rate) AS t FROM b JOIN o ON o.bucket = b.bucket AND o.n = b.n + 1))
SELECT bucket, event_id, allowed, wait_ms FROM b"""


@query(_BUCKET, bound=False)
def token_bucket(spark, sf_dir):
    """Whether each request gets a token of its user's bucket at a provider, and how long it would have to wait."""
    return tables.folded(_requests(table(spark, sf_dir, "events")), "bucket", ["at", "us", "event_id"], lambda _: (0.0, None), _take, BUCKET_OUT)


@query(_BUCKET, bound=False)
def stream_token_bucket(spark, sf_dir):
    """The same from a stream; a bucket that has rested until it is full again leaves the state store."""
    full = 1000 * SLOWER * max(capacity / rate for capacity, rate in state.BUCKETS.values())
    return _settled(spark, sf_dir, lambda rows: stateful.folded(_requests(rows), "bucket", ["at", "us", "event_id"], lambda _: (0.0, None), _take, BUCKET_OUT, "tokens double, last double", int(full), windows.LATE))


@query("SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS paper, event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 6 ELSE -1 END AS stage FROM events WHERE user_id % 3 > 0", bound=False)
def progress_stream(spark, sf_dir):
    """Progress of papers: messages of channels paper:<id>, with the place of their stage; other channels are passed over."""
    stages = {"signup": "queued", "view": "extracted", "click": "segmented", "purchase": "ready", "error": "failed"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in stages.items()])
    channel = F.concat(F.when(F.col("user_id") % 3 == 0, "user:").otherwise("paper:"), F.get_json_object("props", "$.k"))
    stream = windows.events(spark, sf_dir).select("event_id", channel.alias("channel"), kind.alias("kind"))
    return windows.drained(spark, windows.progress(stream), "append")


registry.QUERIES |= {"loop_fold": loop_fold, "loop_stream": loop_stream}
