"""Queries: the event log in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.redact import redact
from lexloom.session import new_path
from lexloom.streaming import events as E
from lexloom.streaming.state import admitted, follow_from
from lexloom.plans.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("job_id"), "event_id", name.alias("event"), F.col("props").alias("data"), F.col("ts").alias("at"))


def event_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sequence(_events(spark, sf_dir)).select("job_id", "event_id", "seq")


def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages recorded and replayed, up to the first terminal one."""
    rows = E.sequence(_events(spark, sf_dir)).drop("event_id")
    return E.until_terminal(E.replay(E.record(rows))).select("job_id", "seq", "event", "at")


_SEQ = """e AS (SELECT user_id % 500 AS job_id, event_id, CASE event_type WHEN 'purchase' THEN 'done' ELSE event_type END AS event, ts AS "at", row_number() OVER (PARTITION BY user_id % 500 ORDER BY event_id) AS seq FROM events)"""


def event_replay_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What late listeners still get: each had seen a few events."""
    seen = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 9).alias("last"))
    return E.unseen(E.sequence(_events(spark, sf_dir)), seen).select("job_id", "seq", "event")


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("tenant"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return E.admitted(requests, 30, 150)


_QUOTA = """WITH r AS (SELECT event_id AS id, user_id % 8 AS tenant, ts AS "at", ts::DATE AS day FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY tenant, day ORDER BY "at", id) AS nth FROM r),
g AS (SELECT *, sum((nth <= 30)::INT) OVER (PARTITION BY day ORDER BY "at", id) AS every FROM o)
SELECT id, tenant, day, nth, nth <= 30 AND every <= 150 AS ok FROM g"""


def quota_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), (F.col("user_id") % 8).alias("tenant"))
    return E.count_today(rows, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), tenant=F.lit(3))


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream that reads all there is gives, written to the shared folder and read back."""
    out, marks = new_path(spark, "stream"), new_path(spark, "marks")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{epoch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", marks).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(out)


def _as_stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = new_path(spark, f"source-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every event arrives twice gives each once."""
    rows = E.sequence(_events(spark, sf_dir)).select("job_id", F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"))
    twice = _as_stream(spark, rows.unionByName(rows))
    return _drained(spark, E.follow(twice), "append").select("job_id", "seq")


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listeners of all jobs hear: a job's first events, a number that depends on the job, are recorded; the rest, and one of the recorded again, come live."""
    rows = E.sequence(_events(spark, sf_dir)).select("job_id", F.col("seq").cast("long").alias("seq"), "event", "data", F.col("at").cast("timestamp").alias("at"))
    known = F.col("job_id") % 23
    live = _as_stream(spark, rows.where(F.col("seq") >= known))
    return _drained(spark, follow_from(live, rows.where(F.col("seq") <= known), "400 days"), "append").select("job_id", "seq", "event", "at")


def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests admitted as they arrive, their questions redacted first."""
    question = F.concat(F.lit("user "), "user_id", F.lit(" of SSN 123-45-6789 asks"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("tenant"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), question.alias("question"))
    return _drained(spark, admitted(_as_stream(spark, rows), 30, 150), "append").select("id", "tenant", "day", "nth", "every", "ok", "question")


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of tenants as a stream."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("tenant"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(spark, E.daily_counts(_as_stream(spark, rows)), "complete")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", E.frame(F.col("event_type"), F.struct(F.col("user_id").alias("user"))).alias("frame"))


def terminal_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("job_id").agg(F.max_by("event", "event_id").alias("status")).where(E.is_terminal(F.col("status")))


def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redact(docs).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.regexp_count("text", F.lit(r"\[REDACTED")).alias("n"))


QUERIES = {
    "event_seq": (event_seq, f"WITH {_SEQ} SELECT job_id, event_id, seq FROM e"),
    "event_replay": (event_replay, f"""WITH {_SEQ}, t AS (SELECT *, min(CASE WHEN event IN ('done', 'error') THEN seq END) OVER (PARTITION BY job_id) AS stop FROM e) SELECT job_id, seq, event, "at" FROM t WHERE stop IS NULL OR seq <= stop"""),
    "event_replay_dedupe": (event_replay_dedupe, f"WITH {_SEQ} SELECT job_id, seq, event FROM e LEFT JOIN (SELECT c_custkey AS job, c_custkey % 9 AS seen FROM customer) ON job = job_id WHERE seq > coalesce(seen, 0)"),
    "daily_quota": (daily_quota, _QUOTA),
    "quota_today": (quota_today, "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' AND user_id % 8 = 3"),
    "stream_dedupe": (stream_dedupe, f"WITH {_SEQ} SELECT job_id, seq FROM e"),
    "followed_events": (followed, f"""WITH {_SEQ}, t AS (SELECT *, min(CASE WHEN event IN ('done', 'error') THEN seq END) OVER (PARTITION BY job_id) AS stop FROM e) SELECT job_id, seq, event, "at" FROM t WHERE stop IS NULL OR seq <= stop"""),
    "stream_admission": (
        stream_admission,
        """WITH r AS (SELECT event_id AS id, user_id, user_id % 8 AS tenant, ts AS "at", ts::DATE AS day FROM events),
        o AS (SELECT *, row_number() OVER (PARTITION BY tenant, day ORDER BY "at", id) AS nth FROM r QUALIFY nth <= 30)
        SELECT id, tenant, day, nth, row_number() OVER (PARTITION BY day ORDER BY "at", id) AS every, row_number() OVER (PARTITION BY day ORDER BY "at", id) <= 150 AS ok, 'user ' || user_id || ' of SSN [REDACTED SSN] asks' AS question FROM o""",
    ),
    "stream_equals_batch": (stream_equals_batch, "SELECT ts::DATE AS day, user_id % 8 AS tenant, count(*) AS n FROM events GROUP BY 1, 2"),
    "event_frames": (event_frames, """SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"user":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events"""),
    "terminal_jobs": (terminal_jobs, f"WITH {_SEQ} SELECT job_id, arg_max(event, event_id) AS status FROM e GROUP BY job_id HAVING arg_max(event, event_id) IN ('done', 'error')"),
    "pii_redact": (pii_redact, None),
}
