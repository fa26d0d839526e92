"""Stateful streams: a log split anywhere between record and stream, gaps and repeats, and quotas over several micro-batches."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lexloom.streaming import events as E
from lexloom.streaming import state as S

KIND = "job_id long, seq long, event string, data string, at timestamp"


def drained(spark, path, name, kind, parts, make):
    """What make(stream) tells of parts, a micro-batch each."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{path}/in/{n}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/marks").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def at(n):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


@pytest.mark.parametrize("split", [0, 1, 3, 5, 7])
def test_a_log_split_anywhere_is_heard_the_same(spark, tmp_path, split):
    rng, log = random.Random(split), []
    for job in range(6):
        n = 3 + job
        log += [(job, s, "done" if s == n - 1 and job % 2 else "error" if s == 2 and job == 4 else "work", f"d{s}", at(s)) for s in range(1, n + 1)]
    record = [r for r in log if r[1] <= split]
    live = [r for r in log if r[1] > split] + [r for r in log if r[1] in (split, 1)]
    rng.shuffle(live)
    parts = [live[i::3] for i in range(3) if live[i::3]]
    name = f"t{uuid.uuid4().hex}"
    recorded = spark.createDataFrame(record, KIND)
    got = drained(spark, str(tmp_path), name, KIND, parts, lambda s: S.follow_from(s, recorded, "1 day"))
    heard = sorted((r["job_id"], r["seq"], r["event"], r["data"]) for r in got.collect())
    want = E.until_terminal(spark.createDataFrame(log, KIND)).collect()
    assert heard == sorted((r["job_id"], r["seq"], r["event"], r["data"]) for r in want)


def test_what_is_behind_a_gap_is_told_when_the_watermark_passes(spark, tmp_path):
    parts = [[(1, 1, "work", "a", at(1)), (1, 3, "work", "c", at(3))], [(2, 1, "work", "x", at(600))], [(2, 2, "work", "y", at(601))]]
    got = drained(spark, str(tmp_path), f"t{uuid.uuid4().hex}", KIND, parts, lambda s: S.follow_from(s, spark.createDataFrame([], KIND), "10 minutes"))
    assert sorted((r["job_id"], r["seq"]) for r in got.collect()) == [(1, 1), (1, 3), (2, 1), (2, 2)]


def test_quotas_hold_over_micro_batches_and_questions_are_redacted(spark, tmp_path):
    kind = "tenant long, at timestamp, id long, question string"
    rows = [(i % 3, at(i * 40), i, f"SSN 123-45-678{i % 10} of {i}") for i in range(120)]
    parts = [rows[:30], rows[30:31], rows[31:90], rows[90:]]
    got = drained(spark, str(tmp_path), f"t{uuid.uuid4().hex}", kind, parts, lambda s: S.admitted(s, 8, 20, "3 days"))
    whole = E.admitted(spark.createDataFrame(rows, kind).select("tenant", "at", "id"), 8, 20).where("nth <= 8")
    assert sorted((r["id"], r["tenant"], r["nth"], r["ok"]) for r in got.collect()) == sorted((r["id"], r["tenant"], r["nth"], r["ok"]) for r in whole.collect())
    assert all(r["question"] == f"SSN [REDACTED SSN] of {r['id']}" for r in got.collect())
    assert got.where(~F.col("ok")).count() > 0
