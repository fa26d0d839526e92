"""The job-event log: stages appended, numbered, replayed, followed as a stream, and counted against quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("done", "error")
#: Queries a day of a tenant and of all tenants.
PER_TENANT, OVERALL = 50, 200


def sequence(events: DataFrame, job: str = "job_id", order: str = "event_id") -> DataFrame:
    """seq: the place of each event in its job. Times are too coarse to order by."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(order)))


def replay(jobs: DataFrame) -> DataFrame:
    """Recorded stages, array(struct(event, data, at)), as rows: job_id, seq, event, data, at."""
    return jobs.select("job_id", F.posexplode("stages").alias("i", "s")).select("job_id", (F.col("i") + 1).alias("seq"), "s.event", "s.data", "s.at")


def record(events: DataFrame) -> DataFrame:
    """The reverse: job_id and its stages in order."""
    stage = F.struct("seq", "event", "data", "at")
    return events.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(stage)), lambda s: F.struct(s["event"].alias("event"), s["data"].alias("data"), s["at"].alias("at"))).alias("stages"))


def unseen(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Events that a listener who has seen up to seen(job_id, last) has not had yet."""
    return events.join(seen, "job_id", "left").where(F.col("seq") > F.coalesce("last", F.lit(0))).drop("last")


def until_terminal(events: DataFrame) -> DataFrame:
    """Events up to each job's first terminal one."""
    ends = F.min(F.when(F.col("event").isin(*TERMINAL), F.col("seq"))).over(Window.partitionBy("job_id"))
    return events.withColumn("_e", ends).where(F.col("_e").isNull() | (F.col("seq") <= F.col("_e"))).drop("_e")


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def follow(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events(job_id, seq, at) with each (job_id, seq) once, repeats within a delay dropped."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])


def frame(event: Column, data: Column) -> Column:
    """An event as server-sent text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def count_today(rows: DataFrame, day: Column, at: str = "at", tenant: Column | None = None) -> DataFrame:
    """n: rows since midnight of a day, of one tenant if given."""
    held = rows.where((F.col(at) >= day) & (F.col(at) < F.date_add(day, 1).cast(dict(rows.dtypes)[at])))
    return (held if tenant is None else held.where(F.col("tenant") == tenant)).agg(F.count("*").alias("n"))


def admitted(requests: DataFrame, per_tenant: int = PER_TENANT, overall: int = OVERALL) -> DataFrame:
    """requests(tenant, at, id) with ok: within the tenant's and everyone's quota of its UTC day, in order.

    A request over its tenant's quota does not count against everyone's.
    """
    own = F.row_number().over(Window.partitionBy("tenant", "day").orderBy("at", "id"))
    df = requests.withColumn("day", F.to_date("at")).withColumn("nth", own).withColumn("within", F.col("nth") <= per_tenant)
    # only requests within their tenant's quota count; of a day's no task hands on more than the first that are let in
    first = Window.partitionBy("day").orderBy("at", "id")
    let_in = df.where("within").select("day", "at", "id").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= overall)
    last = let_in.groupBy("day").agg(F.max(F.struct("at", "id")).alias("_last"))
    return df.join(last, "day", "left").withColumn("ok", F.col("within") & F.coalesce(F.struct("at", "id") <= F.col("_last"), F.lit(False))).select("id", "tenant", "day", "nth", "ok")


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Requests of each tenant and day, for a stream of requests(tenant, at)."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("w"), "tenant").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "tenant", "n")
