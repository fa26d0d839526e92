"""The citation graph: neighbourhoods and treatment flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes, most serious first.
NEGATIVE = ("overruled", "reversed", "vacated", "reversed in part", "vacated in part")
POSITIVE = ("affirmed in part", "affirmed", "dismissed")
STALE_DAYS = 7


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, held: DataFrame) -> DataFrame:
    """node: held nodes within so many undirected steps of seeds(node), without the seeds.

    Each hop joins the frontier alone with the edges; what has been reached already drops out before the next.
    """
    ways = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    frontier = reached = seeds.select("node").distinct()
    for _ in range(hops):
        frontier = ways.join(frontier, "node", "left_semi").select(F.col("to").alias("node")).distinct().join(reached, "node", "left_anti")
        reached = reached.unionByName(frontier)
    return reached.join(seeds.select("node").distinct(), "node", "left_anti").join(held.select("node").distinct(), "node", "left_semi")


def resolve(events: DataFrame) -> DataFrame:
    """One row per (citation, by_citation) of events(citation, kind, by_citation, checked_at): the one kind, or unknown."""
    kinds = events.groupBy("citation", "by_citation").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"), F.max("checked_at").alias("checked_at"))
    return kinds.select("citation", "by_citation", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("unknown").alias("kind"), "checked_at")


def flags(opinions: DataFrame, treatments: DataFrame, now: Column) -> DataFrame:
    """citation, status, by, checked_at, stale for each of opinions(citation).

    treatments(citation, source, kind, by_citation, checked_at). A manual row decides; then an overruling; sources that
    disagree give unknown; then the worst negative outcome, an appeal that was decided, a positive one, none. Without
    rows the status is unknown.
    """
    seen = lambda k: F.bool_or(F.col("kind") == k)
    rank = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(NEGATIVE))):
        rank = F.when(F.col("kind") == k, i).otherwise(rank)
    good = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(POSITIVE))):
        good = F.when(F.col("kind") == k, i).otherwise(good)
    by = treatments.groupBy("citation").agg(
        F.min(F.when(F.col("source") == "manual", F.struct("kind", "by_citation"))).alias("manual"),
        F.min(rank).alias("neg"),
        F.min(good).alias("pos"),
        seen("unknown").alias("unsure"),
        F.bool_or(F.col("kind").isin("decided", "appealed")).alias("decided"),
        F.max("checked_at").alias("checked"),
    )
    named = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), at + 1)
    status = (
        F.when(F.col("manual").isNotNull(), F.col("manual.kind"))
        .when(F.col("neg") == 0, "overruled")
        .when((F.col("neg").isNotNull() & F.col("pos").isNotNull()) | F.col("unsure"), "unknown")
        .when(F.col("neg").isNotNull(), named(NEGATIVE, F.col("neg")))
        .when(F.col("decided"), "decided")
        .when(F.col("pos").isNotNull(), named(POSITIVE, F.col("pos")))
        .otherwise("none")
    )
    by = by.withColumn("status", status)
    first = treatments.join(by.select("citation", "status"), "citation").where((F.col("kind") == F.col("status")) | ((F.col("status") == "decided") & (F.col("kind") == "appealed")))
    first = first.groupBy("citation").agg(F.min(F.struct((F.col("source") != "courtlistener").alias("late"), F.col("by_citation"))).alias("first"))
    out = opinions.select("citation").distinct().join(by, "citation", "left").join(first, "citation", "left")
    return out.select(
        "citation",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("manual.by_citation", "first.by_citation", F.lit("")).alias("by"),
        F.col("checked").alias("checked_at"),
        F.when(F.col("manual").isNotNull(), False).otherwise(F.coalesce(F.col("checked") < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS"), F.lit(True))).alias("stale"),
    )
