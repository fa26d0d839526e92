"""Authority profiles and revisions computed anew for all stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T


def backfill(chunks: DataFrame) -> DataFrame:
    """chunks with authority and source_revision as an ingest would store them now, and updated where that changed something.

    A temporary regulation whose whole section has ended is excluded as expired, which changes its key.
    """
    temporary = (F.col("source") == "ecfr") & F.col("section").endswith("T")
    ended = chunks.where(temporary).groupBy("section").agg(
        F.bool_or(T.sunset(F.col("cita"), F.col("as_of"))).alias("late"),
        F.bool_or(F.coalesce(T.expiry(F.col("text"), F.col("as_of")) == "whole", F.lit(False))).alias("whole"),
        F.bool_or(F.coalesce(T.expiry(F.col("text"), F.col("as_of")) == "partly", F.lit(False))).alias("partly"),
    )
    df = chunks.join(ended, "section", "left")
    over = temporary & (F.coalesce("late", F.lit(False)) | F.coalesce("whole", F.lit(False)))
    profile = T.authority(F.col("source"), F.col("citation"), F.col("section"), F.coalesce("partly", F.lit(False)))
    excluded = F.when(over, F.coalesce("excluded", F.lit("expired"))).otherwise(F.col("excluded"))
    revision = F.coalesce("source_revision", T.revision(F.col("source"), F.col("as_of")))
    df = df.withColumn("_x", excluded).withColumn("_a", profile).withColumn("_r", revision)
    changed = ~F.col("_x").eqNullSafe(F.col("excluded")) | ~F.col("_a").eqNullSafe(F.col("authority")) | ~F.col("_r").eqNullSafe(F.col("source_revision"))
    df = df.withColumn("updated", changed).drop("excluded", "authority", "source_revision", "key", "late", "whole", "partly")
    df = df.withColumnsRenamed({"_x": "excluded", "_a": "authority", "_r": "source_revision"})
    return df.withColumn("key", T.chunk_key(F.col("citation"), F.col("excluded"), F.col("part"))).select(*chunks.columns, "updated")


def summary(done: DataFrame) -> DataFrame:
    """rows, updated, expired, points of a backfill."""
    return done.agg(F.count("*").alias("rows"), F.count_if("updated").alias("updated"), F.count_if(F.col("updated") & (F.col("excluded") == "expired")).alias("expired"), F.count_if(F.col("excluded").isNull()).alias("points"))
