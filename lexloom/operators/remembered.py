"""What providers have computed, kept by what they computed it from: vectors of texts and scores of pairs.

A memory is a folder with numbered generations. A generation holds results(digest, value) and uses(digest, used_at), each in as many files
as runs have appended. The digest is of the model's name and the inputs, so another model or another text is another row. A run sends
the provider the distinct inputs that the memory lacks, each once. forget writes a new generation with the results that were used last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import providers as P
from lexloom.session import materialise


def digest_of(model: str, *inputs: str) -> Column:
    """Inputs are told apart by their lengths; null counts as empty."""
    held = [F.coalesce(F.col(c), F.lit("")) for c in inputs]
    return F.sha2(F.concat_ws("|", F.lit(f"{len(model)}|{model}"), *[F.concat_ws(":", F.length(h).cast("string"), h) for h in held]), 256)


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Generations that are whole; the last is the memory."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    held = [s.getPath() for s in fs.listStatus(at)]
    whole = [h.getName() for h in held if h.getName().startswith("generation-") and fs.exists(jvm.org.apache.hadoop.fs.Path(h, "uses/_SUCCESS"))]
    return sorted(int(n.rpartition("-")[2]) for n in whole)


def _folder(spark: SparkSession, path: str) -> str | None:
    held = _generations(spark, path)
    return f"{path}/generation-{held[-1]}" if held else None


def recalled(asked: DataFrame, path: str, model: str, inputs: list[str], compute: Callable[[DataFrame], DataFrame], now: Column | None = None) -> DataFrame:
    """asked with value: remembered, or computed and remembered. compute takes a table of the inputs and adds value; it gets the distinct
    inputs that the memory lacks, and none twice."""
    spark = asked.sparkSession
    asked = materialise(asked.withColumn("_digest", digest_of(model, *inputs)), "asked")
    folder = _folder(spark, path)
    distinct = asked.groupBy(F.col("_digest").alias("digest")).agg(*[F.first(c).alias(c) for c in inputs])
    known = spark.read.parquet(f"{folder}/results").select("digest") if folder else None
    new = materialise(distinct.join(known, "digest", "left_anti") if known is not None else distinct, "absent")
    folder = folder or f"{path}/generation-0"
    if not new.isEmpty() or known is None:
        compute(new).select("digest", "value").write.mode("append").parquet(f"{folder}/results")
    distinct.select("digest", (now if now is not None else F.current_timestamp()).cast("timestamp").alias("used_at")).write.mode("append").parquet(f"{folder}/uses")
    # a run that broke off after its results has them twice
    results = spark.read.parquet(f"{folder}/results").dropDuplicates(["digest"])
    return asked.join(results, asked["_digest"] == results["digest"], "left").drop("_digest", "digest")


def forget(spark: SparkSession, path: str, most: int) -> None:
    """Only the results that were used last stay, so many at most; of those last used together, the smaller digests. Older generations stay for those who read them."""
    folder = _folder(spark, path)
    if folder is None:
        return
    uses = spark.read.parquet(f"{folder}/uses").groupBy("digest").agg(F.max("used_at").alias("used_at"))
    kept = materialise(uses.orderBy(F.desc("used_at"), "digest").limit(most), "kept")
    after = f"{path}/generation-{_generations(spark, path)[-1] + 1}"
    spark.read.parquet(f"{folder}/results").dropDuplicates(["digest"]).join(kept, "digest", "left_semi").write.mode("overwrite").parquet(f"{after}/results")
    kept.write.mode("overwrite").parquet(f"{after}/uses")


def vectors(texts: DataFrame, text: str, provider: str, path: str, now: Column | None = None) -> DataFrame:
    """texts with the provider's embedding of a column, remembered between runs."""
    compute = lambda df: P.embedded(df, text, provider).withColumnRenamed("embedding", "value")
    return recalled(texts, path, provider, [text], compute, now).withColumnRenamed("value", "embedding")


def pair_scores(pairs: DataFrame, query: str, text: str, model: str, score: Callable[[Column, Column], Column], path: str, now: Column | None = None) -> DataFrame:
    """pairs with a model's score of two columns, remembered between runs."""
    compute = lambda df: df.withColumn("value", score(F.coalesce(query, F.lit("")), F.coalesce(text, F.lit(""))))
    return recalled(pairs, path, model, [query, text], compute, now).withColumnRenamed("value", "score")
