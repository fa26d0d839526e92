"""Stored tables that a batch changes in place, reading and writing only the folders that it names.

Chunks lie in folders by source and by a bucket of their section; an index of keys lies in folders by a bucket of the key and says in
which folder of chunks a key was first stored, since a chunk keeps its section whatever a later batch says. A batch reads the folders
of its sections and of its keys, and overwrites these alone. What is overwritten or swept goes to a table of past versions first, in a
folder that the batch names, so a batch that broke off can be run again and one that is run twice changes nothing.

Treatments lie in folders by source and points by tenant, for the same reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import store as S
from lexloom.session import materialise

#: Folders of sections in each source, and of keys.
BUCKETS, KEY_BUCKETS = 64, 64


def _bucket(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(""))), F.lit(n)).cast("int")


def placed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("bucket", _bucket("section", BUCKETS))


def _indexed(chunks: DataFrame) -> DataFrame:
    return placed(chunks).select(_bucket("key", KEY_BUCKETS).alias("key_bucket"), "key", "source", "bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _folders(df: DataFrame, by: list[str]) -> list[tuple]:
    """The folders that rows lie in: at most as many as there are folders."""
    return sorted((tuple(r) for r in df.select(*by).distinct().collect()), key=str)


def _of(by: list[str], folders: list[tuple]) -> Column:
    """Whether a row lies in one of the folders, as a condition on folder columns alone; the last column's values are listed by the others'."""
    groups: dict[tuple, list] = {}
    for f in folders:
        groups.setdefault(f[:-1], []).append(f[-1])
    one = lambda head, last: reduce(lambda a, b: a & b, [*[F.col(c) == v for c, v in zip(by, head, strict=False)], F.col(by[-1]).isin(last)])
    return reduce(lambda a, b: a | b, [one(h, v) for h, v in groups.items()], F.lit(False))


def overwrite(df: DataFrame, path: str, by: list[str], folders: list[tuple]) -> None:
    """The rows of these folders become df, which must not be read from them; no other folder is touched. Folders without rows go."""
    spark = df.sparkSession
    left = set(_folders(df, by))
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for f in folders:
        if f not in left:
            _removed(spark, "/".join([path, *(f"{c}={v}" for c, v in zip(by, f, strict=True))]))


def create(chunks: DataFrame, path: str) -> None:
    """A table of chunks in a new folder."""
    placed(chunks).repartition("source", "bucket").write.partitionBy("source", "bucket").parquet(f"{path}/chunks")
    _indexed(chunks).repartition("key_bucket").write.partitionBy("key_bucket").parquet(f"{path}/keys")


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks").drop("bucket")


def past(spark: SparkSession, path: str) -> DataFrame:
    """Versions that ended: key, source, citation, text, recorded_at, retired_at."""
    return spark.read.parquet(f"{path}/versions").drop("batch")


def folders_of(spark: SparkSession, path: str, batch: DataFrame) -> list[tuple]:
    """The folders (source, bucket) that a batch names by its sections or by keys that were stored elsewhere."""
    own = _indexed(batch)
    keys = _of(["key_bucket"], _folders(own, ["key_bucket"]))
    held = spark.read.parquet(f"{path}/keys").where(keys).join(own.select("key"), "key", "left_semi")
    return _folders(own.select("source", "bucket").unionByName(held.select("source", "bucket")), ["source", "bucket"])


def rows_of(spark: SparkSession, path: str, folders: list[tuple]) -> DataFrame:
    """The chunks of some folders; the others are not read."""
    return spark.read.parquet(f"{path}/chunks").where(_of(["source", "bucket"], folders))


def save(spark: SparkSession, path: str, batch: DataFrame, source: str, name: str, now: Column | None = None) -> int:
    """The table after a batch of one source: upserted by key, and swept of the keys of its sections that it lacks. How many folders changed.

    name is the batch's own: past versions are written to a folder of this name. A batch without rows does nothing.
    """
    batch = materialise(batch, "batch")
    if batch.isEmpty():
        return 0
    folders = folders_of(spark, path, batch)
    known = rows_of(spark, path, folders)
    old = materialise(known.drop("bucket").select(*batch.columns), "old")
    gone = S.swept(old, batch, source)
    ended = S.retired(old, batch, gone, now).withColumn("batch", F.lit(name))
    if not (ended := materialise(ended, "ended")).isEmpty():
        ended.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/versions")
    after = materialise(placed(S.save(old, batch, source)), "after")
    fresh = materialise(_indexed(batch.join(old.select("key"), "key", "left_anti")), "fresh")
    if not fresh.isEmpty():
        fresh.repartition("key_bucket").write.mode("append").partitionBy("key_bucket").parquet(f"{path}/keys")
    overwrite(after, f"{path}/chunks", ["source", "bucket"], folders)
    return len(folders)


def create_treatments(rows: DataFrame, path: str) -> None:
    rows.repartition("source").write.partitionBy("source").parquet(path)


def replace_treatments(spark: SparkSession, path: str, rows: DataFrame, source: str) -> None:
    """One source's treatments replaced, as store.replace_source says; the folders of other sources are neither read nor written."""
    mine = spark.read.parquet(path).where(F.col("source") == source)
    columns = ["citation", "kind", "by_citation", "source", "recorded_at", "checked_at"]
    after = S.replace_source(mine.select(*columns), rows, source)
    overwrite(materialise(after, "treatments"), path, ["source"], [(source,)])


def create_points(points: DataFrame, path: str) -> None:
    points.repartition("tenant").write.partitionBy("tenant").parquet(path)


def delete_document(spark: SparkSession, path: str, tenant: str, document: str) -> None:
    """One tenant's document goes; only that tenant's folder is read and written."""
    mine = spark.read.parquet(path).where(F.col("tenant").cast("string") == tenant)
    overwrite(materialise(mine.where(F.col("document") != document), "points"), path, ["tenant"], [(tenant,)])


def drop_tenants(spark: SparkSession, path: str, live: DataFrame) -> int:
    """The folders of tenants that are not in live(tenant) go, unread. How many went."""
    if not _exists(spark, path):
        return 0
    held = spark.read.parquet(path).select(F.col("tenant").cast("string").alias("tenant")).distinct()
    gone = [r[0] for r in held.join(live.select(F.col("tenant").cast("string").alias("tenant")), "tenant", "left_anti").collect()]
    for tenant in gone:
        _removed(spark, f"{path}/tenant={tenant}")
    return len(gone)
