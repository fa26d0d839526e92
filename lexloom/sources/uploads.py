"""Tenants and their documents: admission of uploads, redaction, windows, writing as one, lookup and removal.

An upload is written as one: its document, chunks and points go to folders of its batch, and last a row of commits, which every reader joins.
A batch that breaks off before shows nowhere, and is run again under the same name in place of what it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.redact import redact, redacted
from lexloom.operators import providers as P
from lexloom.operators import windows as W
from lexloom.session import materialise

PAGE_CAP, PER_DAY, WINDOW_TOKENS, OVERLAP = 50, 20, 300, 0.15
MAX_BYTES = 10 << 20
#: The namespace of identifiers of points.
POINTS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"


def tenant(spark: SparkSession, name: str, key: str) -> DataFrame:
    """A tenant's row; of the key only the digest is kept."""
    return spark.range(1).select(F.uuid().alias("id"), F.lit(name).alias("name"), F.sha2(F.lit(key).cast("binary"), 256).alias("key_sha256"), F.current_timestamp().alias("created_at"))


def tenants(asked: DataFrame) -> DataFrame:
    """A row for each of asked(name, key); of the key only the digest is kept."""
    return asked.select(F.uuid().alias("id"), "name", F.sha2(F.col("key").cast("binary"), 256).alias("key_sha256"), F.current_timestamp().alias("created_at"))


def tenant_for(tenants: DataFrame, key: str) -> DataFrame:
    return tenants.where(F.col("key_sha256") == F.sha2(F.lit(key).cast("binary"), 256)).select("id", "name")


def is_id(column: Column) -> Column:
    return column.rlike(_UUID)


def owned(rows: DataFrame, row_id: str, tenant_id: str) -> DataFrame:
    """A row by id and tenant; a malformed id and another tenant's row are both nothing."""
    return rows.where(is_id(F.lit(row_id)) & (F.lower("id") == row_id.lower()) & (F.col("tenant") == tenant_id))


def all_owned(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(id, tenant, ...) with row, the id of the row that is answered; a malformed id and another tenant's row are both nothing."""
    own = rows.select(F.col("id").alias("row"), F.col("tenant").alias("_t"))
    return asked.join(own, is_id(F.col("id")) & (F.lower("id") == F.col("row")) & (F.col("tenant") == F.col("_t")), "left").drop("_t")


def newest_first(rows: DataFrame, tenant_id: str) -> DataFrame:
    return rows.where(F.col("tenant") == tenant_id).orderBy(F.desc("created_at"), "id")


def admission(uploads: DataFrame, page_cap: int = PAGE_CAP, per_day: int = PER_DAY) -> DataFrame:
    """uploads(id, content, n_pages, n_words, today) with status: the first rule that refuses, 200 if none does."""
    return uploads.withColumn("kind", T.upload_kind(F.col("content"))).withColumn(
        "status",
        F.when(F.col("kind").isNull(), 415)
        .when(F.col("today") >= per_day, 429)
        .when(F.col("n_pages") > page_cap, 413)
        .when(F.col("n_words") == 0, 422)
        .otherwise(200),
    )


def clean_name(name: Column) -> Column:
    """A file's name as it may be cited: redacted, one line, no double quotes, 200 characters; "document" where nothing is left."""
    flat = F.replace(F.regexp_replace(redacted(F.coalesce(name, F.lit(""))), r"\s+", " "), F.lit('"'), F.lit("'"))
    return F.coalesce(F.nullif(F.substring(F.trim(flat), 1, 200), F.lit("")), F.lit("document"))


def chunks(pages: DataFrame) -> DataFrame:
    """Redacted windows of pages(tenant, document, name, page, text): key, tenant, document, page, citation, text, tokens."""
    name = redact(pages.select("tenant", "document", "page", "text", "name"), "name")
    df = redact(name, "text").withColumn("w", T.words(F.col("text"))).where(F.size("w") > 0)
    cut = df.select("tenant", "document", "page", "name", F.posexplode(W.word_windows(F.col("w"), int(WINDOW_TOKENS / 1.3), OVERLAP)).alias("n", "win"))
    citation = F.concat("name", F.lit(", p. "), "page")
    key = F.concat_ws("#", "document", F.col("page").cast("string"), (F.col("n") + 1).cast("string"))
    return cut.select(key.alias("key"), "tenant", "document", "page", citation.alias("citation"), F.array_join("win", " ").alias("text"), T.tokens_of_words(F.size("win")).alias("tokens"))


def documents(pages: DataFrame) -> DataFrame:
    """tenant, document, pages, failed_pages: pages without a word failed."""
    return pages.groupBy("tenant", "document").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.when(T.word_count(F.col("text")) == 0, F.col("page")))).alias("failed_pages"))


def without(rows: DataFrame, tenant_id: str, document: str) -> DataFrame:
    """Rows after one tenant's document is deleted."""
    return rows.where(~((F.col("tenant") == tenant_id) & (F.col("document") == document)))


def statuses(uploads: DataFrame, pages: DataFrame, today: DataFrame | None = None, page_cap: int = PAGE_CAP, per_day: int = PER_DAY, most_bytes: int = MAX_BYTES) -> DataFrame:
    """uploads(document, tenant, name, content, at) with kind and status: the first rule that refuses, 200 if none does.

    today(tenant, n) counts what tenants have stored today. Of a batch, a tenant's earlier uploads (at, document) that are stored count too.
    """
    read = pages.groupBy("document").agg(F.count("*").alias("_pages"), F.sum(T.word_count(F.coalesce("text", F.lit("")))).alias("_words"))
    df = uploads.join(read, "document", "left").withColumn("kind", T.upload_kind(F.col("content")))
    df = df.join(today.select("tenant", F.col("n").alias("_today")), "tenant", "left") if today is not None else df.withColumn("_today", F.lit(0))
    large, odd = F.length("content") > most_bytes, F.col("kind").isNull()
    many, empty = F.coalesce(F.col("_pages") > page_cap, F.lit(False)), F.coalesce("_words", F.lit(0)) == 0
    good = ~(large | odd | many | empty)
    before = F.coalesce(F.sum(good.cast("int")).over(Window.partitionBy("tenant").orderBy("at", "document").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spent = F.coalesce("_today", F.lit(0)) + before >= per_day
    status = F.when(large, 413).when(odd, 415).when(spent, 429).when(many, 413).when(empty, 422).otherwise(200)
    return df.withColumn("status", status).drop("_pages", "_words", "_today")


def ingest(spark: SparkSession, root: str, batch: str, uploads: DataFrame, pages: DataFrame, provider: str, **rules) -> DataFrame:
    """document, status of each of uploads(document, tenant, name, content, at), pages(document, page, text) being what was read from them.

    What is accepted is stored as one under root; batch names the write.
    """
    decided = materialise(statuses(uploads, pages, stored_today(spark, root, uploads), **rules).drop("content"), "decided")
    good = decided.where("status = 200").select("document", "tenant", "kind", "at", clean_name(F.col("name")).alias("name"))
    own = materialise(pages.join(good, "document").select("tenant", "document", "name", "kind", "at", "page", F.coalesce("text", F.lit("")).alias("text")), "pages")
    counted = documents(own).join(good, ["tenant", "document"])
    said = materialise(chunks(own), "chunks")
    points = P.embedded(said, "text", provider).select(T.point_id(F.col("key"), POINTS).alias("id"), "key", "tenant", "document", "embedding")
    for name, df in (("documents", counted), ("chunks", said), ("points", points)):
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    commit = good.select("document", "tenant", "at")
    commit.write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")
    return decided.select("document", "status")


def committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """documents, chunks or points of the uploads that were committed; None where there are none yet."""
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/commits").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")):
        return None
    commits = spark.read.parquet(f"{root}/commits")
    rows = commits if name == "commits" else spark.read.parquet(f"{root}/{name}").join(commits.select("batch", "document"), ["batch", "document"], "left_semi")
    return rows.drop("batch")


def stored_today(spark: SparkSession, root: str, uploads: DataFrame) -> DataFrame | None:
    """tenant, n: what was committed on the day of the first upload of a batch, UTC."""
    held = committed(spark, root, "commits")
    if held is None:
        return None
    day = uploads.agg(F.to_date(F.min("at")).alias("day"))
    return held.withColumn("day", F.to_date("at")).join(F.broadcast(day), "day", "left_semi").groupBy("tenant").agg(F.count("*").alias("n"))
