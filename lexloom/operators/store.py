"""Idempotent maintenance of chunks: upsert with history, sweep, as-of lookup, and sweeps of what mirrors them.

Tables are DataFrames; a new state is written to a new directory, since plain parquet has no MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.session import materialise

#: Columns that an upsert never changes.
FIXED = ("source", "citation", "part", "section")
#: A stored chunk; the last four columns came later than the others.
CHUNK = (
    "key string, source string, citation string, part int, section string, heading string, text string, tokens int, cita string, as_of date, fetched_at timestamp_ntz, excluded string, "
    "source_revision string, effective struct<year:int,rule:string,date:string,retroactive:boolean,amendment:string>, recorded_at timestamp_ntz, authority struct<type:string,status:string,level:int>"
)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after new rows: by key; FIXED columns stay as first stored, recorded_at stays while the text does."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.key") == F.col("n.key"), "full_outer")
    there, given = F.col("o.key").isNotNull(), F.col("n.key").isNotNull()

    def pick(name: str) -> Column:
        was, now = F.col(f"o.{name}"), F.col(f"n.{name}")
        if name == "recorded_at":
            return F.when(there & given & F.col("o.text").eqNullSafe(F.col("n.text")), was).when(given, now).otherwise(was)
        return F.when(there, was).otherwise(now) if name in FIXED else F.when(given, now).otherwise(was)

    return both.select(*[(F.coalesce("o.key", "n.key") if c == "key" else pick(c)).alias(c) for c in old.columns])


def retired(old: DataFrame, new: DataFrame, gone: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Versions that end: replaced texts at the new row's recorded_at, and deleted keys (gone) at now."""
    keep = ["key", "source", "citation", "text", "recorded_at"]
    o, n = old.select(*keep).alias("o"), new.select("key", "text", "recorded_at").alias("n")
    changed = o.join(n, F.col("o.key") == F.col("n.key")).where(~F.col("o.text").eqNullSafe(F.col("n.text")))
    out = changed.select(*[F.col(f"o.{c}") for c in keep], F.col("n.recorded_at").alias("retired_at"))
    if gone is not None:
        ended = now if now is not None else F.current_timestamp()
        out = out.unionByName(old.select(*keep).join(gone.select("key"), "key", "left_semi").withColumn("retired_at", ended))
    return out


def swept(old: DataFrame, batch: DataFrame, source: str) -> DataFrame:
    """Rows to delete after a batch: of its sections and its source, with keys that it lacks. An empty batch deletes none."""
    scope = old.where(F.col("source") == source).join(batch.select("section").distinct(), "section", "left_semi")
    return scope.join(batch.select("key"), "key", "left_anti")


def save(old: DataFrame, batch: DataFrame, source: str) -> DataFrame:
    """Upsert, then sweep."""
    return upsert(old, batch).join(swept(old, batch, source).select("key"), "key", "left_anti")


def versions(current: DataFrame, past: DataFrame) -> DataFrame:
    """key, citation, text, recorded_at, retired_at of current rows (not retired) and past ones."""
    cols = ["key", "citation", "text", "recorded_at"]
    return current.select(*cols, F.lit(None).cast("timestamp_ntz" if dict(past.dtypes)["retired_at"] == "timestamp_ntz" else "timestamp").alias("retired_at")).unionByName(past.select(*cols, "retired_at"))


def held_at(current: DataFrame, past: DataFrame, citation: str, at: Column) -> DataFrame:
    """key, text that stood under a citation at an instant. Validity is half-open; rows never recorded stood never."""
    every = versions(current, past).where(F.col("citation") == citation)
    return every.where((F.col("recorded_at") <= at) & (F.col("retired_at").isNull() | (at < F.col("retired_at")))).select("key", "text").orderBy("key")


def held_at_all(probes: DataFrame, every: DataFrame, line: tuple[str, ...] = ("citation",), days: int = 30) -> DataFrame:
    """The same for many probes(citation, at): probes.*, key, text.

    Versions of one line follow one another: no two of them stand at the same instant. A line is named by columns of every; those
    that probes lack give a probe for each line of its citation. Probes and starts of versions are sorted together, and the last
    start is carried forward. Time is cut into ranges of so many days, so a citation with a long history is many groups: what stood when a
    range begins comes from the last starts of the ranges before it, a row for each. Rows never recorded stood never.
    """
    on, names = list(line), probes.columns
    more = [c for c in on if c not in names]
    if more:
        probes = probes.join(every.select("citation", *more).distinct(), "citation")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = F.lit(days * 86_400_000_000)
    version = F.struct("key", "text", "retired_at")
    last = F.coalesce(micros("retired_at"), F.lit((1 << 63) - 1))
    none = lambda df, c: F.lit(None).cast(df.select(version.alias("v")).schema["v"].dataType) if c == "v" else F.lit(None)
    starts = every.where("recorded_at is not null").select(*on, micros("recorded_at").alias("t"), last.alias("end"), F.lit(0).alias("kind"), version.alias("v"))
    starts = materialise(starts.withColumn("range", F.floor(F.col("t") / span)), "starts")
    asked = materialise(probes.select(*on, micros("at").alias("t"), F.struct(*names).alias("p")).withColumn("range", F.floor(F.col("t") / span)), "probes")

    lasts = starts.groupBy(*on, "range").agg(F.max_by("v", F.struct("t", "end")).alias("v")).withColumn("kind", F.lit(0))
    needed = asked.select(*on, "range").distinct().withColumn("v", none(every, "v")).withColumn("kind", F.lit(-1))
    earlier = Window.partitionBy(*on).orderBy("range", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.unionByName(needed).withColumn("c", F.last("v", ignorenulls=True).over(earlier)).where("kind = -1 and c is not null")

    no_probe = F.lit(None).cast(asked.schema["p"].dataType).alias("p")
    rows = starts.select(*on, "range", "t", "end", "kind", "v", no_probe)
    rows = rows.unionByName(carried.select(*on, "range", F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("end"), "kind", F.col("c").alias("v"), no_probe))
    rows = rows.unionByName(asked.select(*on, "range", "t", F.lit(None).cast("long").alias("end"), F.lit(1).alias("kind"), none(every, "v").alias("v"), "p"))
    upto = Window.partitionBy(*on, "range").orderBy("t", "kind", "end").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("s", F.last("v", ignorenulls=True).over(upto)).where("kind = 1 and s is not null")
    return held.where(F.col("s.retired_at").isNull() | (F.col("t") < micros("s.retired_at"))).select("p.*", "s.key", "s.text")


def index_sweep(index: DataFrame, live: DataFrame) -> DataFrame:
    """Index rows whose key is no longer live."""
    return index.join(live.select("key"), "key", "left_anti")


def tenant_sweep(points: DataFrame, tenants: DataFrame) -> DataFrame:
    """Points of tenants that are gone; with no tenant left, all of them."""
    return points.join(tenants.select("tenant").distinct(), "tenant", "left_anti")


def replace_source(old: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """treatments(citation, kind, by_citation, source, recorded_at, checked_at) after one source's rows are replaced.

    recorded_at is when a row was first known, and stays; rows that the batch lacks go; other sources are untouched.
    """
    keys = ["citation", "by_citation"]
    mine = old.where(F.col("source") == source).select(*keys, F.col("recorded_at").alias("_first"))
    new = rows.join(mine, keys, "left").select("citation", "kind", "by_citation", F.lit(source).alias("source"), F.coalesce("_first", "recorded_at").alias("recorded_at"), "checked_at")
    return old.where(F.col("source") != source).unionByName(new)


def payload(chunks: DataFrame) -> DataFrame:
    """What an index holds of live chunks; empty structures count as absent."""
    return chunks.where(F.col("excluded").isNull())


def counted(source: str | None = None, indexable_only: bool = False) -> Column:
    """How many chunks a table has, of one source or that an index may hold."""
    own = F.lit(True) if source is None else F.col("source") == source
    return F.count_if(own & F.col("excluded").isNull() if indexable_only else own)


def upgraded(df: DataFrame, schema: str = CHUNK) -> DataFrame:
    """df in the columns of schema: what it lacks is null, but rows that were never recorded count as recorded when they were fetched."""
    held = set(df.columns)
    out = df.select(*[(F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    return out if "recorded_at" in held or "fetched_at" not in held else out.withColumn("recorded_at", F.col("fetched_at"))


def write_layout(df: DataFrame, path: str, by: str) -> None:
    """A folder for each value of a column, so that filters on it read their folders alone; each task writes the values that it has."""
    df.write.partitionBy(by).parquet(path)


def appended(spark: SparkSession, path: str, rows: DataFrame, key: str, make) -> DataFrame:
    """All results under path after make(rows) is appended for the rows whose key has none yet: what a broken run has saved is not made again."""
    done = spark.read.parquet(path)
    make(rows.join(done.select(key), key, "left_anti")).select(*done.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def reusable(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked(question, run, prompt) with answer: cached under the question and run, null where that was made from another prompt."""
    held = cache.select("question", "run", F.col("prompt").alias("_was"), F.col("answer").alias("_held"))
    both = asked.join(held, ["question", "run"], "left")
    return both.withColumn("answer", F.when(F.md5(F.col("prompt").cast("binary")) == F.col("_was"), F.col("_held"))).drop("_was", "_held")
