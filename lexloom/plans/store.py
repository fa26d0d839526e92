"""Queries: upsert, history, sweeps, as-of lookup, treatments, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import graph as G
from lexloom.operators import incremental as N
from lexloom.operators import store as S
from lexloom.plans.tables import table
from lexloom.session import new_path

COLUMNS = ["key", "source", "citation", "part", "section", "text", "recorded_at"]


def old_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored chunks: every doc_id not divisible by 5 was there before."""
    d = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0")
    return d.select(
        F.concat(F.lit("k"), "doc_id").alias("key"), "source", F.concat(F.lit("c"), F.col("doc_id") % 50).alias("citation"),
        (F.col("doc_id") % 7).cast("int").alias("part"), F.concat(F.lit("s"), F.col("doc_id") % 20).alias("section"), "text",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("recorded_at"),
    )


def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later batch: some keys as before, some with other text, some new, under another citation and part."""
    d = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return d.select(
        F.concat(F.lit("k"), "doc_id").alias("key"), "source", F.concat(F.lit("n"), F.col("doc_id") % 50).alias("citation"),
        (F.col("doc_id") % 11).cast("int").alias("part"), F.concat(F.lit("s"), F.col("doc_id") % 20).alias("section"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("*"), "text")).otherwise(F.col("text")).alias("text"),
        F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("recorded_at"),
    )


_OLD_NEW = """
o AS (SELECT 'k' || doc_id AS key, source, 'c' || (doc_id % 50) AS citation, (doc_id % 7)::INT AS part, 's' || (doc_id % 20) AS section, text,
             TIMESTAMP '2024-01-01' AS recorded_at FROM documents WHERE doc_id % 5 <> 0),
n AS (SELECT 'k' || doc_id AS key, source, 'n' || (doc_id % 50) AS citation, (doc_id % 11)::INT AS part, 's' || (doc_id % 20) AS section,
             CASE WHEN doc_id % 2 = 0 THEN '*' || text ELSE text END AS text, TIMESTAMP '2024-06-01' AS recorded_at FROM documents WHERE doc_id % 3 <> 0)"""
_UP = """
u AS (SELECT coalesce(o.key, n.key) AS key,
             CASE WHEN o.key IS NOT NULL THEN o.source ELSE n.source END AS source, CASE WHEN o.key IS NOT NULL THEN o.citation ELSE n.citation END AS citation,
             CASE WHEN o.key IS NOT NULL THEN o.part ELSE n.part END AS part, CASE WHEN o.key IS NOT NULL THEN o.section ELSE n.section END AS section,
             CASE WHEN n.key IS NOT NULL THEN n.text ELSE o.text END AS text,
             CASE WHEN o.key IS NOT NULL AND n.key IS NOT NULL AND o.text IS NOT DISTINCT FROM n.text THEN o.recorded_at
                  WHEN n.key IS NOT NULL THEN n.recorded_at ELSE o.recorded_at END AS recorded_at
      FROM o FULL JOIN n ON o.key = n.key)"""


def _brief(df: DataFrame) -> DataFrame:
    """Chunks with a digest in place of the text."""
    return df.withColumn("text", F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def scd_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(S.upsert(old_chunks(spark, sf_dir), new_chunks(spark, sf_dir)))


def scd_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_chunks(spark, sf_dir), new_chunks(spark, sf_dir)
    gone = S.swept(old, new.where("source = 'src1'"), "src1")
    return _brief(S.retired(old, new.where("source = 'src1'"), gone, F.lit("2024-07-01 00:00:00").cast("timestamp_ntz")))


def scd_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.swept(old_chunks(spark, sf_dir), new_chunks(spark, sf_dir).where("source = 'src1'"), "src1").select("key", "section")


def scd_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(S.save(old_chunks(spark, sf_dir), new_chunks(spark, sf_dir).where("source = 'src2'"), "src2"))


def incremental_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch on a stored table, of which only the folders that the batch names are read and written; run twice."""
    path = new_path(spark, "chunks")
    N.create(old_chunks(spark, sf_dir), path)
    batch = new_chunks(spark, sf_dir).where("source = 'src2'")
    for _ in range(2):
        N.save(spark, path, batch, "src2", "b1")
    return _brief(N.current(spark, path).select(*COLUMNS))


def incremental_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch on a stored table has ended."""
    path = new_path(spark, "chunks")
    N.create(old_chunks(spark, sf_dir), path)
    N.save(spark, path, new_chunks(spark, sf_dir).where("source = 'src1'"), "src1", "b1", F.lit("2024-07-01 00:00:00").cast("timestamp_ntz"))
    return _brief(N.past(spark, path))


def scd_empty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is swept by a batch without rows."""
    return S.swept(old_chunks(spark, sf_dir), new_chunks(spark, sf_dir).where("false"), "src1").agg(F.count("*").alias("n"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: a user's event stands until their next one."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.concat(F.lit("e"), "event_id").alias("key"), F.concat(F.lit("u"), "user_id").alias("citation"), F.col("event_type").alias("text"), F.col("ts").alias("recorded_at"), F.lead("ts").over(w).alias("retired_at"))


_HISTORY = "h AS (SELECT 'e' || event_id AS key, 'u' || user_id AS citation, event_type AS text, ts AS recorded_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS retired_at FROM events)"


def held_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _history(spark, sf_dir)
    current, past = every.where("retired_at is null"), every.where("retired_at is not null")
    return S.held_at(current, past, "u7", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


def held_at_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("u"), "user_id").alias("citation"), F.col("ts").alias("at"), "event_id")
    return S.held_at_all(probes, _history(spark, sf_dir)).select("event_id", "key", "text")


def index_stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    live = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"))
    return S.index_sweep(index, live)


def tenant_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), "event_id")
    tenants = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 100).alias("tenant"))
    return S.tenant_sweep(points, tenants)


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatments of one source replaced by a later batch."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.concat(F.lit("o"), F.col("user_id")).alias("citation"), F.concat(F.lit("b"), F.col("event_id") % 3).alias("by_citation"), F.when(F.col("event_id") % 2 == 0, "corpus").otherwise("manual").alias("source"))
    old = rows.agg(F.max("event_type").alias("kind"), F.min("ts").alias("recorded_at"), F.min("ts").alias("checked_at"))
    late = e.where("event_id % 4 = 0 and user_id % 2 = 0").groupBy(F.concat(F.lit("o"), F.col("user_id")).alias("citation"), F.concat(F.lit("b"), F.col("event_id") % 3).alias("by_citation"))
    new = late.agg(F.min("event_type").alias("kind"), F.max("ts").alias("recorded_at"), F.max("ts").alias("checked_at"))
    return S.replace_source(old, new, "corpus")


_REPLACE = """WITH old AS (
  SELECT 'o' || user_id AS citation, 'b' || (event_id % 3) AS by_citation, CASE WHEN event_id % 2 = 0 THEN 'corpus' ELSE 'manual' END AS source,
         max(event_type) AS kind, min(ts) AS recorded_at, min(ts) AS checked_at FROM events GROUP BY 1, 2, 3),
new AS (SELECT 'o' || user_id AS citation, 'b' || (event_id % 3) AS by_citation, min(event_type) AS kind, max(ts) AS at FROM events
        WHERE event_id % 4 = 0 AND user_id % 2 = 0 GROUP BY 1, 2)
SELECT citation, kind, by_citation, source, recorded_at, checked_at FROM old WHERE source <> 'corpus'
UNION ALL
SELECT n.citation, n.kind, n.by_citation, 'corpus', coalesce(o.recorded_at, n.at), n.at
FROM new n LEFT JOIN old o ON o.source = 'corpus' AND o.citation = n.citation AND o.by_citation = n.by_citation"""

#: Event types as outcomes of appeals.
KINDS = {"click": "affirmed", "error": "reversed", "purchase": "none", "signup": "overruled", "view": "decided"}


def _treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("string")
    for a, b in KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    events = e.select(F.concat(F.lit("o"), F.col("user_id")).alias("citation"), kind.alias("kind"), F.concat(F.lit("b"), F.col("event_id") % 7).alias("by_citation"), F.col("ts").alias("checked_at"))
    return G.resolve(events)


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
_RESOLVED = f"""
ev AS (SELECT 'o' || user_id AS citation, {_KIND} AS kind, 'b' || (event_id % 7) AS by_citation, ts AS checked_at FROM events),
res AS (SELECT citation, by_citation, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'unknown' END AS kind, max(checked_at) AS checked_at FROM ev GROUP BY citation, by_citation)"""


def treatment_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _treatments(spark, sf_dir)


def treatment_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _treatments(spark, sf_dir).where("kind <> 'unknown' or citation < 'o5'").withColumn("source", F.when(F.col("by_citation") < "b3", "corpus").when(F.col("by_citation") == "b6", "manual").otherwise("courtlistener"))
    t = t.where("source <> 'manual' or citation like '%3'")
    opinions = table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), F.col("c_custkey")).alias("citation"))
    return G.flags(opinions, t, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


_FLAG = f"""WITH {_RESOLVED},
t AS (SELECT *, CASE WHEN by_citation < 'b3' THEN 'corpus' WHEN by_citation = 'b6' THEN 'manual' ELSE 'courtlistener' END AS source FROM res WHERE kind <> 'unknown' OR citation < 'o5'),
u AS (SELECT * FROM t WHERE source <> 'manual' OR citation LIKE '%3'),
a AS (SELECT citation, list(kind) AS ks, max(checked_at) AS checked, min(CASE WHEN source = 'manual' THEN kind || '|' || by_citation END) AS man FROM u GROUP BY citation),
s AS (SELECT *, CASE WHEN man IS NOT NULL THEN split_part(man, '|', 1)
                     WHEN list_contains(ks, 'overruled') THEN 'overruled'
                     WHEN list_contains(ks, 'reversed') AND list_contains(ks, 'affirmed') OR list_contains(ks, 'unknown') THEN 'unknown'
                     WHEN list_contains(ks, 'reversed') THEN 'reversed' WHEN list_contains(ks, 'decided') THEN 'decided'
                     WHEN list_contains(ks, 'affirmed') THEN 'affirmed' ELSE 'none' END AS status FROM a),
f AS (SELECT u.citation, arg_min(by_citation, (source <> 'courtlistener', by_citation)) AS by_first FROM u JOIN s ON u.citation = s.citation AND u.kind = s.status GROUP BY u.citation)
SELECT o.citation, coalesce(status, 'unknown') AS status, coalesce(split_part(man, '|', 2), by_first, '') AS by, checked AS checked_at,
       CASE WHEN man IS NOT NULL THEN FALSE ELSE coalesce(checked < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY, TRUE) END AS stale
FROM (SELECT 'o' || c_custkey AS citation FROM customer) o LEFT JOIN s ON o.citation = s.citation LEFT JOIN f ON o.citation = f.citation"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    edges = line.select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()
    seeds = table(spark, sf_dir, "part").where("p_partkey % 500 = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    held = table(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("node")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    return edges, seeds, held


def graph_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, seeds, held = _graph(spark, sf_dir)
    return G.neighbourhood(edges, seeds, 1, held)


def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, seeds, held = _graph(spark, sf_dir)
    return G.neighbourhood(edges, seeds, 2, held)


_GRAPH = """
e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
w AS (SELECT a AS node, b AS nxt FROM e UNION ALL SELECT b, a FROM e),
seed AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 500 = 1),
held AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size < 25 UNION SELECT 's' || s_suppkey FROM supplier),
h1 AS (SELECT DISTINCT nxt AS node FROM w WHERE node IN (SELECT node FROM seed)),
h2 AS (SELECT DISTINCT nxt AS node FROM w WHERE node IN (SELECT node FROM h1) UNION SELECT node FROM h1)"""


def _graph_sql(level: str) -> str:
    return f"WITH {_GRAPH} SELECT node FROM {level} WHERE node NOT IN (SELECT node FROM seed) AND node IN (SELECT node FROM held)"


def edge_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are replaced whole: distinct, without loops."""
    line = table(spark, sf_dir, "lineitem")
    return line.where("l_returnflag = 'R'").select((F.col("l_partkey") % 200).alias("citing"), (F.col("l_suppkey") % 200).alias("cited")).where("citing <> cited").distinct()


def final_section_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary sections (name ending in T) whose final section exists."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "T").otherwise("")).alias("section")).distinct()
    final = parts.where(~F.col("section").endswith("T"))
    return parts.where(F.col("section").endswith("T")).withColumn("final", F.regexp_replace("section", "T$", "")).join(final.select(F.col("section").alias("final")), "final", "left_semi").select("section", "final")


QUERIES = {
    "scd_upsert": (scd_upsert, f"WITH {_OLD_NEW}, {_UP} SELECT key, source, citation, part, section, md5(coalesce(text, '')) AS text, recorded_at FROM u"),
    "scd_versions": (
        scd_versions,
        f"""WITH {_OLD_NEW}, b AS (SELECT * FROM n WHERE source = 'src1'),
        gone AS (SELECT key FROM o WHERE source = 'src1' AND section IN (SELECT section FROM b) AND key NOT IN (SELECT key FROM b))
        SELECT o.key, o.source, o.citation, md5(coalesce(o.text, '')) AS text, o.recorded_at, b.recorded_at AS retired_at FROM o JOIN b ON o.key = b.key WHERE o.text IS DISTINCT FROM b.text
        UNION ALL SELECT key, source, citation, md5(coalesce(text, '')), recorded_at, TIMESTAMP '2024-07-01' FROM o WHERE key IN (SELECT key FROM gone)""",
    ),
    "scd_sweep": (scd_sweep, f"WITH {_OLD_NEW}, b AS (SELECT * FROM n WHERE source = 'src1') SELECT key, section FROM o WHERE source = 'src1' AND section IN (SELECT section FROM b) AND key NOT IN (SELECT key FROM b)"),
    "scd_save": (
        scd_save,
        f"""WITH {_OLD_NEW.replace("n AS (", "n0 AS (")}, n AS (SELECT * FROM n0 WHERE source = 'src2'), {_UP}
        SELECT key, source, citation, part, section, md5(coalesce(text, '')) AS text, recorded_at FROM u
        WHERE key NOT IN (SELECT key FROM o WHERE source = 'src2' AND section IN (SELECT section FROM n) AND key NOT IN (SELECT key FROM n))""",
    ),
    "incremental_save": (
        incremental_save,
        f"""WITH {_OLD_NEW.replace("n AS (", "n0 AS (")}, n AS (SELECT * FROM n0 WHERE source = 'src2'), {_UP}
        SELECT key, source, citation, part, section, md5(coalesce(text, '')) AS text, recorded_at FROM u
        WHERE key NOT IN (SELECT key FROM o WHERE source = 'src2' AND section IN (SELECT section FROM n) AND key NOT IN (SELECT key FROM n))""",
    ),
    "incremental_versions": (
        incremental_versions,
        f"""WITH {_OLD_NEW}, b AS (SELECT * FROM n WHERE source = 'src1'),
        gone AS (SELECT key FROM o WHERE source = 'src1' AND section IN (SELECT section FROM b) AND key NOT IN (SELECT key FROM b))
        SELECT o.key, o.source, o.citation, md5(coalesce(o.text, '')) AS text, o.recorded_at, b.recorded_at AS retired_at FROM o JOIN b ON o.key = b.key WHERE o.text IS DISTINCT FROM b.text
        UNION ALL SELECT key, source, citation, md5(coalesce(text, '')), recorded_at, TIMESTAMP '2024-07-01' FROM o WHERE key IN (SELECT key FROM gone)""",
    ),
    "scd_empty_batch": (scd_empty_batch, "SELECT 0::BIGINT AS n"),
    "held_at": (held_at, f"WITH {_HISTORY} SELECT key, text FROM h WHERE citation = 'u7' AND recorded_at <= TIMESTAMP '2024-01-15 12:00:00' AND (retired_at IS NULL OR retired_at > TIMESTAMP '2024-01-15 12:00:00')"),
    "held_at_all": (
        held_at_all,
        f"""WITH {_HISTORY} SELECT p.event_id, h.key, h.text FROM events p JOIN h ON h.citation = 'u' || p.user_id AND h.recorded_at <= p.ts AND (h.retired_at IS NULL OR p.ts < h.retired_at)
        WHERE p.event_type = 'error'""",
    ),
    "index_stale_sweep": (index_stale_sweep, "SELECT vec_id AS key, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "tenant_delete": (tenant_delete, "SELECT user_id AS tenant, event_id FROM events WHERE user_id NOT IN (SELECT c_custkey % 100 FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "replace_source": (replace_source, _REPLACE),
    "treatment_conflict": (treatment_conflict, f"WITH {_RESOLVED} SELECT citation, by_citation, kind, checked_at FROM res"),
    "treatment_flag": (treatment_flag, _FLAG),
    "graph_one_hop": (graph_one_hop, _graph_sql("h1")),
    "graph_two_hop": (graph_two_hop, _graph_sql("h2")),
    "edge_rebuild": (edge_rebuild, "SELECT DISTINCT l_partkey % 200 AS citing, l_suppkey % 200 AS cited FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 200 <> l_suppkey % 200"),
    "final_section_exists": (
        final_section_exists,
        """WITH s AS (SELECT DISTINCT p_size || CASE WHEN p_partkey % 3 = 0 THEN 'T' ELSE '' END AS section FROM part)
        SELECT section, regexp_replace(section, 'T$', '') AS final FROM s WHERE section LIKE '%T' AND regexp_replace(section, 'T$', '') IN (SELECT section FROM s)""",
    ),
}
