"""Queries: routed retrieval and uploads over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import retrieval as R
from lexloom.operators import routing as G
from lexloom.plans import retrieval as PR
from lexloom.plans.retrieval import searches_sql
from lexloom.plans.tables import table
from lexloom.session import new_path
from lexloom.sources import uploads as U


#: Kinds of sub-queries by a question's number, modulo 4.
SUBQUERIES = [("statutory", "case_law"), ("statutory", "client_fact"), ("unrouted",), ("case_law", "statutory", "client_fact")]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions: i, question, asked, and as a sub-query's own text the first sentence."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.concat(F.lit("q"), "item_id").alias("question"), F.col("text").alias("asked"), F.substring_index("text", ".", 1).alias("query"))


def kinds_of(i: Column) -> Column:
    return F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in SUBQUERIES]), (i % 4 + 1).cast("int"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text, terms and vector of every question and sub-query; a text that comes several times has the vector of the least number."""
    a = asked(spark, sf_dir)
    both = a.select(F.col("asked").alias("text"), F.col("i").alias("vec_id")).unionByName(a.select(F.col("query").alias("text"), (F.col("i") + 200).alias("vec_id")))
    one = both.groupBy("text").agg(F.min("vec_id").alias("vec_id"))
    return one.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "left").select("text", R.tokens(F.col("text")).alias("terms"), "embedding")


def retrieved(spark: SparkSession, sf_dir: str, plans: DataFrame, k: int, **more) -> tuple[DataFrame, DataFrame]:
    """Hits of plans(question, sq, kind, asked, query) by hybrid search over all documents and vectors, and pinned citations."""
    search = G.hybrid(PR.vectors(spark, sf_dir), PR.index(spark, sf_dir))
    return G.retrieve(plans, search, words(spark, sf_dir), PR.labelled(spark, sf_dir).drop("text"), k, **more)


def routed_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = asked(spark, sf_dir).select("question", "asked", "query", F.posexplode(kinds_of(F.col("i"))).alias("sq", "kind"))
    hits, pinned = retrieved(spark, sf_dir, plans, 8, statute=1, planned=1, siblings=2)
    return hits.join(pinned.withColumn("pinned", F.lit(True)), ["question", "citation"], "left").select("question", "sq", "key", "citation", "source", "score", F.coalesce("pinned", F.lit(False)).alias("pinned"))


PLANNED = """
b AS (SELECT item_id AS i, 'q' || item_id AS question, text AS asked, split_part(text, '.', 1) AS query FROM benchmark),
pl AS (SELECT question, i, sq, kind, asked, query FROM b JOIN
       (VALUES (0, 0, 'statutory'), (0, 1, 'case_law'), (1, 0, 'statutory'), (2, 0, 'unrouted'), (3, 0, 'case_law'), (3, 1, 'statutory')) x(m, sq, kind) ON i % 4 = m),
wd AS (SELECT text, min(vid) AS vid FROM (SELECT asked AS text, i AS vid FROM b UNION ALL SELECT query, i + 200 FROM b) GROUP BY text),
lab AS (SELECT doc_id AS key, 'c' || (doc_id % 400) AS citation, 's' || (doc_id % 90) AS section, (['usc', 'ecfr', 'case', 'irs_pub', 'client'])[(doc_id % 5 + 1)::INT] AS source FROM documents)"""


def requests_sql(rows: str, out: str) -> str:
    """SQL from requests(question, sq, kind, base, text, srcs, secs, n) to {out}(question, sq, kind, base, ord, key, citation, section, source, score)."""
    sid = "text || '|' || coalesce(array_to_string(srcs, ','), '') || '|' || coalesce(array_to_string(secs, ','), '')"
    return f"""
{out}_r AS (SELECT *, {sid} AS sid FROM ({rows})),
{out}_a AS (SELECT DISTINCT sid, regexp_extract_all(lower(r.text), '[a-z0-9]+') AS terms, embedding::DOUBLE[] AS q, srcs, secs FROM {out}_r r JOIN wd ON r.text = wd.text LEFT JOIN embeddings ON vec_id = vid),
{searches_sql(f"{out}_a", f"{out}_h")},
{out}_p AS (SELECT h.sid, h.key, rrf AS score, citation, section, source, row_number() OVER (PARTITION BY h.sid ORDER BY rrf DESC, citation, h.key) AS place FROM {out}_h h JOIN lab ON h.key = lab.key),
{out} AS (SELECT question, sq, kind, base, base + place AS ord, key, citation, section, source, score FROM {out}_r r JOIN {out}_p p ON r.sid = p.sid WHERE place <= n)"""


_SRCS = "CASE kind WHEN 'statutory' THEN ['usc', 'ecfr', 'irs_pub'] WHEN 'case_law' THEN ['case'] END"


def own_sql(k: int) -> str:
    """SQL of the hits of the questions' own words."""
    return requests_sql(f"SELECT question, sq, kind, 0 AS base, asked AS text, {_SRCS} AS srcs, NULL::VARCHAR[] AS secs, {k} AS n FROM pl", "own")


_REQUESTS = f"""SELECT question, sq, kind, 0 AS base, asked AS text, {_SRCS} AS srcs, NULL::VARCHAR[] AS secs, 8 AS n FROM pl
  UNION ALL SELECT question, sq, kind, 1000, asked, ['usc'], NULL, 8 FROM pl WHERE kind = 'statutory' UNION ALL SELECT question, sq, kind, 2000, query, ['usc'], NULL, 1 FROM pl WHERE kind = 'statutory'"""
_ROUTED = f"""WITH {PLANNED}, {requests_sql(_REQUESTS, "r1")},
pool AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY question, sq, key ORDER BY ord) = 1),
fs AS (SELECT question, sq, section, min(ord) AS since FROM pool WHERE kind = 'statutory' AND source IN ('usc', 'ecfr') GROUP BY question, sq, section),
ft AS (SELECT fs.*, asked, row_number() OVER (PARTITION BY fs.question, fs.sq ORDER BY since) AS nth FROM fs JOIN pl ON fs.question = pl.question AND fs.sq = pl.sq QUALIFY nth <= 3),
{requests_sql("SELECT question, sq, 'statutory' AS kind, 2900 + 100 * nth AS base, asked AS text, ['usc', 'ecfr'] AS srcs, [section] AS secs, 2 AS n FROM ft", "r2")},
every AS (SELECT * FROM (SELECT * FROM pool UNION ALL SELECT * FROM r2) QUALIFY row_number() OVER (PARTITION BY question, sq, key ORDER BY ord) = 1)
SELECT question, sq, key, citation, source, score, EXISTS (SELECT 1 FROM r1 WHERE base = 2000 AND r1.question = every.question AND r1.citation = every.citation) AS pinned FROM every"""


def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 7 == 0, F.lit(bytearray(b"GIF8"))).otherwise(F.lit(bytearray(b"%PDF-1.7")))
    uploads = d.select(F.col("doc_id").alias("id"), head.alias("content"), (F.col("n_chars") % 60).alias("n_pages"), (F.col("doc_id") % 11).alias("n_words"), (F.col("doc_id") % 25).alias("today"))
    return U.admission(uploads).groupBy("kind", "status").agg(F.count("*").alias("n"))


def _said() -> Column:
    """A turn as a page: an identifier of each kind after it, its own digits as letters, since SQL can't tell which of them redaction takes."""
    return F.concat(F.regexp_replace("text", r"[0-9]", "x"), F.lit(" my SSN 123-45-6789 and EIN 12-3456789"))


def uploads_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as uploads of five tenants, written as one, then read: what is committed of each, with its chunks and points."""
    c = table(spark, sf_dir, "conversations")
    head = F.when(F.col("conv_id") % 9 == 0, F.lit(bytearray(b"GIF8"))).otherwise(F.lit(bytearray(b"%PDF-1.7")))
    at = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("conv_id") % 1440).cast("int"))).alias("at")
    document = F.concat(F.lit("d"), "conv_id").alias("document")
    ups = c.select("conv_id").distinct().select(document, (F.col("conv_id") % 5).cast("string").alias("tenant"), F.concat(F.lit('the  "file" '), "conv_id").alias("name"), head.alias("content"), at)
    pages = c.select(document, (F.col("turn") + 1).alias("page"), _said().alias("text"))
    root = new_path(spark, "uploads")
    U.ingest(spark, root, "b1", ups, pages, "hashed", per_day=40, page_cap=6)
    held = U.committed(spark, root, "documents").select("document", "tenant", "name", "pages")
    n = lambda name: U.committed(spark, root, name).groupBy("document").agg(F.count("*").alias(name))
    return held.join(n("chunks"), "document").join(n("points"), "document")


def client_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).cast("string").alias("tenant"), F.concat(F.lit("d"), "conv_id").alias("document"), F.concat(F.lit("file "), "conv_id").alias("name"), (F.col("turn") + 1).alias("page"), _said().alias("text"))
    return U.chunks(pages).select("key", "tenant", "citation", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


_CLIENT = r"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '[0-9]', 'x', 'g') || ' my SSN [REDACTED SSN] and EIN [REDACTED EIN]', '[^ \t\n\r\f\v]+') AS w FROM conversations),
c AS (SELECT conv_id, turn, unnest(CASE WHEN len(w) <= 230 THEN [w] ELSE [w[i + 1 : i + 230] FOR i IN range(0, len(w), 195) IF len(w[i + 1 : i + 230]) > 34.5] END) AS x,
      generate_subscripts(CASE WHEN len(w) <= 230 THEN [w] ELSE [w[i + 1 : i + 230] FOR i IN range(0, len(w), 195) IF len(w[i + 1 : i + 230]) > 34.5] END, 1) AS n FROM p WHERE len(w) > 0)
SELECT 'd' || conv_id || '#' || (turn + 1) || '#' || n AS key, (conv_id % 5)::VARCHAR AS tenant, 'file ' || conv_id || ', p. ' || (turn + 1) AS citation, round_even(len(x) * 1.3, 0)::INT AS tokens, md5(array_to_string(x, ' ')) AS digest FROM c"""

_UPLOADS = _CLIENT[: _CLIENT.index("SELECT 'd' ||")] + """,
n AS (SELECT conv_id, count(*) AS chunks FROM c GROUP BY conv_id), g AS (SELECT conv_id, count(*) AS pages FROM conversations GROUP BY conv_id),
o AS (SELECT *, conv_id % 9 <> 0 AND pages <= 6 AS good FROM g),
s AS (SELECT *, sum(good::INT) OVER (PARTITION BY conv_id % 5 ORDER BY conv_id % 1440, 'd' || conv_id) AS nth FROM o)
SELECT 'd' || s.conv_id AS document, (s.conv_id % 5)::VARCHAR AS tenant, 'the ''file'' ' || s.conv_id AS name, pages, chunks, chunks AS points FROM s JOIN n ON s.conv_id = n.conv_id WHERE good AND nth <= 40"""

QUERIES = {
    "uploads_written": (uploads_written, _UPLOADS),
    "routed_retrieval": (routed_retrieval, _ROUTED),
    "upload_admission": (
        upload_admission,
        """SELECT CASE WHEN doc_id % 7 <> 0 THEN 'pdf' END AS kind, CASE WHEN doc_id % 7 = 0 THEN 415 WHEN doc_id % 25 >= 20 THEN 429 WHEN n_chars % 60 > 50 THEN 413 WHEN doc_id % 11 = 0 THEN 422 ELSE 200 END AS status, count(*) AS n
        FROM documents GROUP BY 1, 2""",
    ),
    "client_chunks": (client_chunks, _CLIENT),
}
