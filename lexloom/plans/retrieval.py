"""Queries: filters, exact vector and lexical top-k, fusion, rankings built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import cells as N
from lexloom.operators import lexical as X
from lexloom.operators import ranking as K
from lexloom.operators import retrieval as R
from lexloom.plans.tables import table
from lexloom.session import materialise, new_path

#: Query terms of the lexical branch.
TERMS = ["onesen", "inenan", "whou", "heron", "with"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, for searches by vector under a filter: key, embedding, text, lang, source."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", "lang", "source", "n_chars")
    return vectors.join(docs, "key")


def query_vector(spark: SparkSession, sf_dir: str, key: int = 0):
    return R.vector(table(spark, sf_dir, "embeddings"), "vec_id", key)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk: key, text, and citation, section and source made from its number."""
    source = F.element_at(F.array(*[F.lit(s) for s in ("usc", "ecfr", "case", "irs_pub", "client")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.concat(F.lit("c"), F.col("doc_id") % 400).alias("citation"), F.concat(F.lit("s"), F.col("doc_id") % 90).alias("section"), source.alias("source"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, with the source and section of its document where there is one."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return held.join(labelled(spark, sf_dir).select("key", "source", "section"), "key", "left")


def index(spark: SparkSession, sf_dir: str) -> str:
    """The inverted index of all documents, which the session builds once for the files as they are."""
    return X.index_of(spark, [f"{sf_dir}/documents.parquet"], lambda: labelled(spark, sf_dir).select("key", "text", "source", "section"))


def lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The lexical branch, over all documents."""
    return X.search_index(spark, index(spark, sf_dir), TERMS, k)


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return R.fuse([R.dense_topk(held, query_vector(spark, sf_dir)), lexical(spark, sf_dir, R.PREFETCH)], 10)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question: item, text, terms, and the vector of its number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text", R.tokens(F.col("text")).alias("terms"))
    return b.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "embedding"), "item", "left")


def hybrid_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage against all vectors and all documents, fused."""
    asked = questions(spark, sf_dir).select(F.col("item").alias("search"), "terms", "embedding")
    fused = R.fuse_many([R.dense_many(vectors(spark, sf_dir), asked), X.search_many(asked, index(spark, sf_dir))])
    best = K.first_n(fused, ["search"], [F.desc("rrf"), F.asc("key")], 10)
    return best.select(F.col("search").alias("item"), "key", "rrf", "branches")


def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage, the texts that hold its first word nearest to its second or third."""
    words = R.tokens(F.col("text"))
    b = table(spark, sf_dir, "benchmark").where(F.size(words) >= 3).select(F.col("item_id").alias("search"), words.alias("w"))
    asked = b.select("search", F.array(F.array(F.get("w", 0)), F.array(F.get("w", 1), F.get("w", 2))).alias("groups"))
    return X.search_covers(asked, index(spark, sf_dir), 10).select(F.col("search").alias("item"), "key", "score", "rank")


_TERMS = ", ".join(f"'{t}'" for t in TERMS)
_CORPUS = """
corpus AS (SELECT vec_id AS key, embedding, label, text, lang, source, n_chars FROM embeddings JOIN documents ON vec_id = doc_id),
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id AS key, embedding FROM embeddings),
txt AS (SELECT doc_id AS key, text FROM documents)"""


def _dense(source: str = "corpus", where: str = "TRUE", k: int = 50, name: str = "dense") -> str:
    return f"""
{name} AS (
  SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank
  FROM (SELECT key, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM {source}, qv WHERE {where})
  ORDER BY score DESC, key LIMIT {k})"""


def _sparse(source: str = "corpus", k: int = 50, name: str = "sparse") -> str:
    return f"""
{name}_tok AS (SELECT key, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM {source}),
{name}_dl AS (SELECT s.key, count(t.term) AS dl FROM {source} s LEFT JOIN {name}_tok t ON s.key = t.key GROUP BY s.key),
{name}_st AS (SELECT count(*) AS n, avg(dl) AS mean FROM {name}_dl),
{name}_tf AS (SELECT key, term, count(*) AS tf FROM {name}_tok WHERE term IN ({_TERMS}) GROUP BY key, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_s AS (
  SELECT t.key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 9) AS score
  FROM {name}_tf t JOIN {name}_df d ON t.term = d.term JOIN {name}_dl l ON t.key = l.key, {name}_st GROUP BY t.key),
{name} AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM {name}_s ORDER BY score DESC, key LIMIT {k})"""


_RRF = """
fused AS (SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, count(*) AS branches
          FROM (SELECT key, rank FROM dense UNION ALL SELECT key, rank FROM sparse) GROUP BY key ORDER BY rrf DESC, key LIMIT 10)"""
HYBRID = f"WITH {_CORPUS}, {_dense('vec')}, {_sparse('txt')}, {_RRF} SELECT key, rrf, branches FROM fused"


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_topk(corpus(spark, sf_dir), query_vector(spark, sf_dir), 10)


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, 10)


def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.conjunctive(corpus(spark, sf_dir), sources=["src1", "src2", "src3"])
    return R.dense_topk(docs.where("lang = 'en'"), query_vector(spark, sf_dir), 10)


def distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance ascending, as a vector store orders."""
    docs = corpus(spark, sf_dir).select("key", F.round(1 - R.cosine(F.col("embedding"), query_vector(spark, sf_dir)), 9).alias("distance"))
    return docs.orderBy("distance", "key").limit(10)


def any_term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.arrays_overlap(R.tokens(F.col("text")), F.array(*[F.lit(t) for t in TERMS]))).select("doc_id")


def exact_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query against all vectors: the nearest other one, and how many are close."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    asked = held.where("key % 20 = 0").withColumnRenamed("key", "search")
    best = R.dense_many(held, asked, 2, close=0.3).where("key <> search")
    return K.first_n(best, ["search"], [F.asc("rank")], 1).select(F.col("search").alias("query_id"), "key", "score", "close")


def edition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("edition", F.when(F.col("lang") == "en", (2000 + F.col("doc_id") % 30).cast("int")))
    return R.edition_filter(docs, 2020, 1, 0).select("doc_id", "edition")


def source_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No filter, an empty one, one source and two, counted."""
    docs = table(spark, sf_dir, "documents")
    parts = [R.source_filter(docs, f).agg(F.lit(n).alias("filter"), F.count("*").alias("n")) for n, f in (("none", None), ("empty", ()), ("one", "src1"), ("two", ["src1", "src2"]))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reattach_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused keys joined to their rows again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "lang")
    return hybrid_topk(spark, sf_dir).join(docs, "key", "left").select("key", "source", "lang", "rrf")


def filtered_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step search (top 50, then filter) against the filtered exact search."""
    docs, q = corpus(spark, sf_dir), query_vector(spark, sf_dir)
    late = R.dense_topk(docs, q, 50).join(docs.where("lang = 'en'").select("key"), "key", "left_semi").orderBy("rank").limit(10)
    exact = R.dense_topk(docs.where("lang = 'en'"), q, 10)
    both = late.agg(F.collect_list("key").alias("a")).join(exact.agg(F.collect_list("key").alias("e")))
    return both.select(F.round(R.filtered_recall(F.col("a"), F.col("e")), 6).alias("recall"), F.size("e").cast("long").alias("n"))


def cells(spark: SparkSession, sf_dir: str) -> str:
    """The cells of all vectors, written anew."""
    return _cells_of(spark, vectors(spark, sf_dir))


def _cells_of(spark: SparkSession, held: DataFrame) -> str:
    path = new_path(spark, "cells")
    N.write_cells(held, path)
    return path


def cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a search, free and within one kind of source: how many searches, and whether approximate hits hold nine of ten exact ones."""
    held, out = materialise(vectors(spark, sf_dir), "vectors"), None
    path = _cells_of(spark, held)
    own = held.select(F.col("key").alias("search"), "embedding")
    for name, sources in (("free", None), ("usc", ["usc"])):
        asked = own.withColumn("sources", F.array(*map(F.lit, sources)) if sources else F.lit(None).cast("array<string>"))
        shares = N.recall(N.search_cells(asked, path, 10), R.dense_many(held, asked, 10))
        one = shares.agg(F.lit(name).alias("filter"), F.count("*").alias("n"), (F.avg("recall") >= 0.9).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


def cell_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a search of its whole neighbourhood: with all cells visited the approximate search is exact."""
    held = vectors(spark, sf_dir)
    asked = held.where("key % 20 = 0").select(F.col("key").alias("search"), "embedding", F.array(F.lit("usc"), F.lit("case")).alias("sources"))
    return N.search_cells(asked, cells(spark, sf_dir), 10, visits=1 << 60)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of four routed searches, one for each language: question, sq, rank, key, citation, source, score, authority."""
    docs, q, out = corpus(spark, sf_dir), query_vector(spark, sf_dir), None
    for sq, lang in enumerate(("en", "fr", "de", "es")):
        held = docs.where(F.col("lang") == lang)
        top = R.dense_topk(held, q, 8).join(held.select("key", "source", "label"), "key")
        one = top.select(
            F.lit("q0").alias("question"),
            F.lit(sq).alias("sq"),
            F.col("rank"),
            F.col("key"),
            F.concat(F.lit("c"), (F.col("key") % 40).cast("string")).alias("citation"),
            F.when(F.col("label") < 4, "case").when(F.col("label") < 7, "usc").otherwise("irs_pub").alias("source"),
            F.col("score"),
            (F.col("label") % 5).cast("double").alias("lvl"),
        )
        out = one if out is None else out.unionByName(one)
    return out


_ROUTED = f"""WITH {_CORPUS},
hit AS (
  SELECT 'q0' AS question, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS sq, rank, key,
         'c' || (key % 40) AS citation,
         CASE WHEN label < 4 THEN 'case' WHEN label < 7 THEN 'usc' ELSE 'irs_pub' END AS source, score, (label % 5)::DOUBLE AS lvl
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, key) AS rank
        FROM (SELECT *, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM corpus, qv WHERE lang IN ('en', 'fr', 'de', 'es')))
  WHERE rank <= 8),
merged AS (
  SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY question ORDER BY rank, sq) AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY question, citation ORDER BY rank, sq) AS n FROM hit) WHERE n = 1)"""


def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.merge(_routed(spark, sf_dir), 10).select("ord", "citation", "sq", "key")


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = K.merge(_routed(spark, sf_dir)).drop("ord", "rank", "sq")
    return K.weigh_prior(pool, 0.5)


_WEIGHED = _ROUTED + """,
kinds AS (SELECT *, CASE WHEN source = 'case' THEN 'case' ELSE 'statutory' END AS kind FROM merged),
pos AS (SELECT *, row_number() OVER (PARTITION BY question, kind ORDER BY round(score + 0.5 * (lvl - 1), 9) DESC, citation) AS np,
                  row_number() OVER (PARTITION BY question, kind ORDER BY score DESC, citation) AS op FROM kinds),
weighed AS (SELECT a.question, a.citation, a.source, b.score, row_number() OVER (PARTITION BY a.question ORDER BY b.score DESC, a.citation) AS ord
            FROM pos a JOIN pos b ON a.question = b.question AND a.kind = b.kind AND a.np = b.op)"""


def authority_prior_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir).select("ord", "citation", "source", "score")


def authority_prior_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = K.merge(_routed(spark, sf_dir)).drop("ord", "rank", "sq")
    return K.weigh_prior(pool, 0.5, scoped=False).select("ord", "citation", "score")


def authority_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = K.merge(_routed(spark, sf_dir)).select("question", "citation", "source", "score", "lvl")
    return K.weigh_tie(pool, 0.05).select("ord", "citation", "score")


#: One comparison a step: neighbours are swapped, pass after pass, until a pass swaps none.
_TIE = _ROUTED.replace("WITH ", "WITH RECURSIVE ", 1) + """,
start AS (SELECT CASE WHEN source = 'case' THEN 'case' ELSE 'statutory' END AS kind, list({'c': citation, 's': score, 'l': lvl} ORDER BY score DESC, citation) AS r, list(score ORDER BY score DESC, citation) AS given FROM merged GROUP BY 1),
run AS (
  SELECT kind, r, given, 1 AS i, FALSE AS moved, FALSE AS done FROM start
  UNION ALL
  SELECT kind, CASE WHEN sw THEN r[: i - 1] || [r[i + 1], r[i]] || r[i + 2 :] ELSE r END, given, CASE WHEN i + 1 >= len(r) THEN 1 ELSE i + 1 END,
         CASE WHEN i + 1 >= len(r) THEN FALSE ELSE moved OR sw END, i + 1 >= len(r) AND NOT (moved OR sw)
  FROM (SELECT *, i < len(r) AND coalesce(r[i].s - r[i + 1].s < 0.05 AND r[i + 1].l > r[i].l, FALSE) AS sw FROM run WHERE NOT done)),
placed AS (SELECT unnest(r).c AS citation, unnest(given) AS score FROM run WHERE done)
SELECT row_number() OVER (ORDER BY score DESC, citation) AS ord, citation, score FROM placed"""


def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _routed(spark, sf_dir)
    pinned = hits.where("sq = 0 and rank = 8")
    return K.slots(_weighed(spark, sf_dir), hits, 8, floor=1, statute_floor=2, pinned=pinned).select("place", "citation", "score")


_SLOTS = _WEIGHED + """,
cand AS (
  SELECT question, citation, score, ord, 0 AS cls, sq FROM (
    SELECT w.*, h.sq, row_number() OVER (PARTITION BY w.question, h.sq ORDER BY ord) AS n
    FROM weighed w JOIN (SELECT DISTINCT question, sq, citation FROM hit) h ON w.question = h.question AND w.citation = h.citation) WHERE n <= 1
  UNION ALL
  SELECT question, citation, score, ord, 1, 0 FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ord) AS n FROM weighed WHERE source = 'usc') WHERE n <= 2
  UNION ALL
  SELECT question, citation, score, ord, 2, 0 FROM weighed WHERE citation IN (SELECT citation FROM hit WHERE sq = 0 AND rank = 8)
  UNION ALL
  SELECT question, citation, score, ord, 3, 0 FROM weighed),
one AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY question, citation ORDER BY cls, sq, ord) AS n FROM cand) WHERE n = 1),
seats AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY cls, sq, ord) AS seat FROM one),
places AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, seat) AS place FROM seats WHERE cls < 3 OR seat <= 8)
SELECT place, citation, score FROM places WHERE place <= 8"""


def pooled_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search's hits with another's that are not there yet, by key or citation."""
    routed = _routed(spark, sf_dir).select("question", "sq", F.when(F.col("key") % 3 > 0, F.concat(F.lit("k"), F.col("key") % 25)).otherwise("").alias("key"), "citation", (F.col("sq") * 100 + F.col("rank")).alias("ord"))
    hits = K.first_by(routed.where("sq < 2").withColumn("_s", F.coalesce(F.nullif("key", F.lit("")), "citation")), ["question", "_s"], [F.col("ord")]).drop("_s")
    return K.append_new(hits, routed.where("sq >= 2")).select("sq", "key", "citation", "ord")


_POOLED = _ROUTED + """,
p AS (SELECT question, sq, CASE WHEN key % 3 > 0 THEN 'k' || (key % 25) ELSE '' END AS key, citation, sq * 100 + rank AS ord FROM hit),
s AS (SELECT *, coalesce(nullif(key, ''), citation) AS same, CASE WHEN sq < 2 THEN 0 ELSE 1 END AS late FROM p)
SELECT sq, key, citation, ord FROM (SELECT *, row_number() OVER (PARTITION BY question, same ORDER BY late, ord) AS n FROM s) WHERE n = 1"""


def sibling_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sections of a search, each searched again for its own best six."""
    docs, q = corpus(spark, sf_dir).withColumnRenamed("source", "section"), query_vector(spark, sf_dir)
    top = R.dense_topk(docs, q, 20).join(docs.select("key", "section"), "key")
    first = top.groupBy("section").agg(F.min("rank").alias("at")).orderBy("at").limit(3)
    rows = docs.join(first, "section").select("section", "at", "key", R.cosine(F.col("embedding"), q).alias("score"))
    return K.first_n(rows, ["section"], [F.desc("score"), F.asc("key")], 6).select("section", "key", "score")


_SIBLINGS = f"""WITH {_CORPUS}, {_dense(k=20)},
f AS (SELECT source AS section, min(rank) AS since FROM dense JOIN corpus ON dense.key = corpus.key GROUP BY source ORDER BY since LIMIT 3),
r AS (SELECT section, key, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM corpus JOIN f ON source = section, qv)
SELECT section, key, score FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, key) AS n FROM r) WHERE n <= 6"""

def searches_sql(asked: str, name: str = "hy") -> str:
    """SQL of many hybrid searches: asked names a table (sid, terms, q, srcs, secs); gives {name}(sid, key, rrf, branches) and what it needs."""
    return f"""
{name}_doc AS (SELECT doc_id AS key, text, (['usc', 'ecfr', 'case', 'irs_pub', 'client'])[(doc_id % 5 + 1)::INT] AS source, 's' || (doc_id % 90) AS section FROM documents),
{name}_d AS (SELECT sid, key, row_number() OVER (PARTITION BY sid ORDER BY score DESC, key) AS rank FROM (
  SELECT sid, v.vec_id AS key, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM {asked} a, embeddings v LEFT JOIN {name}_doc d ON v.vec_id = d.key
  WHERE q IS NOT NULL AND (srcs IS NULL OR list_contains(srcs, d.source)) AND (secs IS NULL OR list_contains(secs, d.section))) QUALIFY rank <= 50),
{name}_tok AS (SELECT key, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM {name}_doc),
{name}_dl AS (SELECT d.key, count(term) AS dl FROM {name}_doc d LEFT JOIN {name}_tok t ON d.key = t.key GROUP BY d.key),
{name}_st AS (SELECT count(*) AS n, avg(dl) AS mean FROM {name}_dl),
{name}_tf AS (SELECT key, term, count(*) AS tf FROM {name}_tok GROUP BY key, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_w AS (SELECT t.key, t.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean)) AS w FROM {name}_tf t JOIN {name}_df f ON t.term = f.term JOIN {name}_dl l ON t.key = l.key, {name}_st),
{name}_s AS (SELECT sid, key, row_number() OVER (PARTITION BY sid ORDER BY score DESC, key) AS rank FROM (
  SELECT a.sid, w.key, round(sum(w), 9) AS score FROM (SELECT DISTINCT sid, srcs, secs, unnest(terms) AS term FROM {asked}) a JOIN {name}_w w ON a.term = w.term JOIN {name}_doc d ON d.key = w.key
  WHERE (srcs IS NULL OR list_contains(srcs, d.source)) AND (secs IS NULL OR list_contains(secs, d.section)) GROUP BY a.sid, w.key) QUALIFY rank <= 50),
{name} AS (SELECT sid, key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, count(*) AS branches FROM (SELECT * FROM {name}_d UNION ALL SELECT * FROM {name}_s) GROUP BY sid, key)"""


_MANY = f"""WITH asked AS (SELECT item_id AS sid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS terms, embedding::DOUBLE[] AS q, NULL::VARCHAR[] AS srcs, NULL::VARCHAR[] AS secs FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
{searches_sql("asked")}
SELECT sid AS item, key, rrf, branches FROM hy QUALIFY row_number() OVER (PARTITION BY sid ORDER BY rrf DESC, key) <= 10"""

#: Places of either group's words in each text, and the latest of each group so far, by windows.
_COVERS = """WITH q AS (SELECT item_id AS item, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 3),
g AS (SELECT DISTINCT item, grp, term FROM (SELECT item, 0 AS grp, w[1] AS term FROM q UNION ALL SELECT item, 1, w[2] FROM q UNION ALL SELECT item, 1, w[3] FROM q)),
t AS (SELECT doc_id AS key, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), 1) AS place FROM documents),
o AS (SELECT item, key, place, bool_or(grp = 0) AS a, bool_or(grp = 1) AS b FROM g JOIN t ON g.term = t.term GROUP BY item, key, place),
l AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN a THEN place END) OVER w AS la, max(CASE WHEN b THEN place END) OVER w AS lb FROM o WINDOW w AS (PARTITION BY item, key ORDER BY place)),
s AS (SELECT *, least(la, lb) AS since, CASE WHEN la IS NOT NULL AND lb IS NOT NULL THEN lag(CASE WHEN la IS NOT NULL AND lb IS NOT NULL THEN least(la, lb) END) OVER (PARTITION BY item, key ORDER BY place) END AS before FROM l),
c AS (SELECT s.*, p.n AS first FROM s JOIN l p ON s.item = p.item AND s.key = p.key AND s.since = p.place WHERE s.la IS NOT NULL AND s.lb IS NOT NULL AND (before IS NULL OR since > before)),
r AS (SELECT item, key, round(sum(0.1::DOUBLE / (1 + (place - since) - (n - first))), 9) AS score FROM c GROUP BY item, key)
SELECT item, key, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, key) AS rank FROM r QUALIFY rank <= 10"""

QUERIES = {
    "hybrid_many": (hybrid_many, _MANY),
    "cover_density_topk": (cover_density, _COVERS),
    "cell_recall": (cell_recall, "SELECT 'free' AS filter, count(*) AS n, TRUE AS enough FROM embeddings UNION ALL SELECT 'usc', count(*), TRUE FROM embeddings"),
    "cell_topk": (
        cell_topk,
        """SELECT a.vec_id AS search, b.vec_id AS key, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS rank
        FROM embeddings a, embeddings b JOIN documents ON doc_id = b.vec_id WHERE a.vec_id % 20 = 0 AND b.vec_id % 5 IN (0, 2) QUALIFY rank <= 10""",
    ),
    "hybrid_topk": (hybrid_topk, HYBRID),
    "dense_topk": (dense_topk, f"WITH {_CORPUS}, {_dense(k=10)} SELECT key, score, rank FROM dense"),
    "sparse_topk": (sparse_topk, f"WITH {_CORPUS}, {_sparse('txt', k=10)} SELECT key, score, rank FROM sparse"),
    "filtered_topk": (filtered_topk, f"WITH {_CORPUS}, {_dense(where='''lang = 'en' AND source IN ('src1', 'src2', 'src3')''', k=10)} SELECT key, score, rank FROM dense"),
    "distance_topk": (distance_topk, f"WITH {_CORPUS} SELECT key, round(1 - round(list_cosine_similarity(embedding::DOUBLE[], q), 9), 9) AS distance FROM corpus, qv ORDER BY distance, key LIMIT 10"),
    "any_term_match": (any_term_match, f"SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), [{_TERMS}])"),
    "exact_scan_all": (
        exact_scan_all,
        """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS key, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
           FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
           SELECT query_id, arg_min(key, (-score, key)) FILTER (WHERE key <> query_id) AS key, max(score) FILTER (WHERE key <> query_id) AS score, count(*) FILTER (WHERE score > 0.3) AS close FROM s GROUP BY query_id""",
    ),
    "edition_filter": (edition_filter, "SELECT doc_id, CASE WHEN lang = 'en' THEN (2000 + doc_id % 30)::INT END AS edition FROM documents WHERE lang <> 'en' OR 2000 + doc_id % 30 BETWEEN 2019 AND 2020"),
    "source_filter_any": (
        source_filter_any,
        """SELECT 'none' AS filter, count(*) AS n FROM documents UNION ALL SELECT 'empty', count(*) FROM documents
           UNION ALL SELECT 'one', count(*) FROM documents WHERE source = 'src1' UNION ALL SELECT 'two', count(*) FROM documents WHERE source IN ('src1', 'src2')""",
    ),
    "rrf_join": (reattach_citation, f"WITH {_CORPUS}, {_dense('vec')}, {_sparse('txt')}, {_RRF} SELECT key, source, lang, rrf FROM fused LEFT JOIN documents ON key = doc_id"),
    "filtered_recall": (
        filtered_recall,
        f"""WITH {_CORPUS}, {_dense()}, {_dense(where="lang = 'en'", k=10, name="exact")},
        late AS (SELECT dense.key FROM dense JOIN corpus ON dense.key = corpus.key WHERE lang = 'en' ORDER BY rank LIMIT 10)
        SELECT round((SELECT count(*) FROM late WHERE key IN (SELECT key FROM exact)) / (SELECT count(*) FROM exact)::DOUBLE, 6) AS recall, (SELECT count(*) FROM exact) AS n""",
    ),
    "round_robin_merge": (round_robin_merge, _ROUTED + " SELECT ord, citation, sq, key FROM merged WHERE ord <= 10"),
    "authority_prior_scoped": (authority_prior_scoped, _WEIGHED + " SELECT ord, citation, source, score FROM weighed"),
    "authority_prior_global": (
        authority_prior_global,
        _ROUTED
        + """, pos AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score + 0.5 * (lvl - 1), 9) DESC, citation) AS np,
                             row_number() OVER (PARTITION BY question ORDER BY score DESC, citation) AS op FROM merged)
        SELECT a.np AS ord, a.citation, b.score FROM pos a JOIN pos b ON a.question = b.question AND a.np = b.op""",
    ),
    "authority_tie": (authority_tie, _TIE),
    "slot_allocation": (slot_allocation, _SLOTS),
    "pooled_dedupe": (pooled_dedupe, _POOLED),
    "sibling_sections": (sibling_sections, _SIBLINGS),
}
