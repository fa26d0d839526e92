"""Queries: sentences and claims, authorities, pages of HTML, providers, backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import claims as C
from lexloom.functions import legal as L
from lexloom.operators import backfill as B
from lexloom.operators import providers as P
from lexloom.operators import ranges as I
from lexloom.operators import retrieval as R
from lexloom.plans.answers import _hits, _sentences
from lexloom.plans.evaluation import _JUDGED, _judged
from lexloom.plans.answers import _HITS, _SENTENCES
from lexloom.plans.retrieval import _CORPUS, _TERMS, TERMS, _sparse, lexical
from lexloom.plans.tables import table
from lexloom.session import new_path, ship


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer"), "text")
    return C.with_sentences(c).select("answer", "n", F.md5(F.col("sentence").cast("binary")).alias("digest"), C.structural(F.col("sentence")).alias("structural"))


def claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("**"), F.coalesce("text", F.lit("")), F.lit("** [c"), "doc_id", F.lit("] , end ;")).alias("s"))
    return d.select("doc_id", F.md5(C.claim_text(F.regexp_replace("s", "[^ -~]", "x")).cast("binary")).alias("digest"))


_CLAIM = r"""WITH d AS (SELECT doc_id, regexp_replace('**' || coalesce(text, '') || '** [c' || doc_id || '] , end ;', '[^ -~]', 'x', 'g') AS s FROM documents),
p AS (SELECT doc_id, regexp_replace(regexp_replace(s, '\[([^\[\]]+)\]', '', 'g'), '\*\*', '', 'g') AS s FROM d)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(s, '\s{2,}', ' ', 'g'), '\s+([,.;:])', '\1', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g')) AS digest FROM p"""


def citation_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of pages and paragraphs against chunks of the same source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") % 30).alias("p"))
    page = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("T.C. Memo. 2020-1, at *"), "p", F.lit("-"), F.col("p") + 2)).otherwise(F.concat(F.lit("183("), F.col("p"), F.lit(")-(z)")))
    named = d.select(F.col("doc_id").alias("id"), "source", page.alias("citation"))
    return I.contained(named, named, ["source"]).where("a < b").select(F.col("a").alias("citation"), F.col("b").alias("chunk"))


_CONTAINS = """WITH d AS (SELECT doc_id, source, n_chars % 30 AS p, doc_id % 3 > 0 AS pg FROM documents)
SELECT a.doc_id AS citation, b.doc_id AS chunk FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id
WHERE a.pg = b.pg AND CASE WHEN a.pg THEN abs(a.p - b.p) <= 2 ELSE a.p = b.p END"""


def laundered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("see Section "), F.col("conv_id") % 7 + F.col("turn"), F.lit("A(z) and Notice 2026-"), F.col("turn"))
    hits = c.select(F.col("conv_id").alias("answer"), F.when(F.col("role") == "user", "client").otherwise("usc").alias("source"), F.concat(F.lit("c"), "turn").alias("citation"), F.when(F.col("role") == "user", said).otherwise(F.concat(F.lit("under § "), F.col("conv_id") % 7 + F.col("turn") - 1, F.lit("A(z)."))).alias("text"))
    return C.laundered(hits)


_LAUNDERED = """WITH n AS (SELECT DISTINCT conv_id AS answer, unnest(['§' || (conv_id % 7 + turn) || 'A(z)', 'Notice2026-' || turn]) AS authority FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id AS answer, string_agg('c' || turn || 'under§' || (conv_id % 7 + turn - 1) || 'A(z).', '' ORDER BY turn) AS public FROM conversations WHERE role <> 'user' GROUP BY conv_id)
SELECT n.answer, authority FROM n LEFT JOIN p ON n.answer = p.answer WHERE NOT contains(coalesce(public, ''), authority)"""


def reseeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reseeded(_sentences(spark, sf_dir).where(F.size("citations") > 0), _hits(spark, sf_dir))


_RESEED = f"""WITH {_HITS}, {_SENTENCES}, x AS (SELECT answer, idx, unnest(cites) AS citation FROM s WHERE len(cites) > 0),
y AS (SELECT answer, idx, CASE WHEN citation LIKE 'T.C.%' THEN split_part(citation, ',', 1) ELSE substr(citation, 8) END AS section FROM x),
i AS (SELECT answer, idx, list(section) AS own FROM y GROUP BY answer, idx),
f AS (SELECT i.answer, i.idx, h.ord, h.citation, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.answer = h.answer AND x.citation = h.citation) THEN 1 ELSE 0 END AS c
      FROM i JOIN h ON i.answer = h.answer WHERE NOT list_contains(i.own, h.section))
SELECT answer, idx, arg_min(citation, (c, ord)) AS citation FROM f GROUP BY answer, idx"""


def authority_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = _judged(spark, sf_dir)
    tags = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.array(F.concat(F.lit("c"), F.col("vec_id"))).alias("controls"), F.array(F.concat(F.lit("c"), F.col("vec_id")), F.concat(F.lit("c"), F.col("vec_id") + 1)).alias("keep"), (F.col("vec_id") % 2).alias("target"))
    return C.authority_facts(tags, items.where("rank > 0 or question % 3 > 0"), items)


_FACTS = f"""WITH {_JUDGED}, it AS (SELECT * FROM items WHERE rank > 0 OR question % 3 > 0),
t AS (SELECT vec_id AS question, vec_id % 2 AS target FROM embeddings WHERE vec_id % 20 = 0)
SELECT t.question, (SELECT min(rank) + 1 FROM it WHERE it.question = t.question AND label = 'c' || t.question) AS rank,
  coalesce((SELECT min(rank) FROM it WHERE it.question = t.question AND label = 'c' || t.question) < target, FALSE) AS at_target,
  EXISTS (SELECT 1 FROM items WHERE items.question = t.question AND label = 'c' || t.question) AS in_pool,
  EXISTS (SELECT 1 FROM it WHERE it.question = t.question AND rank < 8 AND label = 'c' || t.question) AND EXISTS (SELECT 1 FROM it WHERE it.question = t.question AND rank < 8 AND label = 'c' || (t.question + 1)) AS keeps FROM t"""


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from collections.abc import Iterator

    import pandas as pd

    from lexloom.sources.outline import html_blocks as blocks

    ship(spark)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, i, b) for p, h in zip(pdf["page_id"], pdf["html"], strict=True) for i, b in enumerate(blocks(h or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "n", "text"])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, n long, text string")


#: Tags of page furniture go with their contents, block tags end a line, other tags vanish; runs of one text are one.
_HTML = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(p|div|li|ul|ol|h[1-6]|article|nav|br|tr|table|title|head|body)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, generate_subscripts(string_split(h, chr(10)), 1) AS i, unnest(string_split(h, chr(10))) AS x FROM b),
d AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[\s\x{85}\x{A0}]+', ' ', 'g')) AS x FROM c),
e AS (SELECT *, lag(x) OVER (PARTITION BY page_id ORDER BY i) AS before FROM d WHERE x <> '')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS n, x AS text FROM e WHERE before IS NULL OR x <> before"""


def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that passages made from documents carry."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("See A v. Commissioner, T.C. Memo. 2010-"), F.col("doc_id") % 40, F.lit(", 9 T.C.M. (CCH) 1; B v. Commissioner, 116 T.C. "), F.col("doc_id") % 30 + 430, F.lit(" (2001).\n"), F.coalesce("text", F.lit("")))
    return L.cited_opinions(d.select(F.concat(F.lit("T.C. Memo. 2010-"), F.col("doc_id") % 40 + F.col("doc_id") % 2).alias("citing"), text.alias("text")))


_EDGES = """WITH d AS (SELECT 'T.C. Memo. 2010-' || (doc_id % 40 + doc_id % 2) AS citing, 'T.C. Memo. 2010-' || (doc_id % 40) AS a, CASE WHEN doc_id % 30 = 20 THEN '116 T.C. No. 29' ELSE '116 T.C. ' || (doc_id % 30 + 430) END AS b FROM documents),
e AS (SELECT DISTINCT citing, unnest([a, b]) AS cited FROM d)
SELECT citing, cited FROM e WHERE cited <> citing AND NOT (starts_with(citing, cited) AND regexp_matches(substr(citing, length(cited) + 1, 1), '[0-9]'))"""


def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source mirrored into an index that holds some of its rows as they are, some with old texts, and some that are gone."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.concat(F.lit("k"), "doc_id").alias("key"), "source", "text", F.when(F.col("doc_id") % 9 == 0, "toc").alias("excluded"))
    old = d.where("doc_id % 3 > 0").select(F.concat(F.lit("k"), F.col("doc_id") + F.when(F.col("doc_id") % 4 == 0, 100000).otherwise(0)).alias("key"), "source", F.md5(F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text")).cast("binary")).alias("digest"))
    index = old.withColumn("embedding", F.array(F.lit(0.0)).cast("array<float>"))
    out = P.sync(chunks, index, "src1", "hashed")
    return out.select("key", "source", "digest", (F.size("embedding") > 1).alias("fresh"))


_SYNC = """WITH d AS (SELECT * FROM documents),
o AS (SELECT 'k' || (doc_id + CASE WHEN doc_id % 4 = 0 THEN 100000 ELSE 0 END) AS key, source, md5(CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE text END) AS digest FROM d WHERE doc_id % 3 > 0),
l AS (SELECT 'k' || doc_id AS key, source, md5(text) AS digest FROM d WHERE source = 'src1' AND doc_id % 9 <> 0)
SELECT key, source, digest, FALSE AS fresh FROM o WHERE source <> 'src1' UNION ALL
SELECT l.key, l.source, l.digest, NOT EXISTS (SELECT 1 FROM o WHERE o.key = l.key AND o.digest = l.digest) FROM l"""


def authority_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    temporary = F.col("doc_id") % 3 == 0
    section = F.concat(F.lit("1."), F.floor(F.col("doc_id") / 6), F.when(temporary, "T").otherwise(""))
    empty = F.struct(F.lit("unknown").alias("type"), F.lit("unknown").alias("status"), F.lit(0).alias("level"))
    chunks = d.select(F.concat(section, F.lit("#body#"), "doc_id").alias("key"), F.lit("ecfr").alias("source"), section.alias("citation"), F.col("doc_id").cast("int").alias("part"), section.alias("section"),
                      F.when(F.col("doc_id") % 2 == 0, "The applicability of this section expires on May 7, 2018.").otherwise("plain").alias("text"), F.lit(None).cast("string").alias("cita"),
                      F.lit("2019-01-01").cast("date").alias("as_of"), F.lit(None).cast("string").alias("excluded"), F.lit(None).cast("string").alias("source_revision"), empty.alias("authority"))
    return B.summary(B.backfill(chunks))


def rerank_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten candidates ordered anew by a provider's scores."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    pool = lexical(spark, sf_dir, 25)
    scores = docs.join(F.broadcast(pool.select("key")), "key").select("key", P.lexical_score(F.lit(" ".join(TERMS)), F.col("text")).alias("score"))
    return R.rerank(pool, scores, 10).select("key", "score", "rank")


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables dumped and restored, counted."""
    out = None
    for name in ("documents", "labels", "embeddings"):
        path = new_path(spark, f"dump-{name}")
        table(spark, sf_dir, name).write.parquet(path)
        one = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "sentence_split": (sentence_split, None),
    "claim_texts": (claim_texts, _CLAIM),
    "citation_contains": (citation_contains, _CONTAINS),
    "laundered_authorities": (laundered, _LAUNDERED),
    "reseeded_citations": (reseeded, _RESEED),
    "authority_facts": (authority_facts, _FACTS),
    "html_blocks": (html_blocks, _HTML),
    "citation_edges": (citation_edges, _EDGES),
    "index_sync": (index_sync, _SYNC),
    "authority_backfill": (
        authority_backfill,
        """WITH s AS (SELECT doc_id, doc_id // 6 AS g, doc_id % 3 = 0 AS t, doc_id % 2 = 0 AS e FROM documents), w AS (SELECT g FROM s WHERE t GROUP BY g HAVING bool_or(e))
        SELECT count(*) AS rows, count(*) AS updated, count(*) FILTER (WHERE t AND g IN (SELECT g FROM w)) AS expired, count(*) FILTER (WHERE NOT (t AND g IN (SELECT g FROM w))) AS points FROM s""",
    ),
    "rerank_provider": (
        rerank_provider,
        f"""WITH {_CORPUS}, {_sparse('txt', k=25)}, t AS (SELECT txt.key, round(len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), [{_TERMS}])) / 5::DOUBLE, 9) AS score FROM sparse JOIN txt ON sparse.key = txt.key)
        SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM t ORDER BY score DESC, key LIMIT 10""",
    ),
    "snapshot_roundtrip": (snapshot_roundtrip, "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'embeddings', count(*) FROM embeddings"),
}
