"""Queries for single operators that the larger queries only use inside: lookups, labels, unions, fences, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import claims as C
from lexloom.functions import text as T
from lexloom.operators import answers as A
from lexloom.operators import retrieval as R
from lexloom.operators import routing as G
from lexloom.operators import store as S
from lexloom.plans import retrieval as PR
from lexloom.plans.law import _said
from lexloom.plans.store import _HISTORY, _OLD_NEW, _history, old_chunks
from lexloom.plans.tables import table
from lexloom.session import new_path
from lexloom.sources import documents as D
from lexloom.sources import uploads as U

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("i", F.col("doc_id").cast("string"))


def branch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches' ranks side by side, before they are fused."""
    docs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    dense = R.dense_topk(docs, PR.query_vector(spark, sf_dir)).select(F.lit("dense").alias("branch"), "key", "rank")
    return dense.unionByName(PR.lexical(spark, sf_dir, R.PREFETCH).select(F.lit("sparse").alias("branch"), "key", "rank"))


_BRANCHES = f"WITH {PR._CORPUS}, {PR._dense('vec')}, {PR._sparse('txt')} SELECT 'dense' AS branch, key, rank FROM dense UNION ALL SELECT 'sparse', key, rank FROM sparse"


def version_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current and retired rows as one table."""
    every = _history(spark, sf_dir)
    return S.versions(every.where("retired_at is null"), every.where("retired_at is not null"))


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index would hold of stored chunks: live ones, in the columns of the payload."""
    chunks = old_chunks(spark, sf_dir).withColumn("excluded", F.when(F.col("part") == 3, "toc"))
    return S.payload(chunks).select("key", "source", "citation")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = old_chunks(spark, sf_dir).withColumn("excluded", F.when(F.col("part") == 3, "toc"))
    kinds = {"all": S.counted(), "src1": S.counted("src1"), "src1 live": S.counted("src1", True), "none": S.counted("no such source")}
    held = chunks.agg(*[n.alias(k) for k, n in kinds.items()])
    return held.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(f"`{k}`").alias("n")) for k in kinds])).alias("r")).select("r.*")


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 5 identifiers of chunk keys."""
    return _docs(spark, sf_dir).select("doc_id", T.point_id(_said("26 CFR 1.{i}#body#1"), NAMESPACE).alias("id"))


_POINTS = f"""WITH h AS (SELECT doc_id, lower(sha1(unhex('{NAMESPACE.replace("-", "")}') || encode('26 CFR 1.' || doc_id || '#body#1'))) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[((position(h[17:17] IN '0123456789abcdef') - 1) % 4 + 1)::INT] || h[18:20] || '-' || h[21:32] AS id FROM h"""


def _tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(T.point_id(F.col("c_custkey").cast("string"), NAMESPACE).alias("id"), F.col("c_name").alias("name"), F.sha2(_said("key-{k}", k=F.col("c_custkey").cast("string")).cast("binary"), 256).alias("key_sha256"), (F.col("c_custkey") % 5).cast("string").alias("tenant"), F.make_date(F.lit(2024), F.lit(1), (F.col("c_custkey") % 28 + 1).cast("int")).alias("created_at"))


def tenant_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenant of a key; a key that nobody has is nobody's."""
    every = _tenants(spark, sf_dir)
    return U.tenant_for(every, "key-17").unionByName(U.tenant_for(every, "key-0x")).select("name")


def tenant_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's rows with their places, newest first."""
    from pyspark.sql import Window

    rows = U.newest_first(_tenants(spark, sf_dir), "3")
    return rows.select("name", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).alias("place"), F.col("created_at").alias("day"))


def tenant_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row asked for by its tenant, by another, in capitals, and by a malformed id: how many of each are answered."""
    every = _tenants(spark, sf_dir)
    ways = [("own", F.col("id"), F.col("tenant")), ("other tenant", F.col("id"), F.lit("another")), ("upper case", F.upper("id"), F.col("tenant")), ("malformed", F.substring("id", 1, 20), F.col("tenant"))]
    asked = every.select(F.explode(F.array(*[F.struct(F.lit(n).alias("asked"), i.alias("id"), t.alias("tenant")) for n, i, t in ways])).alias("a")).select("a.*")
    return U.all_owned(every, asked).groupBy("asked").agg(F.count("row").alias("n"))


def routed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of sub-query may search a document's source, and which sub-queries are searched or facts."""
    source = F.element_at(F.array(*[F.lit(s) for s in ("usc", "ecfr", "case", "irs_pub", "client")]), (F.col("doc_id") % 5 + 1).cast("int"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("statutory", "case_law", "unrouted", "client_fact")]))
    plans = _docs(spark, sf_dir).select(F.col("i").alias("question"), F.lit(0).alias("sq"), kinds.alias("kind"), source.alias("source"), F.lit("q").alias("query"))
    hit = G.searched(plans).where(G.allowed(F.col("kind"), F.col("source"))).groupBy("kind", "source").agg(F.count("*").alias("n"))
    return hit.unionByName(G.facts(plans).agg(F.lit("client_fact").alias("kind"), F.lit("-").alias("source"), F.count("*").alias("n")))


_ROUTES = """WITH d AS (SELECT (['usc', 'ecfr', 'case', 'irs_pub', 'client'])[(doc_id % 5 + 1)::INT] AS source FROM documents)
SELECT 'unrouted' AS kind, source, count(*) AS n FROM d GROUP BY source UNION ALL SELECT 'statutory', source, count(*) FROM d WHERE source IN ('usc', 'ecfr', 'irs_pub') GROUP BY source
UNION ALL SELECT 'case_law', source, count(*) FROM d WHERE source = 'case' GROUP BY source UNION ALL SELECT 'client_fact', '-', count(*) FROM d"""


def client_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's own hits for its facts, then for the question; each citation once."""
    scored = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).cast("string").alias("question"), F.concat(F.lit("f"), F.col("turn") % 3).alias("text"), F.concat(F.lit("k"), F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.concat(F.lit("c"), F.col("conv_id") % 7).alias("citation"), F.round(F.length("text") % 97 / 97, 6).alias("score"))
    asked = scored.select("question").distinct().select("question", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f"f{n}").alias("text")) for n in range(3)])).alias("a")).select("question", "a.*")
    return G.client_hits(asked, scored, 3)


_CLIENT = """WITH s AS (SELECT conv_id % 20 AS q, turn % 3 AS n, 'k' || (conv_id * 100 + turn) AS key, 'c' || (conv_id % 7) AS citation, round(length(text) % 97 / 97::DOUBLE, 6) AS score FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY q, n ORDER BY score DESC, citation, key) AS r FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY q, citation ORDER BY n, score DESC, key) AS f FROM b WHERE r <= 3)
SELECT q::VARCHAR AS question, n::INT AS n, key, citation, score FROM o WHERE f = 1"""


def kept_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries that a verdict keeps, or that have none."""
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("sq"))
    verdicts = parts.where("question % 3 > 0").withColumn("sufficient", F.col("sq") % 2 == 0)
    return G.sufficient(parts, verdicts)


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a line break parted, joined, and lines as they are compared."""
    text = F.concat(F.lit("exam-\n  ple 12  of  345 "), F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.dehyphenate(text).cast("binary")).alias("joined"), F.md5(T.normalised_line(text).cast("binary")).alias("line"))


_LINES = r"""WITH d AS (SELECT doc_id, 'exam-' || chr(10) || '  ple 12  of  345 ' || coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '([\p{L}\p{M}\p{N}_])-[\s\x0B\x{85}\x{A0}\p{Z}]+([\p{L}\p{M}\p{N}_])', '\1\2', 'g')) AS joined, md5(regexp_replace(trim(regexp_replace(t, '[\s\x0B]+', ' ', 'g')), '[0-9]+', '#', 'g')) AS line FROM d"""


def publication_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and years that first pages say."""
    m = F.col("doc_id") % 3
    first = F.when(m == 0, _said("Userid: x Publication {i} Business Use of Home {i} For use in preparing 20{y} Returns", y=(F.col("doc_id") % 90 + 10).cast("string"))).when(m == 1, _said("Your Income  Tax {i} Publication {i} Get forms and more")).otherwise("nothing to see")
    return _docs(spark, sf_dir).select("doc_id", D.title(first, F.col("i")).alias("title"), D.edition_year(first).alias("year"))


_TITLES = """SELECT doc_id, 'Publication ' || doc_id || CASE doc_id % 3 WHEN 0 THEN ' Business Use of Home ' || doc_id WHEN 1 THEN ' Your Income Tax ' || doc_id ELSE '' END AS title,
  CASE WHEN doc_id % 3 = 0 THEN '20' || (doc_id % 90 + 10) END AS year FROM documents"""


def opinion_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page that holds an opinion's own citation, though spaced out, and the first with a filing date."""
    c = table(spark, sf_dir, "conversations")
    opinion = _said("T.C. Memo. 2020-{n}", n=(F.col("conv_id") + 1000).cast("string"))
    said = F.when(F.col("turn") == 1, _said("T. C. Memo. 2020- {n} page {t}", n=(F.col("conv_id") + 1000).cast("string"), t=F.col("turn").cast("string"))).when(F.col("turn") == 2, "Filed March 3, 2020.").otherwise(F.col("text"))
    pages = c.select(opinion.alias("opinion"), F.concat(opinion, F.lit(", at *"), F.col("turn") + 1).alias("citation"), said.alias("text"))
    return D.captions(pages)


_CAPTIONS = """SELECT 'T.C. Memo. 2020-' || (conv_id + 1000) AS opinion, max(CASE WHEN turn = 1 THEN 'T. C. Memo. 2020- ' || (conv_id + 1000) || ' page ' || turn END) AS caption, max(CASE WHEN turn = 2 THEN 'March 3, 2020' END) AS filed
FROM conversations GROUP BY conv_id"""


def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question set written as JSON lines and read: rows that can be scored, gold as groups; then the plans that are missing."""
    gold = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array(_said("c{i}"), F.lit("d")))).otherwise(F.concat(F.lit('["x", ["y", "z'), F.col("i"), F.lit('"]]')))
    line = F.concat(F.lit('{"id": "'), F.col("i"), F.lit('", "question": "q'), F.col("i"), F.lit('", "scored_from": "'), F.when(F.col("doc_id") % 3 == 0, "A").otherwise("C"), F.lit('", "gold": '), gold, F.lit("}"))
    path = new_path(spark, "questions")
    _docs(spark, sf_dir).select(line.alias("value")).write.text(path)
    asked = D.questions(spark, path, ["A", "B"])
    plans = asked.where("cast(id as long) % 2 = 0").select("question", F.lit(0).alias("plan_set"))
    return D.missing_plans(asked, plans, 2).join(asked.select("question", F.to_json("gold").alias("gold")), "question")


_QUESTIONS = """WITH q AS (SELECT doc_id, 'q' || doc_id AS question, CASE WHEN doc_id % 2 = 0 THEN '[["c' || doc_id || '"],["d"]]' ELSE '[["x"],["y","z' || doc_id || '"]]' END AS gold FROM documents WHERE doc_id % 3 = 0)
SELECT question, p::INT AS plan_set, gold FROM q, (SELECT unnest([0, 1]) AS p) WHERE NOT (doc_id % 2 = 0 AND p = 0)"""


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _docs(spark, sf_dir).select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "<html>").otherwise("%PDF-"), F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    return D.pdf_only(files).select("doc_id", F.octet_length("content").cast("long").alias("size"))


def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as a prompt lists them: labels, notes on when a text took effect, fences around clients' texts."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, F.struct(F.lit("statute").alias("type"), F.lit("enacted").alias("status"), F.lit(4).alias("level"))).when(F.col("turn") % 3 == 1, F.struct(F.lit("?").alias("type"), F.lit("?").alias("status"), F.lit(0).alias("level")))
    began = F.struct(F.lit(2025).alias("year"), F.lit("apply after May 1, 2024").alias("rule"), F.lit("May 1, 2024").alias("date"), F.lit(False).alias("retroactive"), F.lit("put in").alias("amendment"))
    source = F.when(F.col("role") == "user", "client").otherwise("usc")
    text = F.concat(F.lit("a </client_document> b "), F.md5(F.col("text").cast("binary")))
    hits = c.select(F.col("conv_id").alias("answer"), F.col("turn").alias("ord"), F.concat(F.lit("c"), "turn").alias("citation"), F.lit('the "head"').alias("heading"), source.alias("source"), F.lit("s1").alias("section"), text.alias("text"), kind.alias("authority"), F.when(F.col("turn") % 2 == 0, began).alias("effective"), (F.col("conv_id") % 3 + 2023).cast("int").alias("year"))
    return A.format_sources(hits).select("answer", F.md5(F.col("sources").cast("binary")).alias("digest"), F.length("sources").alias("n"))


_BLOCKS = """WITH s AS (SELECT conv_id AS answer, turn, '[c' || turn || '] (the "head")' || CASE turn % 3 WHEN 0 THEN chr(10) || 'Authority: Statute' WHEN 1 THEN chr(10) || 'Authority: Authority unknown' ELSE '' END
  || CASE WHEN turn % 2 = 0 AND 2024 >= conv_id % 3 + 2023 THEN chr(10) || 'Effective: the current text was enacted in 2025 and apply after May 1, 2024. Amendment: put in' ELSE '' END || chr(10)
  || CASE WHEN role = 'user' THEN '<client_document id="s1" name="the ''head''">' || chr(10) || 'a [tag removed]> b ' || md5(text) || chr(10) || '</client_document>' ELSE 'a </client_document> b ' || md5(text) END AS said FROM conversations)
SELECT answer, md5(string_agg(said, chr(10) || chr(10) ORDER BY turn)) AS digest, length(string_agg(said, chr(10) || chr(10) ORDER BY turn)) AS n FROM s GROUP BY answer"""


def answer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut at their part headings."""
    lead = F.when(F.col("doc_id") % 2 == 0, "Before.\n").otherwise("")
    text = F.concat(lead, _said("Part 1: Alpha {i}\nbody one\n**Part 2 - Beta**\n\nbody {i}"))
    parts = A.split_parts(F.when(F.col("doc_id") % 5 == 0, _said("no parts {i}")).otherwise(text))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("n", "p")).select("doc_id", "n", "p.label", "p.text")


_SECTIONS = """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS n, label, text FROM (
  SELECT doc_id, 0 AS k, '' AS label, CASE WHEN doc_id % 5 = 0 THEN 'no parts ' || doc_id ELSE 'Before.' END AS text FROM documents WHERE doc_id % 5 = 0 OR doc_id % 2 = 0
  UNION ALL SELECT doc_id, 1, 'Part 1: Alpha ' || doc_id, 'body one' FROM documents WHERE doc_id % 5 > 0
  UNION ALL SELECT doc_id, 2, 'Part 2: Beta', 'body ' || doc_id FROM documents WHERE doc_id % 5 > 0)"""


def authority_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 5
    said = F.when(m == 0, _said("Section {i}(a)")).when(m == 1, _said("Treas. Reg. § 1.{i}")).when(m == 2, _said("I.R.C. §{i}")).when(m == 3, _said("Pub. L. No. 119-{i}")).otherwise(_said("Notice 2020-{i}"))
    return _docs(spark, sf_dir).select("doc_id", C.canonical(said).alias("authority"))


_SPELLINGS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '§' || doc_id || '(a)' WHEN 1 THEN '§1.' || doc_id WHEN 2 THEN '§' || doc_id WHEN 3 THEN 'Pub.L.119-' || doc_id ELSE 'Notice2020-' || doc_id END AS authority FROM documents"


def citation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows with a citation of an opinion among them, and each citation's kind."""
    m = F.col("doc_id") % 4
    c = F.when(m == 0, _said("T.C. Memo. 2020-{i}, at *3")).when(m == 1, _said("{i} T.C. No. 4")).when(m == 2, _said("{i} T.C. 4")).otherwise(_said("26 CFR 1.{i}"))
    return _docs(spark, sf_dir).select("doc_id", C.kind_of(c).alias("kind"), F.exists(F.array(F.lit("26 CFR 1.61-1"), c), lambda x: x.rlike(T.OPINION)).alias("has_case"))


def json_in_chatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found in replies that say more, less, or something broken."""
    m = F.col("doc_id") % 4
    reply = F.when(m == 0, _said('Sure: {o}"grade": {n}, "why": "x"{c} done', o=F.lit("{"), c=F.lit("}"), n=F.col("i"))).when(m == 1, "no object").when(m == 2, '{"grade": ').otherwise(_said('{o}"why": "only {n}"{c}', o=F.lit("{"), c=F.lit("}"), n=F.col("i")))
    got = C.json_in(reply, "struct<grade:long,why:string>")
    return _docs(spark, sf_dir).select("doc_id", got["grade"].alias("grade"), got["why"].alias("why"))


_JSON = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS grade, CASE doc_id % 4 WHEN 0 THEN 'x' WHEN 3 THEN 'only ' || doc_id END AS why FROM documents"


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether answers keep a string out and cite a document, and their sentences that cite nothing."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat("role", F.lit(" says [c"), F.col("turn") % 3, F.lit("]."))
    cut = c.select(F.col("conv_id").alias("answer"), F.col("turn").alias("n"), F.when(F.col("turn") % 2 == 0, text).otherwise("plain.").alias("sentence"))
    bare = A.uncited(cut).groupBy("answer").agg(F.count("*").alias("uncited"))
    ok = c.where("turn = 0").select(F.col("conv_id").alias("answer"), C.checks(text, ["ASSIST"], F.concat(F.lit("c"), F.col("conv_id") % 2)).alias("ok"))
    return ok.join(bare, "answer", "left")


_CHECKS = "SELECT conv_id AS answer, bool_or(turn = 0 AND NOT contains(lower(role), 'assist') AND conv_id % 2 = 0) AS ok, nullif(count(*) FILTER (WHERE turn % 2 = 1), 0) AS uncited FROM conversations GROUP BY conv_id HAVING bool_or(turn = 0)"


def claim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citing sentences with the uncited ones before them."""
    cut = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer"), F.lit(0).alias("para"), F.col("turn").alias("n"), F.concat(F.lit("s"), "turn", F.when(F.col("turn") % 3 == 1, " [c]").otherwise("")).alias("sentence"))
    return C.spans(cut).select("answer", "first", "last", "span")


_SPANS = """WITH c AS (SELECT conv_id, turn, 's' || turn || CASE WHEN turn % 3 = 1 THEN ' [c]' ELSE '' END AS s, sum((turn % 3 = 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS island FROM conversations)
SELECT conv_id AS answer, min(turn) AS first, max(turn) AS last, string_agg(s, ' ' ORDER BY turn) AS span FROM c WHERE island > 0 GROUP BY conv_id, island"""


def client_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants' documents with their failed pages, after one is deleted."""
    pages = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).cast("string").alias("tenant"), F.concat(F.lit("d"), "conv_id").alias("document"), (F.col("turn") + 1).alias("page"), F.when(F.length("text") % 4 == 0, " \n").otherwise(F.col("text")).alias("text"))
    return U.without(U.documents(pages), "1", "d1").select("tenant", "document", "pages", F.array_join(F.transform("failed_pages", lambda x: x.cast("string")), ",").alias("failed"))


_DOCUMENTS = """SELECT (conv_id % 5)::VARCHAR AS tenant, 'd' || conv_id AS document, count(*) AS pages, coalesce(string_agg((turn + 1)::VARCHAR, ',' ORDER BY turn) FILTER (WHERE length(text) % 4 = 0 OR trim(text) = ''), '') AS failed
FROM conversations WHERE conv_id <> 1 GROUP BY conv_id"""


def year_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 3 + 2020).cast("string"))
    gold = F.when(F.col("doc_id") % 5 == 0, F.lit("2020 and 2021")).when(F.col("doc_id") % 5 < 4, (F.col("doc_id") % 2 + 2020).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", T.as_of_match(plan, gold).alias("match"))


_YEARS = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 4 THEN doc_id % 4 = 0 ELSE doc_id % 4 > 0 AND doc_id % 3 = doc_id % 2 END AS match FROM documents"""

QUERIES = {
    "branch_ranks": (branch_ranks, _BRANCHES),
    "version_union": (version_union, f"WITH {_HISTORY} SELECT key, citation, text, recorded_at, retired_at FROM h"),
    "payload_rows": (payload_rows, f"WITH {_OLD_NEW} SELECT key, source, citation FROM o WHERE part <> 3"),
    "row_counts": (row_counts, f"WITH {_OLD_NEW} SELECT 'all' AS what, count(*) AS n FROM o UNION ALL SELECT 'src1', count(*) FROM o WHERE source = 'src1' UNION ALL SELECT 'src1 live', count(*) FROM o WHERE source = 'src1' AND part <> 3 UNION ALL SELECT 'none', 0"),
    "point_ids": (point_ids, _POINTS),
    "tenant_by_key": (tenant_by_key, "SELECT c_name AS name FROM customer WHERE c_custkey = 17"),
    "tenant_newest": (tenant_newest, _POINTS.replace("FROM documents", "FROM customer").replace("'26 CFR 1.' || doc_id || '#body#1'", "c_custkey::VARCHAR").replace("SELECT doc_id, lower", "SELECT *, lower").replace("SELECT doc_id, h[1:8]", ", p AS (SELECT *, h[1:8]").removesuffix("FROM h") + "FROM h) SELECT c_name AS name, row_number() OVER (ORDER BY c_custkey % 28 + 1 DESC, id) AS place, make_date(2024, 1, (c_custkey % 28 + 1)::INT) AS day FROM p WHERE c_custkey % 5 = 3"),
    "tenant_owned": (tenant_owned, "SELECT asked, CASE WHEN asked IN ('own', 'upper case') THEN n ELSE 0 END AS n FROM (SELECT count(*) AS n FROM customer), (SELECT unnest(['own', 'other tenant', 'upper case', 'malformed']) AS asked)"),
    "routed_sources": (routed_sources, _ROUTES),
    "client_first": (client_first, _CLIENT),
    "kept_parts": (kept_parts, "SELECT conv_id AS question, turn AS sq, conv_id % 3 = 0 OR turn % 2 = 0 AS keep FROM conversations"),
    "joined_lines": (joined_lines, _LINES),
    "publication_titles": (publication_titles, _TITLES),
    "opinion_captions": (opinion_captions, _CAPTIONS),
    "question_set": (question_set, _QUESTIONS),
    "pdf_files": (pdf_files, "SELECT doc_id, strlen(coalesce(text, '')) + 5 AS size FROM documents WHERE doc_id % 3 <> 0"),
    "source_blocks": (source_blocks, _BLOCKS),
    "answer_sections": (answer_sections, _SECTIONS),
    "authority_spellings": (authority_spellings, _SPELLINGS),
    "citation_kinds": (citation_kinds, "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'case_law' ELSE 'statutory' END AS kind, doc_id % 4 < 2 AS has_case FROM documents"),
    "json_in_chatter": (json_in_chatter, _JSON),
    "answer_checks": (answer_checks, _CHECKS),
    "claim_spans": (claim_spans, _SPANS),
    "client_documents": (client_documents, _DOCUMENTS),
    "year_matches": (year_matches, _YEARS),
}
