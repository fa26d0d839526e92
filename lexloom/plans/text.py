"""Queries: chunk functions, windows, numbering, boilerplate, redaction, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import ranges as I
from lexloom.operators import windows as W
from lexloom.plans.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def chunk_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 5 == 0, "toc")
    return _docs(spark, sf_dir).select("doc_id", T.chunk_key(F.concat(F.lit("26 CFR 1."), "doc_id"), reason, F.col("doc_id") % 4).alias("key"))


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    m = F.col("doc_id") % 9
    source = F.when(m < 3, "ecfr").when(m == 3, "usc").when(m < 6, "case").when(m == 6, "irs_pub").when(m == 7, "client").otherwise("web")
    section = F.concat(F.lit("1."), F.col("doc_id").cast("string"), F.when(m == 1, "T").when(m == 2, "-5A").otherwise(""))
    citation = F.when(m == 4, F.concat(F.lit("A v. Commissioner, "), F.col("doc_id"), F.lit(" T.C. No. 12"))).when(m == 5, F.concat(F.lit("T.C. Memo. 2020-"), F.col("doc_id"))).otherwise(section)
    return d.select("doc_id", "n_chars", source.alias("source"), section.alias("section"), citation.alias("citation"))


_PROFILED = """p AS (SELECT doc_id, n_chars, doc_id % 9 AS m,
  CASE WHEN doc_id % 9 < 3 THEN 'ecfr' WHEN doc_id % 9 = 3 THEN 'usc' WHEN doc_id % 9 < 6 THEN 'case' WHEN doc_id % 9 = 6 THEN 'irs_pub' WHEN doc_id % 9 = 7 THEN 'client' ELSE 'web' END AS source,
  '1.' || doc_id || CASE doc_id % 9 WHEN 1 THEN 'T' WHEN 2 THEN '-5A' ELSE '' END AS section FROM documents)"""
_STATUS = """CASE WHEN m = 0 THEN 'final' WHEN m = 1 THEN CASE WHEN n_chars % 2 = 0 THEN 'temporary_partly_expired' ELSE 'temporary' END WHEN m = 2 THEN 'final_prior_version'
  WHEN m = 3 THEN 'enacted' WHEN m = 4 THEN 'reported' WHEN m = 5 THEN 'memorandum' WHEN m = 6 THEN 'not_binding' WHEN m = 7 THEN 'client' ELSE 'unknown' END"""
_TYPE = "CASE WHEN m < 3 THEN 'regulation' WHEN m = 3 THEN 'statute' WHEN m < 6 THEN 'opinion' WHEN m = 6 THEN 'publication' WHEN m = 7 THEN 'client document' ELSE 'unknown' END"


def _authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiled(spark, sf_dir)
    return p.withColumn("a", T.authority(F.col("source"), F.col("citation"), F.col("section"), F.col("n_chars") % 2 == 0))


def authority_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authority(spark, sf_dir).select("doc_id", F.col("a.type").alias("type"), F.col("a.status").alias("status"), F.col("a.level").alias("level"), T.authority_label(F.col("a.type"), F.col("a.status")).alias("label"))


def authority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authority(spark, sf_dir).groupBy(F.col("a.type").alias("type"), F.col("a.status").alias("status")).agg(F.count("*").alias("n"))


def revision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("doc_id") * 37).cast("int"))
    return _profiled(spark, sf_dir).select("doc_id", T.revision(F.col("source"), day).alias("revision"), T.edition(F.col("source"), day).alias("edition"))


def expiry_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with a month of the year and a day, set against one snapshot."""
    month = F.element_at(F.array(*[F.lit(m) for m in ("January", "March", "July", "December")]), (F.col("doc_id") % 4 + 1).cast("int"))
    what = F.when(F.col("doc_id") % 3 == 0, "this section").otherwise("paragraph (g)(4) of this section, as amended,")
    text = F.concat(F.lit("The applicability of "), what, F.lit(" expires on "), month, F.lit(" "), F.col("doc_id") % 28 + 1, F.lit(", "), F.col("doc_id") % 10 + 2014, F.lit("."))
    at = F.lit("2019-03-15").cast("date")
    note = F.concat(F.lit("[T.D. 8253, 54 FR 20542, "), F.substring(month, 1, 3), F.lit(". "), F.col("doc_id") % 28 + 1, F.lit(", "), F.col("doc_id") % 40 + 1980, F.lit("]"))
    return _docs(spark, sf_dir).select("doc_id", T.expiry(text, at).alias("expiry"), T.sunset(note, at).alias("sunset"))


_EXPIRY = """WITH d AS (SELECT doc_id,
  make_date((doc_id % 10 + 2014)::INT, ([1, 3, 7, 12])[(doc_id % 4 + 1)::INT]::INT, (doc_id % 28 + 1)::INT) AS ends,
  make_date((doc_id % 40 + 1980)::INT, ([1, 3, 7, 12])[(doc_id % 4 + 1)::INT]::INT, (doc_id % 28 + 1)::INT) AS issued FROM documents)
SELECT doc_id, CASE WHEN ends < DATE '2019-03-15' THEN CASE WHEN doc_id % 3 = 0 THEN 'whole' ELSE 'partly' END END AS expiry,
       issued > DATE '1988-11-20' AND issued + INTERVAL 3 YEAR <= DATE '2019-03-15' AS sunset FROM d"""


def tax_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    said = F.when(m == 0, F.lit(None)).when(m == 1, F.concat(F.col("doc_id") % 30 + 1995)).when(m == 2, F.concat(F.col("doc_id") % 30 + 1995, F.lit(" and "), F.col("doc_id") % 7 + 2010)).otherwise("last year")
    return _docs(spark, sf_dir).select("doc_id", T.tax_year(said).alias("year"))


def sha_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.half(F.concat(F.lit("r"), "doc_id")).alias("half"))


def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of made-up citations of all four families."""
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    c = (
        F.when(m == 0, F.concat(F.lit("26 CFR 1.263(a)-"), i, F.lit("(k)(1)")))
        .when(m == 1, F.concat(F.lit("IRS Pub "), i, F.lit(" (2025), p. 12")))
        .when(m == 2, F.concat(F.lit("26 U.S.C. § "), i, F.lit("Z-2(a)(1)")))
        .when(m == 3, F.concat(F.lit("Chapin v. Commissioner, T.C. Memo. 2026-"), i, F.lit(", at *12")))
        .otherwise(F.concat(F.lit("26 CFR "), i, F.lit(".61")))
    )
    return _docs(spark, sf_dir).select("doc_id", T.section_of(c).alias("section"), T.first_page(c).alias("page"))


_SECTION = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1.263(a)-' || doc_id WHEN 1 THEN 'Pub ' || doc_id WHEN 2 THEN doc_id || 'Z-2' WHEN 3 THEN 'T.C. Memo. 2026-' || doc_id ELSE doc_id || '.61' END AS section,
  CASE WHEN doc_id % 5 = 3 THEN 12 ELSE 1000000 END AS page FROM documents"""


def content_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item, how many of its content words any document holds at most."""
    stop = ["that", "with", "this", "from", "which"]
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.content_words(F.col("text"), stop)).alias("w"))
    docs = _docs(spark, sf_dir).select("doc_id", F.explode(T.content_words(F.col("text"), stop)).alias("w"))
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n"))
    both = items.join(docs, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("c")).groupBy("item_id").agg(F.max("c").alias("c"))
    return sizes.join(both, "item_id", "left").select("item_id", "n", F.round(F.coalesce("c", F.lit(0)) / F.col("n"), 6).alias("overlap"))


_OVERLAP = """WITH s AS (SELECT ['that', 'with', 'this', 'from', 'which'] AS st),
i AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark), s WHERE NOT list_contains(st, w)),
d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), s WHERE NOT list_contains(st, w)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
c AS (SELECT item_id, max(c) AS c FROM (SELECT item_id, doc_id, count(*) AS c FROM i JOIN d ON i.w = d.w GROUP BY item_id, doc_id) GROUP BY item_id)
SELECT n.item_id, n, round(coalesce(c, 0) / n::DOUBLE, 6) AS overlap FROM n LEFT JOIN c ON n.item_id = c.item_id"""


def or_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.or_query(F.col("text")).alias("query"))


def prefix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    section = F.concat(F.lit("1.6"), (F.col("doc_id") % 3).cast("string"), F.when(m == 0, "").when(m == 1, "-1").when(m == 2, "(a)-1").otherwise("1-1"))
    return _docs(spark, sf_dir).select("doc_id", section.alias("section")).where(T.in_scope(F.col("section"), ["1.61", "1.62"]))


def outline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*[F.lit(x) for x in ["a", "b", "h", "i", "u", "v", "w", "x", "2", "A", "iv"]])
    pick = lambda k: F.element_at(letters, (F.floor(F.col("doc_id") / k) % 11 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", T.outline_level(pick(1), pick(11)).alias("level"))


_LEVELS = """WITH l AS (SELECT ['a', 'b', 'h', 'i', 'u', 'v', 'w', 'x', '2', 'A', 'iv'] AS x),
p AS (SELECT doc_id, x[(doc_id % 11 + 1)::INT] AS t, x[((doc_id // 11) % 11 + 1)::INT] AS b FROM documents, l)
SELECT doc_id, CASE WHEN t = '2' THEN 2 WHEN t IN ('i', 'v', 'x') THEN CASE WHEN ascii(t) = ascii(b) + 1 THEN 1 END WHEN t IN ('a', 'b', 'h', 'u', 'w') THEN 1 END AS level FROM p"""


def citation_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    first, last, second = F.when(m > 0, "a"), F.when(m == 1, "c").when(m == 2, "a"), F.when(m > 1, "1")
    return _docs(spark, sf_dir).select("doc_id", T.cite(F.lit("26 CFR"), F.concat(F.lit("1."), "doc_id"), first, last, second).alias("citation"))


def upload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [b"%PDF-1.7", b"\x89PNG\r\n", b"\xff\xd8\xff\xe0", b"II*\x00", b"MM\x00*", b"GIF8"]
    out = F.lit(bytearray(heads[0]))
    for i, h in enumerate(heads[1:], 1):
        out = F.when(F.col("doc_id") % 6 == i, F.lit(bytearray(h))).otherwise(out)
    return _docs(spark, sf_dir).select("doc_id", T.upload_kind(out).alias("kind"))


def renumber_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id") % 40).alias("citation"), F.when(F.col("role") == "user", "toc").alias("excluded"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return W.renumber(c)


def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return W.unit_ids(c, "conv_id", "turn", F.col("role") == "user")


def gaps_islands_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text"), F.col("turn").alias("page"), "role")
    return W.fold_numbers(c, "conv_id", "turn", F.col("role") == "user").select("conv_id", "piece", "text", "page")


def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.text_windows(_docs(spark, sf_dir), 230, 0.15)


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')"
_WINDOWS = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, unnest(CASE WHEN len(w) <= 230 THEN [w] ELSE [w[i + 1 : i + 230] FOR i IN range(0, len(w), 195) IF len(w[i + 1 : i + 230]) > 34.5] END) AS x,
             generate_subscripts(CASE WHEN len(w) <= 230 THEN [w] ELSE [w[i + 1 : i + 230] FOR i IN range(0, len(w), 195) IF len(w[i + 1 : i + 230]) > 34.5] END, 1) - 1 AS "window" FROM w)
SELECT doc_id, "window", len(x) AS n_words, x[1] AS first_word FROM c"""


def sliding_windows_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("held"))
    cut = held.select("doc_id", F.posexplode(W.sliding_windows(F.col("held"))).alias("window", "w"))
    return cut.select("doc_id", "window", F.md5(F.col("w").cast("binary")).alias("digest"))


_SLIDING = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 200, 0) + 100, 100)) AS i FROM w)
SELECT doc_id, i // 100 AS window, md5(coalesce(array_to_string(w[i + 1 : i + 200], ' '), '')) AS digest FROM c"""


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications are sources, pages their documents, with a running header added."""
    header = F.concat(F.lit("Page "), F.col("doc_id"), F.lit(" of "), F.col("source"), F.lit("\n"))
    lines = _docs(spark, sf_dir).select(F.col("source").alias("pub"), F.col("doc_id").alias("page"), F.posexplode(F.split(F.concat(header, F.coalesce("text", F.lit(""))), "\n")).alias("line_no", "line"))
    return W.boilerplate(lines).groupBy("pub", "page").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


_BOILER = r"""WITH l AS (SELECT source AS pub, doc_id AS page, unnest(string_split('Page ' || doc_id || ' of ' || source || chr(10) || coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split('Page ' || doc_id || ' of ' || source || chr(10) || coalesce(text, ''), chr(10)), 1) AS i0 FROM documents),
p AS (SELECT pub, count(DISTINCT page) AS pages FROM l GROUP BY pub),
k AS (SELECT *, count(*) OVER (PARTITION BY pub, page) AS n, row_number() OVER (PARTITION BY pub, page ORDER BY i0) AS i FROM l WHERE trim(line) <> ''),
e AS (SELECT *, regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '[0-9]+', '#', 'g') AS norm, CASE WHEN n > 6 THEN 3 ELSE 1 END AS w FROM k),
g AS (SELECT *, i <= w OR i > n - w AS edge FROM e),
b AS (SELECT g.pub, norm FROM g JOIN p ON g.pub = p.pub WHERE edge GROUP BY g.pub, norm, pages HAVING sum(CASE WHEN n = 1 THEN 2 ELSE 1 END) >= pages * 0.5)
SELECT g.pub, page, count(*) AS n, sum(length(line))::BIGINT AS chars FROM g LEFT JOIN b ON g.pub = b.pub AND g.norm = b.norm WHERE NOT (edge AND b.norm IS NOT NULL) GROUP BY g.pub, page"""


def per_group_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 300).alias("item"), F.col("o_orderdate").cast("date").alias("day"))
    return W.newest(o, "o_orderpriority", "item", "day", 40).select("item", "day", F.array_join("groups", "|").alias("groups"))


def one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.one_per_group(_docs(spark, sf_dir), "source", "doc_id", "s0").select("source", "doc_id")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = table(spark, sf_dir, "labels").select("doc_id")
    return W.stratified(_docs(spark, sf_dir), "lang", "doc_id", 15, "s1", prior).select("lang", "doc_id")


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents packed to 400 tokens with one line of overlap."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return W.packed(lines, "doc_id", "line_no", 400, lambda n: round(n * 1.3), overlap=1)


#: From each start the furthest end that fits; the next pack starts at that end, or behind it if it is the start.
_PACK = f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, list(n ORDER BY i) AS n, len(list(n)) AS size FROM (SELECT doc_id, i, sum(len({_WORDS})) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l) GROUP BY doc_id),
p AS (
  SELECT doc_id, 1 AS pack, 1::BIGINT AS s, greatest(1, len(list_filter(n, lambda x: round_even(x * 1.3, 0) <= 400)))::BIGINT AS e FROM c
  UNION ALL
  SELECT q.doc_id, pack + 1, q.t, greatest(q.t, len(list_filter(n, lambda x: round_even((x - coalesce(n[q.t - 1], 0)) * 1.3, 0) <= 400)))
  FROM (SELECT doc_id, pack, CASE WHEN e > s THEN e ELSE e + 1 END AS t, e FROM p) q JOIN c ON q.doc_id = c.doc_id WHERE q.e < size)
SELECT p.doc_id, pack, (s - 1)::INT AS first, (e - 1)::INT AS last, (n[e] - coalesce(n[s - 1], 0))::BIGINT AS n_words FROM p JOIN c ON p.doc_id = c.doc_id"""


def json_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    return e.groupBy("k", "event_type").agg(F.count("*").alias("n"))


def regex_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.bool_or(F.col("text").rlike("(?i)license")).alias("mentions"), F.max("n_chars").alias("longest"))


def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges that overlap within a section."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", (F.col("n_chars") % 90).alias("lo")).withColumn("hi", F.col("lo") + F.col("id") % 4)
    return I.overlapping(d, d, ["source"]).where("a < b").select(F.col("a").alias("cited"), F.col("b").alias("chunk"))


QUERIES = {
    "token_estimate": (token_estimate, f"SELECT doc_id, round_even(len({_WORDS}) * 1.3, 0)::INT AS tokens FROM documents"),
    "chunk_key": (chunk_key, "SELECT doc_id, '26 CFR 1.' || doc_id || '#' || CASE WHEN doc_id % 7 = 0 THEN 'body' WHEN doc_id % 5 = 0 THEN 'toc' ELSE 'body' END || '#' || doc_id % 4 AS key FROM documents"),
    "authority_profile": (
        authority_profile,
        f"""WITH {_PROFILED} SELECT doc_id, {_TYPE} AS type, {_STATUS} AS status, CASE WHEN m < 4 THEN 4 WHEN m = 4 THEN 3 WHEN m = 5 THEN 2 WHEN m = 6 THEN 1 ELSE 0 END AS level,
        CASE {_STATUS} WHEN 'final' THEN 'Treasury regulation' WHEN 'temporary' THEN 'Treasury regulation (temporary)' WHEN 'temporary_partly_expired' THEN 'Treasury regulation (temporary)'
        WHEN 'final_prior_version' THEN 'Treasury regulation (earlier version)' WHEN 'enacted' THEN 'Statute' WHEN 'reported' THEN 'Tax Court opinion (reported)' WHEN 'memorandum' THEN 'Tax Court memorandum opinion'
        WHEN 'not_binding' THEN 'IRS publication (not binding)' WHEN 'client' THEN 'Client document' ELSE 'Authority unknown' END AS label FROM p""",
    ),
    "authority_counts": (authority_counts, f"WITH {_PROFILED} SELECT {_TYPE} AS type, {_STATUS} AS status, count(*) AS n FROM p GROUP BY 1, 2"),
    "revision_labels": (
        revision_labels,
        f"""WITH {_PROFILED}, q AS (SELECT *, DATE '1900-01-01' + (doc_id * 37)::INT AS day FROM p)
        SELECT doc_id, CASE source WHEN 'ecfr' THEN 'eCFR ' || day WHEN 'case' THEN 'filed ' || day WHEN 'irs_pub' THEN CASE WHEN day > DATE '1900-01-01' THEN substr(day::VARCHAR, 1, 4) || ' edition' END END AS revision,
        CASE WHEN source = 'irs_pub' THEN year(day)::INT END AS edition FROM q""",
    ),
    "expiry_clauses": (expiry_clauses, _EXPIRY),
    "tax_years": (tax_years, "SELECT doc_id, CASE WHEN doc_id % 4 = 1 OR doc_id % 4 = 2 AND doc_id % 30 + 1995 = doc_id % 7 + 2010 THEN (doc_id % 30 + 1995)::INT END AS year FROM documents"),
    "sha_split": (sha_split, "SELECT doc_id, CASE WHEN position(right(sha256('r' || doc_id), 1) IN '02468ace') > 0 THEN 'tune' ELSE 'report' END AS half FROM documents"),
    "section_lookup": (section_lookup, _SECTION),
    "content_word_overlap": (content_word_overlap, _OVERLAP),
    "or_terms": (or_terms, "SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2), ' | ') AS query FROM benchmark"),
    "prefix_scope": (prefix_scope, "SELECT doc_id, '1.6' || (doc_id % 3) || (['', '-1', '(a)-1', '1-1'])[(doc_id % 4 + 1)::INT] AS section FROM documents WHERE doc_id % 3 IN (1, 2) AND doc_id % 4 <> 3"),
    "outline_levels": (outline_levels, _LEVELS),
    "citation_builder": (citation_builder, "SELECT doc_id, '26 CFR 1.' || doc_id || (['', '(a)-(c)', '(a)(1)', '(a)(1)'])[(doc_id % 4 + 1)::INT] AS citation FROM documents"),
    "upload_kinds": (upload_kinds, "SELECT doc_id, (['pdf', 'png', 'jpeg', 'tiff', 'tiff', NULL])[(doc_id % 6 + 1)::INT] AS kind FROM documents"),
    "renumber_parts": (
        renumber_parts,
        """WITH c AS (SELECT 'c' || (conv_id % 40) AS citation, CASE WHEN role = 'user' THEN 'toc' END AS excluded, conv_id * 1000 + turn AS seq FROM conversations)
        SELECT *, row_number() OVER (PARTITION BY citation, excluded ORDER BY seq) AS part FROM c""",
    ),
    "unit_ids": (
        unit_ids,
        """SELECT conv_id, turn, role, (sum(o) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS unit
        FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS o FROM conversations)""",
    ),
    "gaps_islands_fold": (
        gaps_islands_fold,
        """WITH c AS (SELECT conv_id, turn, md5(text) AS text, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS is_text FROM conversations),
        i AS (SELECT *, (sum(is_text) OVER (PARTITION BY conv_id ORDER BY turn) - is_text)::BIGINT AS piece FROM c)
        SELECT conv_id, piece, string_agg(text, ' ' ORDER BY turn) AS text, max(turn) AS page FROM i GROUP BY conv_id, piece""",
    ),
    "word_windows": (word_windows, _WINDOWS),
    "sliding_windows_200": (sliding_windows_200, _SLIDING),
    "boilerplate_lines": (boilerplate_lines, _BOILER),
    "per_group_newest_n": (
        per_group_newest_n,
        """WITH o AS (SELECT o_orderpriority AS g, o_custkey % 300 AS item, max(o_orderdate::DATE) AS day FROM orders GROUP BY 1, 2),
        t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY day DESC, item) AS n FROM o)
        SELECT item, max(day) AS day, string_agg(g, '|' ORDER BY g) AS groups FROM t WHERE n <= 40 GROUP BY item""",
    ),
    "one_per_group": (one_per_group, "SELECT source, arg_min(doc_id, (md5('s0|' || doc_id), doc_id)) AS doc_id FROM documents GROUP BY source"),
    "stratified_sample": (
        stratified_sample,
        """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('s1|' || doc_id), doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE n <= 15""",
    ),
    "greedy_pack": (greedy_pack, _PACK),
    "json_group_by": (json_group_by, "SELECT json_extract_string(props, '$.k')::BIGINT AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "regex_inventory": (regex_inventory, "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, bool_or(regexp_matches(text, '(?i)license')) AS mentions, max(n_chars) AS longest FROM documents GROUP BY source"),
    "range_overlap": (
        range_overlap,
        """WITH d AS (SELECT doc_id, source, n_chars % 90 AS lo, n_chars % 90 + doc_id % 4 AS hi FROM documents)
        SELECT a.doc_id AS cited, b.doc_id AS chunk FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id AND a.lo <= b.hi AND b.lo <= a.hi""",
    ),
}
