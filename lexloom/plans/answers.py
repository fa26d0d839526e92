"""Queries: citations of answers, premises, rendering, verdicts, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import answers as A
from lexloom.plans.tables import table


def _memo(n):
    return F.concat(F.lit("T.C. Memo. 2020-"), (n % 9).cast("string"), F.lit(", at *"), (n % 4).cast("string"))


def _rule(n):
    return F.concat(F.lit("26 CFR 1."), (n % 12).cast("string"), F.lit("("), (n % 3).cast("string"), F.lit(")"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation retrieves six sources."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer")).distinct()
    n = F.col("answer") * 5 + F.col("ord") * 3
    citation = F.when(F.col("ord") % 2 == 0, _rule(n)).otherwise(_memo(n))
    return c.select("answer", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ord")).select("answer", "ord", citation.alias("citation")).withColumn("section", T.section_of(F.col("citation")))


_HITS = """h0 AS (SELECT answer, ord, answer * 5 + ord * 3 AS n FROM (SELECT DISTINCT conv_id AS answer FROM conversations), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS ord)),
h AS (SELECT answer, ord, CASE WHEN ord % 2 = 0 THEN '26 CFR 1.' || (n % 12) || '(' || (n % 3) || ')' ELSE 'T.C. Memo. 2020-' || (n % 9) || ', at *' || (n % 4) END AS citation,
             CASE WHEN ord % 2 = 0 THEN '1.' || (n % 12) || '(' || (n % 3) || ')' ELSE 'T.C. Memo. 2020-' || (n % 9) END AS section FROM h0)"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sentences: a digest as the text, none to three citations."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 5 + F.col("turn") * 2
    cites = F.slice(F.array(_rule(n), _memo(n + 3), _rule(n)), 1, (F.length("text") % 4).cast("int"))
    text = F.when(F.length("text") % 11 == 0, "  ").otherwise(F.concat(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), F.lit(" .")))
    return c.select(F.col("conv_id").alias("answer"), F.col("turn").alias("idx"), (F.col("turn") % 3 + 1).cast("int").alias("part"), text.alias("text"), cites.alias("citations"))


_SENTENCES = """s0 AS (SELECT conv_id AS answer, turn AS idx, (turn % 3 + 1)::INT AS part, length(text) AS l, conv_id * 5 + turn * 2 AS n, CASE WHEN length(text) % 11 = 0 THEN '' ELSE substr(md5(text), 1, 8) END AS body FROM conversations),
s1 AS (SELECT *, '26 CFR 1.' || (n % 12) || '(' || (n % 3) || ')' AS r, 'T.C. Memo. 2020-' || ((n + 3) % 9) || ', at *' || ((n + 3) % 4) AS m FROM s0),
s AS (SELECT *, CASE l % 4 WHEN 0 THEN [] WHEN 1 THEN [r] ELSE [r, m] END AS cites FROM s1)"""


def citation_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _sentences(spark, sf_dir).select("answer", F.explode("citations").alias("citation")).distinct()
    return A.classify(cited, _hits(spark, sf_dir)).select("answer", "citation", "kind")


_SEC = "CASE WHEN citation LIKE 'T.C.%' THEN split_part(citation, ',', 1) ELSE substr(citation, 8) END"
_CITED = f"c AS (SELECT DISTINCT answer, citation, {_SEC} AS section FROM (SELECT answer, unnest(cites) AS citation FROM s))"


def section_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _sentences(spark, sf_dir).select("answer", F.explode("citations").alias("citation")).distinct()
    return A.sources_of(cited, _hits(spark, sf_dir)).select("answer", "citation", "ord")


def sentence_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.premises(_sentences(spark, sf_dir), _hits(spark, sf_dir)).select("answer", "idx", F.array_join(F.transform("ords", lambda x: x.cast("string")), ",").alias("ords"))


_PREMISES = f"""WITH {_HITS}, {_SENTENCES}, x AS (SELECT DISTINCT answer, idx, citation FROM (SELECT answer, idx, unnest(cites) AS citation FROM s)),
o AS (SELECT x.answer, idx, ord, h.citation, section FROM x JOIN h ON x.answer = h.answer AND x.citation = h.citation),
p AS (SELECT answer, idx, ord, 0 AS late FROM o UNION ALL
      SELECT o.answer, o.idx, h.ord, 1 FROM o JOIN h ON o.answer = h.answer AND o.section = h.section WHERE o.citation LIKE 'T.C.%' AND h.citation LIKE 'T.C.%'),
q AS (SELECT answer, idx, ord, min(late) AS late FROM p GROUP BY answer, idx, ord)
SELECT answer, idx, string_agg(ord::VARCHAR, ',' ORDER BY late, ord) AS ords FROM q GROUP BY answer, idx"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn % 2 = 1")
    return c.select(F.col("conv_id").alias("answer"), F.col("turn").alias("idx"), (F.col("turn") % 4).cast("int").alias("part"), F.concat(F.lit("why "), "turn").alias("why"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer")).distinct()
    n = F.when(F.col("answer") % 3 == 0, 1).otherwise(2)
    return c.select("answer", F.explode(F.sequence(F.lit(1), n)).alias("part")).withColumn("label", F.concat(F.lit("question "), "part"))


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer")).distinct()
    return c.select("answer", F.when(F.col("answer") % 4 == 0, F.concat(F.lit("20"), (F.col("answer") % 10 + 10).cast("string"))).alias("tax_year"))


def render_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.render(_sentences(spark, sf_dir), _notes(spark, sf_dir), _parts(spark, sf_dir), _years(spark, sf_dir))


def _render_sql(kept: str, notes: str) -> str:
    return f"""
pt AS (SELECT DISTINCT answer, part, several FROM (SELECT conv_id AS answer, unnest(CASE WHEN conv_id % 3 = 0 THEN [1] ELSE [1, 2] END) AS part, conv_id % 3 > 0 AS several FROM conversations)),
sl AS (SELECT k.answer, CASE WHEN pt.part IS NULL THEN 1 ELSE k.part END AS part, 0 AS late, idx, body || ' ' || array_to_string([('[' || x || ']') FOR x IN cites], ', ') || '.' AS line
       FROM {kept} k LEFT JOIN pt ON k.answer = pt.answer AND k.part = pt.part),
nl AS (SELECT n.answer, CASE WHEN pt.part IS NULL THEN 1 ELSE n.part END AS part, idx, why FROM {notes} n LEFT JOIN pt ON n.answer = pt.answer AND n.part = pt.part),
ln AS (SELECT * FROM sl UNION ALL
       SELECT answer, part, 1, idx, CASE WHEN EXISTS (SELECT 1 FROM sl WHERE sl.answer = nl.answer AND sl.part = nl.part) THEN 'Not in the sources: ' ELSE 'INSUFFICIENT EVIDENCE: ' END || why FROM nl),
bl AS (SELECT answer, part, string_agg(line, ' ' ORDER BY late, idx) AS block FROM ln GROUP BY answer, part),
hd AS (SELECT bl.answer, bl.part, CASE WHEN several THEN 'Part ' || bl.part || ': question ' || bl.part || chr(10) ELSE '' END || block AS block FROM bl JOIN pt ON bl.answer = pt.answer AND bl.part = pt.part),
tx AS (SELECT answer, string_agg(block, chr(10) || chr(10) ORDER BY part) AS text FROM hd GROUP BY answer)"""


_NOTES = "nt AS (SELECT conv_id AS answer, turn AS idx, (turn % 4)::INT AS part, 'why ' || turn AS why FROM conversations WHERE turn % 2 = 1)"
_YEAR = "CASE WHEN a.answer % 4 = 0 THEN 'Tax year: 20' || (a.answer % 10 + 10) || chr(10) || chr(10) ELSE '' END"
_RENDER = f"""WITH {_SENTENCES}, {_NOTES}, k0 AS (SELECT * FROM s WHERE body <> '' AND len(cites) > 0), {_render_sql("k0", "nt")}
SELECT a.answer, {_YEAR} || coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id AS answer FROM conversations) a LEFT JOIN tx ON a.answer = tx.answer"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn % 5 <> 4")
    return c.select(F.col("conv_id").alias("answer"), F.col("turn").alias("idx"), (F.length("text") % 3 > 0).alias("supported"))


def hide_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    kept, notes = A.hide(_sentences(spark, sf_dir), _verdicts(spark, sf_dir), _notes(spark, sf_dir), parts, "part")
    return A.render(kept, notes, parts)


_HIDE = f"""WITH {_SENTENCES}, {_NOTES},
p0 AS (SELECT DISTINCT answer, part FROM (SELECT conv_id AS answer, unnest(CASE WHEN conv_id % 3 = 0 THEN [1] ELSE [1, 2] END) AS part FROM conversations)),
it AS (SELECT s.answer, idx, CASE WHEN p0.part IS NULL THEN 1 ELSE s.part END AS part, body, cites, NOT coalesce(l % 3 > 0 AND idx % 5 <> 4, FALSE) AS failed
       FROM s LEFT JOIN p0 ON s.answer = p0.answer AND s.part = p0.part WHERE body <> '' AND len(cites) > 0),
gn AS (SELECT *, bool_or(failed) OVER (PARTITION BY answer, part) AS gone FROM it),
kp AS (SELECT * FROM gn WHERE NOT gone), em AS (SELECT answer, part FROM gn GROUP BY answer, part HAVING bool_and(gone)),
mn AS (SELECT answer, idx, part, why FROM nt WHERE NOT EXISTS (SELECT 1 FROM em WHERE em.answer = nt.answer AND em.part = nt.part)
       UNION ALL SELECT answer, 1000000 + part, part, 'no statement in this part could be verified against its sources.' FROM em), {_render_sql("kp", "mn")}
SELECT a.answer, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id AS answer FROM conversations) a LEFT JOIN tx ON a.answer = tx.answer"""


def dropped_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dropped(_sentences(spark, sf_dir))


def refusal_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = render_answer(spark, sf_dir)
    return rendered.select("answer", A.abstention(F.col("text"), F.col("answer") % 2 == 0).alias("outcome"))


_REFUSAL = f"""WITH {_SENTENCES}, {_NOTES}, k0 AS (SELECT * FROM s WHERE body <> '' AND len(cites) > 0), {_render_sql("k0", "nt")},
r AS (SELECT a.answer, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id AS answer FROM conversations) a LEFT JOIN tx ON a.answer = tx.answer),
f AS (SELECT answer, contains(upper(text), 'INSUFFICIENT EVIDENCE') AND NOT regexp_matches(text, '\\[[^\\[\\]]+\\]') AS refused FROM r)
SELECT answer, CASE WHEN refused AND answer % 2 = 0 THEN 'right refusal' WHEN refused THEN 'wrong refusal' WHEN answer % 2 = 0 THEN 'missed refusal' ELSE 'answered' END AS outcome FROM f"""


def numbered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return A.numbered(hits, A.premises(_sentences(spark, sf_dir), hits))


_NUMBERED = _PREMISES.replace("SELECT answer, idx, string_agg(ord::VARCHAR, ',' ORDER BY late, ord) AS ords FROM q GROUP BY answer, idx", "SELECT answer, ord, dense_rank() OVER (PARTITION BY answer ORDER BY ord) AS number FROM (SELECT DISTINCT answer, ord FROM q)")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir)
    claims = _sentences(spark, sf_dir).join(v, ["answer", "idx"], "left").select("answer", (F.size("citations") > 0).alias("cited"), "supported")
    return A.completeness(claims)


def bracket_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = render_answer(spark, sf_dir)
    return rendered.select("answer", F.explode(T.bracketed(F.col("text"))).alias("citation"))


_BRACKETS = _RENDER.replace("SELECT a.answer, " + _YEAR, "SELECT DISTINCT answer, unnest(regexp_extract_all(text, '\\[([^\\[\\]]+)\\]', 1)) AS citation FROM (SELECT a.answer, " + _YEAR) + ")"


def plan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that a planner could give, sound and broken."""
    m = F.col("conv_id") % 6
    reply = (
        F.when(m == 0, F.concat(F.lit('{"as_of": "2023", "subqueries": [{"kind": "statutory", "query": " q'), "conv_id", F.lit('"}, {"kind": "client_fact", "query": "f"}]}')))
        .when(m == 1, '{"as_of": null, "subqueries": [{"kind": "client_fact", "query": "f"}]}')
        .when(m == 2, "not json")
        .when(m == 3, '{"as_of": "2020", "subqueries": {"kind": "x"}}')
        .when(m == 4, '{"subqueries": [{"kind": "case_law", "query": "a"}, {"kind": "case_law", "query": "b"}, {"kind": "case_law", "query": "c"}, {"kind": "case_law", "query": "d"}, {"kind": "case_law", "query": "e"}, {"kind": "other", "query": "z"}]}')
        .otherwise('{"as_of": ""}')
    )
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    p = c.select("conv_id", A.plan(reply, F.lit("the question")).alias("p"))
    said = F.array_join(F.transform("p.subqueries", lambda s: F.concat(s["kind"], F.lit("="), s["query"])), ";")
    return p.select("conv_id", said.alias("subqueries"), F.col("p.as_of").alias("as_of"), F.col("p.fallback").alias("fallback"))


_PLAN = """SELECT DISTINCT conv_id, CASE conv_id % 6 WHEN 0 THEN 'statutory=q' || conv_id || ';client_fact=f' WHEN 4 THEN 'case_law=a;case_law=b;case_law=c;case_law=d' ELSE 'unrouted=the question' END AS subqueries,
CASE WHEN conv_id % 6 = 0 THEN '2023' END AS as_of,
(['', 'no searchable sub-query', 'unparseable', 'subqueries is not a list', '', 'unparseable'])[(conv_id % 6 + 1)::INT] AS fallback FROM conversations"""


def gold_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold keys and citations that do not exist, or only excluded: by key where the id has a number sign, else by citation."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), "doc_id").alias("citation"), F.concat(F.lit("c"), F.col("doc_id"), F.lit("#body#1")).alias("key"), (F.col("lang") == "es").alias("excluded"))
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.concat(F.lit("c"), F.col("item_id") * 13), F.concat(F.lit("c"), F.col("item_id") * 31, F.lit("#body#1")))).alias("id"))
    keyed, named = gold.where("contains(id, '#')"), gold.where("not contains(id, '#')")
    live = d.where("not excluded")
    return keyed.join(live.select(F.col("key").alias("id")), "id", "left_anti").unionByName(named.join(live.select(F.col("citation").alias("id")), "id", "left_anti")).select("item_id", "id")


QUERIES = {
    "citation_classify": (
        citation_classify,
        f"""WITH {_HITS}, {_SENTENCES}, {_CITED} SELECT answer, citation, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.answer = c.answer AND h.citation = c.citation) THEN 'exact'
        WHEN EXISTS (SELECT 1 FROM h WHERE h.answer = c.answer AND h.section = c.section) THEN 'derived' ELSE 'unsupported' END AS kind FROM c""",
    ),
    "section_fallback": (
        section_fallback,
        f"""WITH {_HITS}, {_SENTENCES}, {_CITED} SELECT answer, citation, coalesce((SELECT max(ord) FROM h WHERE h.answer = c.answer AND h.citation = c.citation),
        (SELECT min(ord) FROM h WHERE h.answer = c.answer AND h.section = c.section)) AS ord FROM c""",
    ),
    "sentence_premises": (sentence_premises, _PREMISES),
    "render_answer": (render_answer, _RENDER),
    "hide_failed": (hide_failed, _HIDE),
    "dropped_sentences": (dropped_sentences, f"WITH {_SENTENCES} SELECT answer, count(*) FILTER (WHERE body <> '' AND len(cites) = 0) AS n FROM s GROUP BY answer"),
    "refusal_class": (refusal_class, _REFUSAL),
    "numbered_sources": (numbered_sources, _NUMBERED),
    "completeness": (
        completeness,
        f"""WITH {_SENTENCES}, c AS (SELECT answer, len(cites) > 0 AS cited, l % 3 > 0 AND idx % 5 <> 4 AS ok FROM s), w AS (SELECT answer, bool_and(cited AND ok) AS whole FROM c GROUP BY answer)
        SELECT count(*) AS sentences, count(*) FILTER (WHERE cited) AS cited, round(count(*) FILTER (WHERE cited) / count(*)::DOUBLE, 9) AS completeness,
        (SELECT round(count(*) FILTER (WHERE whole) / count(*)::DOUBLE, 9) FROM w) AS verified FROM c""",
    ),
    "bracket_citations": (bracket_citations, _BRACKETS),
    "plan_parse": (plan_parse, _PLAN),
    "gold_integrity": (
        gold_integrity,
        """WITH g AS (SELECT item_id, unnest(['c' || item_id * 13, 'c' || item_id * 31 || '#body#1']) AS id FROM benchmark), d AS (SELECT 'c' || doc_id AS citation, 'c' || doc_id || '#body#1' AS key FROM documents WHERE lang <> 'es')
        SELECT item_id, id FROM g WHERE CASE WHEN contains(id, '#') THEN id NOT IN (SELECT key FROM d) ELSE id NOT IN (SELECT citation FROM d) END""",
    ),
}
