"""Queries: citations and later history, appeals, amendment notes, regulation and statute XML. Passages are made from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import legal as L
from lexloom.plans.tables import table
from lexloom.session import new_path
from lexloom.sources import notes as N
from lexloom.sources import outline as O
from lexloom.sources import sections as X

CHECKED = "2026-01-02 00:00:00"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("i", F.col("doc_id").cast("string"))


def _said(template: str, **columns: Column) -> Column:
    """A string with columns in the places of {names}."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), columns[name] if name in columns else F.col(name)]
    return F.concat(*parts, F.lit(rest))


def _chosen(by: Column, templates: list[str], **columns: Column) -> Column:
    out = _said(templates[-1], **columns)
    for k, t in enumerate(templates[:-1]):
        out = F.when(by == k, _said(t, **columns)).otherwise(out)
    return out


#: Passages: a word after, a mixed one after nested parentheses, parallel citations, a word before, no court of appeal, a slip
#: number, an overruling, the parenthesis of another case.
PASSAGES = [
    "Gorse v. Commissioner, T.C. Memo. 1999-{i}, rev'd, 301 F.3d {i} (4th Cir. 2002). ",
    "Hazel v. Commissioner, 70 T.C. {i} (1978) (a note (of two) parts), aff'd in part, vacated in part, 650 F.2d {i} (D.C. Cir. 1980). ",
    "Ivy v. Commissioner, T.C. Memo. 2001-\n{i}, 81 T.C.M. (CCH) 44, 2001 WL 7, at *3, aff'd, 40 F. App'x {i} (3d Cir. 2002). ",
    "Juniper v. Commissioner, 12 F.4th {i}, 5 (2d Cir. 2021) (en banc), aff'g T .C . Memo 2019-{i}. ",
    "Larch v. Commissioner, 70 T.C. {i} (1978), aff'd, 30 B.T.A. {i} (1934). ",
    "Maple v. Commissioner, 116 T.C. 450 (2001), affd. 9 F.3d {i} (Fed. Cir. 2003). ",
    "Oak v. Commissioner, 70 T.C. {i} (1978), is overruled. ",
    "Pine v. Commissioner, 150 T.C. No. 3 (citing 70 T.C. {i} (1978)), aff'd, 5 F.4th {i} (7th Cir. 2021). ",
]


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    text = F.concat(_chosen(F.col("doc_id") % len(PASSAGES), PASSAGES), F.coalesce("text", F.lit("")))
    return d.select(_said("T.C. Memo. 2030-{i}").alias("citing"), text.alias("text"), F.lit(CHECKED).cast("timestamp_ntz").alias("fetched_at"))


def treatment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.subsequent_history(_passages(spark, sf_dir))


_HISTORY = f"""SELECT * FROM (SELECT
  CASE doc_id % 8 WHEN 0 THEN 'T.C. Memo. 1999-' || doc_id WHEN 1 THEN '70 T.C. ' || doc_id WHEN 2 THEN 'T.C. Memo. 2001-' || doc_id WHEN 3 THEN 'T.C. Memo. 2019-' || doc_id
    WHEN 5 THEN '116 T.C. No. 29' WHEN 6 THEN '70 T.C. ' || doc_id END AS citation,
  (['reversed', 'vacated in part', 'affirmed', 'affirmed', NULL, 'affirmed', 'overruled', NULL])[(doc_id % 8 + 1)::INT] AS kind,
  CASE doc_id % 8 WHEN 0 THEN '301 F.3d ' || doc_id || ' (ca4 2002)' WHEN 1 THEN '650 F.2d ' || doc_id || ' (cadc 1980)' WHEN 2 THEN '40 F. App''x ' || doc_id || ' (ca3 2002)'
    WHEN 3 THEN '12 F.4th ' || doc_id || ' (ca2 2021)' WHEN 5 THEN '9 F.3d ' || doc_id || ' (cafc 2003)' WHEN 6 THEN 'T.C. Memo. 2030-' || doc_id END AS by_citation,
  TIMESTAMP '{CHECKED}' AS checked_at FROM documents) WHERE citation IS NOT NULL"""


def passage_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions that the same passages cite, under their own keys."""
    return L.cited_opinions(_passages(spark, sf_dir))


_PASSAGE_CITES = """SELECT 'T.C. Memo. 2030-' || doc_id AS citing, unnest(CASE doc_id % 8 WHEN 0 THEN ['T.C. Memo. 1999-' || doc_id] WHEN 2 THEN ['T.C. Memo. 2001-' || doc_id]
  WHEN 3 THEN ['T.C. Memo. 2019-' || doc_id] WHEN 5 THEN ['116 T.C. No. 29'] WHEN 7 THEN ['150 T.C. No. 3', '70 T.C. ' || doc_id] ELSE ['70 T.C. ' || doc_id] END) AS cited FROM documents"""


def slip_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported citations, some of opinions that are held under a slip number."""
    known = F.array(*[F.lit(x) for x in L.SLIP])
    said = F.when(F.col("doc_id") % 3 == 0, F.element_at(known, (F.col("doc_id") % len(L.SLIP) + 1).cast("int"))).otherwise(_said("116 T.C. {i}"))
    return _docs(spark, sf_dir).select("doc_id", F.element_at(L.opinions_in(F.concat(F.lit("See "), said, F.lit("."))), 1).alias("opinion"))


_SLIPS = ", ".join(f"('{a}', '{b}')" for a, b in L.SLIP.items())
_SLIP = f"""WITH s(cite, slip) AS (VALUES {_SLIPS}),
d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ([{", ".join(f"'{a}'" for a in L.SLIP)}])[(doc_id % {len(L.SLIP)} + 1)::INT] ELSE '116 T.C. ' || doc_id END AS cite FROM documents)
SELECT doc_id, coalesce(slip, d.cite) AS opinion FROM d LEFT JOIN s ON d.cite = s.cite"""

#: How opinions end.
ENDINGS = [" We therefore affirm.", " The order is V ACATED.", " AFFIRMED IN PART; REVERSED IN PART. 1 A note.", " The Tax Court reversed the determination.", " The appeal is hereby dismissed in part."]


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), _chosen(F.col("doc_id") % len(ENDINGS), ENDINGS))
    return _docs(spark, sf_dir).select("doc_id", L.ruling(text).alias("ruling"))


_RULINGS = "SELECT doc_id, (['affirmed', 'vacated', 'reversed in part', NULL, 'dismissed in part'])[(doc_id % 5 + 1)::INT] AS ruling FROM documents"


def _appeals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Opinions of fifty families, and decisions of which some are their appeals."""
    d = _docs(spark, sf_dir)
    family = (F.col("doc_id") % 50).cast("string")
    opinions = d.select(_said("o{i}").alias("opinion"), _said("Ann B. & Carl Quince{f}, Jr., Petitioners", f=family).alias("caption"), F.make_date((F.col("doc_id") % 10 + 2000).cast("int"), F.lit(6), F.lit(1)).alias("filed"))
    what = F.when(F.col("doc_id") % 7 == 0, "Commissioner of Social Security").otherwise("Commissioner")
    text = F.concat(F.when(F.col("doc_id") % 11 > 0, "Carl, from the Tax Court.").otherwise("Dora, from the Tax Court."), _chosen(F.col("doc_id") % len(ENDINGS), ENDINGS))
    day = F.make_date((F.col("doc_id") % 17 + 2000).cast("int"), (F.col("doc_id") % 12 + 1).cast("int"), F.lit(2))
    cite = F.when(F.col("doc_id") % 3 > 0, _said("9 F.3d {i}"))
    decisions = d.select("i", _said("Quince{f} v. {what}", f=family, what=what).alias("case_name"), day.alias("decided"), cite.alias("cite"), _said("ca{n}", n=(F.col("doc_id") % 11 + 1).cast("string")).alias("court"), text.alias("text"))
    return opinions, decisions.withColumnRenamed("i", "decision")


def appeal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.appeals(*_appeals(spark, sf_dir)).select("opinion", "decision")


def first_appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_appeals(*_appeals(spark, sf_dir))


_APPEALS = """o AS (SELECT doc_id, doc_id % 50 AS f, doc_id % 10 + 2000 AS y FROM documents),
c AS (SELECT doc_id AS id, doc_id % 50 AS f, doc_id % 17 + 2000 AS y, make_date((doc_id % 17 + 2000)::INT, (doc_id % 12 + 1)::INT, 2) AS decided, CASE WHEN doc_id % 3 > 0 THEN '9 F.3d ' || doc_id END AS cite,
      'ca' || (doc_id % 11 + 1) AS court, (['affirmed', 'vacated', 'reversed in part', 'decided', 'dismissed in part'])[(doc_id % 5 + 1)::INT] AS kind FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 > 0),
m AS (SELECT o.doc_id, c.*, o.f AS family FROM o JOIN c ON o.f = c.f AND c.y - o.y BETWEEN 0 AND 5)"""
_FIRST = f"""WITH {_APPEALS},
r AS (SELECT doc_id, kind, coalesce(cite, 'Quince' || family || ' v. Commissioner') || ' (' || court || ' ' || y || ')' AS "by", decided, cite IS NULL AS bare FROM m),
b AS (SELECT doc_id, kind, "by" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY decided, bare, "by", kind) AS n FROM r) WHERE n = 1)
SELECT 'o' || o.doc_id AS opinion, coalesce(kind, 'none') AS kind, coalesce("by", '') AS "by" FROM o LEFT JOIN b ON o.doc_id = b.doc_id"""


def _entry_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    k = (F.col("doc_id") % 9 + 1).cast("string")
    text = _said("Amendments2021—Subsec. (c)({k}). Pub. L. 117–{i}, § 3{k}(b), substituted “x” for “y”. Subsecs. (h)(4) to (6). Pub. L. 117–{i}, title II, § 7, struck out. 2016—Pub. L. 114–{i} amended section catchline. 2013—Pub. L. 113–{i}, § 2, amended generally.", k=k)
    return d.select("i", text.alias("text")).select(F.col("i").alias("section"), F.lit("amendments").alias("topic"), F.lit(0).cast("long").alias("n"), "text")


def amendment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.entries(_entry_notes(spark, sf_dir)).select("section", "year", F.array_join("designations", " ").alias("designations"), "law", "law_section", "law_part")


_ENTRIES = """SELECT doc_id::VARCHAR AS section, year, CASE year WHEN 2013 THEN '' ELSE CASE p WHEN 0 THEN '(c)(' || (doc_id % 9 + 1) || ')' ELSE '(h)(4) (6) (h)(4) (h)(5) (h)(6)' END END AS designations,
  CASE year WHEN 2013 THEN '113-' ELSE '117-' END || doc_id AS law, CASE WHEN year = 2013 THEN '2' WHEN p = 0 THEN '3' || (doc_id % 9 + 1) ELSE '7' END AS law_section, CASE WHEN year = 2021 AND p = 0 THEN 'b' END AS law_part
FROM documents, (VALUES (2021, 0), (2021, 1), (2013, 0)) x(year, p)"""


def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks dated by their amendment's rule, by a reference to another section's note, as of an earlier law, or by the law that added
    them; some show nothing of what was put in."""
    d = _docs(spark, sf_dir).withColumn("g", F.floor(F.col("doc_id") / 4).cast("string")).withColumn("m", F.col("doc_id") % 4)
    last = (F.col("doc_id") - 1).cast("string")
    shown = F.when(F.col("doc_id") % 8 == 4, "nothing").otherwise(_said("n{i} dollars"))
    text = F.concat(F.lit("(1) Limit of "), shown, F.lit(". "), F.coalesce("text", F.lit("")))
    chunks = d.select(_said("k{i}").alias("key"), F.col("i").alias("section"), F.when(F.col("m") == 3, _said("26 U.S.C. § {i}")).otherwise(_said("26 U.S.C. § {i}(b)(1)")).alias("citation"), text.alias("text"))
    head = "Effective Date of 2025 Amendment "
    amended = _said("Amendments2025—Subsec. (b)(1). Pub. L. 119–{g}, § 6(a), substituted “n{i} dollars” for “six dollars”. 2001—Pub. L. 107–1 amended generally.")
    dated = _chosen(F.col("m"), [
        head + "Amendment by section 6 of Pub. L. 119–{g} not applicable to stock sold before Jan. 1, 1990. It shall apply to sales after May 1, 2024, except that amendment by section 6(a) of Pub. L. 119–{g} applicable to plants built after July {x}, 2024.",
        head + "See note under section {last} of this title.",
        head + "Amendment by Pub. L. 119–{g} effective as if included in the law of 2017, see note under section {last}.",
        "",
    ], last=last, x=(F.col("doc_id") % 28 + 1).cast("string"))
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(n).cast("long").alias("n"), c.alias("text")) for n, (t, c) in enumerate((
        ("amendments", F.when(F.col("m") < 3, amended)), ("effectiveDateOfAmendment", F.when(F.col("m") < 3, dated)),
        ("credit", F.when(F.col("m") == 3, _said("(Added Pub. L. 119–{g}, § 1, July 4, 2025, 139 Stat. 1.)"))), ("effectiveDate", F.when(F.col("m") == 3, _said("Section applicable to years beginning after Dec. 31, 2024."))),
    ))])
    notes = d.select(F.col("i").alias("section"), F.explode(rows).alias("r")).select("section", "r.*").where("text is not null")
    return N.link(chunks, notes).select("key", "year", "rule", "date", "retroactive")


_EFFECTIVE = """WITH d AS (SELECT doc_id, doc_id % 4 AS m, (doc_id - CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END) % 28 + 1 AS day FROM documents WHERE doc_id % 8 <> 4)
SELECT 'k' || doc_id AS key, 2025 AS year,
  CASE m WHEN 0 THEN 'applicable to plants built after July ' || day || ', 2024' WHEN 1 THEN 'shall apply to sales after May 1, 2024, except that amendment by section 6(a) of Pub' WHEN 2 THEN 'as if included in an earlier law' ELSE 'applicable to years beginning after Dec. 31, 2024' END AS rule,
  CASE m WHEN 0 THEN 'July ' || day || ', 2024' WHEN 1 THEN 'May 1, 2024' WHEN 3 THEN 'Dec. 31, 2024' END AS date, m = 2 AS retroactive FROM d"""


def _regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xml, a section of regulation for each document: reserved, a table of contents, temporary and ended, or two paragraphs."""
    body = "<P>(a) <I>General rule.</I> Number {i} applies.</P><P>(b)(1) An exception.</P><TABLE><TR><TH>x</TH><TD>{i}</TD></TR></TABLE><CITA>[T.D. 8253, 54 FR 20542, Mar. 3, 1990]</CITA>"
    xml = _chosen(F.col("doc_id") % 4, [
        f"<ECFR><DIV8 N='1.{{i}}' TYPE='SECTION'><HEAD>Scope.</HEAD>{body}</DIV8></ECFR>",
        f"<ECFR><DIV8 N='1.{{i}}T' TYPE='SECTION'><HEAD>Scope.</HEAD>{body}</DIV8></ECFR>",
        "<ECFR><DIV8 N='1.{i}' TYPE='SECTION'><HEAD>Table of contents</HEAD><P>x</P></DIV8></ECFR>",
        "<ECFR><DIV8 N='1.{i}' TYPE='SECTION'><HEAD>[Reserved]</HEAD></DIV8></ECFR>",
    ])
    return _docs(spark, sf_dir).select(xml.alias("xml"))


def regulation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each section."""
    return O.regulations(_regulations(spark, sf_dir).select(F.col("xml").cast("binary").alias("content")), "2026-09-17").select("key", "citation", "text", "tokens", "excluded", "cita", F.col("authority.status").alias("status"), "source_revision")


def regulation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sections in files of many, read by ranges of bytes."""
    path = new_path(spark, "regulations")
    _regulations(spark, sf_dir).select(F.regexp_replace("xml", "</?ECFR>", "").alias("value")).write.text(path)
    return X.regulations(spark, path, "2026-09-17").select("key", "citation", "text", "tokens", "excluded", "cita", F.col("authority.status").alias("status"), "source_revision")


def statute_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute sections in files of many, read by ranges of bytes; each quotes another section within its own."""
    path = new_path(spark, "statutes")
    head = '<x xmlns="u"><meta><created>2026-01-02T00</created><docPublicationName>Online@119-110</docPublicationName></meta>'
    quoted = '<notes><quotedContent><section identifier="/us/bill/{i}"><num>1</num><content>quoted</content></section></quotedContent></notes></section>'
    d = _statutes(spark, sf_dir).select("i", F.regexp_replace(F.replace(F.replace("xml", F.lit(head), F.lit("")), F.lit("</x>"), F.lit("")), "</section>$", quoted).alias("value"))
    whole = d.select(F.lit(1).alias("n"), F.concat(F.replace("value", F.lit("{i}"), F.col("i"))).alias("value"))
    first = spark.createDataFrame([(0, head)], "n int, value string")
    first.unionByName(whole).repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.text(path)
    return X.statutes(spark, path).select("key", "section", "text", "excluded", F.col("as_of").cast("string").alias("as_of"), "source_revision", F.col("authority.level").alias("level"))


_REGULATIONS = r"""WITH d AS (SELECT doc_id, doc_id % 4 AS m, '26 CFR 1.' || doc_id || CASE WHEN doc_id % 4 = 1 THEN 'T' ELSE '' END AS c FROM documents WHERE doc_id % 4 < 3)
SELECT c || CASE m WHEN 0 THEN '(a)-(b)#body#1' WHEN 1 THEN '(a)-(b)#expired#1' ELSE '#toc#1' END AS key, c || CASE WHEN m < 2 THEN '(a)-(b)' ELSE '' END AS citation,
  CASE WHEN m < 2 THEN '(a) General rule. Number ' || doc_id || ' applies.' || chr(10) || '(b)(1) An exception.' || chr(10) || 'x | ' || doc_id ELSE '' END AS text, CASE WHEN m < 2 THEN 16 ELSE 0 END AS tokens,
  CASE m WHEN 1 THEN 'expired' WHEN 2 THEN 'toc' END AS excluded, CASE WHEN m < 2 THEN '[T.D. 8253, 54 FR 20542, Mar. 3, 1990]' END AS cita, CASE WHEN m = 1 THEN 'temporary' ELSE 'final' END AS status, 'eCFR 2026-09-17' AS source_revision FROM d"""


def _statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i and xml, a section of statute for each document, some repealed, with a lead that joins its first provision."""
    head = '<x xmlns="u"><meta><created>2026-01-02T00</created><docPublicationName>Online@119-110</docPublicationName></meta>'
    live = '<section identifier="/us/usc/t26/s{i}–1"><num>{i}</num><heading>Deduction</heading><chapeau>There is allowed—</chapeau><subsection identifier="/us/usc/t26/s{i}–1/a"><num>(a)</num><heading>General.</heading><content>amount {i}</content></subsection><subsection identifier="/us/usc/t26/s{i}–1/b"><num>(b)</num><content>nothing else</content></subsection></section></x>'
    gone = '<section identifier="/us/usc/t26/s{i}" status="repealed"><heading>Gone</heading></section></x>'
    xml = _chosen((F.col("doc_id") % 5 == 0).cast("int"), [head + live, head + gone])
    return _docs(spark, sf_dir).select("i", xml.alias("xml"))


def statute_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each section."""
    return O.statutes(_statutes(spark, sf_dir).select(F.col("xml").cast("binary").alias("content"))).select("key", "section", "text", "excluded", F.col("as_of").cast("string").alias("as_of"), "source_revision", F.col("authority.level").alias("level"))


_STATUTES = """SELECT CASE WHEN doc_id % 5 = 0 THEN '26 U.S.C. § ' || doc_id || '#repealed#1' ELSE '26 U.S.C. § ' || doc_id || '-1(a)-(b)#body#1' END AS key, doc_id || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '-1' END AS section,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'There is allowed— (a) General. amount ' || doc_id || chr(10) || '(b) nothing else' END AS text, CASE WHEN doc_id % 5 = 0 THEN 'repealed' END AS excluded,
  '2026-01-02' AS as_of, 'Pub. L. 119-110' AS source_revision, 4 AS level FROM documents"""

QUERIES = {
    "treatment_history": (treatment_history, _HISTORY),
    "passage_citations": (passage_citations, _PASSAGE_CITES),
    "slip_numbers": (slip_numbers, _SLIP),
    "rulings": (rulings, _RULINGS),
    "appeal_matches": (appeal_matches, f"WITH {_APPEALS} SELECT 'o' || doc_id AS opinion, id::VARCHAR AS decision FROM m"),
    "first_appeals": (first_appeals, _FIRST),
    "amendment_entries": (amendment_entries, _ENTRIES),
    "effective_dates": (effective_dates, _EFFECTIVE),
    "regulation_chunks": (regulation_chunks, _REGULATIONS),
    "statute_chunks": (statute_chunks, _STATUTES),
    "regulation_file": (regulation_file, _REGULATIONS),
    "statute_file": (statute_file, _STATUTES),
}
