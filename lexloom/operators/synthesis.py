"""Answers planned, written and checked by chat models behind names.

questions(answer, question, tax_year), parts(answer, part, label) and hits(answer, part, ord, citation, heading, source, section,
text, authority, effective, year), a citation once for each answer. One Spark type states the shape of a reply: the model gets it
as JSON schema and the reply is read by it. Replies are written tables, so no model is asked twice. What a verifier does not
confirm is hidden, and where its reply can't be read nothing of the answer is shown.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from lexloom.functions.claims import canonical, laundered
from lexloom.operators import answers as A
from lexloom.operators.providers import WAIT, replied
from lexloom.session import materialise

#: What is said in place of an answer, and of notes that name a client's law.
NO_SENTENCE = "INSUFFICIENT EVIDENCE: no sentence of the answer could be tied to a source."
UNVERIFIED = "INSUFFICIENT EVIDENCE: the answer could not be verified."
LAUNDERED = "the client document's legal statements are not supported by the sources."

PLAN = "Split the question into sub-queries, each of one kind, and name the year that it is about, as JSON."
WRITE = "Answer each part from the sources alone, one sentence an item with its citations, and say what the sources lack, as JSON."
VERIFY = "Say of each numbered claim whether the sources that it cites state all of it, as JSON."
RECITE = "Name for each numbered claim the one source that states all of it, or null, as JSON."
CONCLUDE = "Say whether the conclusion follows from the numbered statements and which it rests on, as JSON."

TEXT, NUMBER, FLAG = StringType(), IntegerType(), BooleanType()


def _shape(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


PLANNED = _shape(as_of=TEXT, subqueries=ArrayType(_shape(kind=TEXT, query=TEXT)))
ANSWER = _shape(tax_year=TEXT, sentences=ArrayType(_shape(part=NUMBER, text=TEXT, citations=ArrayType(TEXT))), not_answerable=ArrayType(_shape(part=NUMBER, why=TEXT)), conclusion=TEXT)
VERDICTS = _shape(verdicts=ArrayType(_shape(index=NUMBER, supported=FLAG, why=TEXT)))
RECITES = _shape(recites=ArrayType(_shape(index=NUMBER, source=NUMBER, why=TEXT)))
CONCLUSION = _shape(follows=FLAG, basis=ArrayType(NUMBER), yes_no_question=FLAG, why=TEXT)
#: Fields that a reply may leave null, and the field whose values are listed for each answer.
OPTIONAL, LISTED = ("as_of", "tax_year", "source"), "citations"


def json_schema(kind: DataType, name: str = "") -> dict:
    """The JSON schema of a Spark type: strict, every field required. The items of LISTED are an enumeration, to be filled in."""
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType, f.name) for f in kind}, "required": kind.names, "additionalProperties": False}
    if isinstance(kind, ArrayType):
        items = json_schema(kind.elementType, "")
        return {"type": "array", "items": items | {"enum": LISTED} if name == LISTED else items}
    plain = "boolean" if isinstance(kind, BooleanType) else "integer" if isinstance(kind, IntegerType) else "string"
    return {"type": [plain, "null"] if name in OPTIONAL else plain}


def schema_of(shape: StructType, allowed: Column | None = None) -> Column:
    """The schema as text; with allowed, an array, nothing else can be cited."""
    text = F.lit(json.dumps(json_schema(shape)))
    return text if allowed is None else F.replace(text, F.lit(f'"enum": "{LISTED}"'), F.concat(F.lit('"enum": '), F.to_json(allowed)))


def _read(reply: Column, shape: StructType) -> Column:
    """A reply in its shape, null if it is no JSON object."""
    whole = F.try_parse_json(reply).isNotNull() & F.trim(reply).startswith("{")
    return F.when(whole, F.from_json(reply, shape, {"mode": "PERMISSIVE"}))


def _lines(order: str, said: Column, between: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), said.alias("said")))), lambda x: x["said"]), between)


def _place(order: str) -> Column:
    return F.row_number().over(Window.partitionBy("answer").orderBy(order)) - 1


def _source(number: str) -> Column:
    text = A.fenced(F.col("source"), F.col("section"), F.col("heading"), F.col("text"))
    return F.concat(F.lit("Source "), number, F.lit(": ["), "citation", F.lit("] ("), "heading", F.lit(")\n"), text)


def plan(questions: DataFrame, provider: str | DataFrame, wait: float = WAIT) -> DataFrame:
    """answer, sq, kind, query, as_of, fallback: the sub-queries of each question."""
    asked = questions.select("answer", "question", F.lit(PLAN).alias("system"), F.concat(F.lit("Question: "), "question").alias("prompt"), schema_of(PLANNED).alias("schema"))
    read = replied(asked, provider, wait=wait).withColumn("p", A.plan(F.col("reply"), F.col("question")))
    return read.select("answer", "p.as_of", "p.fallback", F.posexplode("p.subqueries").alias("sq", "s")).select("answer", "sq", "s.kind", "s.query", "as_of", "fallback")


def write(questions: DataFrame, parts: DataFrame, hits: DataFrame, provider: str | DataFrame, wait: float = WAIT) -> DataFrame:
    """answer, allowed, reply: what a model writes over the sources of each part."""
    own = A.format_sources(hits.withColumn("answer", F.struct("answer", "part"))).select("answer.answer", "answer.part", "sources")
    headed = F.concat(F.lit("## Part "), F.col("part"), F.lit(": "), F.col("label"), F.lit("\n\n"), F.col("sources"))
    blocks = own.join(parts, ["answer", "part"]).groupBy("answer").agg(_lines("part", headed, "\n\n").alias("sources"))
    allowed = hits.groupBy("answer").agg(F.array_sort(F.collect_set("citation")).alias("allowed"))
    year = F.coalesce(F.concat(F.lit("Tax year(s) the question is about: "), F.nullif("tax_year", F.lit("")), F.lit("\n")), F.lit(""))
    prompt = F.concat(F.lit("Sources:\n\n"), "sources", F.lit("\n\n"), year, F.lit("Question: "), "question")
    asked = questions.join(blocks, "answer").join(allowed, "answer")
    return replied(asked.select("answer", "allowed", F.lit(WRITE).alias("system"), prompt.alias("prompt"), schema_of(ANSWER, F.col("allowed")).alias("schema")), provider, wait=wait)


def items(replies: DataFrame) -> DataFrame:
    """answer, idx, part, text, citations: sentences with a text and a citation that the sources have; others are not kept."""
    s = replies.select("answer", "allowed", F.posexplode(_read(F.col("reply"), ANSWER)["sentences"]).alias("idx", "s"))
    return A.shown(s.select("answer", "idx", F.coalesce("s.part", F.lit(1)).alias("part"), "s.text", F.array_intersect("s.citations", "allowed").alias("citations")))


def notes(replies: DataFrame) -> DataFrame:
    """answer, idx, part, why: what the sources lack."""
    n = replies.select("answer", F.posexplode(_read(F.col("reply"), ANSWER)["not_answerable"]).alias("idx", "n"))
    return n.select("answer", "idx", F.coalesce("n.part", F.lit(1)).alias("part"), "n.why")


def verify(written: DataFrame, hits: DataFrame, questions: DataFrame, provider: str | DataFrame, wait: float = WAIT) -> tuple[DataFrame, DataFrame]:
    """answer, idx, supported, why of each item, no verdict being no support; and the answers whose reply can't be read."""
    listed = written.withColumn("n", _place("idx"))
    prem = A.premises(listed, hits)
    number = A.numbered(hits, prem)
    sources = hits.join(number, ["answer", "ord"]).groupBy("answer").agg(_lines("number", _source("number"), "\n\n").alias("sources"))
    cites = prem.select("answer", "idx", F.posexplode("ords").alias("at", "ord")).join(number, ["answer", "ord"])
    cites = cites.groupBy("answer", "idx").agg(_lines("at", F.concat(F.lit("Source "), "number"), ", ").alias("cites"))
    said = F.concat("n", F.lit(". "), "text", F.lit(" (cites: "), F.coalesce("cites", F.lit("")), F.lit(")"))
    claims = listed.join(cites, ["answer", "idx"], "left").groupBy("answer").agg(_lines("n", said).alias("claims"))
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nSources:\n\n"), "sources", F.lit("\n\nClaims:\n"), "claims")
    asked = claims.join(sources, "answer").join(questions, "answer")
    got = replied(asked.select("answer", F.lit(VERIFY).alias("system"), prompt.alias("prompt"), schema_of(VERDICTS).alias("schema")), provider, wait=wait)
    read = got.withColumn("v", _read(F.col("reply"), VERDICTS)["verdicts"])
    given = read.select("answer", F.posexplode("v").alias("at", "v")).groupBy("answer", F.col("v.index").alias("n")).agg(F.max_by("v", "at").alias("v"))
    out = listed.join(given, ["answer", "n"], "left")
    out = out.select("answer", "idx", F.coalesce("v.supported", F.lit(False)).alias("supported"), F.coalesce("v.why", F.lit("no verdict returned")).alias("why"))
    return out, read.where("v is null").select("answer")


def recite(failed: DataFrame, hits: DataFrame, questions: DataFrame, provider: str | DataFrame, wait: float = WAIT) -> tuple[DataFrame, DataFrame]:
    """answer, idx, citation: another source that a model names for a failed item; and the answers whose reply can't be read."""
    listed, all_of = failed.withColumn("n", _place("idx")), hits.withColumn("number", _place("ord") + 1)
    sources = all_of.groupBy("answer").agg(_lines("number", _source("number"), "\n\n").alias("sources"))
    said = F.concat("n", F.lit(". "), "text", F.lit(" (cited: "), F.array_join("citations", ", "), F.lit(")"))
    claims = listed.groupBy("answer").agg(_lines("n", said).alias("claims"))
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nSources:\n\n"), "sources", F.lit("\n\nClaims:\n"), "claims")
    asked = claims.join(sources, "answer").join(questions, "answer")
    got = replied(asked.select("answer", F.lit(RECITE).alias("system"), prompt.alias("prompt"), schema_of(RECITES).alias("schema")), provider, wait=wait)
    read = got.withColumn("r", _read(F.col("reply"), RECITES))
    named = read.select("answer", F.posexplode("r.recites").alias("at", "r")).select("answer", "at", F.col("r.index").alias("n"), F.col("r.source").alias("number"))
    other = listed.join(named, ["answer", "n"]).join(all_of.select("answer", "number", "citation"), ["answer", "number"]).where(~F.array_contains("citations", F.col("citation")))
    return other.groupBy("answer", "idx").agg(F.max_by("citation", "at").alias("citation")), read.where("r is null").select("answer")


def conclude(conclusions: DataFrame, kept: DataFrame, questions: DataFrame, provider: str | DataFrame, wait: float = WAIT) -> tuple[DataFrame, DataFrame]:
    """answer, conclusion, cites, why: the citations of the items that a conclusion rests on, null if it does not follow; and unread replies."""
    listed = kept.withColumn("n", _place("idx"))
    held = listed.groupBy("answer").agg(_lines("n", F.concat("n", F.lit(". "), "text")).alias("statements"), F.transform(F.array_sort(F.collect_list(F.struct("n", "citations"))), lambda x: x["citations"]).alias("held"))
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nVerified statements:\n"), "statements", F.lit("\n\nConclusion: "), "conclusion")
    asked = conclusions.join(held, "answer").join(questions, "answer")
    got = replied(asked.select("answer", "conclusion", "held", F.lit(CONCLUDE).alias("system"), prompt.alias("prompt"), schema_of(CONCLUSION).alias("schema")), provider, wait=wait)
    read = got.withColumn("c", _read(F.col("reply"), CONCLUSION))
    basis = F.filter(F.coalesce("c.basis", F.array().cast("array<int>")), lambda b: (b >= 0) & (b < F.size("held")))
    why = F.concat(F.when(F.coalesce("c.yes_no_question", F.lit(True)), "").otherwise("(not yes/no) "), F.coalesce("c.why", F.lit("")))
    cites = F.when(F.coalesce("c.follows", F.lit(False)) & (F.size(basis) > 0), F.array_distinct(F.flatten(F.transform(basis, lambda b: F.get("held", b)))))
    return read.where("c is not null").select("answer", "conclusion", cites.alias("cites"), why.alias("why")), read.where("c is null").select("answer")


def checked(questions: DataFrame, parts: DataFrame, hits: DataFrame, replies: DataFrame, provider: str | DataFrame, unit: str = "sentence", again: bool = True, wait: float = WAIT) -> DataFrame:
    """answer, text, shown, hidden, concluded of every question.

    Items are verified; failed ones get another source, if a model names one, and are verified again. What names law that only a
    client's document states fails whatever the verifier says, and a conclusion can't rest on clients' documents alone.
    """
    hits = materialise(hits, "sources")
    written, lacks = materialise(items(replies), "items"), notes(replies)
    verdicts, broken = verify(written, hits, questions, provider, wait)
    if again:
        failed = written.join(verdicts.where("not supported").select("answer", "idx"), ["answer", "idx"], "left_semi")
        picks, unread = recite(failed, hits, questions, provider, wait)
        swapped = written.drop("citations").join(picks, ["answer", "idx"]).withColumn("citations", F.array("citation")).select(*written.columns)
        second, worse = verify(swapped, hits, questions, provider, wait)
        good = second.where("supported").select("answer", "idx")
        written = written.join(good, ["answer", "idx"], "left_anti").unionByName(swapped.join(good, ["answer", "idx"], "left_semi"))
        verdicts = verdicts.join(good.withColumn("_again", F.lit(True)), ["answer", "idx"], "left").withColumn("supported", F.col("supported") | F.coalesce("_again", F.lit(False))).drop("_again")
        broken = broken.unionByName(unread).unionByName(worse)

    foreign = laundered(hits).groupBy("answer").agg(F.collect_set("authority").alias("foreign"))
    named = lambda text: F.coalesce(F.exists("foreign", lambda a: F.contains(canonical(text), a)), F.lit(False))
    own = written.join(foreign, "answer", "left").select("answer", "idx", named(F.col("text")).alias("_named"))
    verdicts = verdicts.join(own, ["answer", "idx"]).withColumn("supported", F.col("supported") & ~F.col("_named")).drop("_named")
    written, verdicts = materialise(written, "items"), materialise(verdicts, "verdicts")
    lacks = lacks.join(foreign, "answer", "left").withColumn("why", F.when(named(F.col("why")), LAUNDERED).otherwise(F.col("why"))).drop("foreign")

    seen, left = A.hide(written, verdicts, lacks, parts, unit)
    text = A.render(seen, left, parts, questions.select("answer", "tax_year"))
    text = text.withColumn("text", F.when(F.trim("text") == "", NO_SENTENCE).otherwise(F.col("text")))
    ends = replies.select("answer", F.trim(_read(F.col("reply"), ANSWER)["conclusion"]).alias("conclusion")).where("conclusion <> ''")
    ends = ends.join(text.where(~A.refused(F.col("text"))).select("answer"), "answer", "left_semi")
    kept = written.join(verdicts.where("supported").select("answer", "idx"), ["answer", "idx"], "left_semi")
    ended, unread = conclude(ends, kept, questions, provider, wait)
    clients = hits.where("source = 'client'").groupBy("answer").agg(F.collect_set("citation").alias("clients"))
    ended = ended.join(clients, "answer", "left").join(foreign, "answer", "left")
    by_client = F.coalesce(F.size(F.array_except("cites", "clients")) == 0, F.lit(False))
    ended = ended.where(F.col("cites").isNotNull() & ~by_client & ~named(F.col("conclusion"))).select("answer", A.displayed(F.col("conclusion"), F.col("why")).alias("conclusion"), "cites")

    counts = written.groupBy("answer").agg(F.count("*").alias("_all"))
    numbers = seen.groupBy("answer").agg(F.count("*").alias("_seen"))
    bad = broken.unionByName(unread).distinct().withColumn("_bad", F.lit(True))
    out = questions.select("answer").join(text, "answer", "left").join(ended, "answer", "left").join(bad, "answer", "left").join(counts, "answer", "left").join(numbers, "answer", "left")
    unread, n_all = F.coalesce("_bad", F.lit(False)), F.coalesce("_all", F.lit(0))
    n_seen = F.when(unread, 0).otherwise(F.coalesce("_seen", F.lit(0)))
    whole = F.when(F.col("cites").isNotNull(), A.with_conclusion(F.col("text"), F.col("conclusion"), F.col("cites"))).otherwise(F.coalesce("text", F.lit(NO_SENTENCE)))
    return out.select("answer", F.when(unread, UNVERIFIED).otherwise(whole).alias("text"), n_seen.alias("shown"), (n_all - n_seen).alias("hidden"), (F.col("cites").isNotNull() & ~unread).alias("concluded"))


def stages(questions: DataFrame, plans: DataFrame, hits: DataFrame, replies: DataFrame, answers: DataFrame) -> DataFrame:
    """job_id, event_id, event, data: what a listener hears of each question on its way to an answer, in the order of event_id."""
    searched = plans.groupBy("answer").agg(F.count("*").alias("n"))
    found = hits.groupBy("answer").agg(F.count("*").alias("n"))
    told = items(replies).groupBy("answer").agg(F.count("*").alias("n"))
    numbers = lambda df, name: questions.select("answer").join(df, "answer", "left").select("answer", F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias(name))).alias("data"))
    rows = [
        ("decomposing", questions.select("answer", F.lit("{}").alias("data"))),
        ("retrieving", numbers(searched, "subqueries")),
        ("synthesizing", numbers(found, "chunks")),
        ("verifying", numbers(told, "sentences")),
        ("answer", answers.select("answer", F.to_json(F.struct(A.refused(F.col("text")).alias("refused"), F.col("hidden").alias("hidden_sentences"))).alias("data"))),
    ]
    out = None
    for n, (event, df) in enumerate(rows):
        one = df.select(F.col("answer").alias("job_id"), F.lit(n).alias("event_id"), F.lit(event).alias("event"), "data")
        out = one if out is None else out.unionByName(one)
    return out
