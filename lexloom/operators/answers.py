"""Answers as tables: citation classes, premises, rendering, hiding what a verifier failed.

sentences(answer, idx, part, text, citations), missing(answer, idx, part, why), parts(answer, part, label): one row for
each sentence, note and part. Hits are hits(answer, ord, citation, section, source, text, heading).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import OPINION, PART, bracketed, section_of

UNVERIFIED = "no statement in this part could be verified against its sources."


def classify(cited: DataFrame, hits: DataFrame) -> DataFrame:
    """cited(answer, citation) with kind: exact, derived (another paragraph of a section that was retrieved) or unsupported."""
    exact = hits.select("answer", "citation").distinct().withColumn("_e", F.lit(True))
    near = hits.select("answer", "section").distinct().withColumn("_d", F.lit(True))
    df = cited.withColumn("section", section_of(F.col("citation"))).join(exact, ["answer", "citation"], "left").join(near, ["answer", "section"], "left")
    return df.withColumn("kind", F.when(F.col("_e"), "exact").when(F.col("_d"), "derived").otherwise("unsupported")).drop("_e", "_d", "section")


def sources_of(cited: DataFrame, hits: DataFrame) -> DataFrame:
    """cited(answer, citation) with the hit's ord: the exact one, else the first of its section, else null."""
    exact = hits.groupBy("answer", "citation").agg(F.max("ord").alias("_exact"))
    first = hits.withColumn("_s", section_of(F.col("citation"))).groupBy("answer", "_s").agg(F.min("ord").alias("_first"))
    df = cited.withColumn("_s", section_of(F.col("citation"))).join(exact, ["answer", "citation"], "left").join(first, ["answer", "_s"], "left")
    return df.withColumn("ord", F.coalesce("_exact", "_first")).drop("_s", "_exact", "_first")


def premises(sentences: DataFrame, hits: DataFrame) -> DataFrame:
    """answer, idx, ords: the hits that a sentence cites, then every other page of an opinion that it cites."""
    cites = sentences.select("answer", "idx", F.explode("citations").alias("citation")).distinct()
    own = cites.join(hits.select("answer", "citation", "ord"), ["answer", "citation"]).select("answer", "idx", "ord", "citation")
    is_opinion = F.col("citation").rlike(OPINION)
    pages = hits.where(is_opinion).select("answer", section_of(F.col("citation")).alias("_s"), F.col("ord").alias("page"))
    more = own.where(is_opinion).withColumn("_s", section_of(F.col("citation"))).join(pages, ["answer", "_s"]).select("answer", "idx", F.col("page").alias("ord"))
    both = own.select("answer", "idx", "ord", F.lit(0).alias("late")).unionByName(more.withColumn("late", F.lit(1)))
    one = both.groupBy("answer", "idx", "ord").agg(F.min("late").alias("late"))
    ords = F.transform(F.array_sort(F.collect_list(F.struct("late", "ord"))), lambda x: x["ord"])
    return one.groupBy("answer", "idx").agg(ords.alias("ords"))


def shown(sentences: DataFrame) -> DataFrame:
    """Sentences with a text and a citation, citations once each in order."""
    df = sentences.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).withColumn("citations", F.array_distinct(F.filter(F.coalesce("citations", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))))
    return df.where((F.col("text") != "") & (F.size("citations") > 0))


def _placed(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with a part that the answer does not have are put under part 1."""
    known = parts.select("answer", "part", F.lit(True).alias("_k"))
    return df.join(known, ["answer", "part"], "left").withColumn("part", F.when(F.col("_k"), F.col("part")).otherwise(1)).drop("_k")


def render(sentences: DataFrame, missing: DataFrame, parts: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """answer, text: each part's sentences with their citations, then its notes; a part without sentences lacks evidence."""
    body = F.regexp_replace("text", r"[.\s]+$", "")
    said = _placed(shown(sentences), parts).select("answer", "part", F.lit(0).alias("late"), "idx", F.concat(body, F.lit(" "), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", "), F.lit(".")).alias("line"))
    answered = said.select("answer", "part").distinct().withColumn("_a", F.lit(True))
    why = F.trim(F.coalesce("why", F.lit("")))
    notes = _placed(missing, parts).join(answered, ["answer", "part"], "left")
    notes = notes.select("answer", "part", F.lit(1).alias("late"), "idx", F.concat(F.when(F.col("_a"), "Not in the sources: ").otherwise("INSUFFICIENT EVIDENCE: "), why).alias("line"))
    lines = said.unionByName(notes).groupBy("answer", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("late", "idx", "line"))), lambda x: x["line"]), " ").alias("block"))
    several = parts.groupBy("answer").agg((F.count("*") > 1).alias("several"))
    headed = lines.join(parts, ["answer", "part"]).join(several, "answer").withColumn("block", F.concat(F.when(F.col("several"), F.concat(F.lit("Part "), "part", F.lit(": "), "label", F.lit("\n"))).otherwise(""), "block"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block"))), lambda x: x["block"]), "\n\n")
    out = headed.groupBy("answer").agg(text.alias("text"))
    out = parts.select("answer").distinct().join(out, "answer", "left").withColumn("text", F.coalesce("text", F.lit("")))
    if years is None:
        return out
    year = F.when(F.col("tax_year").isNotNull() & (F.col("tax_year") != ""), F.concat(F.lit("Tax year: "), "tax_year", F.lit("\n\n"))).otherwise("")
    return out.join(years, "answer", "left").select("answer", F.concat(F.coalesce(year, F.lit("")), "text").alias("text"))


def dropped(sentences: DataFrame) -> DataFrame:
    """answer, n: sentences with a text that cite nothing."""
    has_text = F.trim(F.coalesce("text", F.lit(""))) != ""
    cites = F.size(F.filter(F.coalesce("citations", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))) > 0
    return sentences.groupBy("answer").agg(F.count_if(has_text & ~cites).alias("n"))


def hide(sentences: DataFrame, verdicts: DataFrame, missing: DataFrame, parts: DataFrame, unit: str = "sentence") -> tuple[DataFrame, DataFrame]:
    """Sentences that stay and notes after verdicts(answer, idx, supported): no verdict counts as unsupported.

    With unit part, all of a failed sentence's part goes. A part that this empties gets a note in place of its own.
    """
    if unit not in ("part", "sentence"):
        raise ValueError(f"unit must be part or sentence, not {unit!r}")
    items = _placed(shown(sentences), parts).join(verdicts.select("answer", "idx", "supported"), ["answer", "idx"], "left")
    failed = ~F.coalesce("supported", F.lit(False))
    gone = failed if unit == "sentence" else F.bool_or(failed).over(Window.partitionBy("answer", "part"))
    items = items.withColumn("gone", gone)
    kept = items.where(~F.col("gone")).select(*sentences.columns)
    empty = items.groupBy("answer", "part").agg(F.bool_and("gone").alias("e")).where("e").select("answer", "part")
    notes = missing.join(empty, ["answer", "part"], "left_anti").select("answer", "idx", "part", "why")
    return kept, notes.unionByName(empty.select("answer", (F.lit(1_000_000) + F.col("part")).cast(dict(missing.dtypes)["idx"]).alias("idx"), "part", F.lit(UNVERIFIED).alias("why")))


def refused(text: Column) -> Column:
    """Says that evidence is missing and cites nothing."""
    return F.contains(F.upper(text), F.lit("INSUFFICIENT EVIDENCE")) & (F.size(bracketed(text)) == 0)


def abstention(text: Column, expected: Column) -> Column:
    """right, wrong or missed: refusals where none, or one, was expected."""
    return F.when(refused(text) & expected, "right refusal").when(refused(text), "wrong refusal").when(expected, "missed refusal").otherwise("answered")


def split_parts(text: Column) -> Column:
    """array(struct(label, text)) of an answer's sections under Part headings; what stands before the first has no label."""
    headed = lambda s: s.rlike(rf"(?m)\A{PART}")
    label = lambda s: F.concat(F.lit("Part "), F.regexp_extract(s, rf"(?m)\A{PART}", 1), F.lit(": "), F.regexp_extract(s, rf"(?m)\A{PART}", 2))
    parts = F.transform(
        F.split(text, rf"(?m)(?={PART})"),
        lambda s: F.struct(
            F.when(headed(s), F.regexp_replace(label(s), "[: ]+$", "")).otherwise("").alias("label"),
            F.regexp_replace(F.when(headed(s), F.regexp_replace(s, r"\A[^\n]*", "")).otherwise(s), r"^\s+|\s+$", "").alias("text"),
        ),
    )
    return F.filter(parts, lambda p: (p["label"] != "") | (p["text"] != "") | (F.size(parts) == 1))


def displayed(conclusion: Column, why: Column) -> Column:
    """A leading yes or no goes when the question does not ask for one."""
    rest = F.regexp_replace(F.trim(conclusion), r"(?i)^(yes|no)\b[,:;.]?\s*", "")
    drop = why.startswith("(not yes/no) ") & F.trim(conclusion).rlike(r"(?i)^(yes|no)\b") & (rest != "")
    return F.when(drop, F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1_000_000))).otherwise(F.trim(conclusion))


def with_conclusion(text: Column, conclusion: Column, cites: Column) -> Column:
    """The conclusion as the first line, after the line of the tax year."""
    line = F.concat(F.lit("Short answer: "), F.regexp_replace(F.trim(conclusion), r"\.+$", ""), F.lit(" "), F.array_join(F.transform(cites, lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", "), F.lit("."))
    at = F.instr(text, "\n\n")
    year = F.when(text.startswith("Tax year:") & (at > 0), F.substring(text, F.lit(1), at + 1)).otherwise("")
    return F.concat(year, line, F.lit("\n\n"), F.substring(text, F.length(year) + 1, F.length(text)))


def fenced(source: Column, section: Column, heading: Column, text: Column) -> Column:
    """A source as prompts show it: a client's text stands in a block whose tags it cannot close."""
    safe = lambda c: F.regexp_replace(c, r"(?i)</?\s*client_document", "[tag removed]")
    block = F.concat(F.lit('<client_document id="'), section, F.lit('" name="'), F.replace(safe(heading), F.lit('"'), F.lit("'")), F.lit('">\n'), safe(text), F.lit("\n</client_document>"))
    return F.when(source == "client", block).otherwise(text)


def effective_note(effective: Column, year: Column) -> Column:
    """What is said of a text that took effect later than a question's year, or retroactively; effective as in the chunk's struct."""
    starts = F.nullif(F.regexp_extract(F.coalesce(effective["date"], F.lit("")), r"\d{4}", 0), F.lit("")).cast("int")
    says = F.coalesce(effective["retroactive"], F.lit(False)) | F.coalesce(starts >= year, F.lit(False))
    note = F.concat(F.lit("\nEffective: the current text was enacted in "), effective["year"].cast("string"), F.lit(" and "), effective["rule"], F.lit(". Amendment: "), F.substring(effective["amendment"], 1, 400))
    return F.when(effective.isNotNull() & year.isNotNull() & says, note).otherwise("")


def format_sources(hits: DataFrame) -> DataFrame:
    """answer, sources: hits(answer, ord, citation, heading, source, section, text, authority, effective, year) as prompts list them."""
    from lexloom.functions.text import authority_label

    label = F.when(F.col("authority").isNotNull(), F.concat(F.lit("\nAuthority: "), authority_label(F.col("authority.type"), F.col("authority.status")))).otherwise("")
    shown = F.concat(F.lit("["), "citation", F.lit("] ("), "heading", F.lit(")"), label, effective_note(F.col("effective"), F.col("year")), F.lit("\n"), fenced(F.col("source"), F.col("section"), F.col("heading"), F.col("text")))
    return hits.groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("said")))), lambda x: x["said"]), "\n\n").alias("sources"))


def uncited(cut: DataFrame) -> DataFrame:
    """Sentences of cut(answer, n, sentence) that cite nothing."""
    return cut.where(F.size(bracketed(F.col("sentence"))) == 0)


def numbered(hits: DataFrame, used: DataFrame) -> DataFrame:
    """answer, ord, number: sources that any claim uses, numbered in order; used(answer, ords)."""
    one = used.select("answer", F.explode("ords").alias("ord")).distinct()
    return hits.select("answer", "ord").join(one, ["answer", "ord"], "left_semi").withColumn("number", F.dense_rank().over(Window.partitionBy("answer").orderBy("ord")))


def completeness(claims: DataFrame) -> DataFrame:
    """Shares of material sentences that cite, and of answers with every sentence cited and supported; claims(answer, cited, supported)."""
    per = claims.groupBy("answer").agg(F.count("*").alias("n"), F.count_if("cited").alias("c"), F.bool_and(F.col("cited") & F.coalesce("supported", F.lit(False))).alias("whole"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 9)
    return per.agg(F.sum("n").alias("sentences"), F.sum("c").alias("cited"), share(F.sum("c"), F.sum("n")).alias("completeness"), share(F.count_if("whole"), F.count("*")).alias("verified"))


def plan(reply: Column, question: Column) -> Column:
    """struct(subqueries, as_of, fallback) from a planner's JSON, field by field; anything unusable searches the question."""
    from lexloom.functions.text import ROUTES

    kinds = [*ROUTES, "client_fact"]
    data = F.from_json(reply, "struct<as_of:string, subqueries:array<struct<kind:string,query:string>>>", {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(reply)
    listed = F.try_variant_get(whole, "$.subqueries", "array<variant>")
    there = F.try_variant_get(whole, "$.subqueries", "variant").isNotNull()
    good = F.slice(
        F.filter(
            F.transform(F.coalesce(data["subqueries"], F.array().cast("array<struct<kind:string,query:string>>")), lambda s: F.struct(s["kind"].alias("kind"), F.trim(s["query"]).alias("query"))),
            lambda s: s["kind"].isin(kinds) & (F.coalesce(s["query"], F.lit("")) != ""),
        ),
        1,
        4,
    )
    only = F.array(F.struct(F.lit("unrouted").alias("kind"), question.alias("query")))
    reason = F.when(whole.isNull() | ~there, "unparseable").when(listed.isNull(), "subqueries is not a list").when(~F.exists(good, lambda s: s["kind"] != "client_fact"), "no searchable sub-query").otherwise("")
    as_of = F.when(reason.isin("unparseable", "subqueries is not a list"), F.lit(None).cast("string")).otherwise(F.nullif(data["as_of"], F.lit("")))
    return F.struct(F.when(reason == "", good).otherwise(only).alias("subqueries"), as_of.alias("as_of"), reason.alias("fallback"))
