"""Publications, opinions and question sets: pages and boxes as tables, chunks out of them.

Layout extraction from PDF stays outside: these functions take pages(doc, page, text) or boxes(doc, page, y0, y1, size,
text) as a table, whichever tool made it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import windows as W

#: Print-shop marks that share lines with text, and where a first page says its year and title.
ARTIFACTS = (
    r"(?is)Fileid:.*?source|Userid:\s*\w+|Schema:\s*\w+|Leadpct:\s*[\d.]+%|Pt\. size:\s*\d+|Draft\s+Ok to Print|AH\s+XSL/XML|Init\.\s*&\s*Date|Page \d+ of \d+"
    r"|The type and rule above.{0,90}?printing\.|MUST be removed before printing\.|\d{1,2}:\d{2}\s*-\s*\d{1,2}-[A-Za-z]{3}-\d{4}"
)
YEAR = r"For use in preparing\s+(\d{4})\s+Returns"
TITLE_AFTER = r"Publication\s+\d+[A-Z]?\s+(?!For use in|Get forms)(.{3,80}?)(?=\s+For use in|\s+Get forms|\s+•)"
TITLE_BEFORE = r"([A-Z][^•]{5,80}?)\s+Publication\s+\d+[A-Z]?\s+(?:For use in|Get forms)"
TARGET_TOKENS, OVERLAP, LEAST_WORDS = 300, 0.15, 20
OPINION_TOKENS, OPINION_WORDS = 400, 200


def pdf_only(files: DataFrame) -> DataFrame:
    """binaryFile rows whose content is a PDF; a discontinued one comes as a web page."""
    return files.where(F.substring("content", 1, 5) == F.lit(bytearray(b"%PDF-")))


def latest_snapshot(spark: SparkSession, path: str, title: int = 26) -> DataFrame:
    """up_to_date_as_of of one title in a saved list of titles."""
    titles = spark.read.schema("titles array<struct<number:int,up_to_date_as_of:string>>").json(path, multiLine=True)
    return titles.select(F.explode("titles").alias("t")).where(F.col("t.number") == title).select("t.up_to_date_as_of")


def snapshots(spark: SparkSession, path: str, title: int = 26) -> DataFrame:
    """list, up_to_date_as_of of one title in many saved lists, a line each; lists without the title are not there."""
    lists = spark.read.schema("list long, titles array<struct<number:int,up_to_date_as_of:string>>").json(path)
    return lists.select("list", F.explode("titles").alias("t")).where(F.col("t.number") == title).select("list", "t.up_to_date_as_of")


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved selections of opinions: one JSON array in a file, or one in each line."""
    shape = "citation string, caseCaption string, filingDate string, documentTitle string, docketNumber string, docketEntryId string, topics array<string>"
    if not lines:
        return spark.read.schema(shape).json(path, multiLine=True).where("citation is not null")
    arrays = spark.read.text(path).select(F.explode(F.from_json("value", f"array<struct<{shape.replace(' ', ':').replace(',:', ',')}>>")).alias("o"))
    return arrays.select("o.*").where("citation is not null")


def questions(spark: SparkSession, path: str, phases: list[str]) -> DataFrame:
    """A question set: rows that are scorable, or scored from one of the phases; gold as groups of interchangeable citations."""
    raw = spark.read.schema("id string, category string, style string, question string, scorable boolean, scored_from string, gold string").json(path)
    kept = raw.where(F.coalesce("scorable", F.col("scored_from").isin(phases), F.lit(False)))
    groups = F.transform(F.from_json("gold", "array<string>"), lambda g: F.when(g.startswith("["), F.from_json(g, "array<string>")).otherwise(F.array(g)))
    return kept.withColumn("gold", F.coalesce(groups, F.array().cast("array<array<string>>")))


def missing_plans(asked: DataFrame, plans: DataFrame, sets: int) -> DataFrame:
    """(question, plan_set) that the table of plans lacks."""
    wanted = asked.select("question", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("plan_set"))
    return wanted.join(plans.select("question", "plan_set"), ["question", "plan_set"], "left_anti")


def title(first: Column, number: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.regexp_replace(first, ARTIFACTS, " "), r"\s+", " "))
    found = F.coalesce(F.nullif(F.regexp_extract(flat, TITLE_AFTER, 1), F.lit("")), F.nullif(F.regexp_extract(flat, TITLE_BEFORE, 1), F.lit("")))
    return F.concat_ws(" ", F.lit("Publication"), number, F.trim(found))


def edition_year(first: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(first, r"\s+", " "), YEAR, 1), F.lit(""))


def publication_chunks(pages: DataFrame) -> DataFrame:
    """Page-cited windows of pages(doc, page, text); a page with too few words is kept as a failed extraction."""
    lines = pages.select(F.col("doc").alias("pub"), "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kept = W.boilerplate(lines).groupBy(F.col("pub").alias("doc"), "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    df = pages.select("doc", "page").join(kept, ["doc", "page"], "left").withColumn("text", T.dehyphenate(F.regexp_replace(F.coalesce("text", F.lit("")), ARTIFACTS, " ")))
    first = df.groupBy("doc").agg(F.min_by("text", "page").alias("first"))
    df = df.join(first, "doc").withColumn("year", edition_year(F.col("first"))).withColumn("heading", title(F.col("first"), F.col("doc")))
    label = F.concat(F.lit("IRS Pub "), "doc", F.coalesce(F.concat(F.lit(" ("), "year", F.lit(")")), F.lit("")))
    df = df.withColumn("citation", F.concat(label, F.lit(", p. "), "page")).withColumn("w", T.words(F.col("text")))
    short = F.size("w") < LEAST_WORDS
    failed = F.array(F.array(F.concat(F.lit("[page "), "page", F.lit(": extraction produced "), F.size("w"), F.lit(" words]"))))
    cut = df.select("doc", "page", "citation", "heading", "year", short.alias("short"), F.posexplode(F.when(short, failed).otherwise(W.word_windows(F.col("w"), int(TARGET_TOKENS / 1.3), OVERLAP))).alias("seq", "win"))
    text = F.array_join("win", " ")
    out = cut.select("doc", "page", "citation", "heading", F.when(F.col("short"), "extraction_failed").alias("excluded"), "seq", text.alias("text"), F.when(F.col("short"), 0).otherwise(T.tokens_of_words(F.size("win"))).alias("tokens"), F.coalesce("year", F.lit("1900")).alias("edition"))
    return W.renumber(out).drop("seq")


def body_size(boxes: DataFrame) -> DataFrame:
    """doc, body: the type size that most characters of an opinion have."""
    return boxes.groupBy("doc", F.round("size").alias("size")).agg(F.sum(F.length("text")).alias("n")).groupBy("doc").agg(F.max_by("size", F.struct("n", "size")).alias("body"))


def paragraphs(boxes: DataFrame) -> DataFrame:
    """doc, page, seq, text: body boxes from top to bottom, then the page's footnotes in one; larger type is left out."""
    df = boxes.withColumn("size", F.round("size")).join(body_size(boxes), "doc")
    df = df.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''").where(~F.col("text").rlike(r"^(?:-?\s*\d+\s*-?|\[\*\d+\])$") & ~F.col("text").rlike(r"(?i)^served\b"))
    bottom = F.min(F.when(F.col("size") == F.col("body"), F.col("y0"))).over(Window.partitionBy("doc", "page"))
    df = df.withColumn("bottom", F.coalesce(bottom, F.lit(0.0)))
    main = df.where("size = body").select("doc", "page", F.lit(0).alias("late"), F.negative("y1").alias("at"), "text")
    notes = df.where("size < body and y1 <= bottom").groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.negative("y1").alias("y"), "text"))), lambda x: x["text"]), " ").alias("text"))
    every = main.unionByName(notes.select("doc", "page", F.lit(1).alias("late"), F.lit(0.0).alias("at"), "text"))
    seq = F.row_number().over(Window.partitionBy("doc").orderBy("page", "late", "at", "text"))
    return every.select("doc", "page", seq.alias("seq"), T.dehyphenate(F.regexp_replace("text", r"\[\*\d+\]\s*", "")).alias("text"))


def opinion_chunks(paras: DataFrame, opinions: DataFrame) -> DataFrame:
    """Chunks of opinions(doc, citation, caption) from paragraphs: packed to 400 tokens, each opening with the last paragraph of the one before."""
    folded = W.fold_numbers(paras, "doc", "seq", F.col("text").rlike(r"^[\s\d.,$%()*–-]+$")).select("doc", F.col("piece").alias("n"), "page", "text")
    packs = W.packed(folded, "doc", "n", OPINION_TOKENS, lambda n: round(n * 1.3), overlap=1)
    held = packs.join(folded, "doc").where("n between first and last")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    cut = held.groupBy("doc", "pack").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), text.alias("text"))
    words = folded.groupBy("doc").agg(F.sum(T.word_count(F.col("text"))).alias("words"))
    df = opinions.join(words, "doc", "left").withColumn("short", F.coalesce("words", F.lit(0)) < OPINION_WORDS)
    good = df.where("not short").join(cut, "doc").select("citation", "caption", F.concat("citation", F.lit(", "), T.pages_label(F.col("lo"), F.col("hi"))).alias("label"), F.col("pack").alias("seq"), "text", F.lit(None).cast("string").alias("excluded"))
    none = df.where("short").select("citation", "caption", F.col("citation").alias("label"), F.lit(1).alias("seq"), F.lit("").alias("text"), F.lit("no_text").alias("excluded"))
    out = good.unionByName(none).select(F.col("label").alias("citation"), F.col("citation").alias("section"), F.concat(F.regexp_replace("caption", r",? Petitioners?$", ""), F.lit(" v. Commissioner")).alias("heading"), "seq", "text", "excluded")
    return W.renumber(out).withColumn("tokens", T.estimate_tokens(F.col("text")))


def captions(pages: DataFrame) -> DataFrame:
    """opinion, caption, filed: of pages(opinion, citation, text) the first that holds the opinion's own citation, and the first with a filing date."""
    order = T.first_page(F.col("citation"))
    own = F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("opinion")))
    dated = F.regexp_extract("text", r"\bFiled ([A-Z][a-z]{2,8}\.? \d{1,2}, \d{4})", 1)
    return pages.groupBy("opinion").agg(
        F.min_by(F.when(own, F.col("text")), F.when(own, order)).alias("caption"),
        F.min_by(F.nullif(dated, F.lit("")), F.when(dated != "", order)).alias("filed"),
    )
