"""From raw documents to a mixed, encodable corpus: each stage works on what the one before it kept.

1. quality: documents that the classifier rejects go.
2. exact: of documents with equal texts one stays.
3. near: of near-duplicates (five-word shingles, similarity 0.8) the one with the least doc_id stays.
4. mix: sources get temperature weights; a document appears as often as its source is passed over. The budget is the least
   at which no document is lost, and no source is repeated more than REPEATS times.
5. pieces: every text is encoded and decoded; rows get their tokens, digests and span bytes, and the pieces with their spans.

Stages decide row by row. A row goes by its doc_id where no other row has it; rows without an id of their own go by a number
made of id and text that stands beyond all ids, so they come last in ties and no label is theirs. Of rows with the same id and
equal texts one stays in the exact stage; rows with the same id and different texts are documents of their own throughout.

The last stage adds columns, the others return the columns of documents; columns of the documents that have the names of the
last stage's own give way to these. Null and empty texts count as empty: all but one of them are copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import exact_dedup, mixing, near_dedup, quality, sentence_pieces
from lexloom.llm.queries import tokenizer
from lexloom.session import new_path

#: Most passes over a source relative to the largest.
REPEATS = 1.5


#: The characters that do not count when texts are compared, and numbers that no doc_id reaches.
SPACE, BEYOND = " \t\n\v\f\r", 1 << 62


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have in any case."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def _digest() -> Column:
    return F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACE, ""), 256)


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row that only equal texts under one id share, and the name of its column."""
    name, many = _fresh(docs, "row"), _fresh(docs, "many")
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "repeated")
    docs.groupBy("doc_id").agg(F.count("*").alias(many)).where(F.col(many) > 1).select("doc_id", F.lit(True).alias(many)).write.parquet(path)
    repeated = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {many} boolean").parquet(path)
    made = F.lit(BEYOND) + F.xxhash64("doc_id", _digest()).bitwiseAND(F.lit(BEYOND - 1))
    if repeated.isEmpty():
        return docs.withColumn(name, F.coalesce("doc_id", made)), name
    docs = docs.join(repeated, "doc_id", "left")
    return docs.withColumn(name, F.when(F.col("doc_id").isNull() | F.col(many), made).otherwise(F.col("doc_id"))), name


def _as_documents(named: DataFrame, name: str) -> DataFrame:
    return named.select(F.col(name).alias("doc_id"), "text", "source")


def _without(named: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """Rows whose number is not a doc_id of dropped."""
    return named.join(dropped.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, name = _named(docs)
    scores = quality.quality_scores(_as_documents(named, name), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(named, name, scores.where("predicted = 0")).select(*docs.columns)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, name = _named(docs)
    kept = _without(named, name, exact_dedup.exact_dedup(_as_documents(named, name)).where(~F.col("kept")))
    turn = _fresh(named, "turn")
    order = Window.partitionBy(name).orderBy(F.desc(F.length("text")), F.asc_nulls_last("text"))
    return kept.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(*docs.columns)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, name = _named(docs)
    found = near_dedup.near_dedup(_as_documents(named, name), shingle_words=5, percent=80)
    return _without(named, name, found.where(~F.col("kept"))).select(*docs.columns)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, name = _named(docs)
    times, copy = _fresh(named, "times"), _fresh(named, "copy")
    copies = mixing.mix(_as_documents(named, name), repeats=REPEATS, budget=None).where("n_copies <> 1")
    copies = copies.groupBy(F.col("doc_id").alias(name)).agg(F.max("n_copies").alias(times))
    held = named.join(copies, name, "left").where(F.coalesce(times, F.lit(1)) > 0)
    return held.withColumn(copy, F.explode(F.sequence(F.lit(1), F.coalesce(times, F.lit(1)).cast("int")))).select(*docs.columns)


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.with_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", stage_quality),
    ("exact", stage_exact),
    ("near", stage_near),
    ("mix", stage_mix),
    ("pieces", stage_pieces),
]

#: The classifier and the piece encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
