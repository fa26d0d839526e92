"""From the hits of several searches to one list: interleaving, authority, slots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import materialise, ship


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in an order that must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def append_new(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Hits, then extra ones that are not there yet by key, or by citation where the key is empty. Both have ord."""
    both = hits.withColumn("_late", F.lit(0)).unionByName(extra.withColumn("_late", F.lit(1)))
    both = both.withColumn("_same", F.coalesce(F.nullif(F.col("key").cast("string"), F.lit("")), F.col("citation")))
    keys = [c for c in ("question",) if c in hits.columns] + ["_same"]
    return first_by(both, keys, [F.col("_late"), F.col("ord")]).drop("_late", "_same")


def merge(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Round-robin over sub-queries: hits(question, sq, rank, citation, ...) by rank, then sq; each citation once."""
    one = first_by(hits, ["question", "citation"], [F.col("rank"), F.col("sq")])
    out = one.withColumn("ord", F.row_number().over(Window.partitionBy("question").orderBy("rank", "sq")))
    return out.where(F.col("ord") <= k) if k is not None else out


def level(authority: Column, statute_first: bool = False, demote_prior: bool = False) -> Column:
    out = F.coalesce(authority["level"].cast("double"), F.lit(0.0))
    if statute_first:
        out = out + F.when(authority["type"] == "statute", 0.5).otherwise(0.0)
    if demote_prior:
        out = out - F.when(authority["status"] == "final_prior_version", 0.25).otherwise(0.0)
    return out


def weigh_prior(ranked: DataFrame, w: float = 0.5, scoped: bool = True) -> DataFrame:
    """ranked(question, citation, source, lvl, score): reorder by score + w (lvl - 1) and give the sorted scores to the new order."""
    kind = F.when(F.col("source") == "case", "case").otherwise("statutory") if scoped else F.lit("all")
    df = ranked.withColumn("_kind", kind)
    within = Window.partitionBy("question", "_kind")
    new = df.withColumn("_pos", F.row_number().over(within.orderBy(F.desc(F.round(F.col("score") + w * (F.col("lvl") - 1), 9)), "citation")))
    old = df.select("question", "_kind", F.col("score").alias("_given"), F.row_number().over(within.orderBy(F.desc("score"), "citation")).alias("_pos"))
    out = new.join(old, ["question", "_kind", "_pos"]).drop("score").withColumnRenamed("_given", "score")
    order = [F.desc("score"), F.asc("citation")] if scoped else [F.asc("_pos")]
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("question").orderBy(*order))).drop("_kind", "_pos")


def weigh_tie(ranked: DataFrame, delta: float, scoped: bool = True) -> DataFrame:
    """As weigh_prior, but a higher level only passes a lower one whose score is within delta, again and again."""
    ship(ranked.sparkSession)
    names = ranked.columns

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "citation"], ascending=[False, True]).to_dict("records")
        given = [r["score"] for r in rows]
        moved = True
        while moved:
            moved = False
            for i in range(len(rows) - 1):
                a, b = rows[i], rows[i + 1]
                if a["score"] - b["score"] < delta and b["lvl"] > a["lvl"]:
                    rows[i], rows[i + 1], moved = b, a, True
        return pd.DataFrame(rows, columns=names).assign(score=given)

    kind = F.when(F.col("source") == "case", "case").otherwise("statutory") if scoped else F.lit("all")
    out = ranked.groupBy("question", kind.alias("_kind")).applyInPandas(lambda pdf: settle(pdf[names]), ranked.schema)
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "citation")))


def slots(ranked: DataFrame, hits: DataFrame, k: int, floor: int = 1, statute_floor: int = 0, pinned: DataFrame | None = None, slot: Column | None = None) -> DataFrame:
    """The k rows that are shown. ranked(question, citation, source, score, ord); hits(question, sq, citation).

    First each sub-query's best floor rows, then statute_floor statute rows, then pinned citations, then the rest while
    there are fewer than k; at last all are sorted by score, stable in that order, and cut to k.
    """
    ranked, hits = materialise(ranked, "ranked"), hits.select("question", "sq", "citation")  # each part reads the ranking anew
    tag = lambda df, cls, sq: df.select("question", "citation", "score", "ord", F.lit(cls).alias("cls"), sq.alias("sq"))
    of = ranked.join(hits.select("question", "sq", "citation").distinct(), ["question", "citation"])
    of = of.withColumn("_n", F.row_number().over(Window.partitionBy("question", "sq").orderBy("ord"))).where(F.col("_n") <= floor)
    parts = [tag(of, 0, F.col("sq"))]
    if statute_floor:
        own = ranked.where(slot if slot is not None else F.col("source") == "usc")
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy("ord"))).where(F.col("_n") <= statute_floor)
        parts.append(tag(own, 1, F.lit(0)))
    if pinned is not None:
        parts.append(tag(ranked.join(pinned.select("question", "citation").distinct(), ["question", "citation"], "left_semi"), 2, F.lit(0)))
    parts.append(tag(ranked, 3, F.lit(0)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    chosen = first_by(every, ["question", "citation"], [F.col("cls"), F.col("sq"), F.col("ord")])
    chosen = chosen.withColumn("seat", F.row_number().over(Window.partitionBy("question").orderBy("cls", "sq", "ord")))
    chosen = chosen.where((F.col("cls") < 3) | (F.col("seat") <= k))
    out = chosen.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "seat")))
    return out.where(F.col("place") <= k).select("question", "citation", "score", "place")


def batched(it: Iterator[pd.DataFrame], size: int = 16) -> Iterator[pd.DataFrame]:
    """Batches of a fixed size, for providers that take so many rows at once."""
    for pdf in it:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]
