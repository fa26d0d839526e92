"""Sequence operators: numbering, units, folding, windows, packing, boilerplate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import normalised_line, word_count, words
from lexloom.session import ship

#: Lines at each end of a page that can be boilerplate, and the share of pages on which such a line stands.
EDGE_LINES, SHARE = 3, 0.5


def renumber(chunks: DataFrame) -> DataFrame:
    """part: a running count for each citation and reason of exclusion, in the order of seq."""
    return chunks.withColumn("part", F.row_number().over(Window.partitionBy("citation", "excluded").orderBy("seq")))


def unit_ids(blocks: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """unit: a new one wherever starts holds; the first row always opens one."""
    w = Window.partitionBy(group).orderBy(order)
    opened = F.when(starts | (F.row_number().over(w) == 1), 1).otherwise(0)
    return blocks.withColumn("_o", opened).withColumn("unit", F.sum("_o").over(w)).drop("_o")


def fold_numbers(paras: DataFrame, group: str, order: str, numeric: Column) -> DataFrame:
    """Pieces of numbers alone go before the next paragraph; trailing ones stand together at the end.

    Result: group, piece, page (of the paragraph, or of the last trailing piece), text.
    """
    w = Window.partitionBy(group).orderBy(order)
    df = paras.withColumn("_text", F.when(numeric, 0).otherwise(1))
    df = df.withColumn("piece", F.sum("_text").over(w) - F.col("_text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    return df.groupBy(group, "piece").agg(joined.alias("text"), F.max_by("page", F.col(order)).alias("page"))


def word_windows(held: Column, size: int, overlap: float) -> Column:
    """Windows of size words with a share of overlap; one if there are no more; tails that are overlap alone go."""
    step = max(1, int(size * (1 - overlap)))
    n = F.size(held)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    cut = F.filter(F.transform(starts, lambda i: F.slice(held, i + 1, size)), lambda x: F.size(x) > size * overlap)
    return F.when(n <= size, F.array(held)).otherwise(cut)


def sliding_windows(held: Column, size: int = 200, stride: int = 100) -> Column:
    """Windows that cover the tail: starts at 0, stride, ... below the last words' start plus stride. One if empty."""
    n = F.size(held)
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)) + stride - 1, F.lit(stride))
    return F.transform(starts, lambda i: F.array_join(F.slice(held, i + 1, size), " "))


def boilerplate(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """Lines of lines(pub, page, line_no, line) without those at a page's edges that share of the pub's pages have there."""
    page = Window.partitionBy("pub", "page")
    df = lines.where(F.trim("line") != "").withColumn("n", F.count("*").over(page)).withColumn("i", F.row_number().over(page.orderBy("line_no")))
    edge = F.when(F.col("n") > 2 * EDGE_LINES, EDGE_LINES).otherwise(1)
    df = df.withColumn("at_edge", (F.col("i") <= edge) | (F.col("i") > F.col("n") - edge)).withColumn("norm", normalised_line(F.col("line")))
    pages = lines.select("pub", "page").distinct().groupBy("pub").agg(F.count("*").alias("pages"))
    # a page of one line has it at both edges, and counts twice
    seen = df.where("at_edge").groupBy("pub", "norm").agg(F.sum(F.when(F.col("n") == 1, 2).otherwise(1)).alias("times"))
    boiler = seen.join(pages, "pub").where(F.col("times") >= F.col("pages") * share).select("pub", "norm", F.lit(True).alias("boiler"))
    out = df.join(boiler, ["pub", "norm"], "left")
    return out.where(F.coalesce("boiler", F.lit(False)) & F.col("at_edge") == F.lit(False)).select("pub", "page", "line_no", "line")


def packed(blocks: DataFrame, group: str, order: str, limit: int, tokens: Callable[[int], int], overlap: int = 0) -> DataFrame:
    """Greedy packing: consecutive blocks while their tokens stay within limit; overlap blocks open the next pack again.

    Result: group, pack, first, last (order values). tokens turns a count of words into tokens.
    """
    ship(blocks.sparkSession)
    sized = blocks.select(group, order, word_count(F.col("text")).alias("_words"))

    kinds = dict(sized.dtypes)
    lists = sized.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_words").alias("n")))).alias("_l"))
    lists = lists.select(group, F.col("_l.at").alias("_at"), F.col("_l.n").alias("_n"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for name, at, n in zip(pdf[group], pdf["_at"], pdf["_n"], strict=True):
                at, n, start, number = list(at), [int(x) for x in n], 0, 0
                while start < len(n):
                    end, total = start + 1, n[start]
                    while end < len(n) and tokens(total + n[end]) <= limit:
                        total, end = total + n[end], end + 1
                    number += 1
                    out.append((name, number, at[start], at[end - 1], total))
                    if end == len(n):
                        break
                    start = end - overlap if end - start > overlap else end
            yield pd.DataFrame(out, columns=[group, "pack", "first", "last", "n_words"])

    return lists.mapInPandas(run, f"{group} {kinds[group]}, pack int, first {kinds[order]}, last {kinds[order]}, n_words long")


def newest(df: DataFrame, group: str, item: str, day: str, n: int) -> DataFrame:
    """The n newest distinct items of each group; an item's groups accumulate."""
    one = df.groupBy(group, item).agg(F.max(day).alias(day))
    top = one.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(day), item))).where(F.col("_n") <= n)
    return top.groupBy(item).agg(F.max(day).alias(day), F.array_sort(F.collect_set(group)).alias("groups"))


def one_per_group(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """One row of each group, chosen by a seeded digest."""
    turn = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(turn, key))).where("_n = 1").drop("_n")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str, prior: DataFrame | None = None) -> DataFrame:
    """At most n rows of each stratum in the order of a seeded digest, without rows of an earlier sample."""
    if prior is not None:
        df = df.join(prior.select(key), key, "left_anti")
    turn = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(turn, key))).where(F.col("_n") <= n).drop("_n")


def text_windows(df: DataFrame, size: int, overlap: float) -> DataFrame:
    """One row for each window of words of df(doc_id, text): doc_id, window, n_words, first_word."""
    held = df.select("doc_id", words(F.col("text")).alias("held"))  # cut into words once, not once for each window
    cut = held.select("doc_id", F.posexplode(word_windows(F.col("held"), size, overlap)).alias("window", "w"))
    return cut.select("doc_id", "window", F.size("w").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"))
