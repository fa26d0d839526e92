"""Joins on intervals and on prefixes as equi-joins, each pair once.

Intervals are put into bins of the power of two that is at least their length, of which an interval meets two at most. Of two that overlap,
the longer one's bins hold the other too: so each stands in its own bins, and asks in the bins of every longer size there is. A bin is an
ordinary join key, so Spark deals it out and splits a crowded one like any other; no pair is made that does not share a bin.

A text starts with another if the other is one of its prefixes: texts are expanded to their prefixes, of the lengths that there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialise

#: Parts that the ids of one citation are dealt into when pairs are made.
SPLIT = 8


def _size(lo: Column, hi: Column) -> Column:
    """The least power of two that is at least the length, as its exponent."""
    return F.ceil(F.log2(F.greatest(hi - lo + 1, F.lit(1)).cast("double"))).cast("int")


def _bins(df: DataFrame, sizes: Column) -> DataFrame:
    """df with size and bin, a row for each bin of these sizes that its interval meets."""
    one = df.withColumn("_size", F.explode(sizes))
    shift = lambda c: F.expr(f"shiftright({c}, _size)")
    return one.withColumn("_first", shift("_lo")).withColumn("_bin", F.explode(F.sequence(F.col("_first"), shift("_hi"))))


def overlapping(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """a, b: the ids of left(id, lo, hi, *on) and right(id, lo, hi, *on) that agree in on and whose closed intervals overlap.

    Bounds are whole numbers from 0 to 2**52; rows with a null, or with hi below lo, overlap nothing.
    """
    good = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi"))
    shape = lambda df, name: df.where(good).select(*on, F.col("id").alias(name), F.col("lo").cast("long").alias("_lo"), F.col("hi").cast("long").alias("_hi")).withColumn("_own", _size(F.col("_lo"), F.col("_hi")))
    a, b = materialise(shape(left, "a"), "left"), materialise(shape(right, "b"), "right")
    found = sorted({r[0] for r in a.select("_own").distinct().union(b.select("_own").distinct()).collect()})  # 53 at most
    every = F.array(*[F.lit(s) for s in found]).cast("array<int>")

    def side(own: DataFrame, other: DataFrame, strict: bool) -> DataFrame:
        """own in its bins, joined with the others that are no longer (strictly shorter if strict)."""
        home = _bins(own, F.array("_own"))
        sizes = F.filter(every, lambda s: s > F.col("_own") if strict else s >= F.col("_own"))
        asks = _bins(other, sizes).select(*on, "_size", "_bin", F.col("_first").alias("_f"), F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), *[c for c in ("a", "b") if c in other.columns])
        met = home.join(asks, [*on, "_size", "_bin"]).where((F.col("_bin") == F.greatest("_first", "_f")) & (F.col("_lo") <= F.col("_h")) & (F.col("_l") <= F.col("_hi")))
        return met.select("a", "b")

    return side(a, b, False).unionByName(side(b, a, True))


def prefixed(texts: DataFrame, heads: DataFrame, on: list[str]) -> DataFrame:
    """a, b: the ids of texts(id, text, *on) and heads(id, text, *on) that agree in on and where a's text starts with b's. Nulls start nothing."""
    h = heads.where("text is not null").select(*on, F.col("id").alias("b"), F.col("text").alias("_head"))
    lengths = [r[0] for r in h.select(F.length("_head").alias("n")).distinct().collect()]  # of citations: few
    t = texts.where("text is not null").select(*on, F.col("id").alias("a"), F.col("text").alias("_text"))
    some = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_text"))
    cut = t.withColumn("_n", F.explode(some)).select(*on, "a", F.expr("left(_text, _n)").alias("_head"))
    return cut.join(h, [*on, "_head"]).select("a", "b")


def contained(citations: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """a, b: citations(id, citation, *on) with the chunks(id, citation, *on) that hold them, as functions.claims.contains says of one pair.

    Rows of one citation are alike: different citations are joined, and each pair of them is made into pairs of ids last, in no shuffle.
    """
    from lexloom.functions.claims import head_of, pages

    ranges = lambda df: df.withColumn("_p", pages(F.col("citation"))).select(*on, "id", F.col("_p.first").alias("lo"), F.col("_p.last").alias("hi"))
    whole = lambda df: df.select(*on, "id", F.col("citation").alias("text"))
    heads = lambda df: df.select(*on, "id", head_of(F.col("citation")).alias("text"))
    (of_a, one_a), (of_b, one_b) = _alike(citations, on, "citations"), _alike(chunks, on, "chunks")
    back = prefixed(whole(one_b), heads(one_a), on).select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = overlapping(ranges(one_a), ranges(one_b), on).unionByName(prefixed(whole(one_a), heads(one_b), on)).unionByName(back).distinct()
    parts = int(citations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = of_a.select(F.col("id").alias("_id"), F.col("alike").alias("a")).join(pairs, "a").select("_id", F.col("b").alias("alike"), F.pmod(F.xxhash64("_id"), F.lit(SPLIT)).cast("int").alias("_part"))
    right = of_b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    both = left.repartition(parts, "alike", "_part").join(right.repartition(parts, "alike", "_part"), ["alike", "_part"])
    return both.select(F.col("_id").alias("a"), F.col("id").alias("b"))


def _alike(df: DataFrame, on: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(id, alike) of each id once, and (id, citation, *on), the rows that an id with this alike has."""
    rows = df.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(*on, "citation"))).alias("rows"))
    of = materialise(rows.withColumn("alike", F.md5(F.to_json("rows").cast("binary"))), label)
    return of.select("id", "alike"), materialise(of.select("alike", "rows").distinct().select(F.col("alike").alias("id"), F.explode("rows").alias("r")).select("id", "r.*"), label)
