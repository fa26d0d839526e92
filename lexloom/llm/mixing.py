"""Mixing sources to target weights, in DataFrame functions alone.

A source's weight is its share of tokens to the power alpha. Bisection finds the alpha at which the weights meet a target
entropy, or the least alpha at which no source is repeated more often than a limit; it runs inside one expression over
the array of source shares, one element for each source. Weights times the budget are quotas: a source is passed over
whole as often as its quota allows, and what is left takes blocks in a seeded order. A block is a hash class of a
source's documents (8,192 at most, so a hot source is still many small pieces); of the one block in which the quota ends,
documents are taken in hash order while they fit.

Edge cases: null and empty texts have 0 tokens and follow their block; a null source is a source of its own; sources
without tokens have weight 0 and each of their documents one copy; rows that repeat a doc_id share a block and are taken
one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import materialise

#: Tokens of a block, most blocks of a source, steps of the bisection.
BLOCK_TOKENS, MOST_BLOCKS, STEPS = 1 << 14, 8192, 50
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts: Column | str) -> Column:
    """60 bits of the digest of the parts, joined by bars."""
    joined = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def _exponent(shares: Column, entropy: float | None, repeats: float | None, budget: Column | None) -> Column:
    """The alpha in [0, 1] for an array of positive shares that sum to 1. budget: in corpora, null for the least that loses no document."""
    powers = lambda a: F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.pow(p, a))
    if entropy is not None:
        z_log = lambda a: F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.pow(p, a) * F.log(p))
        fits = lambda a: F.log(powers(a)) - a * z_log(a) / powers(a) <= F.lit(float(entropy))
    elif budget is None:
        fits = lambda a: F.pow(F.array_max(shares) / F.array_min(shares), 1 - a) <= F.lit(float(repeats))
    else:
        fits = lambda a: budget * F.pow(F.array_min(shares), a - 1) / powers(a) <= F.lit(float(repeats))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        ok = fits(mid)
        return F.struct(F.when(ok, s["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    return F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(found["hi"])


def source_weights(sized: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """name, tokens, alpha, weight, quota for each source of sized(name, n_tokens). budget: in corpora; None: no document is lost."""
    by = sized.groupBy("name").agg(F.sum("n_tokens").alias("tokens"))
    row = by.where("tokens > 0").agg(F.sort_array(F.collect_list("tokens")).alias("all"), F.sum("tokens").alias("total"))
    row = row.withColumn("shares", F.transform("all", lambda t: t / F.col("total")))
    row = row.withColumn("alpha", _exponent(F.col("shares"), entropy, repeats, None if budget is None else F.lit(float(budget))))
    row = row.withColumn("z", F.aggregate("shares", F.lit(0.0), lambda acc, p: acc + F.pow(p, F.col("alpha"))))
    size = F.lit(float(budget)) if budget is not None else F.col("z") * F.pow(F.array_max("shares"), 1 - F.col("alpha"))
    row = row.select("total", "alpha", "z", size.alias("size"))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("alpha")) / F.col("z")).otherwise(0.0)
    one = F.lit(1).alias("one")  # row is a single aggregate
    return by.select("*", one).join(row.select("*", one), "one").withColumn("weight", weight).select("name", "tokens", "alpha", "weight", F.round(F.col("weight") * F.col("size") * F.col("total"), 3).alias("quota"))


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = 4.0, budget: float | None = 1.0, seed: int = 1) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, block_rank, n_copies for every row of docs(doc_id, text, source)."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    sized = materialise(sized.withColumn("name", name), "sized")
    weights = source_weights(sized, entropy, repeats, budget)
    blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long")
    weights = materialise(weights.withColumn("blocks", blocks).withColumn("passes", passes).withColumn("left", F.when(F.col("tokens") > 0, F.round(F.col("quota") - passes * F.col("tokens"), 3)).otherwise(0.0)), "weights")
    placed = sized.join(weights, "name").withColumn("turn", _hash(str(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = placed.withColumn("block", F.pmod(F.col("turn"), F.col("blocks")))

    order = Window.partitionBy("name").orderBy(_hash(str(seed), F.col("name"), F.col("block").cast("string")), "block")
    plan = placed.groupBy("name", "block", "left").agg(F.sum("n_tokens").alias("held"))
    plan = plan.withColumn("block_rank", F.row_number().over(order).cast("long")).withColumn("until", F.sum("held").over(order))
    plan = materialise(plan.select("name", "block", "block_rank", (F.col("until") - F.col("held")).alias("since"), "until", "left"), "blocks")
    placed = placed.join(plan.drop("left"), ["name", "block"])
    shown = ["doc_id", "source", "n_tokens", "weight", "block", "block_rank"]
    whole = placed.where("until <= left or since >= left").select(*shown, (F.col("passes") + (F.col("until") <= F.col("left")).cast("long")).alias("n_copies"))
    inside = Window.partitionBy("name", "block").orderBy(F.floor(F.col("turn") / F.lit(MOST_BLOCKS)), "turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where("until > left and since < left").withColumn("sofar", F.sum("n_tokens").over(inside) + F.col("since"))
    return whole.unionByName(cut.select(*shown, (F.col("passes") + (F.col("sofar") <= F.col("left")).cast("long")).alias("n_copies")))
