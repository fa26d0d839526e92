"""Evaluation analytics: retrieval metrics, agreement, thresholds, percentiles, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import materialise


def first_hits(items: DataFrame, gold: DataFrame) -> DataFrame:
    """question, grp, rank: the first rank (from 0) at which a gold group is met, null if never.

    items(question, rank, item); gold(question, grp, want). An item meets a wanted key or citation: by itself or by its
    part before the number sign.
    """
    named = items.select("question", "rank", F.explode(F.array_distinct(F.array("item", F.substring_index("item", "#", 1)))).alias("want"))
    groups = gold.select("question", "grp").distinct()
    met = gold.join(named, ["question", "want"]).groupBy("question", "grp").agg(F.min("rank").alias("rank"))
    return groups.join(met, ["question", "grp"], "left")


def retrieval_metrics(items: DataFrame, gold: DataFrame) -> DataFrame:
    """question, recall, ndcg, mrr. The ideal counts as many groups as there are, or items if fewer."""
    sizes = items.groupBy("question").agg(F.count("*").alias("n_items"))
    by = first_hits(items, gold).groupBy("question").agg(
        F.count("*").alias("groups"),
        F.count("rank").alias("met"),
        F.min("rank").alias("first"),
        F.coalesce(F.sum(1 / F.log2(F.col("rank") + 2)), F.lit(0.0)).alias("gain"),
    )
    depth = F.least(F.col("groups"), F.coalesce("n_items", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 2))
    return by.join(sizes, "question", "left").select(
        "question",
        F.round(F.col("met") / F.col("groups"), 9).alias("recall"),
        F.round(F.when(depth > 0, F.col("gain") / ideal).otherwise(0.0), 9).alias("ndcg"),
        F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 9).alias("mrr"),
    )


def elapsed(marks: DataFrame) -> DataFrame:
    """question, ms from the first to the last of marks(question, at)."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return marks.groupBy("question").agg(F.floor((us(F.max("at")) - us(F.min("at"))) / 1000).alias("ms"))


def index_percentile(df: DataFrame, groups: list[str], value: str, p: float, shift: int = 0) -> DataFrame:
    """The value at index min(floor(p n), n - 1) + shift of each group in ascending order: never interpolated.

    Ranks come from counts of distinct values, so a group of many equal values is a few rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*groups).orderBy(value)
    at = F.greatest(F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1) + shift, F.lit(0))
    held = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*groups)))
    return held.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*groups, F.col(value).alias("percentile"))


def mean_sd(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """mean, sd (of a sample; 0 for fewer than two)."""
    return df.groupBy(*groups).agg(F.round(F.avg(value), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 9).alias("sd"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of pairs(a, b); 1 where chance alone agrees always. Only the table of outcomes is joined."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("a").alias("v")).agg(F.sum("c").alias("x"))
    right = cells.groupBy(F.col("b").alias("v")).agg(F.sum("c").alias("y"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("e"))
    one = F.lit(1).alias("one")
    both = total.select("*", one).join(chance.select("*", one), "one")
    e = F.col("e") / (F.col("n") * F.col("n"))
    return both.select(F.round(F.when(e == 1, 1.0).otherwise((F.col("same") / F.col("n") - e) / (1 - e)), 9).alias("kappa"), F.col("n").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def negative_f1(supported: Column, judge: Column) -> list[Column]:
    """Aggregates f1, precision, recall, false_accept, n on the class of what the judge does not support."""
    tp, fp, fn = F.count_if(~judge & ~supported), F.count_if(judge & ~supported), F.count_if(~judge & supported)
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 9).alias("f1"),
        F.round(p, 9).alias("precision"),
        F.round(r, 9).alias("recall"),
        F.round(_ratio(fn, tp + fn), 9).alias("false_accept"),
        F.count("*").alias("n"),
    ]


def threshold_search(pairs: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """threshold, f1 that is best for pairs(judge, score) of each group, ties to the lower; scores are compared with 3-digit thresholds.

    Scores are counted by thousandths first, so running sums over that many rows replace a grid times all pairs.
    """
    by = groups or []
    # a score reaches thresholds of up to floor(1000 score) thousandths
    binned = pairs.select(*by, "judge", F.floor(F.round(F.col("score") * 1000, 6)).cast("long").alias("at"), F.round("score", 3).alias("t"))
    own = F.explode(F.array(F.round(F.col("t") * 1000).cast("long"), F.lit(500).cast("long")))
    grid = binned.select(*by, own.alias("at")).distinct()
    counts = binned.groupBy(*by, "at").agg(F.count_if("judge").alias("good"), F.count_if(~F.col("judge")).alias("bad"))
    rows = grid.select(*by, "at", F.lit(0).alias("good"), F.lit(0).alias("bad"), F.lit(1).alias("mark")).unionByName(counts.withColumn("mark", F.lit(0)))
    ordered = Window.partitionBy(*by).orderBy("at")
    below = ordered.rangeBetween(Window.unboundedPreceding, -1)
    sums = rows.withColumn("fp", F.coalesce(F.sum("good").over(below), F.lit(0))).withColumn("tp", F.coalesce(F.sum("bad").over(below), F.lit(0)))
    sums = sums.withColumn("all_bad", F.sum("bad").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("mark = 1")
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("all_bad"))
    f1 = F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 9)
    best = sums.select(*by, F.struct(f1.alias("f1"), F.negative("at").alias("minus")).alias("x")).groupBy(*by).agg(F.max("x").alias("x")).where("x is not null")
    return best.select(*by, (F.negative("x.minus") / 1000).alias("threshold"), "x.f1")


def triage_limits(pairs: DataFrame, leak: float = 0.02, loss: float = 0.10) -> DataFrame:
    """lo, hi fitted on pairs(judge, score): the least threshold of those accepted of whom at most leak are bad, and the greatest of those
    rejected of whom at most loss are good; 0 and 1.01 where none is. Thresholds are the scores to 3 digits.

    One sorted pass of scores and thresholds by thousandths, as for threshold_search.
    """
    binned = pairs.select("judge", F.floor(F.round(F.col("score") * 1000, 6)).cast("long").alias("at"), F.round(F.round("score", 3) * 1000).cast("long").alias("t"))
    counts = binned.groupBy("at").agg(F.count_if("judge").alias("good"), F.count_if(~F.col("judge")).alias("bad"))
    rows = binned.select(F.col("t").alias("at")).distinct().select("at", F.lit(0).alias("good"), F.lit(0).alias("bad"), F.lit(1).alias("mark")).unionByName(counts.withColumn("mark", F.lit(0)))
    ordered = Window.orderBy("at")  # rows of thousandths
    below, all_ = ordered.rangeBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = rows.select("at", "mark", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in ("good", "bad")], *[F.sum(c).over(all_).alias(f"{c}_all") for c in ("good", "bad")]).where("mark = 1")
    rejected, accepted_bad = F.col("good_below") + F.col("bad_below"), F.col("bad_all") - F.col("bad_below")
    accepted = F.col("good_all") + F.col("bad_all") - rejected
    return sums.agg(
        F.coalesce(F.min(F.when((accepted > 0) & (accepted_bad <= leak * accepted), F.col("at") / 1000)), F.lit(1.01)).alias("hi"),
        F.coalesce(F.max(F.when((rejected > 0) & (F.col("good_below") <= loss * rejected), F.col("at") / 1000)), F.lit(0.0)).alias("lo"),
    )


def verifier_report(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """For each group of pairs(half, judge, score), halves tune and report: what the judge supports, f1 of accepting all, the thresholds
    fitted on either half and f1 on the other, their mean, and the f1 of fitting and scoring on everything."""
    fitted = threshold_search(pairs, [*groups, "half"]).groupBy(*groups)
    fitted = fitted.agg(F.max(F.when(F.col("half") == "tune", F.col("threshold"))).alias("threshold"), F.max(F.when(F.col("half") == "report", F.col("threshold"))).alias("other_way"))
    whole = threshold_search(pairs, groups).withColumnRenamed("f1", "ceiling").drop("threshold")

    def f1(half: str, at: str) -> Column:
        inside, call = F.col("half") == half, F.col("score") >= F.col(at)
        tp, off = F.count_if(inside & ~F.col("judge") & ~call), F.count_if(inside & (F.col("judge") != call))
        return F.round(_ratio(2.0 * tp, 2 * tp + off), 9)

    good = F.count_if("judge")
    out = pairs.join(fitted, groups).groupBy(*groups, "threshold", "other_way").agg(
        F.count("*").alias("judged"),
        F.round(good / F.count("*"), 9).alias("supported"),
        F.round(2 * good / (good + F.count("*")), 9).alias("accept_all_f1"),
        f1("report", "threshold").alias("report_f1"),
        f1("tune", "other_way").alias("tune_f1"),
    )
    return out.join(whole, groups).withColumn("held_out_f1", F.round((F.col("report_f1") + F.col("tune_f1")) / 2, 9))


def suppression(answers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shares hidden at three granularities: answers(answer, refused), pairs(answer, section, fails)."""
    live = answers.where(~F.col("refused")).select("answer")
    held = pairs.join(live, "answer")
    sections = held.groupBy("answer", "section").agg(F.bool_or("fails").alias("hidden"), F.count("*").alias("claims"), F.count_if("fails").alias("bad"))
    per = sections.groupBy("answer").agg(F.bool_or("hidden").alias("any"), F.bool_and("hidden").alias("every"), F.count("*").alias("sections"), F.count_if("hidden").alias("hidden"), F.sum("claims").alias("claims"), F.sum("bad").alias("bad"))
    out = live.join(per, "answer", "left").agg(
        F.count("*").alias("answers"),
        F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"),
        F.count_if("any").alias("a"),
        F.count_if("every").alias("e"),
        F.sum("hidden").alias("h"),
        F.sum("sections").alias("s"),
        F.sum("bad").alias("b"),
    )
    share = lambda x, y: F.round(_ratio(F.col(x), F.col(y)), 9)
    return out.select("answers", "claims", share("a", "answers").alias("whole_answer"), share("h", "s").alias("section"), share("e", "answers").alias("emptied"), share("b", "claims").alias("claim"))


def faithfulness(answers: DataFrame) -> DataFrame:
    """Roll-up of answers(refused, claims, supported): the mean is over answers that were scored alone."""
    score = F.when(~F.col("refused") & (F.col("claims") > 0), F.col("supported") / F.col("claims"))
    return answers.agg(
        F.round(F.avg(score), 9).alias("faithfulness"),
        F.count(score).alias("scored"),
        F.round(F.avg(F.col("refused").cast("double")), 9).alias("refusal_rate"),
        F.count_if(score == 1).alias("perfect"),
        F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"),
    )


def within_limit(rates: DataFrame, rate: str, limit: float | None) -> DataFrame:
    """Whether the mean rate is within a limit; no limit passes, no rates count as 0."""
    mean = F.coalesce(F.avg(rate), F.lit(0.0))
    return rates.agg((F.lit(True) if limit is None else mean <= limit).alias("ok"))


def spend(calls: DataFrame, order: str, cost: str, cap: float) -> DataFrame:
    """Calls in order while their running cost is within a cap. Ranges of the order are summed first, so no task holds all calls."""
    ranged = materialise(calls.repartitionByRange(order).withColumn("_r", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_r").agg(F.sum(cost).alias("_s"))
    before = before.select("_r", (F.sum("_s").over(Window.orderBy("_r")) - F.col("_s")).alias("_b"))
    w = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(before, "_r").withColumn("spent", F.round(F.sum(cost).over(w) + F.col("_b"), 8))
    return out.where(F.col("spent") <= cap).drop("_r", "_b")


def choose(arms: DataFrame, base: str, worst: float = -0.02) -> DataFrame:
    """The arm of arms(arm, category, delta, guards_kept, parts) to keep: guards kept, no category below worst, a better mean than
    base's; the best mean, then the simplest."""
    per = arms.groupBy("arm").agg(F.min("delta").alias("low"), F.round(F.avg("delta"), 9).alias("mean"), F.bool_and("guards_kept").alias("kept"), F.max("parts").alias("parts"))
    own = per.where(F.col("arm") == base).select(F.col("mean").alias("base"), F.lit(1).alias("one"))
    ok = per.withColumn("one", F.lit(1)).join(own, "one").where(F.col("kept") & (F.col("low") >= worst) & (F.col("mean") > F.col("base")))
    return ok.orderBy(F.desc("mean"), "parts", "arm").limit(1).select("arm", "mean", "low")
