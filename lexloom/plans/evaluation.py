"""Queries: retrieval metrics, agreement, thresholds, percentiles, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import metrics as M
from lexloom.operators import retrieval as R
from lexloom.plans.tables import table


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ten nearest vectors of every twentieth one, and gold: groups of vectors with the same label."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0")
    near = R.dense_many(v.select(F.col("vec_id").alias("key"), "embedding"), asked.select(F.col("vec_id").alias("search"), "embedding"), 10)
    items = near.select(F.col("search").alias("question"), (F.col("rank") - 1).alias("rank"), F.concat(F.lit("c"), F.col("key"), F.lit("#body#1")).alias("item"))
    gold = asked.select(F.col("vec_id").alias("question"), "label").join(v.select("label", F.col("vec_id").alias("w")), "label")
    want = F.when(F.col("w") % 2 == 0, F.concat(F.lit("c"), "w")).otherwise(F.concat(F.lit("c"), F.col("w"), F.lit("#body#1")))
    return items, gold.select("question", (F.col("w") % 4).alias("grp"), want.alias("want"))


_JUDGED = """
near AS (SELECT a.vec_id AS question, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
items AS (SELECT question, n - 1 AS rank, 'c' || vec_id || '#body#1' AS item, 'c' || vec_id AS label FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS n FROM near) WHERE n <= 10),
gold AS (SELECT a.vec_id AS question, b.vec_id % 4 AS grp, CASE WHEN b.vec_id % 2 = 0 THEN 'c' || b.vec_id ELSE 'c' || b.vec_id || '#body#1' END AS want
         FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0),
fh AS (SELECT g.question, g.grp, min(i.rank) AS rank FROM gold g LEFT JOIN items i ON g.question = i.question AND (i.item = g.want OR i.label = g.want) GROUP BY g.question, g.grp)"""


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_hits(*_judged(spark, sf_dir))


def recall_ndcg_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.retrieval_metrics(*_judged(spark, sf_dir))


_METRICS = f"""WITH {_JUDGED},
m AS (SELECT question, count(*) AS groups, count(rank) AS met, min(rank) AS first, coalesce(sum(1 / log2(rank + 2)), 0) AS gain FROM fh GROUP BY question)
SELECT question, round(met / groups::DOUBLE, 9) AS recall,
  round(gain / list_sum([1 / log2(i + 2) FOR i IN range(0, least(groups, 10))]), 9) AS ndcg, round(coalesce(1 / (first + 1)::DOUBLE, 0), 9) AS mrr FROM m"""


def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.round("value", 2).alias("value"))
    p50 = M.index_percentile(e, ["event_type"], "value", 0.5).withColumnRenamed("percentile", "p50")
    p95 = M.index_percentile(e, ["event_type"], "value", 0.95).withColumnRenamed("percentile", "p95")
    low = M.index_percentile(e, ["event_type"], "value", 0.95, -1).withColumnRenamed("percentile", "p95_low")
    return p50.join(p95, "event_type").join(low, "event_type")


_PERCENTILES = """WITH e AS (SELECT event_type, round(value, 2) AS value FROM events),
o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE i = least(floor(0.5 * n), n - 1)) AS p50, max(value) FILTER (WHERE i = least(floor(0.95 * n), n - 1)) AS p95,
       max(value) FILTER (WHERE i = least(floor(0.95 * n), n - 1) - 1) AS p95_low FROM o GROUP BY event_type"""


def mean_sd_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_sd(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judgements: quality is the judge, a score is made from the text's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "source", "lang", (F.col("quality") == 1).alias("judge"), (F.col("toxic") == 1).alias("toxic"), F.round((F.col("n_chars") * 7919 % 10007) / 10007, 6).alias("score"))


_LABELS = "l AS (SELECT l.doc_id, source, lang, quality = 1 AS judge, toxic = 1 AS toxic, round((n_chars * 7919 % 10007) / 10007::DOUBLE, 6) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _labels(spark, sf_dir).select(F.col("judge").cast("string").alias("a"), (F.col("score") > 0.5).cast("string").alias("b"))
    return M.kappa(pairs)


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("judge", "toxic").agg(F.count("*").alias("n"))


def negative_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("lang").agg(*M.negative_f1(F.col("score") >= 0.4, F.col("judge")))


def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_search(_labels(spark, sf_dir))


_THRESHOLD = f"""WITH {_LABELS}, e AS (SELECT judge, score FROM l),
g AS (SELECT DISTINCT round(score, 3) AS t FROM e UNION SELECT 0.5),
c AS (SELECT t, count(*) FILTER (WHERE NOT judge AND score < t) AS tp, count(*) FILTER (WHERE judge AND score < t) AS fp, count(*) FILTER (WHERE NOT judge AND score >= t) AS fn FROM g, e GROUP BY t),
f AS (SELECT t, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c)
SELECT t::DOUBLE AS threshold, f1 FROM f ORDER BY f1 DESC, t LIMIT 1"""


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept and reject thresholds under leak limits, fitted on one half and applied to the other."""
    p = _labels(spark, sf_dir).select("judge", "score", T.half(F.concat(F.lit("r"), "doc_id")).alias("half"))
    limits = M.triage_limits(p.where("half = 'tune'"))
    rep = p.where("half = 'report'").withColumn("one", F.lit(1)).join(limits.withColumn("one", F.lit(1)), "one")
    return rep.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("hi")).alias("accepted"), F.count_if(F.col("score") < F.col("lo")).alias("rejected"), F.count_if((F.col("score") >= F.col("hi")) & ~F.col("judge")).alias("leaked"))


_TRIAGE = f"""WITH {_LABELS}, p AS (SELECT judge, score, CASE WHEN position(right(sha256('r' || doc_id), 1) IN '02468ace') > 0 THEN 'tune' ELSE 'report' END AS half FROM l),
g AS (SELECT DISTINCT round(score, 3) AS g FROM p WHERE half = 'tune'),
f AS (SELECT g, count(*) FILTER (WHERE score >= g) AS acc, count(*) FILTER (WHERE score >= g AND NOT judge) AS ab, count(*) FILTER (WHERE score < g) AS rej, count(*) FILTER (WHERE score < g AND judge) AS rg
      FROM g, p WHERE half = 'tune' GROUP BY g),
t AS (SELECT coalesce(min(g) FILTER (WHERE acc > 0 AND ab <= 0.02 * acc), 1.01) AS hi, coalesce(max(g) FILTER (WHERE rej > 0 AND rg <= 0.10 * rej), 0.0) AS lo FROM f)
SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, count(*) AS n, count(*) FILTER (WHERE score >= hi) AS accepted, count(*) FILTER (WHERE score < lo) AS rejected, count(*) FILTER (WHERE score >= hi AND NOT judge) AS leaked
FROM p, t WHERE half = 'report' GROUP BY lo, hi"""


def suppression_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers, their turns as claims."""
    c = table(spark, sf_dir, "conversations")
    answers = c.groupBy(F.col("conv_id").alias("answer")).agg((F.max("turn") < 2).alias("refused"))
    pairs = c.select(F.col("conv_id").alias("answer"), F.col("role").alias("section"), (F.length("text") % 5 == 0).alias("fails"))
    return M.suppression(answers, pairs)


_SUPPRESSION = """WITH a AS (SELECT conv_id AS answer FROM conversations GROUP BY conv_id HAVING max(turn) >= 2),
p AS (SELECT conv_id AS answer, role AS section, length(text) % 5 = 0 AS fails FROM conversations WHERE conv_id IN (SELECT answer FROM a)),
s AS (SELECT answer, section, bool_or(fails) AS hidden FROM p GROUP BY answer, section),
w AS (SELECT answer, bool_or(hidden) AS any_h, bool_and(hidden) AS all_h FROM s GROUP BY answer)
SELECT (SELECT count(*) FROM a) AS answers, (SELECT count(*) FROM p) AS claims,
  round((SELECT count(*) FROM w WHERE any_h) / (SELECT count(*) FROM a)::DOUBLE, 9) AS whole_answer,
  round((SELECT count(*) FROM s WHERE hidden) / (SELECT count(*) FROM s)::DOUBLE, 9) AS section,
  round((SELECT count(*) FROM w WHERE all_h) / (SELECT count(*) FROM a)::DOUBLE, 9) AS emptied,
  round((SELECT count(*) FROM p WHERE fails) / (SELECT count(*) FROM p)::DOUBLE, 9) AS claim"""


def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") == 1).alias("refused"), F.count_if(F.col("role") == "assistant").alias("claims"), F.count_if((F.col("role") == "assistant") & (F.length("text") % 3 > 0)).alias("supported"))
    return M.faithfulness(c)


_FAITH = """WITH c AS (SELECT conv_id, count(*) = 1 AS refused, count(*) FILTER (WHERE role = 'assistant') AS claims, count(*) FILTER (WHERE role = 'assistant' AND length(text) % 3 > 0) AS supported FROM conversations GROUP BY conv_id),
s AS (SELECT *, CASE WHEN NOT refused AND claims > 0 THEN supported / claims::DOUBLE END AS f FROM c)
SELECT round(avg(f), 9) AS faithfulness, count(f) AS scored, round(avg(refused::INT), 9) AS refusal_rate, count(*) FILTER (WHERE f = 1) AS perfect, sum(claims)::BIGINT AS claims FROM s"""


def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two models at their prices, until a cap."""
    prices = {"click": (0.15, 0.6), "view": (1.0, 5.0)}
    e = table(spark, sf_dir, "events")
    calls = e.select("event_id", T.cost(F.col("event_type"), F.col("event_id") % 5000, F.col("user_id"), prices).alias("usd"))
    return M.spend(calls, "event_id", "usd", 1.0).select("event_id", "spent")


def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.avg((F.col("role") == "user").cast("double")).alias("rate"))
    return M.within_limit(c, "rate", 0.6)


def arm_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("category")).agg(F.avg("o_totalprice").alias("p"), F.max(F.length("o_orderpriority")).alias("parts"))
    arms = o.select("arm", "category", F.round((F.col("p") - 140000) / 1e6, 9).alias("delta"), (F.col("p") > 0).alias("guards_kept"), "parts")
    return M.choose(arms, "5-LOW")


_ARMS = """WITH o AS (SELECT o_orderpriority AS arm, o_orderstatus AS category, round((avg(o_totalprice) - 140000) / 1e6, 9) AS delta, max(length(o_orderpriority)) AS parts FROM orders GROUP BY 1, 2),
p AS (SELECT arm, min(delta) AS low, round(avg(delta), 9) AS mean, max(parts) AS parts FROM o GROUP BY arm)
SELECT arm, mean, low FROM p WHERE low >= -0.02 AND mean > (SELECT mean FROM p WHERE arm = '5-LOW') ORDER BY mean DESC, parts, arm LIMIT 1"""


def grade_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of models, one column for each grade, with the median cost."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O', 'P')")
    wide = o.groupBy(F.col("o_orderpriority").alias("model")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    cost = o.groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.median("o_totalprice"), 4).alias("median"))
    return wide.join(cost, "model").select("model", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in ("F", "O", "P")], "median")


def conflict_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional rates by set and kind."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).alias("plan_set"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("at_target"), F.round(F.avg((F.col("value") > 50).cast("double")), 9).alias("rate"))


def worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("score")).alias("score")).where("score is not null").orderBy("score", "doc_id").limit(5)


def max_window_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document by the share of its words that are in a claim's."""
    from lexloom.operators.windows import sliding_windows

    claim = F.array(*[F.lit(w) for w in ("the", "and", "of", "de", "la", "der", "que")])
    words = table(spark, sf_dir, "documents").select("doc_id", T.words(F.lower("text")).alias("held"))
    cut = words.select("doc_id", F.explode(sliding_windows(F.col("held"))).alias("w"))
    held = F.split("w", " ")
    share = F.round(F.size(F.filter(held, lambda x: F.array_contains(claim, x))) / F.size(held), 6)
    return cut.select("doc_id", share.alias("s")).groupBy("doc_id").agg(F.max("s").alias("score"))


_MAXWIN = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\r\\f\\v]+') AS w FROM documents),
c AS (SELECT doc_id, unnest([w[i + 1 : i + 200] FOR i IN range(0, greatest(len(w) - 200, 0) + 100, 100)]) AS x FROM w)
SELECT doc_id, max(round(len(list_filter(x, lambda t: list_contains(['the', 'and', 'of', 'de', 'la', 'der', 'que'], t))) / greatest(len(x), 1)::DOUBLE, 6)) AS score FROM c GROUP BY doc_id"""


QUERIES = {
    "first_hits": (first_hits, f"WITH {_JUDGED} SELECT question, grp, rank FROM fh"),
    "recall_ndcg_mrr": (recall_ndcg_mrr, _METRICS),
    "index_percentiles": (index_percentiles, _PERCENTILES),
    "mean_sd_by_group": (mean_sd_by_group, "SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 9) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 9) AS sd FROM orders GROUP BY 1, 2"),
    "cohen_kappa": (
        cohen_kappa,
        f"""WITH {_LABELS}, p AS (SELECT judge AS a, score > 0.5 AS b FROM l),
        e AS (SELECT count(*) AS n, avg((a = b)::INT) AS o, avg(a::INT) AS pa, avg(b::INT) AS pb FROM p)
        SELECT round((o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa, n FROM e""",
    ),
    "contingency": (contingency, f"WITH {_LABELS} SELECT judge, toxic, count(*) AS n FROM l GROUP BY 1, 2"),
    "negative_f1": (
        negative_f1,
        f"""WITH {_LABELS}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT judge AND score < 0.4) AS tp, count(*) FILTER (WHERE judge AND score < 0.4) AS fp, count(*) FILTER (WHERE NOT judge AND score >= 0.4) AS fn FROM l GROUP BY lang)
        SELECT lang, n, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) AS precision,
        round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 9) AS recall, round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn)::DOUBLE ELSE 0 END, 9) AS false_accept FROM c""",
    ),
    "threshold_search": (threshold_search, _THRESHOLD),
    "triage": (triage, _TRIAGE),
    "suppression_rollup": (suppression_rollup, _SUPPRESSION),
    "faithfulness": (faithfulness, _FAITH),
    "running_spend": (
        running_spend,
        """WITH c AS (SELECT event_id, CASE event_type WHEN 'click' THEN ((event_id % 5000) * 0.15::DOUBLE + user_id * 0.6::DOUBLE) / 1e6 WHEN 'view' THEN ((event_id % 5000) * 1.0::DOUBLE + user_id * 5.0::DOUBLE) / 1e6 ELSE 0 END AS usd FROM events),
        s AS (SELECT event_id, round(sum(usd) OVER (ORDER BY event_id), 8) AS spent FROM c) SELECT event_id, spent FROM s WHERE spent <= 1.0""",
    ),
    "refusal_gate": (refusal_gate, "SELECT coalesce(avg(rate), 0) <= 0.6 AS ok FROM (SELECT avg((role = 'user')::INT) AS rate FROM conversations GROUP BY conv_id)"),
    "arm_choice": (arm_choice, _ARMS),
    "grade_pivot": (
        grade_pivot,
        """SELECT o_orderpriority AS model, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, round(median(o_totalprice), 4) AS median
        FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1""",
    ),
    "conflict_rates": (conflict_rates, "SELECT user_id % 5 AS plan_set, event_type AS kind, count(*) AS n, sum((value > 50)::INT)::BIGINT AS at_target, round(avg((value > 50)::INT), 9) AS rate FROM events GROUP BY 1, 2"),
    "worst_rows": (worst_rows, f"WITH {_LABELS} SELECT doc_id, score FROM l WHERE doc_id % 3 > 0 ORDER BY score, doc_id LIMIT 5"),
    "max_window_score": (max_window_score, _MAXWIN),
}
