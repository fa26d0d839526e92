"""Queries: answers from plan to conclusion with recorded replies of models, evaluation rows and reports, layouts and caches of tables."""

from __future__ import annotations

from json import dumps as json_text

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import legal as L
from lexloom.functions import text as T
from lexloom.operators import metrics as M
from lexloom.operators import providers as P
from lexloom.operators import ranking as K
from lexloom.operators import remembered as Z
from lexloom.operators import routing as G
from lexloom.operators import store as S
from lexloom.operators import synthesis as Y
from lexloom.plans.evaluation import _LABELS, _labels
from lexloom.plans import retrieval as PR
from lexloom.plans.routing import PLANNED, asked, kinds_of, own_sql, retrieved
from lexloom.plans.tables import table
from lexloom.session import materialise, new_path
from lexloom.sources import documents as D
from lexloom.sources import uploads as U
from lexloom.streaming import events as E

#: Questions whose recorded plan can't be read, modulo 10.
UNREAD = 6


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select(F.col("question").alias("answer"), F.col("asked").alias("question"), "query", "i")


def _recorded(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    """Replies of a model to each question at each step, as a table: answer, system, reply.

    It names sub-queries by the question's number, repeats every source that was found, confirms every other claim, and its replies to
    some questions can't be read; a plan of no known kind searches the question.
    """
    q = _asked(spark, sf_dir)
    json = lambda *fields: F.to_json(F.struct(*fields))
    listed = lambda make: F.transform(F.sequence(F.lit(0), F.lit(63)), make)
    kinds = F.transform(kinds_of(F.col("i")), lambda k: F.struct(k.alias("kind"), F.col("query").alias("query")))
    planned = json(F.when(F.col("i") % 4 == 0, "2023").alias("as_of"), kinds.alias("subqueries"))
    verdicts = json(listed(lambda k: F.struct(k.alias("index"), (k % 2 == 0).alias("supported"), F.lit("read").alias("why"))).alias("verdicts"))
    recites = json(listed(lambda k: F.struct(k.alias("index"), F.lit(1).alias("source"), F.lit("closer").alias("why"))).alias("recites"))
    steps = [
        (Y.PLAN, F.when(F.col("i") % 10 == UNREAD, "no plan").otherwise(planned)),
        (Y.VERIFY, F.when(F.col("i") % 4 == 2, "{").otherwise(verdicts)),
        (Y.RECITE, recites),
        (Y.CONCLUDE, F.lit(json_text({"follows": True, "basis": [0, 2], "yes_no_question": False, "why": "both"}))),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(system).alias("system"), reply.alias("reply")) for system, reply in steps])).alias("r")
    out = q.select("answer", rows).select("answer", "r.*")
    if hits is None:
        return out
    said = F.struct(F.col("part").alias("part"), F.col("ord").alias("ord"), F.concat(F.lit("It says "), "citation", F.lit(".")).alias("text"), F.array("citation").alias("citations"))
    told = hits.groupBy("answer").agg(F.array_sort(F.collect_list(said)).alias("s"))
    plain = F.transform("s", lambda x: F.struct(x["part"].alias("part"), x["text"].alias("text"), x["citations"].alias("citations")))
    lost = F.struct(F.lit(1).alias("part"), F.lit("Nobody says so.").alias("text"), F.array(F.lit("no source of these")).alias("citations"))
    lacks = F.array(F.struct(F.lit(1).alias("part"), F.lit("the rate").alias("why")))
    whole = json(F.array_append(plain, lost).alias("sentences"), lacks.alias("not_answerable"), F.lit("Yes, it does.").alias("conclusion"))
    written = told.join(q, "answer").select("answer", F.lit(Y.WRITE).alias("system"), F.when(F.col("i") % 4 == 3, "I had rather not.").otherwise(whole).alias("reply"))
    return out.unionByName(written)


def _searched(spark: SparkSession, sf_dir: str, k: int, shown: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans of all questions, the hits of their sub-queries, and the hits that are shown."""
    questions = _asked(spark, sf_dir)
    plans = materialise(Y.plan(questions, _recorded(spark, sf_dir)), "plans")
    by = plans.join(questions.select("answer", F.col("question").alias("asked")), "answer").withColumnRenamed("answer", "question")
    hits, _ = retrieved(spark, sf_dir, by, k)
    hits = materialise(hits, "hits")
    return plans, hits, K.merge(hits.withColumnRenamed("ord", "rank"), shown)


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    plans, _, best = _searched(spark, sf_dir, 3, 4)
    part = F.dense_rank().over(Window.partitionBy("question").orderBy("sq"))
    none = lambda kind: F.lit(None).cast(kind)
    texts = PR.labelled(spark, sf_dir).select("key", F.coalesce("text", F.lit("")).alias("text"))
    hits = best.join(texts, "key").select(
        F.col("question").alias("answer"), part.alias("part"), "sq", "ord", "citation", F.concat(F.lit("head of "), "key").alias("heading"), "source", "section", "text",
        none("struct<type:string,status:string,level:int>").alias("authority"), none("struct<year:int,rule:string,date:string,retroactive:boolean,amendment:string>").alias("effective"), none("int").alias("year"),
    )
    hits = materialise(hits, "shown")
    parts = hits.select("answer", "part", "sq").distinct().join(plans, ["answer", "sq"]).select("answer", "part", F.col("query").alias("label"))
    questions = _asked(spark, sf_dir).join(plans.groupBy("answer").agg(F.max("as_of").alias("tax_year")), "answer", "left").select("answer", "question", "tax_year")
    recorded = materialise(_recorded(spark, sf_dir, hits), "recorded")
    replies = Y.write(questions, parts, hits, recorded)
    return questions, plans, hits, replies, Y.checked(questions, parts, hits, replies, recorded)


def composed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question from plan to conclusion, over the texts that hybrid search finds."""
    return _answered(spark, sf_dir)[-1]


#: Unreadable plans search the question in all sources.
_PLANS = f"""{PLANNED.replace("pl AS (", "pl0 AS (")},
pl AS (SELECT question, i, sq, kind, asked, query FROM pl0 WHERE i % 10 <> {UNREAD} UNION ALL SELECT question, i, 0, 'unrouted', asked, asked FROM b WHERE i % 10 = {UNREAD})"""


def _best_sql(k: int, shown: int) -> str:
    return f"""{_PLANS}, {own_sql(k)},
a AS (SELECT *, ord AS n FROM own),
f AS (SELECT *, row_number() OVER (PARTITION BY question, citation ORDER BY n, sq) AS f FROM a),
o AS (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY question ORDER BY n, sq) AS ord FROM f WHERE f = 1),
h AS (SELECT *, dense_rank() OVER (PARTITION BY question ORDER BY sq) AS part FROM o WHERE ord <= {shown})"""


_MARKED = f"""WITH {_best_sql(3, 4)},
k AS (SELECT h.*, query, row_number() OVER (PARTITION BY h.question ORDER BY part, ord) - 1 AS k, first_value(citation) OVER (PARTITION BY h.question ORDER BY ord) AS own, max(part) OVER (PARTITION BY h.question) AS parts FROM h JOIN pl ON h.question = pl.question AND h.sq = pl.sq),
s AS (SELECT *, CASE WHEN k % 2 = 1 THEN own ELSE citation END AS cite, k % 4 < 3 AS good FROM k),
ln AS (SELECT question, part, parts, query, 0 AS late, k, 'It says ' || citation || ' [' || cite || '].' AS line FROM s WHERE good
       UNION ALL SELECT question, 1, max(parts), min(query), 1, 0, CASE WHEN bool_or(good AND part = 1) THEN 'Not in the sources: the rate' ELSE 'INSUFFICIENT EVIDENCE: no statement in this part could be verified against its sources.' END FROM s GROUP BY question
       UNION ALL SELECT question, part, max(parts), min(query), 1, 1, 'INSUFFICIENT EVIDENCE: no statement in this part could be verified against its sources.' FROM s WHERE part > 1 GROUP BY question, part HAVING NOT bool_or(good)),
bl AS (SELECT question, part, CASE WHEN max(parts) > 1 THEN 'Part ' || part || ': ' || min(query) || chr(10) ELSE '' END || string_agg(line, ' ' ORDER BY late, k) AS block FROM ln GROUP BY question, part),
tx AS (SELECT question, string_agg(block, chr(10) || chr(10) ORDER BY part) AS text FROM bl GROUP BY question),
ks AS (SELECT question, cite, row_number() OVER (PARTITION BY question ORDER BY k) - 1 AS n FROM s WHERE good),
cc AS (SELECT question, min(n) AS n, cite FROM ks WHERE n IN (0, 2) GROUP BY question, cite),
co AS (SELECT question, string_agg('[' || cite || ']', ', ' ORDER BY n) AS cites FROM cc GROUP BY question),
ct AS (SELECT question, count(*) AS n, count(*) FILTER (WHERE good) AS good FROM s GROUP BY question),
q AS (SELECT question AS answer, i FROM b),
an AS (SELECT answer, CASE i % 4 WHEN 3 THEN 'INSUFFICIENT EVIDENCE: no sentence of the answer could be tied to a source.' WHEN 2 THEN 'INSUFFICIENT EVIDENCE: the answer could not be verified.'
  ELSE CASE WHEN i % 4 = 0 AND i % 10 <> {UNREAD} THEN 'Tax year: 2023' || chr(10) || chr(10) ELSE '' END || 'Short answer: It does ' || cites || '.' || chr(10) || chr(10) || text END AS text,
  CASE WHEN i % 4 < 2 THEN good ELSE 0 END AS shown, CASE WHEN i % 4 < 2 THEN n - good WHEN i % 4 = 2 THEN n ELSE 0 END AS hidden, i % 4 < 2 AS concluded
  FROM q LEFT JOIN tx ON answer = tx.question LEFT JOIN co ON answer = co.question LEFT JOIN ct ON answer = ct.question)"""
_SUBQUERIES = f"CASE WHEN i % 10 = {UNREAD} THEN 1 ELSE CASE i % 4 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 2 END END"


def job_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the same questions, numbered as a listener gets them."""
    rows = Y.stages(*_answered(spark, sf_dir))
    return E.sequence(rows).select("job_id", "seq", "event", "data")


_STAGES = f"""{_MARKED},
sq AS (SELECT question AS answer, ({_SUBQUERIES})::BIGINT AS n FROM b),
ev AS (SELECT answer, 1 AS seq, 'decomposing' AS event, '{{}}' AS data FROM an
  UNION ALL SELECT answer, 2, 'retrieving', '{{"subqueries":' || n || '}}' FROM sq
  UNION ALL SELECT an.answer, 3, 'synthesizing', '{{"chunks":' || coalesce(n, 0) || '}}' FROM an LEFT JOIN ct ON an.answer = ct.question
  UNION ALL SELECT an.answer, 4, 'verifying', '{{"sentences":' || (shown + hidden) || '}}' FROM an
  UNION ALL SELECT answer, 5, 'answer', '{{"refused":' || (NOT concluded) || ',"hidden_sentences":' || hidden || '}}' FROM an)
SELECT answer AS job_id, seq, event, data FROM ev"""


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each question: what was planned and why a plan failed, how long it took, how many hits were shown, how they meet the gold.

    Gold is the same for all questions: 8 groups of 20 citations; sections are judged by those of the first group. Times are those of the
    user of the question's number in the event log.
    """
    plans, _, best = _searched(spark, sf_dir, 8, 8)
    items = best.select("question", (F.col("ord") - 1).alias("rank"), F.col("citation").alias("item"))
    gold = _asked(spark, sf_dir).select(F.col("answer").alias("question"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("grp"))
    gold = gold.withColumn("want", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: F.concat(F.lit("c"), x * 8 + F.col("grp")))))
    scores = M.retrieval_metrics(items, gold)
    sections = best.select("question", (F.col("ord") - 1).alias("rank"), F.col("section").alias("item"))
    wanted = _asked(spark, sf_dir).select(F.col("answer").alias("question"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: F.concat(F.lit("s"), x * 4))).alias("grp", "want"))
    by_section = M.retrieval_metrics(sections, wanted).select("question", F.col("recall").alias("section_recall"))
    first = M.first_hits(items, gold).groupBy("question").agg((F.min("rank") + 1).alias("first_hit_rank"))
    top = items.groupBy("question").agg(F.count("*").alias("chunks"), F.min_by("item", "rank").alias("top1"))
    how = plans.groupBy(F.col("answer").alias("question")).agg(F.count("*").alias("subqueries"), F.max("as_of").alias("as_of"), F.bool_or(F.col("kind") == "case_law").alias("has_case"), F.max("fallback").alias("fallback"))
    marks = table(spark, sf_dir, "events").select(F.concat(F.lit("q"), "user_id").alias("question"), F.col("ts").alias("at"))
    rows = _asked(spark, sf_dir).select(F.col("answer").alias("question")).join(how, "question")
    for part in (scores, by_section, first, top, M.elapsed(marks)):
        rows = rows.join(part, "question", "left")
    return rows


_EVALUATION = f"""WITH {_best_sql(8, 8)},
i AS (SELECT question, ord - 1 AS rank, citation, section FROM h),
g AS (SELECT question, grp, 'c' || (x * 8 + grp) AS want FROM b, (SELECT unnest(range(8)) AS grp), (SELECT unnest(range(20)) AS x)),
fh AS (SELECT g.question, grp, min(rank) AS rank FROM g LEFT JOIN i ON g.question = i.question AND i.citation = g.want GROUP BY g.question, grp),
m AS (SELECT question, count(*) AS groups, count(rank) AS met, min(rank) AS first, coalesce(sum(1 / log2(rank + 2)), 0) AS gain FROM fh GROUP BY question),
t AS (SELECT question, count(*) AS chunks, arg_min(citation, rank) AS top1 FROM i GROUP BY question),
sr AS (SELECT b.question, round(count(DISTINCT section) / 20::DOUBLE, 9) AS section_recall FROM b LEFT JOIN i ON b.question = i.question AND section IN (SELECT 's' || x * 4 FROM (SELECT unnest(range(20)) AS x)) GROUP BY b.question),
ms AS (SELECT 'q' || user_id AS question, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY user_id)
SELECT b.question, round(met / groups::DOUBLE, 9) AS recall, round(gain / list_sum([1 / log2(x + 2) FOR x IN range(0, least(groups, chunks))]), 9) AS ndcg, round(coalesce(1 / (first + 1)::DOUBLE, 0), 9) AS mrr,
  section_recall, first + 1 AS first_hit_rank, chunks, top1, ms, {_SUBQUERIES} AS subqueries, CASE WHEN b.i % 4 = 0 AND b.i % 10 <> {UNREAD} THEN '2023' END AS as_of,
  b.i % 4 IN (0, 3) AND b.i % 10 <> {UNREAD} AS has_case, CASE WHEN b.i % 10 = {UNREAD} THEN 'unparseable' WHEN b.i % 4 = 2 THEN 'no searchable sub-query' ELSE '' END AS fallback
FROM b LEFT JOIN m ON b.question = m.question LEFT JOIN t ON b.question = t.question LEFT JOIN sr ON b.question = sr.question LEFT JOIN ms ON b.question = ms.question"""


def kept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each sub-query that the shown list holds."""
    _, hits, best = _searched(spark, sf_dir, 8, 4)
    return G.kept(hits, best).select("question", "sq", "key", "citation")


def verifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores against a judge's labels, fitted on either half."""
    p = _labels(spark, sf_dir).withColumn("half", T.half(F.concat(F.lit("r"), "doc_id")))
    two = F.array(F.struct(F.lit("long").alias("model"), F.col("score").alias("s")), F.struct(F.lit("even").alias("model"), F.round((F.col("doc_id") * 37 + F.col("judge").cast("int") * 40) % 101 / 101, 6).alias("s")))
    return M.verifier_report(p.select("half", "judge", F.explode(two).alias("m")).select("half", "judge", "m.model", F.col("m.s").alias("score")), ["model"])


_REPORT = f"""WITH {_LABELS},
p0 AS (SELECT doc_id, judge, score, CASE WHEN position(right(sha256('r' || doc_id), 1) IN '02468ace') > 0 THEN 'tune' ELSE 'report' END AS half FROM l),
p AS (SELECT 'long' AS model, half, judge, score FROM p0 UNION ALL SELECT 'even', half, judge, round((doc_id * 37 + judge::INT * 40) % 101 / 101::DOUBLE, 6) FROM p0),
x AS (SELECT model, half AS part, judge, score FROM p UNION ALL SELECT model, 'all', judge, score FROM p),
g AS (SELECT DISTINCT model, part, round(score, 3) AS t FROM x UNION SELECT DISTINCT model, part, 0.5 FROM x),
c AS (SELECT g.model, g.part, t, count(*) FILTER (WHERE NOT judge AND score < t) AS tp, count(*) FILTER (WHERE judge <> (score >= t)) AS off FROM g JOIN x ON g.model = x.model AND g.part = x.part GROUP BY g.model, g.part, t),
b AS (SELECT *, row_number() OVER (PARTITION BY model, part ORDER BY f1 DESC, t) AS n FROM (SELECT *, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + off) ELSE 0 END, 9) AS f1 FROM c)),
w AS (SELECT model, max(t) FILTER (WHERE part = 'tune') AS threshold, max(t) FILTER (WHERE part = 'report') AS other_way, max(f1) FILTER (WHERE part = 'all') AS ceiling FROM b WHERE n = 1 GROUP BY model),
r AS (SELECT p.model, threshold, other_way, ceiling, count(*) AS judged, count(*) FILTER (WHERE judge) AS good,
  count(*) FILTER (WHERE half = 'report' AND NOT judge AND score < threshold) AS tp1, count(*) FILTER (WHERE half = 'report' AND judge <> (score >= threshold)) AS off1,
  count(*) FILTER (WHERE half = 'tune' AND NOT judge AND score < other_way) AS tp2, count(*) FILTER (WHERE half = 'tune' AND judge <> (score >= other_way)) AS off2 FROM p JOIN w ON p.model = w.model GROUP BY ALL),
f AS (SELECT *, round(CASE WHEN 2 * tp1 + off1 > 0 THEN 2.0::DOUBLE * tp1 / (2 * tp1 + off1) ELSE 0 END, 9) AS report_f1, round(CASE WHEN 2 * tp2 + off2 > 0 THEN 2.0::DOUBLE * tp2 / (2 * tp2 + off2) ELSE 0 END, 9) AS tune_f1 FROM r)
SELECT model, threshold::DOUBLE AS threshold, other_way::DOUBLE AS other_way, judged, round(good / judged::DOUBLE, 9) AS supported, round(2 * good / (good + judged)::DOUBLE, 9) AS accept_all_f1, report_f1, tune_f1, ceiling,
  round((report_f1 + tune_f1) / 2, 9) AS held_out_f1 FROM f"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source read from a layout with a folder for each source."""
    path = new_path(spark, "layout")
    S.write_layout(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), path, "source")
    return spark.read.parquet(path).where("source = 'src1'").select("doc_id", "n_chars", "source")


def upgraded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table from before the late columns, in today's schema."""
    old = _docs(spark, sf_dir).select(F.concat(F.lit("k"), "doc_id").alias("key"), "source", F.col("n_chars").alias("tokens"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"))
    new = S.upgraded(old)
    return new.select("key", "source", "tokens", "recorded_at", (F.col("authority").isNull() & F.col("effective").isNull() & F.col("source_revision").isNull()).alias("empty"))


def tenant_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tenants: one for each customer, a digest in place of the key."""
    asked_for = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("key of "), "c_custkey").alias("key"))
    return U.tenants(asked_for).select("name", "key_sha256", U.is_id(F.col("id")).alias("has_id"))


def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that broke off with some rows saved, resumed: rows that were there are not made again."""
    path = new_path(spark, "progress")
    rows = _docs(spark, sf_dir).select("doc_id", "n_chars")
    rows.where("doc_id % 3 = 0").select("doc_id", F.lit("first").alias("made"), "n_chars").write.parquet(path)
    return S.appended(spark, path, rows, "doc_id", lambda df: df.withColumn("made", F.lit("second")))


def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of earlier runs, used where they come from the same prompt."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("question"), F.explode(F.array(F.lit(0), F.lit(1))).alias("run"), F.coalesce("text", F.lit("")).alias("prompt"))
    was = F.when(F.col("question") % 4 == 0, F.lit("an older prompt")).otherwise(F.col("prompt"))
    cache = d.where("(question + run) % 3 > 0").select("question", "run", F.md5(was.cast("binary")).alias("prompt"), F.concat(F.lit("a"), "question").alias("answer"))
    return S.reusable(d, cache).select("question", "run", "answer")


def results_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results as JSON with a nested summary, read back."""
    path = new_path(spark, "results")
    rows = _labels(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("judge").alias("good"))
    rows.select("lang", F.struct("n", "good", F.create_map(F.lit("share"), F.round(F.col("good") / F.col("n"), 9)).alias("by")).alias("summary")).write.json(path)
    back = spark.read.schema("lang string, summary struct<n:long,good:long,by:map<string,double>>").json(path)
    return back.select("lang", "summary.n", "summary.good", F.element_at("summary.by", "share").alias("share"))


@P.register("letters")
def letters():
    """How often a text holds each letter from a to z, small or capital."""

    def embed(texts: list[str]) -> np.ndarray:
        held = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        small = [np.where((h >= 65) & (h <= 90), h + 32, h) for h in held]
        return np.stack([np.bincount(h[(h >= 97) & (h <= 122)] - 97, minlength=26) for h in small]).astype(np.float32)

    return embed


def provider_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of whole texts from a provider that is called in batches."""
    d = P.embedded(_docs(spark, sf_dir).select("doc_id", "text"), "text", "letters")
    total = F.aggregate(F.col("embedding"), F.lit(0.0), lambda acc, x: acc + x)
    return d.select("doc_id", F.size("embedding").alias("dim"), F.element_at("embedding", 5).cast("long").alias("n_e"), total.cast("long").alias("n_letters"))


_VECTORS = "WITH d AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g')) AS t FROM documents) SELECT doc_id, 26 AS dim, length(t) - length(replace(t, 'e', '')) AS n_e, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_letters FROM d"


def remembered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of benchmark passages with the documents of their number, kept in a table: the second run takes them all from there."""
    path = new_path(spark, "scores")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    pairs = b.join(_docs(spark, sf_dir).select((F.col("doc_id") % 40).alias("item_id"), "doc_id", "text"), "item_id")
    Z.pair_scores(pairs.where("doc_id % 2 = 0"), "query", "text", "lexical", P.lexical_score, path)
    first = pairs.where("doc_id % 3 = 0")
    Z.pair_scores(first, "query", "text", "lexical", lambda q, t: F.lit(-1.0), path)
    return Z.pair_scores(pairs, "query", "text", "lexical", P.lexical_score, path).select("item_id", "doc_id", "score")


_REMEMBERED = """WITH p AS (SELECT item_id, b.text AS query, doc_id, coalesce(d.text, '') AS text FROM benchmark b JOIN documents d ON doc_id % 40 = item_id),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM p),
s AS (SELECT *, round(len(list_intersect(q, list_distinct(w))) / greatest(len(q), 1)::DOUBLE, 9) AS fresh FROM t),
m AS (SELECT query, text, bool_or(doc_id % 2 = 0) AS even, bool_or(doc_id % 3 = 0) AS third FROM s GROUP BY query, text)
SELECT item_id, doc_id, CASE WHEN even OR NOT third THEN fresh ELSE -1.0 END AS score FROM s JOIN m ON s.query = m.query AND s.text = m.text"""


def snapshot_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of title 26 in each of many saved lists of titles, one for each order, a line each."""
    path = new_path(spark, "titles")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 3).alias("lacks"))
    title = lambda n, day: F.struct(F.lit(n).alias("number"), day.cast("string").alias("up_to_date_as_of"))
    titles = F.when(F.col("lacks") == 0, F.array(title(7, F.col("o_orderdate")))).otherwise(F.array(title(7, F.col("o_orderdate")), title(26, F.date_add("o_orderdate", 3))))
    o.select(F.to_json(F.struct(F.col("o_orderkey").alias("list"), titles.alias("titles"))).alias("value")).write.text(path)
    return D.snapshots(spark, path, 26)


def opinion_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of opinions, one array for each supplier and a line each, read."""
    path = new_path(spark, "manifest")
    o = F.struct(F.concat(F.lit("T.C. Memo. 2020-"), "ps.l_partkey").alias("citation"), F.concat(F.lit("Part "), "ps.l_partkey").alias("caseCaption"), F.array(F.lit("deduction"), F.lit("income")).alias("topics"))
    named = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().select("l_suppkey", F.struct("l_partkey").alias("ps"))
    named.groupBy("l_suppkey").agg(F.to_json(F.collect_list(o)).alias("value")).select("value").write.text(path)
    return D.manifest(spark, path, lines=True).select("citation", F.col("caseCaption").alias("caption"), F.size("topics").alias("topics"), F.col("docketNumber").alias("docket"))


def opinion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live chunks by the opinion that they are pages of."""
    d = _docs(spark, sf_dir).select(F.concat(F.lit("T.C. Memo. 2020-"), F.col("doc_id") % 90, F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit(", at *"), "doc_id")).otherwise("")).alias("citation"), F.when(F.col("doc_id") % 9 == 0, "no_text").alias("excluded"))
    return S.payload(d).groupBy(L.opinion_of(F.col("citation")).alias("opinion")).agg(F.count("*").alias("n"))


def opinion_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of type on opinions' pages in reading order: body text, then footnotes; page numbers and headings are left out."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("o"), "conv_id").alias("doc"), F.col("turn").cast("int").alias("page"))
    boxes = [(700.0, 12.2, "Body  text of page {p}"), (500.0, 11.9, "A second para-\ngraph of the body"), (760.0, 18.0, "HEADING"), (90.0, 8.0, "2 note two"), (120.0, 8.1, "1 note one"), (40.0, 12.0, "- 7 -")]
    made = F.array(*[F.struct(F.lit(y - 10).alias("y0"), F.lit(y).alias("y1"), F.lit(size).alias("size"), F.replace(F.lit(text), F.lit("{p}"), F.col("page").cast("string")).alias("text")) for y, size, text in boxes])
    return D.paragraphs(c.select("doc", "page", F.explode(made).alias("b")).select("doc", "page", "b.*"))


_PARAGRAPHS = """SELECT doc, page, (row_number() OVER (PARTITION BY doc ORDER BY page, n))::INT AS seq, text FROM (
  SELECT 'o' || conv_id AS doc, turn::INT AS page, n, replace(said, '{p}', turn::VARCHAR) AS text FROM conversations, (VALUES (1, 'Body text of page {p}'), (2, 'A second paragraph of the body'), (3, '1 note one 2 note two')) v(n, said))"""

QUERIES = {
    "composed_answers": (composed_answers, f"{_MARKED} SELECT answer, text, coalesce(shown, 0) AS shown, coalesce(hidden, 0) AS hidden, concluded FROM an"),
    "job_stages": (job_stages, _STAGES),
    "evaluation_rows": (evaluation_rows, _EVALUATION),
    "kept_hits": (kept_hits, f"WITH {_best_sql(8, 4)} SELECT a.question, a.sq, a.key, a.citation FROM a WHERE a.n <= 8 AND EXISTS (SELECT 1 FROM h WHERE h.question = a.question AND h.citation = a.citation)"),
    "verifier_report": (verifier_report, _REPORT),
    "partitioned_scan": (partitioned_scan, "SELECT doc_id, n_chars, source FROM documents WHERE source = 'src1'"),
    "upgraded_table": (upgraded_table, "SELECT 'k' || doc_id AS key, source, n_chars::INT AS tokens, TIMESTAMP '2024-01-01' AS recorded_at, TRUE AS empty FROM documents"),
    "tenant_row": (tenant_row, "SELECT c_name AS name, sha256('key of ' || c_custkey) AS key_sha256, TRUE AS has_id FROM customer"),
    "resumed_rows": (resumed_rows, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS made, n_chars FROM documents"),
    "answer_cache": (answer_cache, "SELECT doc_id AS question, run, CASE WHEN (doc_id + run) % 3 > 0 AND doc_id % 4 > 0 THEN 'a' || doc_id END AS answer FROM documents, (SELECT unnest([0, 1]) AS run)"),
    "results_written": (results_written, f"WITH {_LABELS} SELECT lang, count(*) AS n, count(*) FILTER (WHERE judge) AS good, round(count(*) FILTER (WHERE judge) / count(*)::DOUBLE, 9) AS share FROM l GROUP BY lang"),
    "provider_vectors": (provider_vectors, _VECTORS),
    "remembered_scores": (remembered_scores, _REMEMBERED),
    "snapshot_date": (snapshot_date, "SELECT o_orderkey AS list, (o_orderdate::DATE + 3)::DATE::VARCHAR AS up_to_date_as_of FROM orders WHERE o_custkey % 3 <> 0"),
    "opinion_manifest": (opinion_manifest, "SELECT 'T.C. Memo. 2020-' || l_partkey AS citation, 'Part ' || l_partkey AS caption, 2 AS topics, NULL::VARCHAR AS docket FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"),
    "opinion_keys": (opinion_keys, "SELECT 'T.C. Memo. 2020-' || (doc_id % 90) AS opinion, count(*) AS n FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1"),
    "opinion_paragraphs": (opinion_paragraphs, _PARAGRAPHS),
}
