"""Routed retrieval: each sub-query of a plan searched in the sources of its kind, with its expansions pooled.

plans(question, sq, kind, asked, query): asked holds the question's own words, query the sub-query's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import ROUTES
from lexloom.operators import lexical as X
from lexloom.operators import retrieval as R
from lexloom.operators.ranking import append_new, first_n
from lexloom.operators.retrieval import PREFETCH
from lexloom.session import materialise

SIBLING_SECTIONS = 3


def allowed(kind: Column, source: Column) -> Column:
    """Whether a kind of sub-query may search a source; unrouted ones search all, client facts none."""
    out = kind == "unrouted"
    for k, sources in ROUTES.items():
        out = out | ((kind == k) & source.isin(sources))
    return out


def searched(plans: DataFrame) -> DataFrame:
    return plans.where("kind <> 'client_fact'")


def facts(plans: DataFrame) -> DataFrame:
    return plans.where("kind = 'client_fact'").select("question", "sq", "query")


def hybrid(corpus: DataFrame, index: str, prefetch: int = PREFETCH) -> Callable[[DataFrame], DataFrame]:
    """A search of many questions: asked(search, terms, embedding, sources, sections) to search, key, score, by vectors and words.

    corpus(key, embedding, source, section) holds the vectors that there are, index is the folder of the lexical index of all texts.
    """

    def search(asked: DataFrame) -> DataFrame:
        branches = [R.dense_many(corpus, asked, prefetch), X.search_many(asked, index, prefetch)]
        return R.fuse_many(branches).select("search", "key", F.col("rrf").alias("score"))

    return search


def _once(requests: DataFrame, search: Callable[[DataFrame], DataFrame], words: DataFrame, labels: DataFrame) -> DataFrame:
    """requests with their hits, place being the hit's: requests of the same text, sources and sections share one search.

    requests(question, sq, kind, base, text, sources, sections, n); words(text, terms, embedding); labels(key, citation, section, source).
    Equal scores are ordered by citation, then key, before each request takes its n.
    """
    requests = materialise(requests.withColumn("search", F.xxhash64("text", F.coalesce("sources", F.array()), F.coalesce("sections", F.array()))), "requests")
    asked = requests.groupBy("search").agg(*[F.first(c).alias(c) for c in ("text", "sources", "sections")], F.max("n").alias("most"))
    found = search(materialise(asked.join(words, "text"), "asked").select("search", "terms", "embedding", "sources", "sections"))
    hits = found.join(labels, "key")
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "citation", "key")))
    best = materialise(best.join(asked.select("search", "most"), "search").where("place <= most").drop("most"), "found")
    both = requests.select("question", "sq", "kind", "base", "n", "search").join(best, "search").where("place <= n")
    return both.select("question", "sq", "kind", "base", (F.col("place") + F.col("base")).alias("ord"), "key", "citation", "section", "source", "score")


def _pooled(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra hits go behind those of the same sub-query that they do not repeat."""
    tag = lambda df: df.withColumn("_q", F.col("question")).withColumn("question", F.concat_ws("|", "question", F.col("sq").cast("string")))
    return append_new(tag(hits), tag(extra)).drop("question").withColumnRenamed("_q", "question")


def retrieve(plans: DataFrame, search: Callable[[DataFrame], DataFrame], words: DataFrame, labels: DataFrame, k: int = 8, statute: int = 0, planned: int = 0, siblings: int = 0) -> tuple[DataFrame, DataFrame]:
    """Hits of every searched sub-query, (question, sq, kind, ord, key, citation, section, source, score), and pinned citations.

    The question's own words search; statute adds a search of the statute alone to statutory sub-queries; planned adds and
    pins that many statute hits of the sub-query's own text; siblings searches again within the first sections found.
    All questions are searched together, and a text is searched once in the same sources.
    """
    plans = searched(plans)
    routes = F.create_map(*[x for kind, sources in ROUTES.items() for x in (F.lit(kind), F.array(*map(F.lit, sources)))])
    none = F.lit(None).cast("array<string>")
    usc = F.array(F.lit("usc"))

    def ask(df: DataFrame, text: str, sources: Column, n: int, base: int) -> DataFrame:
        return df.select("question", "sq", "kind", F.lit(base).alias("base"), F.col(text).alias("text"), sources.alias("sources"), none.alias("sections"), F.lit(n).alias("n"))

    statutory = plans.where("kind = 'statutory'")
    requests = ask(plans, "asked", routes[F.col("kind")], k, 0)
    if statute:
        requests = requests.unionByName(ask(statutory, "asked", usc, k, 1000))
    if planned:
        requests = requests.unionByName(ask(statutory, "query", usc, planned, 2000))
    every = _once(requests, search, words, labels)
    hits, pinned = every.where("base = 0").drop("base"), every.select("question", "citation").where("false")
    if statute:
        hits = _pooled(hits, every.where("base = 1000").drop("base"))
    if planned:
        own = every.where("base = 2000").drop("base")
        hits, pinned = _pooled(hits, own), own.select("question", "citation").distinct()
    if siblings:
        hits = materialise(hits, "hits")
        found = hits.where("kind = 'statutory' and source in ('usc', 'ecfr')").groupBy("question", "sq", "section").agg(F.min("ord").alias("at"))
        first = first_n(found, ["question", "sq"], [F.asc("at")], SIBLING_SECTIONS)
        first = first.withColumn("n", F.row_number().over(Window.partitionBy("question", "sq").orderBy("at"))).join(statutory.select("question", "sq", "kind", "asked"), ["question", "sq"])
        both = F.array(F.lit("usc"), F.lit("ecfr"))
        more = first.select("question", "sq", "kind", (2900 + 100 * F.col("n")).cast("int").alias("base"), F.col("asked").alias("text"), both.alias("sources"), F.array("section").alias("sections"), F.lit(siblings).alias("n"))
        hits = _pooled(hits, _once(more, search, words, labels).drop("base"))
    return hits, pinned


def client_hits(asked: DataFrame, scored: DataFrame, k: int = 3) -> DataFrame:
    """Hits in a tenant's own documents for each fact, then the question: asked(question, n, text); each citation once."""
    best = first_n(asked.join(scored, ["question", "text"]), ["question", "n"], [F.desc("score"), F.asc("citation"), F.asc("key")], k)
    return first_n(best, ["question", "citation"], [F.asc("n"), F.desc("score")], 1).select("question", "n", "key", "citation", "score")


def sufficient(parts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """parts(question, sq) with whether they are kept: a part without a verdict is."""
    return parts.join(verdicts, ["question", "sq"], "left").withColumn("keep", F.coalesce("sufficient", F.lit(True))).drop("sufficient")


def kept(hits: DataFrame, shown: DataFrame) -> DataFrame:
    """Each sub-query's hits whose citations are among those shown for the question."""
    return hits.join(shown.select("question", "citation").distinct(), ["question", "citation"], "left_semi")
