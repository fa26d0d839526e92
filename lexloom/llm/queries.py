"""One query for each training-data operator, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import centroids, exact_dedup, mixing, near_dedup, pii, quality, runs, secret_scan, sentence_pieces, token_counts, token_store, topk, vector_dedup
from lexloom.session import new_path


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(_docs(spark, sf_dir), labels)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 1024)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_docs(spark, sf_dir), shingle_words=2, percent=80)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir, "source"), repeats=2.0, budget=1.0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_docs(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_docs(spark, sf_dir))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_store(_docs(spark, sf_dir), tokenizer("word_bpe_49k.json"), path, end=2)
    return token_store.read_store(spark, path)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_decode(_docs(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose doc_id is divisible by 20, as a query against all documents."""
    docs = _docs(spark, sf_dir)
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return topk.search(topk.build_index(docs), asked, k=10)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_docs(spark, sf_dir), endings=True, texts=False)
    best = ("start", "length", "period")
    exponent = F.expr("1000 * length div period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", *best, exponent, "runs_sha256", "collapsed_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, dims=64, scale=256, seed=2)


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_token_counts, op3_near_dedup, op4_exact_dedup, op5_mixing, op6_pii, op7_secrets, op8_token_store, op9_sentence_pieces, op10_topk, op11_runs, op12_centroids, op13_vector_dedup, pipeline)}


_OP4 = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id)
"""

#: The bisection of op5 in 50 steps over a table of source shares.
_OP5 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
src AS (SELECT name, sum(n_tokens)::BIGINT AS tokens FROM sized GROUP BY name),
share AS (SELECT name, tokens, tokens / (sum(tokens) OVER ())::DOUBLE AS p FROM src WHERE tokens > 0),
bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN f <= 2.0 THEN lo ELSE mid END, CASE WHEN f <= 2.0 THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT max(pow(p, (lo + hi) / 2 - 1)) / sum(pow(p, (lo + hi) / 2)) FROM share) AS f
        FROM bis WHERE i < 50)),
alpha AS (SELECT CASE WHEN (SELECT pow(min(p), -1) / count(*) FROM share) <= 2.0 THEN 0.0 ELSE (SELECT hi FROM bis WHERE i = 50) END AS a),
w AS (SELECT name, tokens, pow(p, a) / sum(pow(p, a)) OVER () AS weight FROM share, alpha),
q AS (SELECT src.name, src.tokens, coalesce(weight, 0.0) AS weight,
             CASE WHEN src.tokens > 0 THEN round(weight * (SELECT sum(tokens) FROM src), 3) ELSE 0.0 END AS quota,
             least(8192, greatest(1, ceil(src.tokens / 16384.0)))::BIGINT AS blocks
      FROM src LEFT JOIN w ON src.name = w.name),
r AS (SELECT *, CASE WHEN tokens > 0 THEN floor(quota / tokens) ELSE 1 END::BIGINT AS passes FROM q),
l AS (SELECT *, CASE WHEN tokens > 0 THEN round(quota - passes * tokens, 3) ELSE 0.0 END AS rest FROM r),
placed AS (
  SELECT sized.*, weight, passes, rest, turn, turn % blocks AS block
  FROM (SELECT *, ('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS turn FROM sized) sized JOIN l ON sized.name = l.name),
held AS (SELECT name, block, sum(n_tokens)::BIGINT AS held FROM placed GROUP BY name, block),
plan AS (
  SELECT name, block, row_number() OVER o AS block_rank, (sum(held) OVER o)::BIGINT AS until, (sum(held) OVER o - held)::BIGINT AS since
  FROM held WINDOW o AS (PARTITION BY name ORDER BY ('0x' || substr(md5('1|' || name || '|' || block::VARCHAR), 1, 15))::BIGINT, block)),
cut AS (
  SELECT placed.*, block_rank, until, since,
         since + sum(n_tokens) OVER (PARTITION BY placed.name, placed.block ORDER BY turn // 8192, turn, doc_id ROWS UNBOUNDED PRECEDING) AS sofar
  FROM placed JOIN plan ON placed.name = plan.name AND placed.block = plan.block)
SELECT doc_id, source, n_tokens, weight, block, block_rank,
       passes + CASE WHEN until <= rest OR since < rest AND sofar <= rest THEN 1 ELSE 0 END AS n_copies
FROM cut
"""


_OP10 = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents)::DOUBLE AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS w
      FROM tf JOIN dl ON tf.doc_id = dl.doc_id JOIN df ON tf.term = df.term, st),
s AS (SELECT q.doc_id AS query_id, w.doc_id, round(sum(w), 6) AS score
      FROM tf q JOIN w ON q.term = w.term WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, w.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10
"""


def _op12(rounds: int = 5, k: int = 40) -> str:
    """SQL of the clustering, a pair of tables for each round."""
    near = "(SELECT vec_id, vec, j AS cluster, d AS distance FROM (SELECT vec_id, vec, j, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(vec, c)])::BIGINT AS d FROM kept, c{i}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)"
    parts = [
        "kept AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS vec FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS j, vec AS c FROM kept QUALIFY j < {k})",
    ]
    for i in range(rounds):
        mean = "CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END"
        parts += [
            f"a{i} AS MATERIALIZED {near.format(i=i)}",
            f"m{i} AS (SELECT cluster, list({mean} ORDER BY place)::BIGINT[] AS c FROM (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS place FROM a{i}) GROUP BY cluster, place) GROUP BY cluster)",
            f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON m.cluster = o.j)",
        ]
    parts.append(f"last AS {near.format(i=rounds)}")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN c{rounds} ON j = cluster
"""


_OP13 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, len(embedding) AS d FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op4_exact_dedup": _OP4, "op5_mixing": _OP5, "op10_topk": _OP10, "op12_centroids": _op12(), "op13_vector_dedup": _OP13, **whole}
