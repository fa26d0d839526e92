"""Filtered top-k by exact cosine, BM25 and reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lexloom.session import materialise, ship

#: Rows that each branch hands to fusion, and the constant of fusion.
PREFETCH, RRF = 50, 60
K1, B = 1.2, 0.75
#: Questions that are broadcast together, and of them and of vectors how many are multiplied at once.
SEARCHES, ASKED, ROWS = 4096, 256, 2048


def source_filter(df: DataFrame, sources: str | list[str] | tuple[str, ...] | None, column: str = "source") -> DataFrame:
    """Rows of one source or several; nothing given, empty lists too, means no filter."""
    if not sources:
        return df
    return df.where(F.col(column).isin([sources] if isinstance(sources, str) else list(sources)))


def edition_filter(df: DataFrame, year: int, back: int, forward: int, column: str = "edition") -> DataFrame:
    """Rows without an edition, or with one in [year - back, year + forward]."""
    return df.where(F.col(column).isNull() | F.col(column).between(year - back, year + forward))


def conjunctive(df: DataFrame, sources=None, tenant: str | None = None, sections: list[str] | None = None, year: int | None = None, editions: tuple[int, int] | None = None, tenanted: bool = False) -> DataFrame:
    """All filters of a search; a tenants' table is never searched without a tenant."""
    if tenanted and not tenant:
        raise ValueError("a tenants' collection needs a tenant")
    df = source_filter(df, sources)
    if tenant:
        df = df.where(F.col("tenant") == tenant)
    if sections:
        df = df.where(F.col("section").isin(list(sections)))
    return edition_filter(df, year, *editions) if year is not None and editions is not None else df


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 9)


def vector(df: DataFrame, key: str, value: int | str, column: str = "embedding") -> Column:
    """One row's vector as a literal: a query vector, a few dozen numbers."""
    row = df.where(F.col(key) == value).select(column).first()
    return F.array(*[F.lit(float(x)) for x in row[0]])


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest of each row, equal ones by column, in that order."""
    n = scores.shape[1]
    if n > k:
        limit = np.partition(scores, n - k, axis=1)[:, n - k]
        row, column = np.nonzero(scores >= limit[:, None])
    else:
        row, column = np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def _unit(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are whole vectors of dims numbers with a direction, and these at length 1."""
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, np.diff(column.offsets.to_numpy()))
    ends = np.cumsum(np.maximum(sizes, 0))
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")))
    rows = np.flatnonzero(sizes == dims)
    held = values[(ends[rows] - dims)[:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims))
    norm = np.sqrt((held * held).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], held[good] / norm[good, None]


def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch, SEARCHES rows of it at most, as one row of bytes: the driver takes blocks of searches without making each row an object."""
    for whole in batches:
        for at in range(0, whole.num_rows, SEARCHES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_batch(whole.slice(at, SEARCHES))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def opened(rows: DataFrame) -> Iterator[pa.Table]:
    """What was sealed, SEARCHES rows at a time: what the driver and a broadcast hold is bounded."""
    held: list[pa.Table] = []
    for r in rows.toLocalIterator():
        held.append(pa.ipc.open_stream(r["rows"]).read_all())
        while sum(t.num_rows for t in held) >= SEARCHES:
            whole = pa.concat_tables(held)
            yield whole.slice(0, SEARCHES).combine_chunks()
            held = [whole.slice(SEARCHES)]
    if sum(t.num_rows for t in held):
        yield pa.concat_tables(held).combine_chunks()


def column_of(block: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(block.column(name).chunks)


class Best:
    """The k best vectors of each of some searches, of those that a task meets in batches.

    A product in single precision passes over what is below a search's k-th best so far by more than the worst rounding error; what is left
    is scored again in double precision, to 9 decimals. Equal scores go by key. With close, near counts the vectors of a cosine over close.
    """

    def __init__(self, vectors: np.ndarray, k: int, close: float | None = None):
        self.vectors, self.single, self.k, self.close = vectors, vectors.astype(np.float32), k, close
        self.margin = (vectors.shape[1] + 8) * 2.0**-23
        self.least, self.near = np.full(len(vectors), -np.inf), np.zeros(len(vectors), np.int64)
        self.search, self.keys, self.scores = np.zeros(0, np.int64), None, np.zeros(0)
        self.new: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.pending = 0

    def _exact(self, which: np.ndarray, x: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(row)), max(1, (1 << 19) // x.shape[1])
        for at in range(0, len(row), step):
            of = slice(at, at + step)
            out[of] = np.einsum("ij,ij->i", self.vectors[which[row[of]]], x[column[of]])
        return np.round(out, 9)

    def meet(self, which: np.ndarray, x: np.ndarray, single: np.ndarray, keys: pa.Array) -> None:
        """Some searches meet unit vectors x, which stand in the order of their keys."""
        s, k = self.single[which] @ single.T, self.k
        if self.close is not None:
            self.near[which] += np.count_nonzero(s > self.close + self.margin, axis=1)
            row, column = np.divmod(np.flatnonzero(np.abs(s - np.float32(self.close)) <= 2 * self.margin), len(x))
            row, column = (v[s[row, column] <= self.close + self.margin] for v in (row, column))
            self.near[which] += np.bincount(row[self._exact(which, x, row, column) > self.close], minlength=len(which))
        cut = (self.least[which] - self.margin).astype(np.float32)
        over = s >= cut[:, None]
        if len(x) > k and np.count_nonzero(over) > 8 * k * len(which):
            many = np.flatnonzero(np.count_nonzero(over, axis=1) > 4 * k)
            edge = np.partition(s[many], len(x) - k, axis=1)[:, len(x) - k] - 2 * self.margin
            over[many] &= s[many] >= edge[:, None]
        row, column = np.divmod(np.flatnonzero(over), len(x))
        if not len(row):
            return
        score = self._exact(which, x, row, column)
        held = score >= self.least[which[row]]
        row, column, score = row[held], column[held], score[held]
        order = np.lexsort((column, -score, row))
        order = order[np.arange(len(order)) - np.searchsorted(row, row) < k]
        self.new.append((which[row[order]], keys.take(pa.array(column[order])), score[order]))
        self.pending += len(order)
        if self.pending >= max(len(self.vectors) * k, 1 << 14):
            self.settle()

    def settle(self) -> None:
        """Only the k best of each search stay; the last of them is its threshold."""
        if not self.new:
            return
        held = [] if self.keys is None else [(self.search, self.keys, self.scores)]
        search, keys, scores = zip(*held, *self.new, strict=True)
        search, keys, scores = np.concatenate(search), pa.concat_arrays(keys), np.concatenate(scores)
        order = np.lexsort((pc.rank(keys, tiebreaker="dense").to_numpy(), -scores, search))
        place = np.arange(len(order)) - np.searchsorted(search[order], search[order])
        order, place = order[place < self.k], place[place < self.k]
        self.search, self.keys, self.scores = search[order], keys.take(pa.array(order)), scores[order]
        last = place == self.k - 1
        self.least[self.search[last]] = self.scores[last]
        self.new, self.pending = [], 0


def dense_many(corpus: DataFrame, asked: DataFrame, k: int = PREFETCH, close: float | None = None) -> DataFrame:
    """search, key, score, rank of the k nearest by exact cosine for each of asked(search, embedding) in corpus(key, embedding).

    asked may name the sources and sections, arrays, that it searches; corpus then has source and section. A task multiplies its
    vectors with a block of questions, which is broadcast, and hands on the best k of each question alone. A question without a vector, or
    whose vector has no direction, finds nothing. With close, the column of that name counts the vectors of a cosine over close.
    """
    spark = corpus.sparkSession
    ship(spark)
    tags = [c for c in ("source", "section") if c in corpus.columns]
    kinds = {"search": asked.schema["search"].dataType, "key": corpus.schema["key"].dataType}
    schema = StructType([StructField("search", kinds["search"]), StructField("key", kinds["key"]), StructField("score", DoubleType()), StructField("close", LongType())])
    names = [c for c in ("sources", "sections") if c in asked.columns]
    df, out = corpus.select("key", "embedding", *tags), None
    asked = asked.where("embedding is not null").select("search", F.col("embedding").cast("array<double>").alias("embedding"), *names)
    for n, block in enumerate(opened(asked.mapInArrow(sealed, "rows binary"))):
        if n == 1:
            df = materialise(df, "corpus")  # read again for each block
        values = column_of(block, "embedding")
        sizes = pc.list_value_length(values).to_numpy()
        for dims in np.unique(sizes[sizes > 0]).tolist():
            rows = block.take(pa.array(np.flatnonzero(sizes == dims)))
            lists = [[tuple(v) if v else None for v in rows.column(c).to_pylist()] if c in names else [None] * rows.num_rows for c in ("sources", "sections")]
            flat = column_of(rows, "embedding").flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
            held = spark.sparkContext.broadcast((list(zip(rows.column("search").to_pylist(), *lists, strict=True)), flat.reshape(-1, dims)))
            one = df.mapInArrow(_nearest(held, dims, k, close, tags, schema), schema)
            out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = out.where(F.col("key").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    if close is None:
        return best.drop("close")
    counts = out.where(F.col("close").isNotNull()).groupBy("search").agg(F.sum("close").alias("close"))
    return best.drop("close").join(counts, "search")


def _nearest(held, dims: int, k: int, close: float | None, tags: list[str], schema: StructType):
    """Over the batches of a task: the best k of each question, and how many are close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, vectors = held.value
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        able = np.isfinite(norm) & (norm > 0)
        best = Best(vectors / np.where(able, norm, 1)[:, None], k, close)
        known: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(able).tolist():
            known.setdefault(wanted[i][1:], []).append(i)
        groups = [(filters, np.array(own)) for filters, own in known.items()]
        kinds = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                b = b.take(pc.array_sort_indices(b.column(0)))
                rows, x = _unit(b.column(1), dims)
                if not len(rows):
                    continue
                keys, single = b.column(0).take(pa.array(rows)), x.astype(np.float32)
                for filters, own in groups:
                    seen = np.ones(len(rows), bool)
                    for c, allowed in zip(("source", "section"), filters, strict=True):
                        if allowed is not None:
                            seen &= pc.is_in(b.column(2 + tags.index(c)), pa.array(allowed)).to_numpy(zero_copy_only=False)[rows]
                    if not seen.any():
                        continue
                    some = (x, single, keys) if seen.all() else (x[seen], single[seen], keys.filter(pa.array(seen)))
                    for first in range(0, len(own), ASKED):
                        best.meet(own[first : first + ASKED], *some)
        best.settle()
        names = pa.array([w[0] for w in wanted], kinds.field("search").type)
        if best.keys is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.search)), best.keys, pa.array(best.scores), pa.nulls(len(best.search), pa.int64())], schema=kinds)
        if close is not None:
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), kinds.field("key").type), pa.nulls(len(names), pa.float64()), pa.array(best.near)], schema=kinds)

    return run


def dense_topk(df: DataFrame, query: Column, k: int = PREFETCH, key: str = "key", column: str = "embedding") -> DataFrame:
    """key, score, rank of the k nearest by exact cosine."""
    return ranked(df.select(key, cosine(F.col(column), query).alias("score")), k, key)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25_topk(df: DataFrame, terms: list[str], k: int = PREFETCH, key: str = "key", text: str = "text") -> DataFrame:
    """key, score, rank of the k best for a few query terms. One scan counts terms in place; nothing is exploded."""
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    held = df.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), *[count(w).alias(f"tf{i}") for i, w in enumerate(terms)])
    total = held.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = held.join(F.broadcast(total))  # one row of sums
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, n, d = F.col(f"tf{i}"), F.col("n"), F.col(f"df{i}")
        score = score + F.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    # rows without a term are dropped by their score: a filter on the counts would move to the scan and count again there
    return ranked(joined.select(key, F.round(score, 9).alias("score")).where("score > 0"), k, key)


def ranked(df: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The k best by (score descending, key), with their rank from 1. Only these rows are numbered."""
    top = df.orderBy(F.desc("score"), F.asc(key)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))))


def fuse_many(branches: list[DataFrame], constant: int = RRF) -> DataFrame:
    """search, key, rrf, branches: each search's hits in any branch, by the sum of 1 / (constant + rank)."""
    both = branches[0].select("search", "key", "rank")
    for b in branches[1:]:
        both = both.unionByName(b.select("search", "key", "rank"))
    return both.groupBy("search", "key").agg(F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 12).alias("rrf"), F.count("*").alias("branches"))


def fuse(branches: list[DataFrame], k: int, key: str = "key", constant: int = RRF) -> DataFrame:
    """key, rrf, branches of the k best by the sum of 1 / (constant + rank)."""
    both = branches[0].select(key, "rank")
    for b in branches[1:]:
        both = both.unionByName(b.select(key, "rank"))
    summed = both.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 12).alias("rrf"), F.count("*").alias("branches"))
    return summed.orderBy(F.desc("rrf"), F.asc(key)).limit(k)


def rerank(hits: DataFrame, scores: DataFrame, k: int, key: str = "key") -> DataFrame:
    """Hits with the scores of a table (key, score) in place of their own; the best k."""
    return ranked(hits.drop("score", "rank").join(scores.select(key, "score"), key), k, key)


def filtered_recall(approximate: Column, exact: Column) -> Column:
    """The share of an exact result that an approximate one holds."""
    return F.size(F.array_intersect(approximate, exact)) / F.size(exact)
