"""Many vector searches at once, and routed searches, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import cells as C
from lexloom.operators import retrieval as R


def brute(corpus, asked, k):
    out = {}
    for name, v, sources, sections in asked:
        rows = []
        for key, w, source, section in corpus:
            if v is None or w is None or len(v) != len(w) or not any(v) or not any(w) or any(x is None or not math.isfinite(x) for x in w):
                continue
            if sources and source not in sources or sections and section not in sections:
                continue
            rows.append((round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), key))
        out[name] = sorted(rows, key=lambda x: (-x[0], x[1]))
    return {n: [(key, s) for s, key in rows[:k]] for n, rows in out.items()}, {n: sum(s > 0.3 for s, _ in rows) for n, rows in out.items()}


@pytest.mark.parametrize("small", [False, True])
def test_many_vectors_equal_one_by_one(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(R, "SEARCHES", 4)
        monkeypatch.setattr(R, "ROWS", 16)
    rng, pick = np.random.default_rng(1), random.Random(1)
    corpus = [(int(i), rng.integers(-3, 4, 4).astype(float).tolist(), pick.choice("abc"), pick.choice(["s1", None])) for i in rng.permutation(150)]
    corpus += [(200, None, "a", "s1"), (201, [0.0] * 4, "a", "s1"), (202, [1.0, 2.0], "a", "s1"), (203, [1.0, None, 1.0, 1.0], "a", "s1"), (204, [float("nan")] * 4, "a", "s1"), (205, [], "a", "s1")]
    asked = [(i, rng.integers(-3, 4, 4).astype(float).tolist(), pick.choice([None, [], ["a"], ["b", "c"]]), pick.choice([None, ["s1"]])) for i in range(11)]
    asked += [(20, None, None, None), (21, [0.0] * 4, None, None), (22, [1.0, 2.0], None, None)]
    c = spark.createDataFrame(corpus, "key long, embedding array<double>, source string, section string").repartition(3)
    a = spark.createDataFrame(asked, "search int, embedding array<double>, sources array<string>, sections array<string>")
    want, close = brute(corpus, asked, 6)
    got, near = {}, {}
    for r in R.dense_many(c, a, 6, close=0.3).collect():
        got.setdefault(r["search"], []).append((r["rank"], r["key"], r["score"]))
        near[r["search"]] = r["close"]
    assert {n: [(k, pytest.approx(s, abs=2e-9)) for k, s in rows] for n, rows in want.items() if rows} == {n: [(k, s) for _, k, s in sorted(rows)] for n, rows in got.items()}
    assert near == {n: close[n] for n in got}
    assert R.dense_many(c.limit(0), a).count() == 0 and R.dense_many(c, a.limit(0)).count() == 0


def test_best_of_rows():
    scores = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    row, column = R.best_of(scores, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (1, 1)]
    assert R.best_of(scores, 9)[1].tolist() == [1, 2, 4, 3, 0, 0, 1, 2, 3, 4]


def groups(rng, n, dims=16, around=40):
    centres = rng.normal(size=(around, dims))
    return [(int(i), (centres[i % around] + 0.3 * rng.normal(size=dims)).tolist(), "abc"[i % 3], "s1" if i % 2 else None) for i in range(n)]


def test_cells_hold_every_vector_and_all_visits_are_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "PACK", 16)
    monkeypatch.setattr(C, "BLOCK", 7)
    rng = np.random.default_rng(2)
    corpus = [*groups(rng, 900), (1000, None, "a", "s1"), (1001, [0.0] * 16, "a", "s1"), (1002, [1.0], "a", "s1"), (1003, [float("nan")] * 16, "a", "s1")]
    df = spark.createDataFrame(corpus, "key long, embedding array<double>, source string, section string").repartition(3)
    path = str(tmp_path / "cells")
    C.write_cells(df, path)
    stored = spark.read.parquet(f"{path}/cells")
    assert sorted(k for r in stored.collect() for k in r["keys"]) == list(range(900))
    assert all(len(r["keys"]) <= 16 for r in stored.collect()) and stored.select("cell").distinct().count() == 30
    asked = [(i, v, [None, ["a"], ["b", "c"]][i % 3], [None, ["s1"]][i % 2]) for i, v, *_ in corpus[:40]]
    a = spark.createDataFrame(asked, "search long, embedding array<double>, sources array<string>, sections array<string>")
    exact = {(r["search"], r["rank"], r["key"], r["score"]) for r in R.dense_many(df, a, 5).collect()}
    assert {(r["search"], r["rank"], r["key"], r["score"]) for r in C.search_cells(a, path, 5, visits=10**6).collect()} == exact


def test_measured_visits_reach_the_wanted_share(spark, tmp_path):
    df = spark.createDataFrame(groups(np.random.default_rng(3), 2000), "key long, embedding array<double>, source string, section string")
    path = str(tmp_path / "cells")
    C.write_cells(df, path, share=0.95)
    assert 10 <= C.visits_of(spark, path) < 1000
    rare = df.withColumn("source", F.when(F.col("key") % 50 == 0, "rare").otherwise(F.col("source")))
    C.write_cells(rare, path + "2", share=0.95)
    for sources, df, path in ((None, df, path), ("b", df, path), ("rare", rare, path + "2"), ("none", rare, path + "2")):
        asked = df.select(F.col("key").alias("search"), "embedding", (F.lit(None).cast("array<string>") if sources is None else F.array(F.lit(sources))).alias("sources"))
        if sources == "none":
            assert C.search_cells(asked, path, 10).count() == 0
            continue
        got = C.recall(C.search_cells(asked, path, 10), R.dense_many(df, asked, 10)).agg(F.avg("recall")).first()[0]
        assert got >= 0.9


def test_cells_of_an_empty_collection(spark, tmp_path):
    df = spark.createDataFrame([], "key long, embedding array<double>")
    C.write_cells(df, str(tmp_path / "cells"))
    assert C.search_cells(spark.createDataFrame([(1, [1.0])], "search long, embedding array<double>"), str(tmp_path / "cells"), 5).count() == 0


def test_a_task_multiplies_few_questions_at_once():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    rng = np.random.default_rng(0)
    asked, held = rng.normal(size=(R.SEARCHES, 16)), rng.normal(size=(R.ROWS, 16))
    schema = StructType([StructField("search", LongType()), StructField("key", LongType()), StructField("score", DoubleType()), StructField("close", LongType())])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(held))), pa.array(held.tolist())], names=["key", "embedding"])
    run = R._nearest(SimpleNamespace(value=([(i, None, None) for i in range(len(asked))], asked)), 16, 3, 0.3, [], schema)
    tracemalloc.start()
    best, counts = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cosine = np.round((asked / np.linalg.norm(asked, axis=1)[:, None]) @ (held / np.linalg.norm(held, axis=1)[:, None]).T, 9)
    assert peak < 60e6
    assert counts.column(3).to_pylist() == (cosine > 0.3).sum(axis=1).tolist()
    assert np.allclose(np.array(best.column(2)).reshape(-1, 3), -np.sort(-cosine, axis=1)[:, :3], atol=2e-9)


def test_searches_of_cells_shuffle_hits_alone(spark, tmp_path):
    corpus = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1]) for i in range(60)], "key long, embedding array<double>")
    C.write_cells(corpus, str(tmp_path / "c"), cells=4)
    found = C.search_cells(corpus.selectExpr("key as search", "embedding"), str(tmp_path / "c"), 3, visits=1 << 60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1
    assert found.count() == 180


def test_packed_rows_of_a_cell_are_joined():
    import pyarrow as pa

    def row(cell, first, n):
        keys = list(range(first, first + n))
        held = [pa.array([cell], pa.int32()), pa.array([keys]), pa.array([np.array(keys, "<f8").repeat(2).tobytes()], pa.binary()), pa.array([["a"] * n]), pa.array([[None] * n], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(held, names=["cell", "keys", "vectors", "sources", "sections"])

    rows = [row(0, 0, 3), row(1, 3, 7), row(1, 10, 7), row(1, 17, 4), row(2, 21, 2), row(2, 23, 1), row(3, 24, 10)]
    whole = pa.Table.from_batches(rows).combine_chunks().to_batches()
    got = list(C._packed(10)(iter([*whole[0:1]])))
    assert [(b.column(0)[0].as_py(), len(b.column(1)[0])) for b in got] == [(0, 3), (1, 10), (1, 8), (2, 3), (3, 10)]
    assert [k for b in got for k in b.column(1)[0].as_py()] == list(range(34))
    assert np.concatenate([np.frombuffer(b.column(2)[0].as_py(), "<f8") for b in got]).tolist() == [float(i) for i in range(34) for _ in range(2)]


@pytest.mark.parametrize("close", [None, 0.5])
def test_best_scores_again_only_what_can_be_among_the_best(close):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[100:160], x[1500:1600] = x[7], x[7] * (1 + 1e-12)  # equal scores, within a batch and over batches
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked, seen = x[:300], []
    best = R.Best(asked, 5, close)
    exact = best._exact
    best._exact = lambda which, x, row, column: seen.append(len(row)) or exact(which, x, row, column)
    for at in range(0, 3000, 500):
        best.meet(np.arange(300), x[at : at + 500], x[at : at + 500].astype(np.float32), pa.array(range(at, at + 500)))
    best.settle()
    scores = np.round(np.einsum("id,jd->ij", asked, x), 9)
    want = [sorted(range(3000), key=lambda j: (-scores[i, j], j))[:5] for i in range(300)]
    assert np.array(best.keys).reshape(300, 5).tolist() == want
    assert np.allclose(best.scores.reshape(300, 5), [scores[i, w] for i, w in enumerate(want)], atol=2e-9)
    assert sum(seen) < 300 * 3000 / 10
    if close:
        assert best.near.tolist() == (scores > close).sum(axis=1).tolist()


def test_blocks_of_searches_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(R, "SEARCHES", 4)
    df = spark.createDataFrame([(i, [float(i)] * (i % 3)) for i in range(23)], "search long, embedding array<double>").repartition(3)
    blocks = list(R.opened(df.mapInArrow(R.sealed, "rows binary")))
    assert all(b.num_rows == 4 for b in blocks[:-1]) and sum(b.num_rows for b in blocks) == 23
    assert sorted((s, v) for b in blocks for s, v in zip(b.column("search").to_pylist(), b.column("embedding").to_pylist(), strict=True)) == [(i, [float(i)] * (i % 3)) for i in range(23)]
