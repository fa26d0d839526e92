"""The stored index against BM25 by one scan, and what needs a shared folder."""

import math
import random
import re

import pytest

from lexloom import session
from lexloom.operators import lexical as X
from lexloom.operators import retrieval as R

TEXTS = ["the cat and the dog", "The CAT", None, "", "dog dog dog 42", "nothing of that", "cat cat dog the"]


@pytest.mark.parametrize("terms", [["cat", "dog"], ["the"], ["absent"], ["dog", "absent", "42", "dog"]])
def test_index_gives_what_a_scan_gives(spark, tmp_path, terms):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string").repartition(3)
    X.write_index(docs, str(tmp_path / "x"))
    got = X.search_index(spark, str(tmp_path / "x"), terms, 4).collect()
    assert got == R.bm25_topk(docs, list(dict.fromkeys(terms)), 4).collect()


def test_empty_collection(spark, tmp_path):
    X.write_index(spark.createDataFrame([("k", None)], "key string, text string"), str(tmp_path / "x"))
    assert (tmp_path / "x" / "totals").exists()


def test_a_query_reads_the_row_groups_of_its_terms(spark, tmp_path):
    X.write_index(spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string"), str(tmp_path / "x"))
    plan = X.search_index(spark, str(tmp_path / "x"), ["cat"], 4)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,cat)" in plan or "PushedFilters: [In(term, [cat])" in plan
    assert "places" not in plan.rpartition("ReadSchema")[2]


def test_an_index_is_built_anew_when_its_files_change(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    put = lambda rows, mode: spark.createDataFrame(rows, "key long, text string").write.mode(mode).parquet(path)
    docs = lambda: spark.read.parquet(path)
    put([(1, "old words")], "error")
    first = X.index_of(spark, [path], docs)
    assert X.index_of(spark, [path], docs) == first
    put([(2, "new words")], "append")
    second = X.index_of(spark, [path], docs)
    assert second != first
    assert [r["key"] for r in X.search_index(spark, second, ["new"]).collect()] == [2]


def brute_bm25(docs, terms, sources=None, sections=None):
    cut = {k: re.findall("[a-z0-9]+", (t or "").lower()) for k, t, *_ in docs}
    n, mean = len(docs), sum(map(len, cut.values())) / max(len(docs), 1) or 1.0
    out = {}
    for key, _, source, section in docs:
        if sources and source not in sources or sections and section not in sections:
            continue
        score = 0.0
        for t in dict.fromkeys(terms):
            df, tf = sum(t in c for c in cut.values()), cut[key].count(t)
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(cut[key]) / mean)) if df else 0.0
        if score > 0:
            out[key] = round(score, 9)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def collection(n=300):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice("abc"), rng.choice(["s1", "s2", None])) for i in range(n)]
    return [*docs, (n, None, "a", "s1"), (n + 1, "", None, None), (n + 2, docs[0][1], docs[0][2], docs[0][3])]


@pytest.mark.parametrize("shard", [8192, 40])
def test_many_questions_equal_one_by_one(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(X, "BLOCK", 5)
    docs, rng = collection(), random.Random(5)
    X.write_index(spark.createDataFrame(docs, "key long, text string, source string, section string"), str(tmp_path / "x"), shard=shard)
    asked = [(f"q{i}", [rng.choice(["w1", "w2", "the", "w7", "none"]) for _ in range(rng.randint(0, 6))], rng.choice([None, [], ["a"], ["a", "c"]]), rng.choice([None, ["s1"]])) for i in range(23)]
    got = {}
    for r in X.search_many(spark.createDataFrame(asked, "search string, terms array<string>, sources array<string>, sections array<string>"), str(tmp_path / "x"), 7).collect():
        got.setdefault(r["search"], []).append((r["rank"], r["key"], r["score"]))
    for name, terms, sources, sections in asked:
        want = brute_bm25(docs, terms, sources, sections)[:7]
        assert [(k, s) for _, k, s in sorted(got.get(name, []))] == [(k, pytest.approx(s, abs=2e-9)) for k, s in want]


def brute_covers(text, groups):
    """Every stretch that meets all groups and holds no smaller one that does."""
    at = [(i, w) for i, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower())) if any(w in g for g in groups)]
    met = [(a, b) for a in range(len(at)) for b in range(a, len(at)) if all(any(w in g for _, w in at[a : b + 1]) for g in groups)]
    least = [(a, b) for a, b in met if not any((c, d) != (a, b) and a <= c and d <= b for c, d in met)]
    return sum(0.1 / (1 + at[b][0] - at[a][0] - (b - a)) for a, b in least)


@pytest.mark.parametrize("shard", [8192, 40])
def test_covers_equal_brute_force(spark, tmp_path, shard):
    docs = collection(120)
    X.write_index(spark.createDataFrame(docs, "key long, text string, source string, section string"), str(tmp_path / "x"), shard=shard)
    groups = [[["w1"]], [["w1"], ["w2"]], [["w1", "w3"], ["the"]], [["the"], ["w4"], ["w5", "w6"]], [["none"], ["the"]], [["w1", "the"], ["w1", "w9"]]]
    asked = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "search int, groups array<array<string>>")
    got = {(r["search"], r["key"]): r["score"] for r in X.search_covers(asked, str(tmp_path / "x"), 1000).collect()}
    want = {(i, k): brute_covers(t, g) for i, g in enumerate(groups) for k, t, *_ in docs}
    want = {x: s for x, s in want.items() if s}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(s, abs=2e-9) for x, s in want.items())
    assert len(want) > 150


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session())


def test_shards_are_bounded_in_characters_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "CHARS", 500)
    docs = [(i, f"w{i % 3} the " * 40) for i in range(12)] + [(0, "again w0")]
    path = str(tmp_path / "x")
    X.write_index(spark.createDataFrame(docs, "key long, text string"), path)
    rows = spark.read.parquet(f"{path}/postings").collect()
    assert len({r["shard"] for r in rows}) > 3
    assert all(r["n"] == len(r["keys"]) == len(set(r["keys"])) and [len(p) for p in r["places"]] == r["tf"] for r in rows)
    assert sum(sum(r["tf"]) for r in rows) == 12 * 80 + 2
    assert next(r["tf"][r["keys"].index(0)] for r in rows if r["term"] == "w0" and 0 in r["keys"]) == 41


def test_searches_shuffle_the_postings_of_their_terms_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 2)
    docs = [(i, f"the w{i % 5} w{i % 3} only{i}", "ab"[i % 2], "s1") for i in range(60)]
    X.write_index(spark.createDataFrame(docs, "key long, text string, source string, section string"), str(tmp_path / "x"), shard=20)
    asked = spark.createDataFrame([(i, ["the", f"w{i % 5}"], [[f"w{i % 5}"], ["the"]]) for i in range(9)], "search int, terms array<string>, groups array<array<string>>")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (X.search_many(asked, str(tmp_path / "x"), 4), X.search_covers(asked, str(tmp_path / "x"), 4)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan and "sources" not in plan
            assert plan.count("Exchange hashpartitioning(shard") == 1
            assert found.count() == 36
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rounds_of_questions_are_bounded_and_lose_none(spark, tmp_path, monkeypatch):
    docs = collection(90)
    X.write_index(spark.createDataFrame(docs, "key long, text string, source string, section string"), str(tmp_path / "x"), shard=40)
    rows = [(i, ["the", f"w{i}", None], ["a"] if i % 3 else None) for i in range(11)] + [(20, None, None), (21, [], None), (2, ["w9"], ["a"])]
    asked = spark.createDataFrame(rows, "search int, terms array<string>, sources array<string>")
    whole = sorted(X.search_many(asked, str(tmp_path / "x"), 5).collect())
    monkeypatch.setattr(X, "SEARCHES", 4)
    assert [len(r) for r in X._rounds(asked, X.F.array("terms"))] == [4, 4, 4, 1]
    assert sorted(X.search_many(asked, str(tmp_path / "x"), 5).collect()) == whole
    monkeypatch.setattr(X, "WORDS", 5)
    assert all(len(r) <= 3 or sum(len(t or ()) for x in r for g in x["groups"] for t in g) <= 8 for r in X._rounds(asked, X.F.array("terms")))
    assert sorted(X.search_many(asked, str(tmp_path / "x"), 5).collect()) == whole
    sources = dict((d[0], d[2]) for d in docs)
    assert {r["search"] for r in whole} == set(range(11)) and all(sources[r["key"]] == "a" for r in whole if r["search"] % 3)
    want = brute_bm25(docs, ["the", "w2", "w9"], ["a"])[:5]
    assert [(r["key"], r["score"]) for r in sorted(whole, key=lambda r: r["rank"]) if r["search"] == 2] == [(k, pytest.approx(s, abs=2e-9)) for k, s in want]
    assert X.search_many(asked.limit(0), str(tmp_path / "x")).count() == 0


def test_a_task_sorts_one_shard(spark, tmp_path):
    docs = [(i, f"the w{i % 5}") for i in range(120)]
    X.write_index(spark.createDataFrame(docs, "key long, text string"), str(tmp_path / "x"), shard=10)
    held = spark.read.parquet(str(tmp_path / "x" / "postings")).select(X.F.input_file_name().alias("file"), "shard").distinct()
    assert held.select("shard").distinct().count() == 12
    assert held.groupBy("file").count().where("count > 1").count() == 0
