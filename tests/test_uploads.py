"""Uploads as one write, and what providers have computed remembered between runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.operators import providers as P
from lexloom.operators import remembered as Z
from lexloom.sources import uploads as U

UPLOADS = "document string, tenant string, name string, content binary, at timestamp"
PAGES = "document string, page int, text string"
DAY = datetime.datetime(2024, 5, 1)


def upload(n, tenant="t", content=b"%PDF-1", name="a file"):
    return (f"d{n}", tenant, name, content, DAY + datetime.timedelta(minutes=n))


def both(spark, ups, pages):
    return spark.createDataFrame(ups, UPLOADS), spark.createDataFrame(pages, PAGES)


def test_rules_refuse_in_their_order(spark):
    ups = [upload(0, content=b"GIF8" + b"x" * 50), upload(1, content=b"GIF8"), upload(2), upload(3), upload(4), upload(5), upload(6), upload(7, tenant="u"), upload(8, tenant="u")]
    pages = [(f"d{n}", 1, "some words") for n in (0, 1, 2, 4, 5, 6)] + [("d3", p, "w") for p in range(4)] + [("d7", 1, " "), ("d7", 2, None)]
    u, p = both(spark, ups, pages)
    today = spark.createDataFrame([("t", 1)], "tenant string, n long")
    got = {r["document"]: r["status"] for r in U.statuses(u, p, today, page_cap=3, per_day=3, most_bytes=20).collect()}
    # d3 has too many pages and counts for nothing; with d2 and d4 the day is full
    assert got == {"d0": 413, "d1": 415, "d2": 200, "d3": 413, "d4": 200, "d5": 429, "d6": 429, "d7": 422, "d8": 422}


@pytest.mark.parametrize("step", ["documents", "chunks", "points", "commits"])
def test_an_upload_that_breaks_shows_nowhere(spark, tmp_path, monkeypatch, step):
    from pyspark.sql import DataFrameWriter

    root, write = str(tmp_path / "u"), DataFrameWriter.parquet
    u, p = both(spark, [upload(1)], [("d1", 1, "one two")])
    U.ingest(spark, root, "b0", *both(spark, [upload(0)], [("d0", 1, "zero")]), "hashed")

    def broken(self, path, *a, **k):
        if f"/{step}/" in path:
            raise OSError("lost")
        return write(self, path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", broken)
        with pytest.raises(OSError):
            U.ingest(spark, root, "b1", u, p, "hashed")
    for name in ("documents", "chunks", "points"):
        assert [r["document"] for r in U.committed(spark, root, name).collect()] == ["d0"]
    U.ingest(spark, root, "b1", u, p, "hashed")
    for name in ("documents", "chunks", "points"):
        assert sorted(r["document"] for r in U.committed(spark, root, name).collect()) == ["d0", "d1"]


def test_names_and_pages_are_redacted_and_the_day_is_counted(spark, tmp_path):
    root = str(tmp_path / "u")
    assert U.committed(spark, root, "chunks") is None
    names = {0: 'my "file"\n of 123-45-6789', 1: " \t ", 2: None, 3: "x" * 300}
    u, p = both(spark, [upload(n, name=name) for n, name in names.items()], [(f"d{n}", 1, "SSN 123-45-6789 of mine") for n in names] + [("d0", 2, "")])
    U.ingest(spark, root, "b1", u, p, "hashed", per_day=5)
    got = {r["document"]: (r["name"], r["pages"], r["failed_pages"]) for r in U.committed(spark, root, "documents").collect()}
    assert got == {"d0": ("my 'file' of [REDACTED SSN]", 2, [2]), "d1": ("document", 1, []), "d2": ("document", 1, []), "d3": ("x" * 200, 1, [])}
    assert {r["text"] for r in U.committed(spark, root, "chunks").collect()} == {"SSN [REDACTED SSN] of mine"}
    assert U.committed(spark, root, "points").where(F.size("embedding") == 64).count() == 4
    u, p = both(spark, [upload(10), upload(11)], [("d10", 1, "w"), ("d11", 1, "w")])
    assert {r["document"]: r["status"] for r in U.ingest(spark, root, "b2", u, p, "hashed", per_day=5).collect()} == {"d10": 200, "d11": 429}


def failing():
    def make():
        def embed(texts):
            raise AssertionError("asked again")

        return embed

    return make


def test_a_second_run_asks_for_no_row(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None), (5, "")], "n int, text string")
    first = {r["n"]: r["embedding"] for r in Z.vectors(texts, "text", "hashed", path).collect()}
    assert first[1] == first[3] and first[1] != first[2] and spark.read.parquet(f"{path}/generation-0/results").count() == 3
    monkeypatch.setitem(P.EMBEDDERS, "hashed", failing())
    assert {r["n"]: r["embedding"] for r in Z.vectors(texts, "text", "hashed", path).collect()} == first
    with pytest.raises(Exception, match="asked again"):
        Z.vectors(spark.createDataFrame([(9, "new")], "n int, text string"), "text", "hashed", path).collect()


def test_what_was_used_last_stays(spark, tmp_path):
    path, day = str(tmp_path / "m"), lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    pairs = lambda *t: spark.createDataFrame([("q", x) for x in t], "query string, text string")
    run = lambda df, score, n: {r["text"]: r["score"] for r in Z.pair_scores(df, "query", "text", "m", lambda q, t: F.lit(score), path, day(n)).collect()}
    run(pairs("a", "b", "c", "d"), 1.0, 1)
    run(pairs("a", "c"), 2.0, 2)
    Z.forget(spark, path, 3)
    got = run(pairs("a", "b", "c", "d"), 3.0, 3)
    assert got["a"] == got["c"] == 1.0 and sorted([got["b"], got["d"]]) == [1.0, 3.0]
    assert run(pairs("a"), 9.0, 4) == {"a": 1.0}
    other = Z.pair_scores(pairs("a"), "query", "text", "another model", lambda q, t: F.lit(7.0), path, day(5)).first()
    assert other["score"] == 7.0
