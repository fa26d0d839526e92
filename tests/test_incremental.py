"""Batches on stored tables: what they read and write, and that they leave what a whole rewrite leaves."""

import os

import pytest
from pyspark.sql import functions as F

from lexloom.operators import incremental as N
from lexloom.operators import store as S

KIND = "key string, source string, citation string, part int, section string, text string, recorded_at timestamp_ntz"


def chunk(n, source="a", section=None, text=None, day="2024-01-01"):
    return (f"k{n}", source, f"c{n}", n, section or f"s{n % 30}", text or f"text {n}", day)


def table(spark, rows):
    return spark.createDataFrame([(*r[:6], None) for r in rows], KIND).withColumn("recorded_at", F.lit(rows[0][6] if rows else "2024-01-01").cast("timestamp_ntz"))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in ("key", "source", "citation", "part", "section", "text", "recorded_at")) for r in df.collect())))


@pytest.fixture
def stored(spark, tmp_path):
    old = table(spark, [chunk(n, "a" if n % 3 else "b") for n in range(300)])
    N.create(old, str(tmp_path / "t"))
    return old, str(tmp_path / "t")


def test_a_batch_touches_the_folders_that_it_names(spark, stored):
    old, path = stored
    batch = table(spark, [chunk(31, text="new"), chunk(61), chunk(500, section="s1"), chunk(32, section="elsewhere", text="moved")])
    folders = N.folders_of(spark, path, batch)
    read = N.rows_of(spark, path, folders)
    read.collect()
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numPartitions").value() <= len(folders) < 5
    before = files(f"{path}/chunks")
    N.save(spark, path, batch, "a", "b1")
    named = tuple(f"source={s}/bucket={b}/" for s, b in folders)
    kept = {f: t for f, t in before.items() if not any(n in f for n in named)}
    after = files(f"{path}/chunks")
    assert kept.items() <= after.items() and len(kept) > 20
    assert rows(N.current(spark, path)) == rows(S.save(old, batch, "a"))
    # a key keeps the section under which it was first stored, though the batch named another
    assert N.current(spark, path).where("key = 'k32'").count() == 1


def test_a_second_run_and_a_run_after_a_break_change_nothing_more(spark, stored, monkeypatch):
    old, path = stored
    batch = table(spark, [chunk(31, text="new"), chunk(61)])
    want, now = rows(S.save(old, batch, "a")), F.lit("2024-09-01").cast("timestamp_ntz")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(N, "overwrite", broken)
        with pytest.raises(OSError):
            N.save(spark, path, batch, "a", "b1", now)
    assert rows(N.current(spark, path)) == rows(old)
    for _ in range(2):
        N.save(spark, path, batch, "a", "b1", now)
        assert rows(N.current(spark, path)) == want
    ended = sorted(r["key"] for r in N.past(spark, path).collect())
    assert ended == sorted(["k31", *(f"k{n}" for n in range(300) if n % 3 and n % 30 == 1 and n not in (31, 61))])
    assert N.save(spark, path, batch.limit(0), "a", "b2") == 0


def test_folders_without_rows_go(spark, tmp_path):
    path = str(tmp_path / "t")
    N.create(table(spark, [chunk(1, section="x"), chunk(2, section="x")]), path)
    before = N.folders_of(spark, path, table(spark, [chunk(1, section="x")]))
    N.overwrite(N.placed(table(spark, [chunk(9, section="y")])), f"{path}/chunks", ["source", "bucket"], before)
    assert [r["key"] for r in N.current(spark, path).collect()] == ["k9"]


def test_treatments_and_points_of_others_are_untouched(spark, tmp_path):
    t, p = str(tmp_path / "t"), str(tmp_path / "p")
    kind = "citation string, kind string, by_citation string, source string, recorded_at string, checked_at string"
    old = spark.createDataFrame([("c1", "reversed", "x", "m", "1", "1"), ("c2", "affirmed", "y", "m", "1", "1"), ("c1", "affirmed", "z", "n", "1", "1")], kind)
    N.create_treatments(old, t)
    before = {f: v for f, v in files(t).items() if "source=n" in f}
    new = spark.createDataFrame([("c1", "overruled", "x", "m", "5", "5"), ("c3", "affirmed", "w", "m", "5", "5")], kind).drop("source")
    N.replace_treatments(spark, t, new, "m")
    got = sorted((r["citation"], r["kind"], r["by_citation"], r["source"], r["recorded_at"], r["checked_at"]) for r in spark.read.parquet(t).collect())
    assert got == [("c1", "affirmed", "z", "n", "1", "1"), ("c1", "overruled", "x", "m", "1", "5"), ("c3", "affirmed", "w", "m", "5", "5")]
    assert before.items() <= files(t).items()

    points = spark.createDataFrame([(f"t{i % 3}", f"d{i % 4}", i) for i in range(24)], "tenant string, document string, n int")
    N.create_points(points, p)
    before = {f: v for f, v in files(p).items() if "tenant=t1" not in f}
    N.delete_document(spark, p, "t1", "d2")
    assert before.items() <= files(p).items()
    assert spark.read.parquet(p).where("tenant = 't1' and document = 'd2'").count() == 0 and spark.read.parquet(p).count() == 22
    assert N.drop_tenants(spark, p, spark.createDataFrame([("t1",)], "tenant string")) == 2
    assert {r[0] for r in spark.read.parquet(p).select("tenant").distinct().collect()} == {"t1"}
    assert N.drop_tenants(spark, p, spark.createDataFrame([], "tenant string")) == 1
