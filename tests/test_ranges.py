"""Interval, prefix and as-of joins against brute force, and their plans."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions.claims import contains
from lexloom.operators import ranges as I
from lexloom.operators import store as S


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lo = rng.choice([0, 3, 17, 1000, rng.randint(0, 5000), 1 << 40])
        rows.append((i, rng.choice("ab"), lo, lo + rng.choice([0, 0, 1, 2, 7, 8, 100, 3000, 1 << 50])))
    rows += [(400, "a", None, 5), (401, "a", 5, None), (402, "a", 9, 3), (403, None, 1, 2)]
    left, right = rows[::2], rows[1::2]
    df = lambda x: spark.createDataFrame(x, "id long, g string, lo long, hi long")
    got = sorted(map(tuple, I.overlapping(df(left), df(right), ["g"]).collect()))
    ok = lambda r: r[2] is not None and r[3] is not None and r[2] <= r[3]
    want = sorted((a[0], b[0]) for a in left for b in right if ok(a) and ok(b) and a[1] is not None and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert got == want and len(want) > 2000


def test_prefixes_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab(") for _ in range(rng.randint(0, 5))) for _ in range(150)] + [None]
    rows = [(i, "xy"[i % 2], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, g string, text string")
    got = sorted(map(tuple, I.prefixed(df, df, ["g"]).collect()))
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] is not None and b[2] is not None and a[2].startswith(b[2]))


def test_contained_pairs_are_those_of_the_predicate(spark):
    rng = random.Random(3)
    names = [f"T.C. Memo. 2020-{rng.randint(1, 3)}, at *{(p := rng.randint(1, 40))}" + rng.choice(["", f"-{p + rng.randint(0, 30)}", f"-*{p + 1}"]) for _ in range(60)]
    names += [f"183({rng.choice('abc')})" + rng.choice(["", "(1)", "-(c)", "(2)"]) for _ in range(40)] + ["x, at *1-999999999", None, ""]
    df = spark.createDataFrame([(i, "s", c) for i, c in enumerate(names)], "id int, g string, citation string")
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, F.col("a.g") == F.col("b.g")).where(contains(F.col("a.citation"), F.col("b.citation"))).select("a.id", "b.id")
    assert sorted(map(tuple, I.contained(df, df, ["g"]).collect())) == sorted(map(tuple, want.collect()))
    plan = I.contained(df, df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contained_pairs_of_alike_ids_are_made_last_and_once(spark):
    rows = [(i, "st"[i % 2], f"M, at *{i % 5}-{i % 5 + 1}" if i % 3 else f"183({i % 2})-(z)") for i in range(90)] + [(0, "s", "M, at *3"), (0, "s", "M, at *3"), (None, "s", "M, at *3")]
    df = spark.createDataFrame(rows, "id int, g string, citation string")
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, F.col("a.g") == F.col("b.g")).where(contains(F.col("a.citation"), F.col("b.citation"))).select("a.id", "b.id").distinct()
    found = I.contained(df, df, ["g"])
    assert sorted(map(str, found.collect())) == sorted(str(r).replace("id=", "a=", 1).replace("id=", "b=", 1) for r in want.collect())
    plan = [x.strip(" +-:") for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert next(x for x in plan if not x.startswith("Project")).startswith("Join")


@pytest.mark.parametrize("days", [1, 30, 5000])
def test_as_of_equals_brute_force(spark, days):
    rng, day = random.Random(4), lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    versions, probes = [], []
    for c in range(12):
        for part in range(rng.randint(1, 2)):
            cuts = sorted(rng.randint(0, 4000) for _ in range(rng.randint(1, 9)))
            for n, at in enumerate(cuts):
                end = rng.choice([None, cuts[n + 1] if n + 1 < len(cuts) else at + 50]) if n + 1 == len(cuts) else rng.choice([cuts[n + 1], cuts[n + 1] - rng.randint(0, cuts[n + 1] - at)])
                versions.append((f"k{c}{part}", f"c{c}", f"t{c}{part}{n}", day(at), day(end) if end is not None else None))
    versions += [("never", "c0", "never", None, None), ("k", None, "nobody", day(0), None)]
    for i in range(400):
        probes.append((i, rng.choice([f"c{rng.randint(0, 13)}", None]), rng.choice([day(rng.randint(-10, 4100)), *[v[3] for v in versions[:20]]])))
    v = spark.createDataFrame(versions, "key string, citation string, text string, recorded_at timestamp_ntz, retired_at timestamp_ntz")
    p = spark.createDataFrame(probes, "id int, citation string, at timestamp_ntz")
    out = S.held_at_all(p, v, ("citation", "key"), days)
    got = sorted((r["id"], r["key"], r["text"]) for r in out.collect())
    want = sorted((i, k, t) for i, c, at in probes for k, vc, t, since, until in versions if c is not None and c == vc and since is not None and since <= at and (until is None or at < until))
    assert got == want and len(want) > 100
    assert "Join" not in S.held_at_all(p, v)._jdf.queryExecution().executedPlan().toString()
