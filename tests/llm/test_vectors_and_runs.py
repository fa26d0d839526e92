"""Runs of words, centroids and near-duplicate vectors against brute force, and on odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lexloom.llm import centroids, queries, runs, vector_dedup

ODD_TEXTS = [
    (1, "", 5), (2, None, 5), (3, " \n\t ", 5), (4, "one two three", 5), (4, "one two three", 5), (None, "a b " * 30, 5),
    (5, "x" * 300_000, 5), (6, "word " * 20_000, 5), (7, "same text " + "p q r " * 12, 5), (8, "same text " + "p q r " * 12, 5), (9, "日本 é " * 20 + "end", 5),
    (10, " ".join(f"w{i}" for i in range(400)), 5), (21, " ".join(f"w{i}" for i in range(400)), 5),
]


def brute_runs(words):
    """Every stretch that a period q keeps and no neighbour extends, with its smallest period."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(24, 3 * q) and all(any(words[i + t] != words[i + t + d] for t in range(size - d)) for d in range(1, q)):
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *last, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def rows_of(df):
    order = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)


def test_runs_of_random_words_equal_brute_force(monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 2000)
    rng, texts = random.Random(1), []
    for _ in range(250):
        words, size = [], rng.randint(0, 250)
        while len(words) < size:
            kind = rng.random()
            if kind < 0.5:
                words += ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] * rng.randint(1, 14))[: rng.randint(1, 150)]
            elif kind < 0.8:
                words += [b"%d" % rng.randint(0, 50) for _ in range(rng.randint(1, 40))]
            else:
                words += words[-rng.randint(1, 30) :]
        texts.append(words)
    got = list(runs.runs_of(texts))
    assert got == [brute_runs(w) for w in texts]
    assert sum(map(len, got)) > 100


def test_runs_at_the_edge_of_length_and_turns():
    base = [b"w%d" % i for i in range(40)]
    for period, size in [(8, 24), (8, 23), (9, 27), (9, 26), (1, 24), (1, 23), (12, 36), (12, 35)]:
        words = [b"before", *(base[i % period] for i in range(size)), b"after"]
        assert list(runs.runs_of([words])) == [brute_runs(words)]
        assert bool(brute_runs(words)) == (size >= max(24, 3 * period))


def test_query_of_runs_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    short = [r for r in docs if len((r["text"] or "").split()) < 3000]
    got = {r[0]: r for r in rows_of(queries.op11_runs(spark, sf_dir))}
    assert len(got) == len(docs)
    for r in short:
        assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])
    assert sum(r[1] for r in got.values()) > 0


def test_runs_of_odd_rows(spark):
    table = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string, start int")
    found = runs.find_runs(table, endings=True).collect()
    want = sorted((brute_row(i, t) for i, t, _ in ODD_TEXTS if i != 6), key=str)
    got = sorted(((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["period"] and 1000 * r["length"] // r["period"], r["runs_sha256"], r["collapsed_sha256"]) for r in found if r["doc_id"] != 6), key=str)
    assert got == want
    six = next(r for r in found if r["doc_id"] == 6)
    assert (six["starts"], six["lengths"], six["periods"], six["collapsed"]) == ([0], [20_000], [1], "word")
    assert all(hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"] for r in found)
    assert runs.find_runs(table.limit(0)).count() == 0


# centroids


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    x = np.array([v for _, v in kept], np.int64)

    def assign():
        d = np.stack([((x - np.array(c)) ** 2).sum(1) for c in cents], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        to, _d = assign()
        for j in range(len(cents)):
            own = x[to == j]
            if len(own):
                cents[j] = [int(s) // len(own) for s in own.sum(0)]
    to, d = assign()
    names = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in cents]
    return sorted((i, int(c), int(e), int(d[to == c].sum()), int(d.sum()), names[c]) for (i, _), c, e in zip(kept, to, d, strict=True))


def cluster_rows(df):
    return sorted((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters_equal_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert cluster_rows(queries.op12_centroids(spark, sf_dir)) == brute_clusters(rows)


def test_ties_go_to_the_smaller_number_and_near_ties_to_the_exact_distance():
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 26), 1 << 26, (200, 64))
    cents = np.concatenate([base[:20] + rng.integers(-2, 3, (20, 64)) for _ in range(4)] + [base[:5]])
    x = np.concatenate([base, (cents[0:1] + cents[20:21]) // 2, np.zeros((3, 64), np.int64)])
    got, several = centroids.nearest(x, cents)
    gaps = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in cents] for v in x]
    assert got.tolist() == [min(range(len(cents)), key=lambda j: (g[j], j)) for g in gaps]
    assert len(several) >= 20
    same = np.tile(np.arange(64), (3, 1))
    assert centroids.nearest(same, np.tile(np.arange(64), (7, 1)))[0].tolist() == [0, 0, 0]


def test_clusters_of_odd_rows(spark):
    rng = random.Random(2)
    good = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.125]) for _ in range(64)]) for i in range(90)]
    good += [(90, [0.0] * 64), (91, [0.0] * 64), (91, [0.0] * 64), (92, [-0.0] * 64)]
    bad = [(100, None), (101, []), (102, [0.1] * 63), (103, [0.1] * 65), (104, [None] + [0.1] * 63), (105, [float("nan")] + [0.1] * 63), (106, [float("inf")] + [0.1] * 63), (107, [1e30] + [0.1] * 63)]
    table = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, cluster int")
    assert cluster_rows(centroids.cluster(table)) == brute_clusters(good)
    few = table.where("vec_id < 5")
    assert cluster_rows(centroids.cluster(few)) == brute_clusters(good[:5])
    assert centroids.cluster(table.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, [0.5] * 64), (3, [0.25] * 64)], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["cluster"]) for r in centroids.cluster(nameless).collect()} == {(None, 0), (3, 0)}


# near-duplicate vectors


def brute_links(rows, cosine=0.93):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    parent = {r[0]: r[0] for r in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in good]
    n = [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and float((unit[a] * unit[b]).sum()) >= cosine:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, y = find(good[a][0]), find(good[b][0])
                parent[max(x, y)] = min(x, y)
    out = [(r[0], k, find(r[0]), r[0] == find(r[0])) for r, k in zip(good, n, strict=True)]
    held = list(map(id, good))
    return sorted(out + [(r[0], 0, parent[r[0]] if r[0] in parent else r[0], r[0] == parent.get(r[0], r[0])) for r in rows if id(r) not in held], key=str)


def link_rows(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def family(rng, centre, n, angle):
    """n unit vectors at up to this angle around a centre."""
    out = []
    for _ in range(n):
        w = rng.normal(size=len(centre))
        w -= (w @ centre) * centre
        t = angle * rng.random()
        out.append((math.cos(t) * centre + math.sin(t) * w / np.linalg.norm(w)).tolist())
    return out


@pytest.fixture(scope="module")
def families():
    """Tight and wide groups, chains, strangers and copies under three labels."""
    rng = np.random.default_rng(7)
    rows = []
    for label in (1, 2, None):
        for n, angle in ((60, 0.1), (45, 0.3), (50, 0.45), (8, 0.2), (2, 0.05)):
            c = rng.normal(size=64)
            rows += [(v, label) for v in family(rng, c / np.linalg.norm(c), n, angle)]
        rows += [((v / np.linalg.norm(v) * rng.uniform(0.01, 50)).tolist(), label) for v in rng.normal(size=(80, 64))]
        rows += [(rows[k][0], label) for k in (0, 0, 0, 5, 70)]
    order = rng.permutation(len(rows))
    return [(int(i), *rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [vector_dedup.BLOCK, 4])
def test_near_vectors_equal_brute_force(spark, families, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    table = spark.createDataFrame(families, "vec_id long, embedding array<double>, label int")
    got, want = link_rows(vector_dedup.near_vectors(table)), brute_links(families)
    assert sum(r[1] for r in want) > 5000
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want)
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_near_vectors_of_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [], 1), (8, [1.0, None], 1),
        (9, [1.0, float("nan")], 1), (10, [1.0, float("inf")], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e300, 1e299], 1), (13, [-1.0, 0.0], 1),
        (14, [0.93, math.sqrt(1 - 0.93**2)], 1), (15, [0.92, math.sqrt(1 - 0.92**2)], 1), (20, [5.0] * 64, 1), (20, [5.0] * 64, 1), (21, [5.0] * 64, 1),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, item int")
    got = {(r[0], r[1], r[2]) for r in link_rows(vector_dedup.near_vectors(table))}
    near = {(1, 3), (2, 3), (12, 4), (15, 1)}
    assert {(1, 1), (2, 1), (12, 1), (14, 1), (15, 1)} <= {(i, c) for i, _, c in got}
    assert {(i, n) for i, n, _ in got} >= near - {(15, 1)}
    assert {(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (None, 0, None), (11, 0, 11), (13, 0, 13), (20, 2, 20), (21, 2, 20)} <= got
    assert vector_dedup.near_vectors(table.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for cos in (0.93, 0.97):
        w = rng.normal(size=x.shape)
        w -= (w * x).sum(1)[:, None] * x
        y = cos * x + math.sqrt(1 - cos * cos) * w / np.linalg.norm(w, axis=1)[:, None]
        code, factor, _, _ = vector_dedup.coded(x)
        _, _, small, step = vector_dedup.coded(y)
        est = vector_dedup.estimates(code, factor, small, step)
        assert abs(est.mean() - cos) < 0.003
        assert (est >= vector_dedup.lowest(factor, step, np.full(len(x), math.acos(0.93)), 64)).all()
        met = (vector_dedup.buckets(x, np.zeros(len(x), np.uint64)) == vector_dedup.buckets(y, np.zeros(len(x), np.uint64))).any(axis=1)
        assert met.mean() > 0.995
