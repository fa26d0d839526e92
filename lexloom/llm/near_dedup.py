"""Near-duplicate documents by circulant MinHash.

Two permutations make all signature coordinates: the first scatters a shingle over 2**32 places, coordinate k shifts that
place by k around the circle, and the second permutes it again; the least value over a document's shingles is coordinate
k. Coordinates are banded (a pair at 0.8 shares no band with probability 5e-6), and every link is confirmed on the full
shingle sets. Sets are of 64-bit shingle hashes.

Equal sets are one class before anything is paired. Each member of a bucket is first held against the least member of
the bucket that it meets most often; what these links join needs no further pairs. Documents in buckets that still hold
several components are then paired exactly: two sets at the threshold share one of their rarest shingles (prefix
filtering, rarest by a count sketch; any order is correct), so each document lists its few rarest, and only documents of
different components that list the same one, at places that leave enough after it, are compared. Passages that thousands of documents share are not rare and
pair nothing, and of the largest component under a shingle members are not compared with each other. No link between
different components of bucketed documents is lost. Components are found by contraction in a number of rounds that grows with
the logarithm of the vertices, each round a join of written tables.

Edge cases: a text with fewer words than a shingle is one shingle; null, empty and blank texts have none and are linked
with nothing; a null doc_id is linked with nothing and its component is null; rows that repeat a doc_id are one node, which has
the links of all its texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_arrow, raw, slices
from lexloom.session import materialise

BANDS, ROWS = 40, 6
#: Shingles that get their coordinates at once, counters of the sketch of shingle frequencies, rows in which a task hands them on.
CHUNK, COUNTERS, CHUNKS = 2048, 1 << 22, 64
#: Rounds of contraction by ids.
BY_ID = 2

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[5]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, sorted."""
    cut = text.translate(_LOWER).split()
    if not cut:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, cut), np.uint64, len(cut))
    k = min(words, len(cut))
    n = len(cut) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = _mix(total * _ODD[j % 8] + hashes[j : j + n])
    return np.unique(total)


def signature(held: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set."""
    place = (_mix(held) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), CHUNK):
        x = place[None, at : at + CHUNK] + _SHIFTS
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different bands having different keys."""
    total = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        total = _mix(total * _ODD[6] + sig[j * BANDS : (j + 1) * BANDS].astype(np.uint64))
    return total.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                rows, seen = [], {}
                for doc_id, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                    held = shingles(text, words)
                    if not len(held):
                        rows.append((doc_id, 0, None, None))
                        continue
                    key = xxhash.xxh3_128_digest(held.tobytes())
                    if key not in seen:
                        seen[key] = bands(signature(held))
                    rows.append((doc_id, len(held), key, seen[key]))
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SIGNED.types, strict=True)], schema=_SIGNED)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                held = [shingles(t, words).tobytes() for t in raw(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], names=["id", "held"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                keep = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[at] == x).sum())
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("held").alias("held_b")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("held").alias("held_a")), "a").select("a", "b", "held_a", "held_b")
    return materialise(map_arrow(both, _linked(percent), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) of every id in edges(a, b), by contraction.

    In a round each vertex joins the first of itself and its neighbours, and edges are redrawn between what they joined. In the
    first BY_ID rounds the least id is first, which settles stars; then a hash that changes with the round, which leaves about
    half of the vertices of any shape. What each round joined is a table, and the tables, the smallest first, give the labels.
    """
    edges, steps = materialise(edges.where("a <> b"), "edges"), []
    while not edges.isEmpty():
        turn = len(steps)
        order = lambda c: F.struct((F.lit(0) if turn < BY_ID else F.xxhash64(c, F.lit(turn))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ways.groupBy("a").agg(F.min(order("b")).alias("b")).select(F.col("a").alias("id"), F.least("b", order("a")).getField("v").alias("comp"))
        steps.append(materialise(step, "step"))
        to = lambda side: steps[-1].select(F.col("id").alias(side), F.col("comp").alias(f"{side}_to"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        edges = materialise(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    labels = steps.pop()
    while steps:
        known = labels.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        labels = materialise(steps.pop().join(known, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")
    least = labels.groupBy("comp").agg(F.min("id").alias("least"))
    return materialise(labels.join(least, "comp").select("id", F.least("least", "comp").alias("comp")), "labels")


def _sketch(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each of COUNTERS hash classes. Tasks sum counters, CHUNKS rows each; the driver gets 4 * COUNTERS bytes."""
    part = COUNTERS // CHUNKS

    def rows(total: np.ndarray, numbers) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1)
        held = [(k, pack.compress(total[k].tobytes())) for k in numbers]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], names=["chunk", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(COUNTERS, np.uint32), False
        for whole in batches:
            for b in slices(whole):
                held = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) % np.uint64(COUNTERS)
                total += np.bincount(held.astype(np.int64), minlength=COUNTERS).astype(np.uint32)
                seen = True
        if seen:
            yield rows(total.reshape(CHUNKS, part), range(CHUNKS))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(unpack.decompress(x), np.uint32)
        yield rows(total, sorted(total))

    out, unpack = np.zeros((CHUNKS, part), np.uint32), zstandard.ZstdDecompressor()
    for r in map_arrow(map_arrow(sets.select("held"), count, "chunk int, counts binary").repartition("chunk"), add, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(unpack.decompress(bytes(r["counts"])), np.uint32)
    return out.reshape(-1)


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """token, id, comp, size, pos for the shingles of sets(id, comp, held) of which two sets at the threshold share one, rarest first."""
    often = sets.sparkSession.sparkContext.broadcast(_sketch(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                tokens, ids, comps, sizes, places = [], [], [], [], []
                for i, comp, x in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    held = np.frombuffer(x, np.uint64)
                    n = len(held) + percent * len(held) // -100 + 1
                    order = np.lexsort((held, often.value[(held % np.uint64(COUNTERS)).astype(np.int64)]))[:n]
                    tokens.append(held[order].view(np.int64))
                    ids += [i] * n
                    comps += [comp] * n
                    sizes += [len(held)] * n
                    places += range(n)
                columns = (np.concatenate(tokens) if tokens else [], ids, comps, sizes, places)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "id", "comp", "size", "pos"])

    return materialise(map_arrow(sets.select("id", "comp", "held"), run, "token long, id long, comp long, size long, pos long"), "rarest")


def _cross_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components under one token that can reach the threshold.

    Of what two sets share, the rarest stands at these places of both, so no more can be common than what follows there.
    """
    by = rare.groupBy("token", "comp").agg(F.count("*").alias("n"))
    by = by.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    tokens = by.select("token", F.col("top.comp").alias("main"))
    held = materialise(rare.join(tokens, "token"), "open")
    few = held.where("comp <> main").select("token", F.col("id").alias("x"), F.col("comp").alias("comp_x"), F.col("size").alias("size_x"), F.col("pos").alias("pos_x"))
    follow = F.least(F.col("size") - F.col("pos"), F.col("size_x") - F.col("pos_x"))
    can = (F.col("comp") != F.col("comp_x")) & ((F.col("comp") == F.col("main")) | (F.col("id") < F.col("x"))) & ((100 + percent) * follow >= percent * (F.col("size") + F.col("size_x")))
    both = held.join(few, "token").where(can)
    return both.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def _same_document(known: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: the classes that rows of one doc_id belong to, the least with each other."""
    several = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    reps = known.join(several, "doc_id", "left_semi").join(classes, "set_key").select("doc_id", "rep")
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return materialise(reps.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "same")


def near_dedup(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Documents are linked where percent / 100 of the union of their sets of shingle_words-word shingles is common to both.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = materialise(map_arrow(docs, _signed(shingle_words), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    known = signed.where("set_key is not null and doc_id is not null")
    classes = materialise(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    keys = signed.join(classes, (signed.set_key == classes.set_key) & (signed.doc_id == classes.rep)).select("rep", F.explode("bands").alias("key"))

    # in a bucket of several classes: each member with the least one
    buckets = keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("key", "a")
    members = materialise(keys.join(buckets, "key").select("key", "a", F.col("rep").alias("b")), "members")
    stars = materialise(members.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")), "stars")
    ids = members.select(F.col("b").alias("doc_id")).distinct()
    sets = materialise(map_arrow(docs.join(ids, "doc_id", "left_semi"), _sets(shingle_words), "id long, held binary"), "sets")

    best = stars.groupBy("b").agg(F.max(F.struct("n", F.negative("a").alias("a"))).alias("best")).select(F.negative("best.a").alias("a"), "b")
    links = _confirmed(best, sets, percent).unionByName(_same_document(known, classes))
    labels = components(links)

    # what is left: documents in buckets of several components
    named = members.join(labels.select(F.col("id").alias("b"), "comp"), "b", "left").select("key", "b", F.coalesce("comp", "b").alias("comp"))
    spread = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = named.join(spread, "key", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("comp"))
    left = materialise(sets.join(left, "id").select("id", "comp", "held"), "left")
    pairs = materialise(_cross_pairs(_rarest(left, percent), percent), "pairs")
    more = _confirmed(pairs, sets, percent)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = classes.join(labels, classes.rep == labels.id, "left").select("set_key", F.coalesce("comp", "rep").alias("comp"))
    found = known.join(named, "set_key").groupBy("doc_id").agg(F.min("comp").alias("comp"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
