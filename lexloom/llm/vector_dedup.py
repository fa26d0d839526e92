"""Near-duplicate vectors of one label, by randomised-rotation binary codes.

A vector is turned by a random rotation; the signs of what comes out are its code, and the correction factor stored with the code is
the product of the code with the vector itself. The product of a code with another vector, divided by the factor, is an
unbiased estimate of the cosine of the two vectors, and its spread is known from the factor alone. A pair is recomputed exactly, in
double precision, where a cosine at the threshold could have given so low an estimate with SIGMAS deviations; no pair is linked
without that.

Only vectors in a common bucket are estimated. A bucket is the nearest of the 2d signed axes after each of HASHES further rotations, and
every vector is in TABLES buckets; of pairs of 64 dimensions right at the cosine 0.93 one in a thousand shares none (measured), at 0.96 one in 10,000.
Buckets of more than BLOCK rows are compared block by block.

Groups of copies are not paired. Equal vectors are one class. Vectors whose angle to a common centre is at most half of the
threshold's are all linked with each other, so such a ball is one item: the centres are the means of vectors that share a
finer bucket, BALL of them at least. A ball stands once in a bucket, whichever of its members fell there, and its centre and radius
decide on another item as a whole: all linked, or none. Only where they leave it open are members compared, in blocks of rows.

Edge cases: vectors that are null or zero or hold a null or non-finite component, vectors without a label and those with a null
vec_id are linked with nothing and count no links (component_id is then vec_id); vectors of different lengths are never linked; rows
that repeat a vec_id are vectors of their own with one component, which joins what each reaches; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import map_arrow
from lexloom.llm.near_dedup import components
from lexloom.session import materialise

TABLES, HASHES, SIGMAS = 20, 2, 5.0
#: Members from which a ball is made, and rows of a block.
BALL, BLOCK = 16, 2048
#: Members of a ball that are compared at once; room left for rounding in bounds.
PART, ROUNDING = 256, 1e-9

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dims: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    if (dims, number) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([dims, number]).normal(size=(dims, dims)))
        _rotations[dims, number] = (q * np.sign(np.diag(r))).astype(np.float32)
    return _rotations[dims, number]


def padded(dims: int) -> int:
    """Dimensions of codes: whole bytes, and enough of them for estimates of short vectors."""
    return max(64, -(-dims // 8) * 8)


def unit(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the rows that hold vectors with a direction, and these as float64 rows of norm 1."""
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(column.offsets.to_numpy()))
    ends = np.cumsum(sizes)
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")))
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        held = values[(ends[rows] - d)[:, None] + np.arange(d)]
        most = np.abs(held).max(axis=1)
        good = np.isfinite(held).all(axis=1) & (most > 0)
        held = held[good] / most[good, None]
        out[d] = rows[good], held / np.sqrt((held * held).sum(axis=1))[:, None]
    return out


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: codes as bits, correction factors, the rotated rows in 8 bits, and their step."""
    wide = padded(x.shape[1])
    turned = np.pad(x, ((0, 0), (0, wide - x.shape[1]))).astype(np.float32) @ rotation(wide, 0)
    factor = np.abs(turned).sum(axis=1) / np.float32(math.sqrt(wide))
    step = np.abs(turned).max(axis=1) / 127
    return np.packbits(turned >= 0, axis=1), factor, np.rint(turned / step[:, None]).astype(np.int8), step


def estimates(code: np.ndarray, factor: np.ndarray, small: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosines of coded vectors with vectors in 8 bits, pair by pair."""
    wide = small.shape[1]
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    return np.einsum("ij,ij->i", signs, small.astype(np.float32)) * step / (np.float32(math.sqrt(wide)) * factor)


def lowest(factor: np.ndarray, step: np.ndarray, angle: np.ndarray, wide: int) -> np.ndarray:
    """The least estimate that a pair at most so far apart gives, SIGMAS deviations down; 8 bits cost half a step in each dimension."""
    angle = np.minimum(angle, math.pi / 2)
    spread = np.sin(angle) * np.sqrt(np.maximum(1 - factor * factor, 0)) / factor / math.sqrt(wide - 1)
    return np.cos(angle) - SIGMAS * spread - math.sqrt(wide) * step / 2 / factor


def axes(x: np.ndarray, number: int) -> np.ndarray:
    """The nearest signed axis after a rotation."""
    wide = padded(x.shape[1])
    turned = np.pad(x, ((0, 0), (0, wide - x.shape[1]))).astype(np.float32) @ rotation(wide, number)
    at = np.abs(turned).argmax(axis=1)
    return at * 2 + (turned[np.arange(len(x)), at] < 0)


def buckets(x: np.ndarray, label: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The bucket of each row in each table, as 64-bit keys that hold label, length and table too."""
    out = np.empty((len(x), tables), np.uint64)
    for t in range(tables):
        key = label + np.uint64(xxhash.xxh3_64_intdigest(f"{x.shape[1]}|{t}".encode()))
        for h in range(HASHES):
            key = (key ^ axes(x, 1 + t * HASHES + h).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, t] = key
    return out.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _by_length(b: pa.RecordBatch, name: str, kind: str = "<f8") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch of packed vectors, those of one length together, as float64."""
    column = b.column(b.schema.get_field_index(name))
    sizes = np.fromiter(map(len, column.to_pylist()), np.int64, len(column))
    for d in np.unique(sizes):
        part = b.take(pa.array(np.flatnonzero(sizes == d)))
        yield part, _matrix(part.column(part.schema.get_field_index(name)), kind)


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, class, vec and cell of every row: unit vectors by class, the class naming label and components."""
    for b in batches:
        n = b.num_rows
        key, vec, cell, names = [None] * n, [None] * n, [None] * n, b.column(1).to_pylist()
        for d, (rows, held) in unit(b.column(2)).items():
            good = np.array([names[i] is not None for i in rows.tolist()], bool)
            rows, held = rows[good], held[good]
            if not len(rows):
                continue
            label = np.array([xxhash.xxh3_64_intdigest(names[i].encode()) for i in rows.tolist()], np.uint64)
            near = buckets(held, label ^ np.uint64(d), 1)[:, 0].tolist()
            for i, v, c in zip(rows.tolist(), held + 0.0, near, strict=True):
                vec[i], cell[i] = v.tobytes(), c
                key[i] = xxhash.xxh3_128_digest(names[i].encode() + b"\0" + vec[i])
        columns = [b.column(0), pa.array(key, pa.binary()), b.column(1), pa.array(vec, pa.binary()), pa.array(cell, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "class", "label", "vec", "cell"])


def _centre_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each cell, those of a batch together."""
    for b in batches:
        for part, x in _by_length(b, "vec"):
            cells, of = np.unique(part.column(0).to_numpy(), return_inverse=True)
            order = np.argsort(of, kind="stable")
            first = np.searchsorted(of[order], np.arange(len(cells)))
            sums = np.add.reduceat(x[order], first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), _binary(sums)], names=["cell", "total"])


def _centre(table: pa.Table) -> pa.Table:
    """The mean direction of one cell from its sums, a row for each batch that held it."""
    total = np.zeros(1)
    for c in table.column("total").to_pylist():
        total = total + np.frombuffer(c, "<f8")
    norm = math.sqrt(float((total * total).sum()))
    centre = (total / norm).tobytes() if norm > 0 else None
    return pa.table({"cell": table.column("cell")[:1], "centre": pa.array([centre], pa.binary())})


def _angles(half: float):
    """item and angle: the ball of the cell for members within half of the threshold's angle, else the class itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _by_length(b, "vec"):
                centres = part.column(part.schema.get_field_index("centre")).to_pylist()
                own = np.stack([np.frombuffer(c, "<f8") if c is not None and len(c) == 8 * x.shape[1] else np.zeros(x.shape[1]) for c in centres])
                angle = np.arccos(np.clip((x * own).sum(axis=1), -1, 1))
                inside = (angle <= half - 1e-7) & (own != 0).any(axis=1)
                cells, keys = part.column(part.schema.get_field_index("cell")).to_pylist(), part.column(0).to_pylist()
                item = [b"ball" + c.to_bytes(8, "little", signed=True) if i else k for i, c, k in zip(inside.tolist(), cells, keys, strict=True)]
                centre = [c if i else None for i, c in zip(inside.tolist(), centres, strict=True)]
                columns = [part.column(0), pa.array(item, pa.binary()), pa.array(np.where(inside, angle + 1e-7, 0.0)), pa.array(centre, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "item", "angle", "centre"])

    return run


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and item of every vector in every table."""
    for b in batches:
        for part, x in _by_length(b, "vec"):
            names = part.column(1).to_pylist()
            label = np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in names], np.uint64)
            keys = buckets(x, label)
            at = np.repeat(np.arange(len(x)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), part.column(0).take(pa.array(at))], names=["key", "item"])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item and packed: radius, factor, step, code and 8-bit form of each item."""
    for b in batches:
        for part, x in _by_length(b, "vec"):
            code, factor, small, step = coded(x)
            head = np.stack([part.column(2).to_numpy().astype(np.float32), factor, step], 1).astype("<f4")
            packed = [h.tobytes() + c.tobytes() + s.tobytes() for h, c, s in zip(head, code, small, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["item", "packed"])


def _candidates(angle: float):
    """Pairs of items of one bucket whose estimate leaves a link possible; rows come bucket by bucket, side 1 only meeting side 0."""

    def pairs(items: list, sides: np.ndarray, packed: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = (packed.shape[1] - 12) * 8 // 9
        head = packed[:, :12].copy().view("<f4")
        code, small = packed[:, 12 : 12 + wide // 8], packed[:, 12 + wide // 8 :].view(np.int8)
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 15):
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            est = estimates(code[a], head[a, 1], small[b], head[b, 2])
            keep[at : at + (1 << 15)] = est >= lowest(head[a, 1], head[b, 2], angle + head[a, 0] + head[b, 0], wide)
        return i[keep], j[keep]

    def of(bucket: list[tuple]) -> Iterator[pa.RecordBatch]:
        """bucket: rows (run, side, item, packed) of several runs, each whole."""
        by: dict[int, list[int]] = {}
        for n, r in enumerate(bucket):
            by.setdefault(len(r[3]), []).append(n)
        for rows in by.values():
            held = [bucket[n] for n in rows]
            items, sides = [r[2] for r in held], np.array([r[1] for r in held])
            packed = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1)
            run = np.array([r[0] for r in held])
            shift = 1
            while shift < len(held):
                i = np.flatnonzero(run[shift:] == run[:-shift])
                if not len(i):
                    break
                j = i + shift
                ok = (sides[i] == 0) & ((sides[j] == 1) | (sides[i] == -1)) | (sides[i] == -1)
                i, j = pairs(items, sides, packed, i[ok], j[ok])
                found = {(min(items[x], items[y]), max(items[x], items[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True) if items[x] != items[y]}
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                shift += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        runs, last = 0, None
        for b in batches:
            for key, block, side, item, packed in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if (key, block) != last:
                    last, runs = (key, block), runs + 1
                    if len(waiting) >= 4 * BLOCK:
                        yield from of(waiting)
                        waiting = []
                waiting.append((runs, side, item, packed))
        yield from of(waiting)

    return run


def _decided(cosine: float, angle: float):
    """Pairs of items by their centres and radii: a, b and whether all members are linked (else it is open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _by_length(b, "vec_a"):
                names = part.schema.names
                col = lambda n: part.column(names.index(n))  # noqa: B023, E731
                ys = col("vec_b").to_pylist()
                same = np.array([len(y) == 8 * x.shape[1] for y in ys]) & np.array([p == q for p, q in zip(col("label_a").to_pylist(), col("label_b").to_pylist(), strict=True)])
                y = np.stack([np.frombuffer(v, "<f8") if s else np.zeros(x.shape[1]) for v, s in zip(ys, same, strict=True)])
                cos = (x * y).sum(axis=1)
                around = col("angle_a").to_numpy() + col("angle_b").to_numpy()
                apart = np.arccos(np.clip(cos, -1, 1))
                alone = around == 0
                every = same & np.where(alone, cos >= cosine, apart + around <= angle - 1e-7)
                open_ = same & ~alone & ~every & (apart - around <= angle + 1e-7)
                keep = pa.array(every | open_)
                yield pa.RecordBatch.from_arrays([col("a"), col("b"), pa.array(every)], names=["a", "b", "linked"]).filter(keep)

    return run


def _compared(cosine: float):
    """Links of each class over pairs of blocks: item_a, item_b, class, links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, o, keys_a, vecs_a, rows_a, keys_b, vecs_b, rows_b in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                x = np.frombuffer(b"".join(vecs_a), "<f8").reshape(len(keys_a), -1)
                y = np.frombuffer(b"".join(vecs_b), "<f8").reshape(len(keys_b), -1)
                alike = (x[:, None, :] * y[None]).sum(axis=2) >= cosine if x.size * len(y) < 1 << 24 else x @ y.T >= cosine
                n = [*(alike @ np.array(rows_b)).tolist(), *(alike.T @ np.array(rows_a)).tolist()]
                keys = [*keys_a, *keys_b]
                keep = [k for k, v in enumerate(n) if v]
                columns = [pa.array([a] * len(keep), pa.binary()), pa.array([o] * len(keep), pa.binary()), pa.array([keys[k] for k in keep], pa.binary()), pa.array([n[k] for k in keep], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "class", "links"])

    return run


def _sorted_buckets(keyed: DataFrame) -> DataFrame:
    """key, block, side, item, packed: buckets of at most BLOCK rows as they are, larger ones as pairs of their blocks."""
    counts = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    large = counts.where(F.col("n") > BLOCK)
    shared = keyed.join(counts, "key")
    small = shared.where(F.col("n") <= BLOCK).select("key", F.lit(-1).alias("block"), F.lit(-1).alias("side"), "item", "packed")
    if large.isEmpty():
        return small
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("item"), parts).cast("int")
    # block p * parts + q with p <= q holds part p as side 0 and part q as side 1; p = q all against all
    with_ = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = shared.where(F.col("n") > BLOCK).withColumn("parts", parts).withColumn("own", own).withColumn("other", with_)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return small.unionByName(dealt.select("key", (low * F.col("parts") + high).alias("block"), side.alias("side"), "item", "packed"))


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label).

    Vectors of equal labels are linked where their cosine is at least cosine (over 0.5).
    """
    angle = math.acos(cosine)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    known = materialise(map_arrow(rows, _known, "vec_id long, class binary, label string, vec binary, cell long"), "known")
    whole = known.where("class is not null and vec_id is not null")
    one = ("label", "vec", "cell")
    classes = materialise(whole.groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in one)), "classes")

    # balls
    full = classes.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= BALL).select("cell")
    sums = map_arrow(classes.join(full, "cell").select("cell", "vec"), _centre_sums, "cell long, total binary")
    centres = materialise(sums.groupBy("cell").applyInArrow(_centre, "cell long, centre binary"), "centres")
    placed = map_arrow(classes.join(centres, "cell", "left").select("class", "cell", "vec", "centre"), _angles(angle / 2), "class binary, item binary, angle double, centre binary")
    members = materialise(classes.drop("cell").join(placed, "class"), "members")
    grouped = members.groupBy("item").agg(F.max("angle").alias("angle"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.first("label").alias("label"), F.first(F.coalesce("centre", "vec")).alias("vec"))
    items = materialise(grouped, "items")

    # buckets, each item once in each, and what their estimates leave
    keys = map_arrow(members.select("item", "label", "vec"), _bucketed, "key long, item binary").distinct()
    codes = map_arrow(items.select("item", "vec", "angle"), _codes, "item binary, packed binary")
    keyed = materialise(keys.join(codes, "item").select("key", "item", "packed"), "keyed")
    dealt = _sorted_buckets(keyed).repartition("key", "block").sortWithinPartitions("key", "block", "side")
    pairs = materialise(map_arrow(dealt, _candidates(angle), "a binary, b binary").distinct(), "pairs")

    # exact
    end = lambda s: items.select(F.col("item").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("vec", "angle", "label")))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    decided = materialise(map_arrow(both, _decided(cosine, angle), "a binary, b binary, linked boolean"), "decided")
    open_ = decided.where("not linked").select("a", "b")
    links, more = decided.where("linked").select("a", "b"), None
    if not open_.isEmpty():
        asked = open_.select(F.col("a").alias("item")).union(open_.select("b")).distinct()
        part = F.floor(F.row_number().over(Window.partitionBy("item", "salt").orderBy("class")) / PART)
        salted = members.join(asked, "item").withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(64)))
        parts = salted.withColumn("part", part).groupBy("item", "salt", "part").agg(F.collect_list(F.struct("class", "vec", "rows")).alias("m"))
        parts = materialise(parts.select("item", F.col("m.class").alias("classes"), F.col("m.vec").alias("vecs"), F.col("m.rows").alias("rows")), "parts")
        side = lambda s: parts.select(F.col("item").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("classes", "vecs", "rows")))
        met = open_.join(side("a"), "a").join(side("b"), "b").select("a", "b", "classes_a", "vecs_a", "rows_a", "classes_b", "vecs_b", "rows_b")
        more = materialise(map_arrow(met, _compared(cosine), "a binary, b binary, class binary, links long"), "compared")

    # links by class: those within its item, those of whole items, those found one by one; components by item
    ways = links.select("a", F.col("b").alias("item")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("item")))
    beyond = ways.join(items.select("item", "rows"), "item").groupBy(F.col("a").alias("item")).agg(F.sum("rows").alias("beyond"))
    edges = links if more is None else links.unionByName(more.select("a", "b").distinct())
    reached = components(edges.unionByName(_same_id(whole, members))).select(F.col("id").alias("item"), "comp")
    named = items.select("item", "rows", "least").join(reached, "item", "left").withColumn("comp", F.coalesce("comp", "item"))
    least = named.groupBy("comp").agg(F.min("least").alias("component"))
    of = named.join(least, "comp").join(beyond, "item", "left").select("item", "component", (F.col("rows") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    found = members.select("class", "item").join(materialise(of, "named"), "item")
    if more is not None:
        singly = more.groupBy("class").agg(F.sum("links").alias("singly"))
        found = found.join(singly, "class", "left").withColumn("n_links", F.col("n_links") + F.coalesce("singly", F.lit(0)))
    named = found.select("class", "n_links", "component")
    mine = F.when(F.col("vec_id").isNotNull(), F.col("class"))
    out = known.select("vec_id", mine.alias("class")).join(named, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _same_id(whole: DataFrame, members: DataFrame) -> DataFrame:
    """a, b: the items of the rows that repeat a vec_id, the least with each other."""
    several = whole.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")
    of = whole.join(several, "vec_id", "left_semi").join(members.select("class", "item"), "class").select("vec_id", "item")
    least = of.groupBy("vec_id").agg(F.min("item").alias("a"))
    return of.join(least, "vec_id").where("a <> item").select("a", F.col("item").alias("b")).distinct()

