"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Each text gives a vector of statistics (shares of character classes, word and line statistics). Cosines of random
projections of it approximate a Gaussian kernel. Tasks sum the normal equations of their labelled rows, the driver adds
these few matrices and solves them; scores of rows that were kept out of the fit are binned, and pooling adjacent
violators over the bins makes scores probabilities. A small strictly increasing part keeps the order within a pool.

Edge cases: null and empty texts have statistics too (all 0) and get a score; labels that are null or belong to no
document are passed over; without labels of both kinds the score is 0.5 for all; rows that repeat a doc_id get the same
score as their text; a null doc_id is not held out; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_arrow, raw, slices
from lexloom.session import materialise

#: Random features, kernel width in standard deviations per root dimension, ridge per row, most labelled rows of a fit, matrices summed, bins of the calibration.
FEATURES, WIDTH, RIDGE, FIT_ROWS, SUMS, BINS = 256, 1.0, 1e-3, 200_000, 16, 512
ORDER_PART = 0.02

#: Frequent short words of the languages of the corpus; their share tells prose from lists and noise.
COMMON = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für ist im mit nicht sich sie und von zu "
    "al como con del el es esta las lo los no para por se su una y".encode().split()
)

_CLASSES = [
    range(65, 91), range(97, 123), range(48, 58), range(128, 256), (10,), (9, 11, 12, 13, 32), b".,;:?'\"-()", b"!", b"#$%&*@^~", b"|<>{}[]\\/=+_`",
    tuple(range(9)) + tuple(range(14, 32)) + (127,),
]
_BY_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _BY_CLASS[list(_c), _k] = 1
N_STATISTICS = len(_CLASSES) + 10


def statistics(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text."""
    n = len(text)
    if not n:
        return [0.0] * N_STATISTICS
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BY_CLASS) / n
    words, lines = text.split(), text.split(b"\n")
    k = max(len(words), 1)
    distinct = set(words)
    sizes = list(map(len, words)) or [0]
    return [
        *np.sqrt(shares).tolist(),
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(n / k),
        len(distinct) / k,
        math.log1p(k / max(len(distinct), 1)),
        sum(map(COMMON.__contains__, text.lower().split())) / k,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        math.log1p(max(sizes)),
        math.sqrt(sum(1 for w in distinct if w.isupper() and len(w) > 1) / max(len(distinct), 1)),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            found = [statistics(t) for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float32()))], names=["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _measure, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, N_STATISTICS).astype(np.float64)


class Model:
    """Statistics to scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / (WIDTH * math.sqrt(N_STATISTICS)), (N_STATISTICS, FEATURES))
        self.phase = rng.uniform(0, 2 * math.pi, FEATURES)
        self.beta: np.ndarray | None = None
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.cos(z @ self.w + self.phase) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        r = self.raw(x)
        level = np.interp(r, *self.knots) if self.knots else np.clip(r, 0, 1)
        return np.clip((1 - ORDER_PART) * level + ORDER_PART / (1 + np.exp(-4 * (r - 0.5))), 0, 1)


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step function nearest to the values, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for x, y, w in zip(at, value, weight, strict=True):
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(x: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labels(doc_id, quality) whose crc32(doc_id as text) mod 3 is not 1; a quarter of them calibrates.

    At most about fit_rows labelled rows are used, chosen by a hash of doc_id; that is the documented bound of the fit.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null").where(fold % 3 != 1)
    n = labels.count()
    if n > fit_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    rows = materialise(labels.join(x, "doc_id").select("y", "x", (F.floor(fold / 3) % 4 == 0).alias("held")), "labelled").coalesce(SUMS)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, N_STATISTICS))
        for b in batches:
            m = _matrix(b.column(1))
            total += np.stack([np.full(N_STATISTICS, len(m)), m.sum(axis=0), (m * m).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def summed(fn) -> np.ndarray | None:
        got = [np.frombuffer(r["sums"]) for r in map_arrow(rows, fn, "sums binary").collect()]
        return np.sum(got, axis=0) if got else None

    moments = summed(first)
    if moments is None or moments[0] == 0:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    count, one, two = moments.reshape(3, -1)
    mean = one / count
    model = Model(mean, np.sqrt(np.maximum(two / count - mean * mean, 1e-6)))
    d = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 2))
        for whole in batches:
            b = whole.filter(pa.compute.invert(whole.column(2)))
            z, y = model.features(_matrix(b.column(1))), b.column(0).to_numpy(zero_copy_only=False)
            total[:, :d] += z.T @ z
            total[:, d] += z.T @ y
            total[0, d + 1] += y.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = summed(equations).reshape(d, d + 2)
    seen, ones = total[d - 1, d - 1], total[0, d + 1]
    if not 0 < ones < seen:
        return model
    penalty = np.full(d, RIDGE * seen / FEATURES * 10)
    penalty[-1] = 1e-9
    model.beta = np.linalg.solve(total[:, :d] + np.diag(penalty), total[:, d])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for whole in batches:
            b = whole.filter(whole.column(2))
            k = np.clip((model.raw(_matrix(b.column(1))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            total += [np.bincount(k, minlength=BINS), np.bincount(k, b.column(0).to_numpy(zero_copy_only=False), BINS)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    n_bin, y_bin = summed(binned).reshape(2, BINS)
    if n_bin.sum() >= 50 and 0 < y_bin.sum() < n_bin.sum():
        centre = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
        used = n_bin > 0
        model.knots = isotonic(centre[used], y_bin[used] / n_bin[used], n_bin[used])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    x = materialise(measured(docs), "statistics")
    model = fit(x, labels, fit_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_matrix(b.column(1))), pa.float64())], names=["doc_id", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return map_arrow(x, score, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
