"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lexloom.session import ship

#: Bytes of text whose units are looked up together.
SLICE = 24 << 20


def filled(column: pa.Array) -> pa.Array:
    """Texts of an Arrow column as they are, null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of an Arrow column; null counts as empty."""
    return pc.fill_null(column.cast(pa.string()), "").cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about most_bytes at most, one row at least."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most_bytes / max(batch.nbytes, 1)))) if n else 1
    for i in range(0, n, step):
        yield batch.slice(i, step)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units between single spaces in many texts, every unit as a number of these, and where each text's units end."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    return flat.dictionary, flat.indices.to_numpy(), ends


#: Characters of the longest string that is remembered: words recur, runs of text without spaces do not.
WORD = 64


class Memo:
    """Remembered values of strings of up to WORD characters. It starts anew when it holds most of them, which changes no result."""

    def __init__(self, learn: Callable[[list[str]], Iterable], most: int):
        self.learn, self.most = learn, most
        self.known: dict[str, object] = {}

    def values(self, units: list[str]) -> list:
        """The value of each of several distinct strings; unknown ones are learned together."""
        out = list(map(self.known.get, units))
        if None in out:
            new = [u for u, v in zip(units, out, strict=True) if v is None]
            if len(self.known) + len(new) > self.most:
                self.known = {}
            found = list(self.learn(new))
            self.known.update((u, v) for u, v in zip(new, found, strict=True) if len(u) <= WORD)
            rest = iter(found)
            out = [next(rest) if v is None else v for v in out]
        return out


def gathered(parts: list[bytes], codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The items of parts[codes[0]], parts[codes[1]], ... one after the other, and how many each gave."""
    width = np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    held = np.frombuffer(b"".join(parts), kind)
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.cumsum(n)
    at = np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return held[at], n
