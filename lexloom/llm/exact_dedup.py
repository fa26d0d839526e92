"""Exact deduplication with Grace hash tables.

Each task first groups its own rows, so a text with a billion copies leaves a task as one row; only these local groups
are shuffled, by content hash, and a second table joins them. A table compares complete contents; when its memory is
used up, records with contents that it does not hold yet go to spill files by further bits of their hash, and each file
is then grouped in the same way. Membership is a plain equi-join on the digest, which Spark splits where it is skewed.

Edge cases: null and empty texts are equal to each other and to texts of white space alone. A null doc_id sorts after
every other. Rows that repeat a doc_id count as rows of their own in group_size and share its decision; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_arrow, raw, slices

#: The characters that the normalisation deletes: [\x20\x09-\x0D].
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of content that one table may hold before it spills.
TABLE_BYTES = 48 << 20
FANOUT = 16
LEVELS = 12

_GROUPS = "digest binary, content binary, best_chars long, best_id long, rows long"
_OUT = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("rows", pa.int64())])

Record = tuple[bytes, int, "int | None", int]


def _better(a: tuple[int, int | None], b: tuple[int, int | None]) -> bool:
    """a stays rather than b: more code points, then the smaller doc_id, nulls last."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


class OpenTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self, most_bytes: int):
        self.most, self.held, self.mask = most_bytes, 0, 1023
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[tuple[int, int | None]] = []
        self.rows: list[int] = []

    def _grow(self) -> None:
        self.mask = self.mask * 2 + 1
        self.slots = [-1] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = k

    def add(self, h: int, content: bytes, chars: int, doc_id: int | None, rows: int) -> bool:
        """False if the content is new and the table is full."""
        i = h & self.mask
        while (k := self.slots[i]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                self.rows[k] += rows
                if _better((chars, doc_id), self.best[k]):
                    self.best[k] = (chars, doc_id)
                return True
            i = (i + 1) & self.mask
        if self.held and self.held + len(content) > self.most:
            return False
        self.slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append((chars, doc_id))
        self.rows.append(rows)
        self.held += len(content) + 150
        if 3 * len(self.hashes) > 2 * self.mask:
            self._grow()
        return True


def _write(file, content: bytes, chars: int, doc_id: int | None, rows: int) -> None:
    head = b"%d %d %s %d\n" % (len(content), chars, b"-" if doc_id is None else b"%d" % doc_id, rows)
    file.write(head)
    file.write(content)


def _read(file) -> Iterator[Record]:
    file.seek(0)
    while head := file.readline():
        size, chars, doc_id, rows = head.split()
        yield file.read(int(size)), int(chars), None if doc_id == b"-" else int(doc_id), int(rows)


def grace_groups(records: Iterable[Record], most_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[bytes, int, int | None, int]]:
    """Groups (content, code points and doc_id of the row that stays, rows) of records in the same form."""
    table, spills = OpenTable(most_bytes if level < LEVELS else 1 << 62), [None] * FANOUT
    try:
        for content, chars, doc_id, rows in records:
            h = xxhash.xxh3_64_intdigest(content, seed=level)
            if not table.add(h, content, chars, doc_id, rows):
                k = (h >> 56) % FANOUT
                if spills[k] is None:
                    spills[k] = tempfile.TemporaryFile()
                _write(spills[k], content, chars, doc_id, rows)
        for content, (chars, doc_id), rows in zip(table.contents, table.best, table.rows, strict=True):
            yield content, chars, doc_id, rows
        del table
        for file in spills:
            if file is not None:
                yield from grace_groups(_read(file), most_bytes, level + 1)
    finally:
        for file in spills:
            if file is not None:
                file.close()


def _batches(groups: Iterable[tuple[bytes, int, int | None, int]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for g in groups:
        held.append((hashlib.sha256(g[0]).digest(), *g))
        size += len(g[0]) + 100
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _OUT.types, strict=True)], schema=_OUT)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _OUT.types, strict=True)], schema=_OUT)


def _normalised(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for whole in batches:
        for b in slices(whole):
            chars = pc.utf8_length(pc.fill_null(b.column(1).cast(pa.string()), "")).to_pylist()
            for doc_id, text, n in zip(b.column(0).to_pylist(), raw(b.column(1)), chars, strict=True):
                yield text.translate(None, SPACE), n, doc_id, 1


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(grace_groups(_normalised(batches)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[Record]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)

    for b in _batches(grace_groups(records())):
        yield b.drop_columns(["content"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            found = [hashlib.sha256(t.translate(None, SPACE)).digest() for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "digest"])


def groups(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: digest, best_chars, best_id, rows."""
    local = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _local, _GROUPS)
    return map_arrow(local.repartition("digest"), _joined, "digest binary, best_chars long, best_id long, rows long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    member = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _digests, "doc_id long, digest binary")
    return member.join(groups(docs), "digest").select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
