"""Token ids in files: static range asymmetric numeral system over interleaved lanes.

One frequency table, counted over all ids and scaled to a power of two, serves every block. A block holds whole
documents; id i of a block goes to lane i mod lanes, and all lanes take a step together. Every CHECK_ROWS steps the lanes'
states are noted, so a reader can start there, and checksums cover the payload and the ids. A store is a folder of rows
that Spark writes (one block a row, shards in ascending doc_id order), beside a table of frequencies.

Edge cases: null and empty texts have only the end id; null doc_ids come first; rows that repeat a doc_id are documents
of their own, in the order of their ids; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import SLICE, Memo, cut_units, filled, gathered, map_arrow, slices
from lexloom.session import new_path

#: Bits of the frequency table's sum, least state, ids of a block before it closes, rows of lanes between checkpoints.
BITS, LEAST, BLOCK_IDS, CHECK_ROWS = 20, 1 << 31, 1 << 20, 128
MOST_LANES = 2048
REMEMBERED = 1_200_000


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**BITS, nearly in proportion to counts."""
    total, size = max(int(counts.sum()), 1), 1 << BITS
    if len(counts) > size:
        raise ValueError("more symbols than the table has room for")
    f = np.maximum(1, (counts.astype(np.float64) * (size - len(counts)) / total).astype(np.int64))
    f[int(np.argmax(counts))] += size - int(f.sum())
    return f.astype(np.uint64)


class Ans:
    """Encoder and decoder of blocks for one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1]])
        self.symbol: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = 1
        while lanes < MOST_LANES and lanes * 256 < n:
            lanes *= 2
        rows = -(-n // lanes)
        state = np.full(lanes, LEAST, np.uint64)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * rows
        checks: list[tuple[int, np.ndarray]] = []
        bits, shift, step = np.uint64(BITS), np.uint64(32), np.uint64(63 - BITS)
        for r in range(rows - 1, -1, -1):
            s = ids[r * lanes : (r + 1) * lanes]
            f, c = self.freq[s], self.start[s]
            x = state[: len(s)]
            full = x >= f << step
            if full.any():
                words[r] = x[full].astype(np.uint32)
                x = np.where(full, x >> shift, x)
            q = x // f
            state[: len(s)] = (q << bits) + (x - q * f) + c
            if r and r % CHECK_ROWS == 0:
                checks.append((r, state.copy()))
        sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(w) for w in words])])
        head = struct.pack("<QII", n, lanes, len(checks))
        notes = b"".join(struct.pack("<IQ", r, int(sizes[r])) + x.astype("<u8").tobytes() for r, x in reversed(checks))
        body = np.concatenate(words).astype("<u4").tobytes() if rows else b""
        return head + state.astype("<u8").tobytes() + notes + body

    @staticmethod
    def firsts(payload: bytes) -> np.ndarray:
        """The place of the first id after the start and after each checkpoint of a block."""
        _, lanes, n = struct.unpack_from("<QII", payload)
        rows = [struct.unpack_from("<I", payload, 16 + 8 * lanes + k * (12 + 8 * lanes))[0] for k in range(n)]
        return np.array([0, *rows]) * lanes

    def between(self, payload: bytes, since: int, until: int) -> np.ndarray:
        """The ids of a block from one place to another, decoded from the last checkpoint before and no further than the next one after."""
        firsts = self.firsts(payload)
        parts = range(int(np.searchsorted(firsts, since, "right")) - 1, int(np.searchsorted(firsts, max(until, since + 1), "left")))
        held = np.concatenate([np.zeros(0, np.uint32), *[self.decode(payload, p) for p in parts]])
        return held[since - int(firsts[parts[0]]) :][: until - since]

    def decode(self, payload: bytes, part: int | None = None) -> np.ndarray:
        """The ids of a block, or those from checkpoint number part (0: the start) up to the next."""
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        n, lanes, n_checks = struct.unpack_from("<QII", payload)
        at = 16
        marks = [(0, 0, np.frombuffer(payload, "<u8", lanes, at))]
        at += 8 * lanes
        for _ in range(n_checks):
            r, word = struct.unpack_from("<IQ", payload, at)
            marks.append((r, word, np.frombuffer(payload, "<u8", lanes, at + 12)))
            at += 12 + 8 * lanes
        words = np.frombuffer(payload, "<u4", offset=at)
        rows = -(-n // lanes)
        first, pos, state = marks[part or 0]
        last = rows if part is None or part + 1 >= len(marks) else marks[part + 1][0]
        state = state.astype(np.uint64)
        out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
        mask, bits, shift, least = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(LEAST)
        for r in range(first, last):
            m = min(lanes, n - r * lanes)
            x = state[:m]
            slot = x & mask
            s = self.symbol[slot]
            out[(r - first) * lanes : (r - first) * lanes + m] = s
            x = self.freq[s] * (x >> bits) + slot - self.start[s]
            low = np.flatnonzero(x < least)
            if len(low):
                x[low] = x[low] << shift | words[pos : pos + len(low)]
                pos += len(low)
            state[:m] = x
        return out


class UnitIds:
    """Ids of texts by the tokenizers library, for tokenizers whose pieces never hold white space."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts = spec.get("pre_tokenizer") or {}
        first = (cuts.get("pretokenizers") or [cuts])[0]
        special = [t["content"] for t in spec["added_tokens"]]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        #: Each match of this pattern is free of white space and what lies between matches is dropped, so texts can be cut at spaces.
        self.apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and pattern == WORDS and not any(c.isspace() for t in special for c in t)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        #: Whether an id ends a word.
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.memo = Memo(self._learn, REMEMBERED)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> list[bytes]:
        """Ids of keys. Words of lower-case letters alone are each one piece, so their ids end at the first that ends a word."""
        words = [k for k in keys if k[:1] != WHOLE]
        found: list[bytes] = []
        if words:
            (ids,) = self._encode([" ".join(words)])
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            held = ids.tobytes()
            if len(ends) == len(words):
                found = [held[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                found = [x.tobytes() for x in self._encode(words)]
        whole = [k[1:] for k in keys if k[:1] == WHOLE]
        known, rest = iter(found), iter(self._encode(whole) if whole else ())
        return [next(rest).tobytes() if k[:1] == WHOLE else next(known) for k in keys]

    def _keys(self, units: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each unit what is looked up and the marks that follow it: a word in lower case, or the unit whole."""
        cut = pc.extract_regex(units, r"(?s)^(?P<word>.*?)(?P<tail>[!-/:-@\[-`{-~]*)$")
        word = pc.struct_field(cut, "word")
        low = pc.utf8_lower(word)
        plain = pc.utf8_is_alpha(word)
        held = units.buffers()[2]
        if held is not None and np.frombuffer(held, np.uint8).max(initial=0) >= LATIN_1:
            plain = pc.and_(pc.and_(plain, pc.utf8_is_alpha(low)), pc.match_substring_regex(word, SIMPLE))
        whole = pc.binary_join_element_wise(WHOLE, units, "")
        return pc.if_else(plain, low, whole), pc.if_else(plain, pc.struct_field(cut, "tail"), "")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids end."""
        if not self.apart:
            found = self._encode(texts.to_pylist())
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([len(x) for x in found])
        units, codes, ends = cut_units(pc.replace_substring(texts, "\n", " "))
        keys, tails = (x.dictionary_encode() for x in self._keys(units))
        marks = [x.tobytes() if t else b"" for t, x in zip(tails.dictionary.to_pylist(), self._encode(tails.dictionary.to_pylist()), strict=True)]
        words = self.memo.values(keys.dictionary.to_pylist())
        both = np.stack([keys.indices.to_numpy()[codes], tails.indices.to_numpy()[codes] + len(words)], axis=1).reshape(-1)
        ids, sizes = gathered(words + marks, both, "<u4")
        return ids, np.concatenate([[0], np.cumsum(sizes)])[2 * ends]


#: Letters that are lower-cased alone and stay as they are under NFC; what marks a unit that is looked up whole.
SIMPLE, WHOLE = r"^[\x{00}-\x{12f}\x{131}-\x{24f}]*$", "\0"
#: Text without bytes from here on has such letters alone.
LATIN_1 = 0xC4
#: The word pattern of tokenizers that this module may cut at spaces.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary()), ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64())])
_BLOCK_DDL = "shard int, block int, start long, n_ids long, doc_ids array<long>, counts array<long>, payload binary, payload_crc32 long, ids_crc32 long"
_ROW = pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def token_ids(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id and its ids with the end id, each row's packed by zstandard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack = UnitIds(path), zstandard.ZstdCompressor(level=1)
        kind = "<u2" if coder.library.get_vocab_size() <= 65536 else "<u4"
        stop = np.array([end], kind).tobytes()
        for whole in batches:
            for b in slices(whole, SLICE):
                ids, ends = coder.encode(filled(b.column(1)))
                ids, starts = ids.astype(kind), [0, *ends[:-1].tolist()]
                held = [pack.compress(ids[s:e].tobytes() + stop) for s, e in zip(starts, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], schema=_IDS)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def _frequencies(ids: DataFrame, size: int, wide: bool) -> np.ndarray:
    """Counts of every id; what reaches the driver is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(size, np.int64)
        for whole in batches:
            for b in slices(whole):
                held = b"".join(map(unpack.decompress, b.column(0).to_pylist()))
                total += np.bincount(np.frombuffer(held, "<u4" if wide else "<u2"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in map_arrow(ids.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_store(docs: DataFrame, tokenizer: str, path: str, end: int = 2) -> None:
    """Encode docs(doc_id, text) into the folder path, in ascending doc_id order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1)
    wide = size > 65536
    held = new_path(spark, "ids")
    token_ids(docs, tokenizer, end).write.option("compression", "none").parquet(held)
    ids = spark.read.schema("doc_id long, ids binary").parquet(held)
    freq = scaled(_frequencies(ids, size, wide))
    table = freq.astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(table),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/table")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ans, unpack, shard = Ans(np.frombuffer(table, "<u4")), zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        parts: list[np.ndarray] = []
        names: list[int | None] = []
        block = start = size = 0

        def close() -> pa.RecordBatch:
            joined = np.concatenate(parts).astype("<u4")
            payload = ans.encode(joined)
            row = (shard, block, start, len(joined), list(names), [len(p) for p in parts], payload, zlib.crc32(payload), zlib.crc32(joined.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)

        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.append(np.frombuffer(unpack.decompress(x), "<u4" if wide else "<u2"))
                names.append(doc_id)
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield close()
                    block, start, size = block + 1, start + size, 0
                    parts.clear()
                    names.clear()
        if parts:
            yield close()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    map_arrow(ordered, encode, _BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files; checksums are compared."""
    table = bytes(spark.read.parquet(f"{path}/table").first()["frequencies"])
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ans = Ans(np.frombuffer(table, "<u4"))
        for whole in batches:
            for k in range(whole.num_rows):
                (row,) = whole.slice(k, 1).to_pylist()
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: the payload is damaged")
                ids = ans.decode(row["payload"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: the ids differ")
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                crcs = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
                columns = ([row["shard"]] * len(ends), starts + row["start"], row["doc_ids"], row["counts"], crcs)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW.types, strict=True)], schema=_ROW)

    rows = map_arrow(blocks, decode, "shard int, start long, doc_id long, n_tokens long, ids_crc32 long")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start, ids of the documents of wanted(doc_id): of each block only the ranges between checkpoints that hold them are decoded.

    A document that stands several times comes several times; one that the store lacks does not come; start is its place in its block's shard.
    """
    table = bytes(spark.read.parquet(f"{path}/table").first()["frequencies"])
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    placed = blocks.select("shard", "block", "start", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("n", "d"))
    upto = F.sum("d.counts").over(Window.partitionBy("shard", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.select("shard", "block", F.col("d.doc_ids").alias("doc_id"), (upto - F.col("d.counts")).alias("since"), upto.alias("until"))
    asked = placed.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "since", "until")).alias("asked"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ans = Ans(np.frombuffer(table, "<u4"))
        for whole in batches:
            for row in (r for k in range(whole.num_rows) for r in whole.slice(k, 1).to_pylist()):
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: the payload is damaged")
                for d in row["asked"]:
                    ids = ans.between(row["payload"], d["since"], d["until"]).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((d["doc_id"], row["start"] + d["since"], ids), schema.types, strict=True)], schema=schema)

    met = blocks.join(asked, ["shard", "block"]).select("shard", "block", "start", "payload", "payload_crc32", "asked")
    return map_arrow(met, decode, "doc_id long, start long, ids array<long>")
