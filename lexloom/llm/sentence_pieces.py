"""SentencePiece encoding that keeps source offsets, and decoding.

The model's compiled character map is a double-array trie with the replacement strings behind it. Normalising takes the
longest entry at each place and notes the source byte of every character that it writes, so each piece projects to a span
of original bytes; counts, digests and covered bytes are taken from these pieces. Text between spaces is encoded and
projected once and remembered, and gets its offset in each document: no piece of a model with whitespace prefixes holds
a space mark after another character, so no merge crosses such a place; models or texts for which that can't be shown
are encoded and projected whole. Either way the library makes the pieces, and decodes each document's ids.

Edge cases: null and empty texts have no ids and decode to the empty text; repeated rows repeat their result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.llm.common import Memo, cut_units, filled, gathered, map_arrow, slices

MARK = "▁"
#: Units that a worker remembers at most; beyond that it starts anew.
REMEMBERED = 500_000
#: Bytes of text whose spans are held together.
SLICE = 8 << 20


class CharacterMap:
    """Longest-prefix replacement by a compiled map; an empty map keeps every character."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest entry at a byte, and the bytes that it takes."""
        if not self.units:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(b"\0", start)], found[1]


def _firsts(held: bytes) -> np.ndarray:
    """Where the characters of UTF-8 begin."""
    return np.flatnonzero((np.frombuffer(held, np.uint8) & 0xC0) != 0x80)


def _packed(ids: np.ndarray | list[int], begin: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([ids, begin, end], 1).astype("<i4").tobytes()


class Pieces(NamedTuple):
    """Pieces of several texts one after the other: ids, first source bytes, ends; where each text's pieces begin and end; ids as text."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    ends: np.ndarray
    names: list[str]

    def bounds(self) -> Iterator[tuple[int, int]]:
        return zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)

    def covered(self) -> np.ndarray:
        """Source bytes of each text that some piece covers."""
        before = np.concatenate([[0], self.end])[:-1]
        before[self.ends[:-1][np.diff(self.ends) > 0]] = 0
        sums = np.concatenate([[0], np.cumsum(np.maximum(self.end - np.maximum(self.begin, before), 0))])
        return np.diff(sums[self.ends])

    def listed(self) -> pa.Array:
        columns = [pa.array(c, pa.int32()) for c in (np.ascontiguousarray(self.ids), self.begin, self.end)]
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(columns, ["id", "begin", "end"]))


class PieceCoder:
    """Encode with spans of original bytes, and decode, for one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        self.map, self.prefix, self.strip = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        byte = sentencepiece_model_pb2.ModelProto.SentencePiece.Type.Value("BYTE")
        self.is_byte = [p.type == byte for p in model.pieces]
        self.said = [bytes([int(p.piece[3:5], 16)]) if b else p.piece.encode() for p, b in zip(model.pieces, self.is_byte, strict=True)]
        self.width = np.fromiter(map(len, self.said), np.int64, len(self.said))
        user = sentencepiece_model_pb2.ModelProto.SentencePiece.Type.Value("USER_DEFINED")
        texts = [p.piece for p, b in zip(model.pieces, self.is_byte, strict=True) if not b]
        self.apart = not self.map.units and self.prefix and not self.strip and not self.suffix and model.trainer_spec.byte_fallback and user not in kinds and not any(MARK in t.lstrip(MARK) or "\n" in t for t in texts)
        self.mark, self.line = self.library.piece_to_id(MARK), self.library.piece_to_id("<0x0A>")
        self.memo = Memo(self._learn, REMEMBERED)

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text that pieces are cut from, and the source byte of each of its characters, with the end."""
        held = text.encode()
        if not self.map.units and not self.strip and held:
            # every character stays, a space as its mark
            own, whole = _firsts(held), np.array([len(held)])
            before, after = self.prefix and not self.suffix, self.prefix and self.suffix
            said = MARK * before + text.replace(" ", MARK) + MARK * after
            return said, np.concatenate([own[:1]] * before + [own] + [whole] * after + [whole])
        out: list[str] = []
        source: list[int] = []
        at, spaced = 0, self.strip

        def step() -> tuple[str, int]:
            if (hit := self.map.longest(held, at)) is not None:
                return hit[0].decode(), hit[1]
            n = 1 + (held[at] >= 0xC0) + (held[at] >= 0xE0) + (held[at] >= 0xF0)
            return held[at : at + n].decode(), n

        while self.strip and at < len(held) and (hit := step())[0] == " ":
            at += hit[1]
        if at == len(held):
            return "", np.zeros(1, np.int64)
        if self.prefix and not self.suffix:
            out.append(MARK)
            source.append(at)
        while at < len(held):
            said, taken = step()
            if spaced:
                said = said.lstrip(" ")
            for c in said:
                out.append(MARK if c == " " else c)
                source.append(at)
            if said or not spaced:
                spaced = self.strip and said.endswith(" ")
            at += taken
        while self.strip and out and out[-1] == MARK:
            at = source.pop()
            out.pop()
        if self.prefix and self.suffix:
            out.append(MARK)
            source.append(at)
        return "".join(out), np.array([*source, at], np.int64)

    def _project(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First source byte and end of each piece of a text. A byte piece has one byte of its character, or all of what was replaced."""
        said, source = self.normalised(text)
        held = said.encode()
        if b"".join(map(self.said.__getitem__, ids.tolist())) != held:
            raise ValueError("the pieces are not the normalised text")
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = _firsts(held)
        size, taken = np.diff(first, append=len(held)), np.diff(source)
        char = np.repeat(np.arange(len(first)), size)
        ends = np.cumsum(self.width[ids])
        at, last = char[ends - self.width[ids]], char[ends - 1]
        into, until = ends - self.width[ids] - first[at], ends - first[last]
        begin = source[at] + np.where(taken[at] == size[at], into, 0)
        return begin, np.where((until < size[last]) & (taken[last] == size[last]), source[last] + until, source[last + 1])

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first source byte, end) of each piece."""
        found = self.pieces(pa.array([text], pa.string()))
        return list(zip(found.ids.tolist(), found.begin.tolist(), found.end.tolist(), strict=True))

    def _whole(self, texts: pa.Array) -> pa.Array:
        """Whether a text must be encoded whole. In others no merge crosses a space, which goes with what follows it, or a newline."""
        if not self.apart:
            return pa.array([True] * len(texts))
        found = pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))
        for mark in ("  ", " \n", "\0", MARK):
            found = pc.or_(found, pc.match_substring(texts, mark))
        return pc.or_(found, pc.starts_with(texts, "\n"))

    def _learn(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each unit as text, and its pieces with their spans counted from the space before the unit."""
        found = self.library.encode(units, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        begin, end = self._project(" ".join(filter(None, units)), ids)
        if len(begin):
            begin[0] = -1  # there the first mark has a space too
        taken = np.fromiter((len(u.encode()) + 1 if u else 0 for u in units), np.int64, len(units))
        start = np.repeat(np.cumsum(taken) - taken - 1, sizes)
        held, k = _packed(ids, begin - start, end - start), 0
        for u, own in zip(units, found, strict=True):
            n = len(own)
            if u[:1] == "\n":
                if own[:2] != [self.mark, self.line]:
                    raise ValueError("a newline was merged with its neighbours")
                yield ",".join(map(str, own[1:])), held[12 * (k + 1) : 12 * (k + n)]
            else:
                yield ",".join(map(str, own)), held[12 * k : 12 * (k + n)]
            k += n

    def pieces(self, texts: pa.Array) -> Pieces:
        """The pieces of several texts with their spans: of each unit as remembered, moved to its place."""
        whole = self._whole(texts)
        units, codes, ends = cut_units(pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"))
        parts, starts = self.memo.values(units.to_pylist()), np.concatenate([[0], ends])[:-1]
        led = pc.starts_with(units, "\n").to_numpy(zero_copy_only=False)
        # the space that a unit takes is before it, for the first unit before the text; a newline has none
        took = (pc.binary_length(units).to_numpy(zero_copy_only=False) + ~led)[codes]
        place = np.cumsum(took) - took
        place -= np.repeat(place[starts] + 1, ends - starts) + led[codes]
        codes = codes.copy()
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            text = texts[k].as_py()
            ids = self.library.encode(text)
            begin, end = self._project(text, np.array(ids, np.int64))
            codes[starts[k]] = len(parts)
            parts.append((",".join(map(str, ids)), _packed(ids, begin + 1, end + 1)))
        said = [p[0] for p in parts]
        held, n = gathered([p[1] for p in parts], codes, "V12")
        held = held.view("<i4").reshape(-1, 3)
        place = np.repeat(place, n)
        until = np.concatenate([[0], np.cumsum(n)])
        names = [",".join(filter(None, map(said.__getitem__, codes[s:e].tolist()))) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        return Pieces(held[:, 0], np.maximum(held[:, 1] + place, 0), held[:, 2] + place, np.concatenate([[0], until[ends]]), names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.pieces(pa.array(texts, pa.string()))
        return [found.ids[s:e].tolist() for s, e in found.bounds()]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def digests(self, found: Pieces) -> list[pa.Array]:
        """Tokens, digest of the ids, digest of the decoded text, and source bytes under the pieces' spans."""
        ids = [hashlib.sha256(said.encode()).hexdigest() for said in found.names]
        decoded = [hashlib.sha256(self.decode(found.ids[s:e].tolist()).encode()).hexdigest() for s, e in found.bounds()]
        return [pa.array(c, t) for c, t in zip((np.diff(found.ends), ids, decoded, found.covered()), _KINDS, strict=True)]


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64()]
_PIECES = "pieces array<struct<id:int,begin:int,end:int>>"


def _measured(docs: DataFrame, path: str, kept: list[str], listed: bool) -> DataFrame:
    """Columns of docs(text, ...) with those of _DIGESTS and, where listed, of _PIECES."""
    new = StructType.fromDDL(f"{_DIGESTS}, {_PIECES}" if listed else _DIGESTS)
    at, own = docs.columns.index("text"), [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(path)
        for whole in batches:
            for b in slices(whole, SLICE):
                found = coder.pieces(filled(b.column(at)))
                more = [*coder.digests(found), *([found.listed()] if listed else [])]
                yield pa.RecordBatch.from_arrays([*map(b.column, own), *more], names=[*kept, *new.names])

    return map_arrow(docs, run, StructType([*(docs.schema[c] for c in kept), *new.fields]))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_span_bytes for every row of docs(doc_id, text)."""
    return _measured(docs.select(F.col("doc_id").cast("long"), "text"), path, ["doc_id"], listed=False)


def with_pieces(docs: DataFrame, path: str) -> DataFrame:
    """docs(text, ...) with the columns of encode_decode and pieces, an array of (id, first source byte, end); columns of docs with these names go."""
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes", "pieces")
    return _measured(docs, path, docs.columns, listed=True)
