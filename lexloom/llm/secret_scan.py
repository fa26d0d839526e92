"""Secrets: base patterns, and novelty against a dictionary-primed zstandard compressor.

A candidate is a long run of token characters that follows a sensitive word closely. What it costs is the bytes by which
it lengthens the compressed form of its surroundings, where the compressor starts from a dictionary of common
identifiers. Short surroundings of a candidate without both letters and digits, which may be a word, are filled up with
prose, so that it costs what it costs in a text. Text, identifiers and repeated values cost few bytes a character; keys cost
at least what their own alphabet demands, and are reported as kind novel. A long key costs less than a fixed share can ask
for, so the lesser of share and demand counts.

Edge cases: null and empty texts have no spans and the digest of the empty string; repeated rows repeat their result;
offsets are code points, ends exclusive; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_arrow, slices, strings

KINDS = ("assign", "access", "hex", "novel")
BASE = 3
#: Characters of surroundings on each side, characters between sensitive word and candidate, least candidate, and the share of its bytes that a short one must cost.
AROUND, REACH, LEAST, COSTS = 256, 40, 16, 0.8
#: Characters measured at once; a longer candidate is novel where one of its windows is.
WINDOW = 4096

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")
_sensitive = re.compile(r"key|secret|token|passw|bearer|credential|private|signature", re.IGNORECASE | re.ASCII)
_candidate = re.compile(rf"[A-Za-z0-9+/_.-]{{{LEAST},}}(?:={{1,2}}(?![A-Za-z0-9+/_=.-]))?")
#: Alphabets of keys, the smallest first.
_alphabets = [(re.compile(p), n) for p, n in (("[0-9]+", 10), ("[0-9a-f]+|[0-9A-F]+", 16), ("[a-z]+|[A-Z]+", 26), ("[A-Z2-7]+=*|[a-z2-7]+=*", 32), ("[a-z0-9]+|[A-Z0-9]+", 36), ("[A-Za-z]+", 52), ("[A-Za-z0-9]+", 62))]

#: Identifiers, keywords and placeholder values that code and configuration repeat.
IDENTIFIERS = (
    "abstract access_key accessKeyId account address algorithm api_key apiKey application argument authorization base64 "
    "boolean bucket callback certificate changeme class client_id client_secret config configuration connection const "
    "container content-type context credential credentials database default delete deployment description document "
    "dummy-value element encoding endpoint environment example exception export false filename final function getenv "
    "handler header hostname https://example.com/ identifier implements import index integer interface json key language "
    "length localhost message method module namespace null number object optional os.environ package parameter passphrase "
    "passwd password path placeholder port private private_key process.env production property protected public public_key "
    "query redirect_uri region request resource response return schema secret secret_key secretAccessKey self server "
    "service session signature static status string switch template test-token this throw timeout token true type "
    "undefined update username utf-8 value variable version void webhook your-api-key-here xxxxxxxxxxxxxxxxxxxxxxxx "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
)

#: Fills surroundings that are shorter than AROUND.
PROSE = (
    "There was no sign of them in the morning, and the people who had waited by the river went back to their work. She said that "
    "some of the letters could be kept, but most would have to be sent again before the end of the year. Nothing else happened, "
    "so we walked down to the old house and talked about which of the books should go first. "
)


def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False)


class Novelty:
    """Marginal compressed bytes of a span within its surroundings."""

    def __init__(self) -> None:
        self.compress = _compressor().compress

    def share(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        span = text[start:end].encode()
        if not (re.search(b"[0-9]", span) and re.search(b"[A-Za-z]", span)):
            before = PROSE[: AROUND - len(before)] + before
        before, after = before.encode(), after.encode()
        with_it, without = len(self.compress(before + after + span)), len(self.compress(before + after))
        return (with_it - without) / len(span)

    def is_novel(self, text: str, start: int, end: int) -> bool:
        return self.share(text, start, end) >= demanded(text[start:end])


def demanded(span: str) -> float:
    """The share of its bytes that a span must cost: what a random one of its alphabet and length does at least."""
    bits = math.log2(next((n for p, n in _alphabets if p.fullmatch(span)), 64))
    return min(COSTS, 0.99 * bits / 8 * (1 + 16 / len(span)))


def find_secrets(text: str, novelty: Novelty) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    tried: set[int] = set()
    run, novel = (0, 0), -1  # the latest run of candidate characters, and of its windows after the first the last novel one
    for word in _sensitive.finditer(text):
        for m in _candidate.finditer(text, word.end(), min(len(text), word.end() + REACH + LEAST + 2)):
            start = m.start()
            if start - word.end() > REACH:
                break
            if start in tried:
                continue
            tried.add(start)
            if not run[0] <= start < run[1]:
                run = start, _candidate.match(text, start).end()
                later = (min(at, run[1] - WINDOW) for at in range(start + WINDOW, run[1], WINDOW))
                novel = max((at for at in later if novelty.is_novel(text, at, at + WINDOW)), default=-1)
            if novel >= start or novelty.is_novel(text, start, min(start + WINDOW, run[1])):
                found.append((start, 3, run[1]))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for whole in batches:
        for b in slices(whole):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                found = find_secrets(text, novelty)
                said = [(k, f"{k}:{s}:{e}") for k, s, e in found]
                base = ",".join(x for k, x in said if k != KINDS[BASE])
                counts = [sum(k == kind for k, *_ in found) for kind in KINDS] if found else [0] * len(KINDS)
                rows.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said)))
            columns = zip(*rows, strict=True) if rows else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans for every row of docs."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _scan, f"doc_id long, {counts}, base_sha256 string, spans string")
