"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

The base kinds (email, ip, card, phone) are reported whenever pattern and check hold; their score, from the kind and the
words around a span, is a further result. Two more kinds exist only through the method: iban spans need the mod-97
check, and national numbers (nid), which have no checksum, need a context word to reach the threshold.

Edge cases: null and empty texts have no spans and the digest of the empty string; each row is scanned by itself, so
repeated rows repeat their result; offsets are code points, ends exclusive; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_arrow, slices, strings

KINDS = ("email", "ip", "card", "phone", "iban", "nid")
BASE = 4
#: Score that a kind has without context; a context word adds CONTEXT_BONUS. Spans of the further kinds below THRESHOLD go.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "nid": 0.3}
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 0.3, 48, 0.5
CONTEXT = {
    "email": r"e-?mail|contact|mail\b",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|master|credit|debit|payment",
    "phone": r"phone|tel\b|mobile|call|fax",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "nid": r"\bssn\b|social security|national id|tax id",
}
_context = {k: re.compile(v, re.IGNORECASE | re.ASCII) for k, v in CONTEXT.items()}

_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does and takes whole runs, so none is tried again in parts.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_nid = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_not_digit = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number without spaces leaves 1 when its letters stand for 10 to 35."""
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, found from each @ outwards."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local_chars:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers that pass mod-97; each ends at the last word with which it does, as a match can take words that follow."""
    found, m = [], _iban.search(text)
    while m:
        ends = [m.end(), *(e for e in range(m.end() - 1, m.start(), -1) if text[e] == " ")]
        held = (e for e in ends if (n := _iban.match(text, m.start(), e)) and n.end() == e and mod97(n[0].replace(" ", "")))
        if (end := next(held, None)) is not None:
            found.append((m.start(), end))
        m = _iban.search(text, m.start() + 1 if end is None else end)
    return found


def _small(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def find_pii(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as in KINDS, then start."""
    found = [("email", s, e) for s, e in emails(text)]
    if text.isascii() and not any(map(text.__contains__, "0123456789")):
        return [(k, s, e, _score(text, k, s, e)) for k, s, e in found]
    found += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(map(_small, m[0].split(".")))]
    found += [("card", m.start(), m.end()) for m in _card.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d)]
    found += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 8 <= len(_not_digit.sub("", m[0])) <= 15]
    out = [(k, s, e, _score(text, k, s, e)) for k, s, e in found]
    further = [("iban", s, e) for s, e in ibans(text)] + [("nid", m.start(), m.end()) for m in _nid.finditer(text)]
    return out + [(k, s, e, score) for k, s, e in further if (score := _score(text, k, s, e)) >= THRESHOLD]


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS])
    return min(1.0, SCORES[kind] + CONTEXT_BONUS * any(map(_context[kind].search, near)))


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                found = find_pii(text)
                said = [f"{k}:{s}:{e}" for k, s, e, _ in found]
                counts = [0] * len(KINDS)
                for k, *_ in found:
                    counts[KINDS.index(k)] += 1
                base = ",".join(said[: sum(counts[:BASE])])
                rows.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), [x[3] for x in found]))
            columns = zip(*rows, strict=True) if rows else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_iban, n_nid, base_sha256, spans, scores for every row of docs."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _scan, f"doc_id long, {counts}, base_sha256 string, spans string, scores array<double>")


def redact_pii(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the leftmost, then longest."""
    out, at = [], 0
    for kind, s, e, _ in sorted(find_pii(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join(out) + text[at:]
