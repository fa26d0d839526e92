"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

A sequence of byte-pair tokens is what the merges give exactly if each neighbouring pair is. So the last token of every
prefix follows from the last tokens of shorter prefixes: it is the one token that ends there and agrees with the token
before it. One pass over a piece of text gives the exact count at each of its prefixes, and counts, truncations and
budgets are then lookups. Pieces are what the tokenizer's own pattern cuts a text into; no merge crosses them.

Edge cases: null and empty texts have no bytes and no tokens; strings of special tokens in a text count as one token each,
as the library does by default; repeated rows repeat their result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, Memo, map_arrow, slices, strings

#: Units whose counts a worker remembers at most; beyond that it starts anew.
REMEMBERED = 600_000
#: Characters without which single spaces and newlines part a text into units that can be counted alone.
_hard = re.compile("[^\n\x20-\x84\x86-\x9f\xa1-\u024f]")
_doubled = ("  ", "\n\n", " \n", "\n ")
_odd = re.compile("[\x1c-\x1f]|[^\x00-\u024f]")
#: The pattern by which byte-level vocabularies of this family cut texts.
_pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, as letter -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes, for one byte-level byte-pair tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        as_bytes = lambda word: bytes(letters[c] for c in word)
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {as_bytes(w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.longest = max(map(len, self.tokens))
        #: Every ending of a token: what is none of these ends no token.
        self.endings = {t[k:] for t in self.tokens for k in range(len(t))}
        self.made = {a + b: (a, b, k) for (a, b), k in self.rank.items()}
        self.agrees: dict[tuple[bytes, bytes], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.memo = Memo(self._learn, REMEMBERED)
        self.small: dict[bytes, int] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The tokens of a short byte string by applying merges in the order of their ranks."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _agrees(self, before: bytes, token: bytes) -> bool:
        key = (before, token)
        if (known := self.agrees.get(key)) is None:
            if len(self.agrees) > 2 * REMEMBERED:
                self.agrees.clear()
            known = self.agrees[key] = self._apart(before, token) if before else self.merged(token) == [token]
        return known

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at one edge of a token while it is merged: (part, rank of the merge that takes it), bytes first."""
        if (known := self.edges[side].get(token)) is None:
            known, part, taken = [], token, 1 << 60
            while True:
                known.append((part, taken))
                if part not in self.made:
                    break
                *halves, taken = self.made[part]
                part = halves[side]
            known.reverse()
            self.edges[side][token] = known
        return known

    def _apart(self, before: bytes, token: bytes) -> bool:
        """Whether no merge joins two neighbouring tokens. Merges happen in the order of ranks, of equal ones the left first."""
        left, right, i, j = self._edge(before, 1), self._edge(token, 0), 0, 0
        while True:
            (a, a_taken), (b, b_taken) = left[i], right[j]
            rank = self.rank.get((a, b))
            if rank is not None and rank < a_taken and rank <= b_taken:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1

    def piece(self, text: bytes) -> list[int]:
        """counts[i]: tokens of the first i bytes of one piece."""
        n = len(text)
        counts = [0] * (n + 1)
        self._extend(text, 0, [b""] * (n + 1), counts)
        return counts

    def _extend(self, text: bytes, known: int, last: list[bytes], counts: list[int]) -> None:
        """The last token and the count of each prefix that is longer than known bytes."""
        tokens, agrees, endings = self.tokens, self.agrees, self.endings
        for i in range(known + 1, len(text) + 1):
            found, start = [], i - 1
            while start >= 0 and (token := text[start:i]) in endings:
                if token in tokens:
                    found.append((start, token))
                start -= 1
            for start, token in reversed(found):
                pair = (last[start], token)
                if pair in agrees and agrees[pair] or pair not in agrees and self._agrees(*pair):
                    last[i], counts[i] = token, counts[start] + 1
                    break
            else:
                raise ValueError("a byte of the text is not in the vocabulary")

    def _learn(self, units: list[str]) -> list[int]:
        """Counts of units together: in sorted order each piece takes over the prefixes that it shares with the one before."""
        if len(self.small) + len(units) > REMEMBERED:
            self.small.clear()
        cut = [[p.encode() for p in self._cut(u if u[0] == "\n" else " " + u)] for u in units]
        small, long_ = self.small, {}
        before, last, counts = b"", [b""], [0]
        for piece in sorted({p for ps in cut for p in ps if p not in small}):
            n, k, most = len(piece), 0, min(len(piece), len(before))
            while k < most and piece[k] == before[k]:
                k += 1
            last[k + 1 :] = [b""] * (n - k)
            counts[k + 1 :] = [0] * (n - k)
            self._extend(piece, k, last, counts)
            before = piece
            (small if n <= WORD else long_)[piece] = counts[n]
        return [sum(small[p] if p in small else long_[p] for p in ps) for ps in cut]

    def _count(self, text: bytes) -> int:
        if (known := self.small.get(text)) is None:
            if len(self.small) > REMEMBERED:
                self.small.clear()
            known = self.piece(text)[-1]
            if len(text) <= WORD:
                self.small[text] = known
        return known

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text without special tokens."""
        if not _odd.search(text):
            return _pieces.findall(text)
        return [text[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special tokens, and those."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def _units(self, text: str) -> list[str] | None:
        """Units that no piece crosses, each of a few pieces; None if spaces alone don't give them.

        The first unit stands as it is. Of the others, one that starts with a newline does too, and the rest lack the
        space before them.
        """
        if _hard.search(text) or any(map(text.__contains__, _doubled)) or text[0] in " \n" or text[-1] in " \n" or self.special and self.special.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def count(self, text: str) -> int:
        return sum(self.unit_counts(text)[1])

    def unit_counts(self, text: str) -> tuple[list[str], list[int]]:
        """Units that make up the text, and the tokens of each; a special token is a unit of one token."""
        return next(self.all_unit_counts([text]))

    def all_unit_counts(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        cut = [self._units(t) if t else [] for t in texts]
        distinct = list(dict.fromkeys(u for units in cut if units for u in units[1:]))
        known = dict(zip(distinct, self.memo.values(distinct), strict=True))
        for text, units in zip(texts, cut, strict=True):
            if units is None:
                yield self._whole(text)
            else:
                yield units, [sum(self._count(p.encode()) for p in self._cut(units[0])), *map(known.__getitem__, units[1:])] if units else []

    def _whole(self, text: str) -> tuple[list[str], list[int]]:
        units, counts = [], []
        for part, special in self._parts(text):
            if special:
                units.append(part)
                counts.append(1)
            else:
                for p in self._cut(part):
                    units.append(p)
                    counts.append(self._count(p.encode()))
        return units, counts

    def prefix_counts(self, text: str) -> list[int]:
        """counts[i]: tokens that the library gives for the first i code points of the text."""
        counts, base, before = [0], 0, ("", 0)
        for part, special in self._parts(text):
            if special:
                # until it is whole, its letters are ordinary text after that before it, which keeps its tokens only then
                ordinary, fixed = before
                counts += [fixed + self.count(ordinary + part[:i]) for i in range(1, len(part))]
                counts.append(base + 1)
                base = counts[-1]
                continue
            before = part, base
            since, previous = base, ""
            for p in self._cut(part):
                at = self.piece(p.encode())
                ends = list(accumulate(len(c.encode()) for c in p))
                own = [base + at[e] for e in ends]
                if p[0].isspace() and previous and previous.isspace():
                    own[0] = since + self._count((previous + p[0]).encode())
                if p in ("'re", "'ve", "'ll"):
                    own[1] = base + 2
                counts += own
                since, base, previous = base, base + at[-1], p
        return counts

    def truncated(self, text: str, limit: int) -> int:
        """Code points of the longest prefix of at most limit tokens."""
        return self._truncated(text, limit, *self.unit_counts(text))

    def _truncated(self, text: str, limit: int, units: list[str], counts: list[int]) -> int:
        sums = list(accumulate(counts))
        if not sums or sums[-1] <= limit:
            return len(text)
        k = bisect_right(sums, limit)
        if self._units(text) is None:
            if self.special and self.special.search(text):
                return max(i for i, n in enumerate(self.prefix_counts(text)) if n <= limit)
            return self._within(units, sums, k, limit)
        left = limit - (sums[k - 1] if k else 0)
        spaced = [u if not i or u[0] == "\n" else " " + u for i, u in enumerate(units[: k + 1])]
        inside = self.prefix_counts(spaced[k])
        return sum(map(len, spaced[:k])) + max(i for i, n in enumerate(inside) if n <= left)


    def _within(self, units: list[str], sums: list[int], k: int, limit: int) -> int:
        """The same for pieces, of which the counts up to piece k are within the limit: only that piece is read again, and one letter after it."""
        base, p = sums[k - 1] if k else 0, units[k]
        # what is longer than as many of the longest tokens has more tokens
        some = p[: (limit - base + 1) * self.longest]
        at, until = self.piece(some.encode()), sum(map(len, units[:k]))
        own = [base + at[e] for e in accumulate(len(c.encode()) for c in some)]
        if p[0].isspace() and k and units[k - 1].isspace():
            own[0] = (sums[k - 2] if k > 1 else 0) + self._count((units[k - 1] + p[0]).encode())
        if p in ("'re", "'ve", "'ll"):
            own[1] = base + 2
        if p.isspace() and k + 1 < len(units) and units[k + 1][0].isspace() and base + self._count((p + units[k + 1][0]).encode()) <= limit:
            return until + len(p) + 1
        return until + max((i for i, n in enumerate(own, 1) if n <= limit), default=0)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("limit_chars", pa.int64())])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and limit_chars, the code points of the longest prefix within limit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path)
        for whole in batches:
            for b in slices(whole):
                rows, held = [], strings(b.column(1))
                for doc_id, text, (units, counts) in zip(b.column(0).to_pylist(), held, counter.all_unit_counts(held), strict=True):
                    n = sum(counts)
                    rows.append((doc_id, len(text.encode()), n, n > limit, counter._truncated(text, limit, units, counts) if n > limit else len(text)))
                columns = zip(*rows, strict=True) if rows else [()] * len(_OUT)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
