"""Periodic runs of words: every maximal repetition of a text, and the text with what repeats left out.

By the runs theorem the root of a run is the longest Lyndon word at one of its places, under the given or the opposite order of
words. The longest Lyndon word at a place ends where the next smaller suffix begins, so it comes from next smaller values of the
inverse suffix array, for either order. Each such root is extended to both sides by the longest common prefix of two suffixes,
and of two suffixes of the reversed text: the least of a range of the LCP array, by a sparse table. Places, roots and extensions
are as many as the words, so a text takes the time of its suffix sorts.

Runs asked for have MIN_RUN words and MIN_TURNS periods at least, so each of their GRAM-word windows is found a second time in the
same run. Stretches of windows that a text has twice hold all of these runs whole, and only the stretches are sorted; those of many
texts together, each with an end of its own. Windows are compared by hash, which can make a stretch longer and never shorter.

Edge cases: null, empty and blank texts have no words and no runs; a null doc_id takes no periodic ending; rows that repeat a
doc_id are rows of their own; an empty table gives an empty result; further columns are ignored. A task holds one slice of texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_arrow, raw, slices

MIN_RUN, MIN_TURNS, GRAM = 24, 3, 8
#: Words whose stretches are sorted together.
TOGETHER = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """The place of each suffix of s among all in order; a suffix that ends first is the smaller. Codes are from 1 on."""
    n = len(s)
    rank, step = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1, 1
    while n:
        key = rank * (n + 2)
        key[: n - step] += rank[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        held = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([True], held[1:] != held[:-1])))
        rank, step = new, step * 2
        if rank.max() == n:
            break
    return rank - 1


def common_prefixes(s: list, rank: np.ndarray) -> np.ndarray:
    """LCP array: of each suffix in order, how many codes it shares with the one before."""
    n, out, h = len(s), [0] * len(s), 0
    order, places = np.argsort(rank).tolist(), rank.tolist()
    for i, r in enumerate(places):
        if not r:
            h = 0
            continue
        j = order[r - 1]
        end = n - max(i, j)
        while h < end and s[i + h] == s[j + h]:
            h += 1
        out[r] = h
        h -= h > 0
    return np.array(out, np.int64)


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for many ranges, none empty: one row of the sparse table at a time."""
    out = np.zeros(len(lo), np.int64)
    level = np.frexp((hi - lo).astype(float))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[: len(table) - half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
    return out


def _shared(lcp: np.ndarray, rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How long the common prefixes of suffixes i and j are, i != j."""
    lo, hi = np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j])
    return least_between(lcp, lo + 1, hi + 1)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """Of each place, the next with a smaller value; the length where none is."""
    out, open_ = [len(rank)] * len(rank), []
    held = rank.tolist()
    for i, v in enumerate(held):
        while open_ and held[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def maximal_runs(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part, start, length and period of the runs of several sequences of codes, by part, start, period.

    Parts lie one after the other, each closed by an end that is smaller than every code and unlike the other ends.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    ends, k = np.cumsum(sizes + 1) - 1, len(parts)
    s, word = np.empty(len(codes) + k, np.int64), np.ones(len(codes) + k, bool)
    word[ends] = False
    s[ends] = np.arange(1, k + 1)
    most = codes.max(initial=0)
    s[word] = codes + k + 1
    turned = s.copy()
    turned[word] = most - codes + k + 1

    n, rank = len(s), suffix_ranks(s)
    back = suffix_ranks(s[::-1])
    lcp, lcs = common_prefixes(s.tolist(), rank), common_prefixes(s[::-1].tolist(), back)
    found = []
    for order in (rank, suffix_ranks(turned)):
        i = np.flatnonzero(word)
        j = next_smaller(order)[i]
        right = _shared(lcp, rank, i, j)
        left = np.zeros(len(i), np.int64)
        some = np.flatnonzero(i > 0)
        left[some] = _shared(lcs, back, n - i[some], n - j[some])
        start, period = i - left, j - i
        length = j + right - start
        keep = (length >= MIN_RUN) & (length >= MIN_TURNS * period)
        found.append(np.stack([start[keep], period[keep], length[keep]], 1))
    start, period, length = np.unique(np.concatenate(found), axis=0).T
    part = np.searchsorted(ends, start)
    return part, start - (ends[part] - sizes[part]), length, period


def _grams(held: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words at each place that has so many."""
    n = len(held) - GRAM + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j in range(GRAM if n > 0 else 0):
        total = (total ^ held[j : j + n]) * _ODD
        total ^= total >> np.uint64(29)
    return total


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of a text that can hold a run, as start and end."""
    grams = _grams(codes)
    if len(grams) < MIN_RUN - GRAM + 1:
        return []
    order = np.argsort(grams)
    held = grams[order]
    same = held[1:] == held[:-1]
    if not same.any():
        return []
    again = np.zeros(len(grams) + 2, np.int8)
    again[order[1:][same] + 1] = again[order[:-1][same] + 1] = 1
    edge = np.flatnonzero(np.diff(again))
    return [(int(a), int(b) + GRAM - 1) for a, b in edge.reshape(-1, 2) if b - a >= MIN_RUN - GRAM + 1]


def periodic_ending(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place, for the ids whose texts take a periodic ending; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def runs_of(texts: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """The (start, length, period) of every run of each text, given as words; by start, then period."""
    waiting: list[tuple[int, int, np.ndarray]] = []
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def settle() -> None:
        part, start, length, period = maximal_runs([x[2] for x in waiting])
        for p, a, m, q in zip(part.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
            out[waiting[p][0]].append((waiting[p][1] + a, m, q))
        waiting.clear()

    words = 0
    for k, text in enumerate(texts):
        if len(text) < MIN_RUN:
            continue
        hashes = np.fromiter(map(hash, text), np.int64, len(text)).view(np.uint64)
        for a, b in stretches(hashes):
            known: dict[bytes, int] = {}
            waiting.append((k, a, np.fromiter((known.setdefault(w, len(known)) for w in text[a:b]), np.int64, b - a)))
            words += b - a
        if words >= TOGETHER:
            settle()
            words = 0
    if waiting:
        settle()
    return (sorted(x, key=lambda r: (r[0], r[2])) for x in out)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def strongest(runs: Iterable[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or (d := r[1] * best[2] - best[1] * r[2]) > 0 or d == 0 and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


_OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("periods", pa.list_(pa.int64())), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("collapsed", pa.string()), ("collapsed_sha256", pa.string()), ("runs_sha256", pa.string())])


def _scan(endings: bool, texts: bool):
    names = [f.name for f in _OUT if texts or f.name != "collapsed"]
    schema = pa.schema([_OUT.field(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 4 << 20):
                ids, held = b.column(0).to_pylist(), [t.split() for t in raw(b.column(1))]
                if endings:
                    for k, (doc_id, words) in enumerate(zip(ids, held, strict=True)):
                        if (at := periodic_ending(len(words), doc_id)) is not None:
                            held[k] = [words[i] for i in at.tolist()]
                rows = []
                for doc_id, words, runs in zip(ids, held, runs_of(held), strict=True):
                    left = b" ".join(collapsed(words, runs))
                    best = strongest(runs) or (None, None, None)
                    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
                    whole_text = (left.decode(),) if texts else ()
                    columns = [list(c) for c in zip(*runs, strict=True)] or [[], [], []]
                    rows.append((doc_id, len(runs), *columns, *best, *whole_text, hashlib.sha256(left).hexdigest(), hashlib.sha256(listed.encode()).hexdigest()))
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def find_runs(docs: DataFrame, endings: bool = False, texts: bool = True) -> DataFrame:
    """doc_id, n_runs, arrays starts, lengths, periods of all runs, start, length, period of the strongest, collapsed and digests.

    endings gives the texts that periodic_ending names their periodic endings first; without texts, collapsed is left out.
    """
    fields = "doc_id long, n_runs long, starts array<long>, lengths array<long>, periods array<long>, start long, length long, period long, "
    schema = fields + ("collapsed string, " if texts else "") + "collapsed_sha256 string, runs_sha256 string"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _scan(endings, texts), schema)
