"""Periodic runs of words, found in a grammar of the text.

The words of a document become numbers.  Re-Pair replaces the most frequent pair of neighbours by a new symbol until no pair
repeats; pairs of equal frequency that share no symbol are replaced in one round.  Symbols left at the top are
joined in pairs, so every stretch of the text has a lowest symbol that holds it.  A run crosses the middle of the lowest symbol
that holds it, between its left and its right part; so each symbol is searched once, for runs across its middle, and what is
found is translated to every place where the symbol stands.  Of intervals of one period the largest stay.

The search tries the periods at which the word before or after the middle comes back, and measures how
far the text keeps the period to both sides.  A period is skipped where a shorter one that divides it already covers the stretch.

Before that, words that no run can hold split the text: in a run of period q and four or more periods each word but the
last q comes back within q words, so in a stretch of m words a word that comes back later than m / 3, or never, belongs to
no run but for the end of one.  Stretches are split until nothing changes; each is compressed and searched with as many words behind it
as its longest period.  This drops no run; most prose is left with nothing to compress.

Documents are independent: there is no shuffle, and a task holds one batch of texts.

Defined cases: a null text is empty; a document without a word has no run and the digests of the empty text; rows with the same
doc_id are documents of their own; a null doc_id is never made periodic; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many of its periods.
LEAST, PERIODS = 6, 4
OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of words that may stand in a run but for its last period, by rising start."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    later = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    later[order[:-1][same]] = (order[1:] - order[:-1])[same]
    out, open_ = [], [(0, n)]
    while open_:
        a, b = open_.pop()
        if b - a < LEAST - 1:
            continue
        far = np.flatnonzero(later[a:b] > (b - a) // (PERIODS - 1))
        if not len(far):
            out.append((a, b))
            continue
        cuts = np.r_[-1, far, b - a]
        wide = np.flatnonzero(np.diff(cuts) - 1 >= LEAST - 1)
        open_ += [(a + int(cuts[i]) + 1, a + int(cuts[i + 1])) for i in wide]
    return sorted(out)


def windows(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint windows of the text that hold all its runs whole."""
    out: list[tuple[int, int]] = []
    for a, b in _stretches(ids):
        b = min(len(ids), b + (b - a) // (PERIODS - 1))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Grammar:
    """Symbols of a word sequence as (length, length of the left part, starts in the text)."""

    def __init__(self, ids: np.ndarray) -> None:
        self.symbols: list[tuple[int, int, np.ndarray]] = []
        seq, starts = np.unique(ids, return_inverse=True)[1].astype(np.int64), np.arange(len(ids))
        length = [1] * (int(seq.max()) + 1 if len(seq) else 0)
        while len(seq) > 1:
            keys, first, inverse, counts = np.unique(seq[:-1] * len(length) + seq[1:], return_index=True, return_inverse=True, return_counts=True)
            most = counts.max()
            if most < 2:
                break
            tied = np.flatnonzero(counts == most)
            new, taken = np.full(len(keys), -1), set()
            for k in tied[np.argsort(first[tied])].tolist():
                pair = divmod(int(keys[k]), len(length))
                if taken.isdisjoint(pair):
                    taken.update(pair)
                    new[k] = len(length) + len(taken)
            chosen = np.flatnonzero(new >= 0)
            base = len(length)
            new[chosen] = base + np.arange(len(chosen))
            for k in chosen.tolist():
                left, right = divmod(int(keys[k]), base)
                length.append(length[left] + length[right])
            at = np.flatnonzero(new[inverse] >= 0)
            # a symbol twice over overlaps itself: of neighbouring places every other one is replaced
            fresh = np.r_[True, np.diff(at) > 1]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            symbol = new[inverse[at]]
            by = np.argsort(symbol, kind="stable")
            for own in np.split(at[by], np.flatnonzero(np.diff(symbol[by])) + 1):
                self.symbols.append((length[int(new[inverse[own[0]]])], length[int(seq[own[0]])], starts[own]))
            seq[at] = symbol
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            seq, starts = seq[keep], starts[keep]
        edges = [*starts.tolist(), len(ids)]
        #: Symbols of the text itself, before they are joined in pairs.
        self.top = len(starts)
        while len(edges) > 2:
            for i in range(0, len(edges) - 2, 2):
                self.symbols.append((edges[i + 2] - edges[i], edges[i + 1] - edges[i], np.array([edges[i]])))
            edges = edges[::2] if len(edges) % 2 else [*edges[::2], edges[-1]]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        to = min(n, at + step)
        differs = a[at:to] != b[at:to]
        if differs.any():
            return at + int(differs.argmax())
        at, step = to, step * 4
    return n


def crossing(u: np.ndarray, middle: int) -> list[Run]:
    """(start, end, period) of the runs of u that cross its middle, by rising period."""
    n = len(u)
    back, on = u[:middle][::-1], u[middle:]
    # of four periods two stand whole on one side of the middle
    left = 1 + np.flatnonzero(back[1 : min(middle // 2, n // PERIODS) + 1] == back[0])
    right = 1 + np.flatnonzero(on[1 : min(len(on) // 2, n // PERIODS) + 1] == on[0])
    if not len(left) + len(right):
        return []
    left, right = set(left.tolist()), set(right.tolist())
    found: list[Run] = []
    for q in sorted(left | right):
        for side in (left, right):
            if q not in side:
                continue
            near = (middle - 2 * q, middle) if side is left else (middle, middle + 2 * q)
            if any(q % p == 0 and s <= near[0] and near[1] <= e for s, e, p in found):
                continue
            if side is left:
                before, after = _same(back, back[q:]), _same(on, u[middle - q :])
                start, end = middle - q - before, middle + after
                crosses = before >= q and after > 0
            else:
                before, after = _same(back, u[: middle + q][::-1]), _same(on, on[q:])
                start, end = middle - before, middle + q + after
                crosses = after >= q and before > 0
            if crosses and end - start >= max(LEAST, PERIODS * q) and not any(q % p == 0 and s <= start and end <= e for s, e, p in found):
                found.append((start, end, q))
    return found


def _largest(found: np.ndarray) -> list[Run]:
    """Of (period, start, end) rows those that no other of their period holds, as (start, length, period) by start and period."""
    found = np.unique(found, axis=0)
    found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
    out, period, reach = [], 0, 0
    for q, s, e in found.tolist():
        if q != period or e > reach:
            out.append((s, e - s, q))
            period, reach = q, e
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(ids: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a sequence of numbers, by start and period."""
    found = []
    for a, b in windows(ids):
        for length, middle, starts in Grammar(ids[a:b]).symbols:
            if length >= LEAST:
                u = ids[a + starts[0] : a + starts[0] + length]
                for s, e, q in crossing(u, middle):
                    found.append(np.stack([np.full(len(starts), q), a + starts + s, a + starts + e], axis=1))
    return _largest(np.concatenate(found)) if found else []


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic end that the query's documents get by their id: one in ten has one."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * -(-(n - a) // p))[: n - a]


def summary(words: list[bytes]) -> tuple:
    """n_runs, start, length, period and exponent of the longest run, digests of all runs and of the words without repeats."""
    number: dict[bytes, int] = {}
    found = runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))) if len(words) >= LEAST else []
    if found:
        keep = np.ones(len(words), bool)
        for s, n, q in found:
            keep[s + q : s + n] = False
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return len(found), s, n, q, 1000 * n // q if found else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def document_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """A row per document, see OUT; plant: texts get the periodic ends of `planted` first.

    Words are cut at the six ASCII blanks, as bytes, so no text is decoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or b"").split()
                rows.append((doc_id, *summary(planted(words, doc_id) if plant else words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 6 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, OUT)
