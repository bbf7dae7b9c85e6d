"""Periodic runs of words, found through string synchronising sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import SPACE, batch, columns, mix, pieces, utf8, word_hashes, words

RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("strongest", pa.list_(pa.int64())), ("text", pa.string())])
#: Periods below this are looked for directly; it is the first scale of the synchronising sets.
BASE_SCALE = 8
ODD = np.uint64(0xD6E8FEB86659FD93)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text that are looked at together; their arrays fit a core's cache.
PIECE = 1 << 19


def stretches(t: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """start, length and q of all maximal stretches of t with period q that are at least so long (more than q)."""
    if len(t) < least:
        return []
    at = np.flatnonzero(t[q:] == t[:-q])
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) > 1) + 1
    lo, hi = at[np.r_[0, edge]], at[np.r_[edge - 1, len(at) - 1]] + 1 + q
    good = hi - lo >= least
    return [(a, n, q) for a, n in zip(lo[good].tolist(), (hi - lo)[good].tolist(), strict=True)]


def doubled(h: np.ndarray, w: int) -> np.ndarray:
    """Hashes of windows of 2 w from those of w. Windows past the end stand for nothing."""
    after = np.zeros_like(h)
    after[:-w] = h[w:]
    return mix(h * ODD + after)


def least_of(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of w values from each place on, of those that there are."""
    size = 1
    while size * 2 <= w:
        h, size = np.minimum(h, np.r_[h[size:], np.full(min(size, len(h)), NONE)]), size * 2
    return np.minimum(h, np.r_[h[w - size :], np.full(min(w - size, len(h)), NONE)]) if size < w else h


def synchronising(h: np.ndarray, periodic: np.ndarray, tau: int) -> np.ndarray:
    """Places of the synchronising set of scale tau, by the hashes h of windows of tau words.

    A place belongs to it if, of the windows that begin there or up to tau words later and aren't highly periodic, the
    smallest hash is that of the first or the last one. So it depends on the 2 tau words from there on and nothing else, and a
    stretch of 3 tau - 1 words without a small period has a place among its first tau.
    """
    own = np.where(periodic, NONE, h)
    low = least_of(own, tau + 1)
    last = np.r_[own[tau:], np.full(min(tau, len(own)), NONE)]
    return np.flatnonzero((low != NONE) & ((low == own) | (low == last)))


def proposed(places: np.ndarray, context: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of stretches for which neighbouring places of equal contexts (2 tau words) speak, with periods of tau to 2 tau - 1."""
    order = np.argsort(context, kind="stable")
    s, c = places[order], context[order]
    q = np.diff(s)
    good = (c[1:] == c[:-1]) & (q >= tau) & (q < 2 * tau)
    s, q = s[:-1][good], q[good]
    order = np.lexsort((s, q))
    s, q = s[order], q[order]
    end = s + q + 2 * tau
    # those of one period that share a period's length are one stretch
    new = np.r_[True, (q[1:] != q[:-1]) | (s[1:] > end[:-1] - q[1:])][: len(s)]
    first = np.flatnonzero(new)
    return s[first], end[np.r_[first[1:], len(s)] - 1] if len(s) else end, q[first]


def extended(t: np.ndarray, lo: int, hi: int, q: int, step: int) -> list[tuple[int, int, int]]:
    """The maximal stretch of period q around t[lo:hi], word by word."""
    if not np.array_equal(t[lo : hi - q], t[lo + q : hi]):
        return stretches(t, q, 4 * q)  # hashes were equal by chance
    while lo > 0:
        x = max(0, lo - step)
        other = np.flatnonzero(t[x:lo] != t[x + q : lo + q])
        if len(other):
            lo = x + int(other[-1]) + 1
            break
        lo = x
    while hi < len(t):
        y = min(len(t), hi + step)
        other = np.flatnonzero(t[hi:y] != t[hi - q : y - q])
        if len(other):
            hi += int(other[0])
            break
        hi = y
    return [(lo, hi - lo, q)] if hi - lo >= 4 * q else []


def find_runs(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All maximal stretches of at least four periods, with their smallest period: rows of start, length, period by start.

    t: hashes of the words of several texts; first: each text's first word, and the end. Periods below BASE_SCALE are
    looked for directly. Then scales double: at scale tau, windows of tau words with a period of at most tau / 4 lie in
    runs that are known already, so they are left out of the synchronising set; what is left has equal contexts a
    period apart in every run with a period of tau to 2 tau - 1.
    """
    n = np.diff(first)
    docs = np.arange(len(n))
    # a word of its own after each text, so nothing goes across
    own = np.insert(t, first[1:], mix(docs.astype(np.uint64) * ODD + np.uint64(1)))
    place = np.arange(len(own))
    doc_of = np.repeat(docs, n + 1)
    found: dict[tuple[int, int], int] = {}

    def keep(some: list[tuple[int, int, int]], at: np.ndarray) -> None:
        for lo, length, q in some:
            key = (int(at[lo]), length)
            found[key] = min(q, found.get(key, q))

    for q in range(1, BASE_SCALE):
        keep(stretches(own, q, 4 * q), place)
    tau, h = BASE_SCALE, own
    for w in (1, 2, 4):
        h = doubled(h, w)
    while len(own) and (long := n >= 4 * tau).any():
        if not (stay := long[doc_of]).all():
            own, place, doc_of, h = own[stay], place[stay], doc_of[stay], h[stay]
        change = np.zeros(len(own) + 1, np.int32)
        for (lo, length), q in found.items():
            if 4 * q <= tau <= length:
                at = int(np.searchsorted(place, lo))
                if at < len(place) and place[at] == lo:
                    change[at] += 1
                    change[at + length - tau + 1] -= 1
        places = synchronising(h, np.cumsum(change[:-1]) > 0, tau)
        h = doubled(h, tau)
        lo, hi, q = proposed(places, h[places], tau)
        some = hi - lo + 2 * tau >= 4 * q
        for a, b, p in zip(lo[some].tolist(), hi[some].tolist(), q[some].tolist(), strict=True):
            keep(extended(own, a, b, p, tau), place)
        tau *= 2
    rows = np.array(sorted((lo, length, q) for (lo, length), q in found.items()), np.int64).reshape(-1, 3)
    rows[:, 0] -= np.searchsorted(first[1:] + np.arange(1, len(first)), rows[:, 0], "right")
    return rows


def strongest(runs: list[list[int]]) -> list[int] | None:
    """The run with the greatest length / period, exactly; of equal ones the first, then that with the smaller period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(docs: DataFrame, least_periods: int = 4, least_words: int = 6) -> DataFrame:
    """Periodic runs of each text, and the text without their repetitions.

    Words are runs of anything but ASCII whitespace; two are alike if their 64-bit hashes are. A run is a stretch of words with smallest period q that is
    at least least_periods (4 or more) x q and least_words long and that no neighbouring word extends. Of each run the
    first q words stay, unless another run drops them. Returns a row for each row of docs: doc_id, n_words, runs (start,
    length and period, by start, then period), strongest (the run with the greatest length / period) and text (the kept
    words, joined by one space).

    Defined cases: null and empty texts have no words and no runs; a very long text is looked at as a whole, with some 100
    bytes of memory a word; rows with a null doc_id and repeated rows are handled like others; an empty table gives an
    empty table; other columns are ignored.
    """
    if least_periods < 4:
        raise ValueError("runs of less than four periods aren't found")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, off = utf8(rows.column("text"))
            for i, j in pieces(off, PIECE):
                part, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, first = words(part, edges, ~SPACE)
                runs = find_runs(word_hashes(part, starts, ends), first)
                runs = runs[(runs[:, 1] >= least_words) & (runs[:, 1] >= least_periods * runs[:, 2])]
                runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
                gone = np.zeros(len(starts) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                gone = np.cumsum(gone[:-1]) > 0
                own = np.searchsorted(runs[:, 0], first)
                out = []
                for r in range(j - i):
                    ws = part[edges[r] : edges[r + 1]].tobytes().split()
                    of = runs[own[r] : own[r + 1]]
                    if len(of):
                        of = (of - [first[r], 0, 0]).tolist()
                        ws = [w for w, g in zip(ws, gone[first[r] : first[r + 1]].tolist(), strict=True) if not g]
                    out.append((int(first[r + 1] - first[r]), list(of), strongest(of), b" ".join(ws).decode()))
                yield batch(RUNS, rows.column("doc_id").slice(i, j - i), *zip(*out, strict=True))

    return columns(docs, doc_id="long", text="string").mapInArrow(found, "doc_id long, n_words long, runs array<array<long>>, strongest array<long>, text string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts of a tenth of the documents, chosen by h = crc32(doc_id), are periodic from some word on.

    With g = h div 10 and n words, word i >= a = g mod n of such a text is word a + (i - a) mod p, p = 1 + (n - a) div
    (3 + g mod 8). Texts without words, and rows with a null doc_id, stay as they are.
    """

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column("text").to_pylist()
            for r, doc in enumerate(rows.column("doc_id").to_pylist()):
                g, last = divmod(zlib.crc32(str(doc).encode()), 10)
                if doc is None or last or not texts[r]:
                    continue
                ws = texts[r].encode().split()
                if ws:
                    a = g % len(ws)
                    p = 1 + (len(ws) - a) // (3 + g % 8)
                    texts[r] = b" ".join(ws[:a] + (ws[a : a + p] * (-(-(len(ws) - a) // p)))[: len(ws) - a]).decode()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return columns(docs, doc_id="long", text="string").mapInArrow(planted, "doc_id long, text string")
