"""Exact substring dedup over bytes with a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import batch, columns
from lexmill.llm.repeats import Kind, Piece, covered, repeated_windows, runs_of_true, with_repeats

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])


def kind(width: int = 100, hot: int = 4096) -> Kind:
    return Kind(width, max(1, width * 24 // 100), of_words=False, per_document=False, hot=hot)


def suffix_array(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each followed by an end mark of its own (smaller than any byte, in the texts' order), and their sorted suffixes.

    Sorted by seven symbols, then by twice as many in each round; only suffixes that are still tied are sorted again.
    """
    k = len(off) - 1
    n = len(data) + k
    text = np.empty(n, np.int64)
    ends = off[1:] + np.arange(k)
    mark = np.zeros(n, bool)
    mark[ends] = True
    text[~mark] = data.astype(np.int64) + 1
    text[ends] = 0
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    padded = np.r_[text, np.zeros(7, np.int64)]
    for d in range(7):
        sym = np.where(alive, padded[d : d + n], 0)
        key = key << 9 | sym
        alive &= sym > 0
    # suffixes that end within the seven symbols are told apart by their end mark
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)
    which = np.repeat(np.arange(k), np.diff(np.r_[-1, ends]))
    sa = np.lexsort((np.where(left < 7, which, 0), key))
    tied = (key[sa][1:] == key[sa][:-1]) & (left[sa][1:] >= 7) & (left[sa][:-1] >= 7)
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(np.r_[True, ~tied], np.arange(n), 0))
    rank[sa] = start
    h = 7
    while tied.any():
        group = np.r_[tied, False] | np.r_[False, tied]
        at = np.flatnonzero(group)
        own = sa[at]
        second = rank[np.minimum(own + h, n - 1)]
        order = np.argsort(start[at] * np.int64(n + 1) + second, kind="stable")
        own, second, first = own[order], second[order], start[at]
        sa[at] = own
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        tied[:] = False
        tied[at[1:][same] - 1] = True
        start = np.maximum.accumulate(np.where(np.r_[True, ~tied], np.arange(n), 0))
        rank[sa] = start
        h *= 2
    text[ends] = -np.arange(k, 0, -1)
    return text, sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, width: int) -> np.ndarray:
    """For each place in the suffix array whether it shares at least width symbols with the place before.

    Breadth-first backward extension: all places start as one interval of the empty string. In round l, each interval
    of a string of l symbols is extended by every symbol that stands before it in the transform. An extension whose
    right edge has no value yet gets the value l there and goes on; others end. After width rounds the edges without
    value are those of common prefixes of at least width, and nothing longer is ever looked at.
    """
    n = len(sa)
    before = text[sa - 1]
    lf = np.empty(n, np.int64)
    by = np.argsort(before, kind="stable")
    lf[by] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(width):
        size = hi - lo
        one = size == 1
        a, b = lf[lo[one]], lf[lo[one]] + 1
        lo, hi, size = lo[~one], hi[~one], size[~one]
        if len(lo):
            owner = np.repeat(np.arange(len(lo)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]
            to = np.sort(lf[place] + owner * np.int64(n)) if len(lo) > 1 else lf[place] + 0
            if len(lo) == 1:
                to.sort()
            own, to = to // n, to % n
            # extensions of an interval by one symbol are neighbours in the transform's first column
            sym = text[sa[to]]
            cut = np.r_[True, (own[1:] != own[:-1]) | (sym[1:] != sym[:-1])]
            left = to[cut]
            a, b = np.r_[a, left], np.r_[b, left + np.diff(np.r_[np.flatnonzero(cut), len(to)])]
        fresh = ~known[b]
        a, b = a[fresh], b[fresh]
        known[b] = True
        lo, hi = a, b
        if not len(lo):
            break
    return ~known[:n]


def repeated(p: Piece, doc: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A flag for each window of each segment in order: it also starts earlier (smaller document, or there further left)."""
    text, sa = suffix_array(p.data, p.off)
    joined = common_prefixes(text, sa, width)
    group = np.cumsum(~joined)
    k = len(p.off) - 1
    begin = p.off[:-1] + np.arange(k)
    which = np.searchsorted(begin, sa, "right") - 1
    inside = sa - begin[which]
    n = np.diff(p.off) - width + 1
    window = inside < n[which]
    sa, group, which, inside = sa[window], group[window], which[window], inside[window]
    order = np.lexsort((start[which] + inside, doc[which], group))
    first = np.r_[True, group[order][1:] != group[order][:-1]]
    d, s = doc[which][order], (start[which] + inside)[order]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = (d != d[lead]) | (s != s[lead])
    flags = np.zeros(int(n.sum()), bool)
    flags[(np.cumsum(n) - n)[which[order]] + inside[order]] = later
    return flags


def suffix_dedup(docs: DataFrame, width: int = 100, hot: int = 4096) -> DataFrame:
    """Removes from each text the bytes in strings of width bytes that also start earlier: in a smaller doc_id or further left in the same text.

    Texts are UTF-8 bytes, matches never cross documents, overlapping matches count and all are judged on the input.
    Returns a row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, which
    may cut a character) and spans (first byte and length of each removed run).

    Defined cases: a null text is empty; texts under width bytes lose none; rows with a null doc_id lose none and are
    no reference; rows that share doc_id and text count as one document; a very long text is a piece of its own;
    an empty table gives an empty table; other
    columns are ignored.
    """
    k = kind(width, hot)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column("doc_id")
            for i, j, part, edges, flags in repeated_windows(rows, k):
                out = []
                for r in range(j - i):
                    own, cuts = part[edges[r] : edges[r + 1]], []
                    if flags[r].any():
                        gone = covered(flags[r], width)
                        cuts, own = runs_of_true(gone), own[~gone]
                    kept = own.tobytes()
                    out.append((int(edges[r + 1] - edges[r]), int(edges[r + 1] - edges[r]) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept, cuts))
                yield batch(OUT, ids.slice(i, j - i), *zip(*out, strict=True))

    return with_repeats(columns(docs, doc_id="long", text="string"), k, lambda p, _, doc, start: repeated(p, doc, start, width)).mapInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")
