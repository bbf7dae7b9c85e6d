"""Substring dedup by Relative Lempel-Ziv parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import batch, columns, span_of, sums_of
from lexmill.llm.repeats import Kind, Piece, covered, repeated_windows, runs_of_true, with_repeats

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def kind(width: int = 50, hot: int = 4096) -> Kind:
    return Kind(width, max(1, width * 8 // 50), of_words=True, per_document=True, hot=hot)


def parse(p: Piece, anchor: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Relative Lempel-Ziv parse of a block's segments against the block, whose segments of smaller documents are the reference.

    The index has each phrase of width words and its first occurrence, by document. A segment is factored greedily from
    left to right (all segments at once): if the phrase at the cursor is in a smaller document, a factor with that
    source opens and grows as long as source and segment go on alike; the cursor then stands at its end, at the first
    phrase that crosses this boundary, so that what another source has across it opens the next factor. Else the word at
    the cursor is a literal. Factors alone decide: a window is repeated if a factor holds it. Returns a flag for each
    window (repeated) and the factors: segment, first word, words, source segment.
    """
    n = np.diff(p.first) - width + 1
    seg = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n) + p.first[seg]
    sums = sums_of(p.values)
    phrase = span_of(sums, at, at + width) ^ anchor.view(np.uint64)[seg]
    order = np.lexsort((at, doc[seg], phrase))
    head = order[np.r_[True, phrase[order][1:] != phrase[order][:-1]]] if len(order) else order
    index, source, of = phrase[head], at[head], seg[head]
    own = np.flatnonzero(n > 0)
    cursor, stop = p.first[:-1][own], p.first[1:][own]
    factors = [np.zeros((4, 0), np.int64)]
    while len(own):
        here = np.searchsorted(index, span_of(sums, cursor, cursor + width) ^ anchor.view(np.uint64)[own])
        opens = doc[of[here]] < doc[own]
        step = np.ones(len(own), np.int64)
        if opens.any():
            a, b, src = cursor[opens], source[here[opens]], of[here[opens]]
            # the factor's length: alike up to least words, and not up to most + 1
            least, most = np.full(len(a), width), np.minimum(stop[opens] - a, p.first[1:][src] - b)
            while (least < most).any():
                mid = (least + most + 1) // 2
                alike = span_of(sums, a, a + mid) == span_of(sums, b, b + mid)
                least, most = np.where(alike, mid, least), np.where(alike, most, mid - 1)
            factors.append(np.stack([own[opens], a, least, src]))
            step[opens] = least - width + 1
        cursor = cursor + step
        more = cursor + width <= stop
        own, cursor, stop = own[more], cursor[more], stop[more]
    found = np.concatenate(factors, 1)
    found = found[:, np.lexsort((found[1], found[0]))]
    first = found[1] - p.first[found[0]]
    change = np.zeros(len(seg) + 1, np.int64)
    begin = np.cumsum(n) - n
    np.add.at(change, begin[found[0]] + first, 1)
    np.add.at(change, begin[found[0]] + first + found[2] - width + 1, -1)
    return np.cumsum(change)[: len(seg)] > 0, list(zip(found[0].tolist(), first.tolist(), found[2].tolist(), found[3].tolist(), strict=True))


def substring_dedup(docs: DataFrame, width: int = 50, hot: int = 4096) -> DataFrame:
    """Removes from each text the words in windows of width words that also start in a document with a smaller doc_id.

    Words are runs of anything but ASCII whitespace. Windows are judged on the input: what is removed elsewhere
    doesn't matter. Returns a row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words,
    joined by one space), text (those words) and spans (first word and number of words of each removed run).

    Defined cases: a null text has no words; texts under width words lose none; rows with a null doc_id lose none and
    are no reference; rows that share a doc_id are no repetition of each other; a very long text is a piece of its own;
    an empty table gives an empty table;
    other columns are ignored.
    """
    k = kind(width, hot)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column("doc_id")
            for i, j, part, edges, flags in repeated_windows(rows, k):
                out = []
                for r in range(j - i):
                    ws = part[edges[r] : edges[r + 1]].tobytes().split()
                    n, cuts = len(ws), []
                    if flags[r].any():
                        gone = covered(flags[r], width)
                        cuts = runs_of_true(gone)
                        ws = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                    text = b" ".join(ws)
                    out.append((n, n - len(ws), hashlib.sha256(text).hexdigest(), text.decode(), cuts))
                yield batch(OUT, ids.slice(i, j - i), *zip(*out, strict=True))

    return with_repeats(columns(docs, doc_id="long", text="string"), k, lambda p, anchor, doc, _: parse(p, anchor, doc, width)[0]).mapInArrow(cleaned, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, spans array<array<long>>")
