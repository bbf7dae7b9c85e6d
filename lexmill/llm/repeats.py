"""Repeated windows of a corpus, found through content-chosen anchors. Both op1 (words) and op4 (bytes) build on this.

A window is W consecutive tokens of a document. In each window the k-gram with the smallest hash is the window's
anchor (leftmost of ties), so equal windows have equal anchors at equal places, and neighbouring windows mostly share
theirs. Steps, each of them a Spark job over all documents:

1. ``marks``: anchors of each document, counted over the corpus by an aggregation with map-side combine. Windows whose
   anchor occurs once can't be repeated; only shared anchors go on (about a twentieth of all tokens are anchors).
2. ``segments``: for each occurrence of a shared anchor, the tokens of its windows. Equal segments are aggregated to
   their first occurrence, so a group of copies, however large, becomes one row per segment.
3. ``matched``: the distinct segments of an anchor meet in one block, where a matcher decides which windows occur
   earlier. Anchors with over ``hot`` occurrences never meet there: their windows are sent one by one, as 128-bit
   digests, and the aggregation of step 2 alone decides. A block is so bounded by ``hot`` segments per anchor.
4. The caller reads for each document its shared anchors and the windows that it keeps, being their first occurrence.

Texts that a smaller doc_id has as a whole are told apart before, by their digests.

Texts cross the network once: all joins by doc_id reuse one exchange. Rows with a null doc_id are no reference and
lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BASE, BYTES, INVERSE, SPACE, batch, mix, pieces, powers, spans, utf8, word_hashes, words

MARKS = pa.schema([("anchor", pa.int64()), ("docs", pa.list_(pa.int64())), ("n", pa.int64())])
SEGMENTS = pa.schema([("anchor", pa.int64()), ("seg", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64()), ("key", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("keep", pa.binary())])
DIGEST = 16


@dataclass(frozen=True)
class Kind:
    """Tokens are words or bytes; a window has width tokens, an anchor gram tokens; per_document: only other documents count."""

    width: int
    gram: int
    of_words: bool
    per_document: bool
    hot: int = 4096


@dataclass
class Piece:
    """Tokens of some documents: a hash for each, byte ranges (words), and each document's first token."""

    data: np.ndarray
    off: np.ndarray
    values: np.ndarray
    first: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def tokens(data: np.ndarray, off: np.ndarray, of_words: bool) -> Piece:
    """off starts at 0 and ends at len(data)."""
    if not of_words:
        return Piece(data, off, BYTES[data], off)
    starts, ends, first = words(data, off, ~SPACE)
    return Piece(data, off, word_hashes(data, starts, ends), first, starts, ends)


def anchors(p: Piece, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: document row, anchor hash, first and last window start (tokens of the piece)."""
    none = np.zeros(0, np.int64)
    k, w = kind.gram, kind.width - kind.gram + 1
    n = len(p.values) - kind.width + 1
    if n <= 0:
        return none, none, none, none
    sums = np.zeros(len(p.values) + 1, np.uint64)
    np.multiply(p.values, powers(BASE, len(p.values)), out=sums[1:])
    np.cumsum(sums, out=sums)
    g = sums[k:] - sums[:-k]
    g *= powers(INVERSE, len(g))
    low = max(1, int(len(g) - 1).bit_length())
    m = g & np.uint64((1 << 64) - (1 << low))
    m |= np.arange(len(g), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    m &= np.uint64((1 << low) - 1)
    at = m[:n].view(np.int64)
    # a new run where the anchor changes or a document begins; windows that leave their document end it
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[p.first[:-1][p.first[:-1] < n]] = True
    stop = np.clip(p.first[1:] - kind.width + 1, 0, n)
    new[stop[stop < n]] = True
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], n] - 1
    row = np.searchsorted(p.first, lo, "right") - 1
    whole = lo < stop[row]
    lo, hi, row = lo[whole], hi[whole], row[whole]
    return row, mix(g[at[lo]]).view(np.int64), lo, hi


#: Bytes of text that are looked at together; their arrays fit a core's cache.
PIECE = 1 << 19


def each_piece(rows: pa.RecordBatch, of_words: bool) -> Iterator[tuple[int, int, Piece]]:
    data, off = utf8(rows.column("text"))
    for i, j in pieces(off, PIECE):
        yield i, j, tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], of_words)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of its texts that a smaller doc_id has as a whole. docs: doc_id, digest."""
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "digest").filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))


def marks(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id and its anchors that occur again: shared and, for over kind.hot occurrences, hot. Documents without any have no row.

    A task writes one row for an anchor and all documents of a piece that have it. These rows are dealt once, for the
    counts as well as for the way back to the documents (both read n and docs, though one of them would do, since the exchange
    is only shared if neither has a column less).
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            rows = rows.filter(pc.is_valid(rows.column("doc_id")))
            ids = rows.column("doc_id").to_numpy()
            for i, _, p in each_piece(rows, kind.of_words):
                row, anchor, _, _ = anchors(p, kind)
                order = np.lexsort((row, anchor))
                row, anchor = row[order], anchor[order]
                new = np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)]
                own = new | np.r_[True, row[1:] != row[:-1]][: len(anchor)]
                at, edge = np.flatnonzero(own), np.flatnonzero(new)
                n = np.diff(np.r_[edge, len(anchor)]) if not kind.per_document else np.diff(np.r_[np.flatnonzero(new[at]), len(at)])
                docs_of = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(new[at]), len(at)].astype(np.int32)), pa.array(ids[i + row[at]].astype(np.int64)))
                yield batch(MARKS, anchor[edge], docs_of, n)

    dealt = docs.mapInArrow(found, "anchor long, docs array<long>, n long").repartition("anchor")
    shared = dealt.groupBy("anchor").agg(F.sum(F.greatest("n", F.size("docs"))).alias("total")).filter("total > 1").select("anchor", (F.col("total") > kind.hot).alias("hot"))
    own = dealt.join(shared, "anchor").select("anchor", "hot", F.explode_outer(F.when(F.col("n") > 0, F.col("docs"))).alias("doc_id"))
    return own.groupBy("doc_id").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("shared"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))


def lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column of longs; null is empty."""
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))].astype(np.int64)
    return [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def known(row: np.ndarray, anchor: np.ndarray, of_row: list[np.ndarray]) -> np.ndarray:
    """Whether each anchor is in its row's list."""
    out = np.zeros(len(anchor), bool)
    edges = np.searchsorted(row, np.arange(len(of_row) + 1))
    for r, have in enumerate(of_row):
        if len(have) and edges[r + 1] > edges[r]:
            out[edges[r] : edges[r + 1]] = np.isin(anchor[edges[r] : edges[r + 1]], have)
    return out


def digests(values: np.ndarray, at: np.ndarray, width: int) -> list[bytes]:
    """16 bytes for each window; shorter than any segment, so that the two never meet."""
    both = np.empty((len(at), 2), np.uint64)
    both[:, 0] = spans(values, at, at + width)
    both[:, 1] = spans(values * values + (values >> np.uint64(29)), at, at + width)
    return [both[x].tobytes() for x in range(len(at))]


@dataclass
class Runs:
    """Runs of windows of shared anchors and single windows of hot ones, in order of their documents: rows, first and last windows, hashes of their tokens."""

    row: np.ndarray
    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    single: np.ndarray
    key: np.ndarray


def runs_of(p: Piece, kind: Kind, shared: list[np.ndarray], hot: list[np.ndarray]) -> Runs:
    row, anchor, lo, hi = anchors(p, kind)
    single = known(row, anchor, hot)
    n = np.where(single, hi - lo + 1, known(row, anchor, shared).astype(np.int64))
    pick = np.repeat(np.arange(len(row)), n)
    nth = np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)
    row, anchor, single = row[pick], anchor[pick], single[pick]
    lo, hi = lo[pick] + nth, np.where(single, lo[pick] + nth, hi[pick])
    return Runs(row, anchor, lo, hi, single, spans(p.values, lo, hi + kind.width).view(np.int64))


def written(p: Piece, lo: int, end: int) -> bytes:
    """Tokens lo to end; words are joined by one space, so that other spacing is no difference."""
    if p.starts is None:
        return p.data[lo:end].tobytes()
    return b" ".join(p.data[p.starts[lo] : p.ends[end - 1]].tobytes().split())


def segments(marked: DataFrame, kind: Kind) -> DataFrame:
    """marked: doc_id, text, shared, hot. A row for each run of windows of a shared anchor and for each window of a hot one."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            rows = rows.filter(pc.is_valid(rows.column("doc_id")))
            ids, shared, hot = rows.column("doc_id").to_numpy(), lists(rows.column("shared")), lists(rows.column("hot"))
            for i, j, p in each_piece(rows, kind.of_words):
                r = runs_of(p, kind, shared[i:j], hot[i:j])
                segs = np.empty(len(r.lo), object)
                for x in np.flatnonzero(~r.single).tolist():
                    segs[x] = written(p, r.lo[x], r.hi[x] + kind.width)
                if r.single.any():
                    segs[r.single] = digests(p.values, r.lo[r.single], kind.width)
                for a in range(0, len(segs), 20_000):
                    b = slice(a, a + 20_000)
                    yield batch(SEGMENTS, r.anchor[b], segs[b].tolist(), ids[i + r.row[b]], (r.lo - p.first[r.row])[b], r.key[b])

    return marked.mapInArrow(found, "anchor long, seg binary, doc_id long, start long, key long")


#: Takes the segments of a block (a Piece), the anchors, documents and starts; gives a flag for each window in order: it occurs earlier.
Matcher = Callable[[Piece, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def matched(segs: DataFrame, kind: Kind, repeated: Matcher) -> DataFrame:
    """doc_id and the windows of shared anchors that it keeps: the key of their run, and a bit for each window (no bits: all)."""
    first = segs.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "start", "key")).alias("at")).select("anchor", "seg", "at.*")

    def block(t: pa.Table) -> pa.RecordBatch:
        anchor, seg, doc, start = t["anchor"].to_numpy(), t["seg"].to_pylist(), t["doc_id"].to_numpy(), t["start"].to_numpy()
        change = anchor[1:] != anchor[:-1]
        alone = np.r_[True, change] & np.r_[change, True]
        many = np.flatnonzero(~alone & np.fromiter((len(s) != DIGEST for s in seg), bool, len(seg)))
        keep = [b""] * len(seg)
        if len(many):
            data = np.frombuffer(b"".join([seg[x] for x in many]), np.uint8)
            p = tokens(data, np.r_[0, np.cumsum([len(seg[x]) for x in many])], kind.of_words)
            again = repeated(p, anchor[many], doc[many], start[many])
            edges = np.r_[0, np.cumsum(np.diff(p.first) - kind.width + 1)]
            for k, x in enumerate(many.tolist()):
                keep[x] = np.packbits(~again[edges[k] : edges[k + 1]], bitorder="little").tobytes()
        return batch(KEPT, doc, t["key"].to_numpy(), keep)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        for rows in batches:
            for a in range(0, rows.num_rows, 2048):
                part = rows.slice(a, 2048)
                held.append(part)
                size += part.nbytes
                if size < PIECE_OF_BLOCK:
                    continue
                t = pa.Table.from_batches(held)
                anchor = t["anchor"].to_numpy()
                if upto := int(np.searchsorted(anchor, anchor[-1])):  # the last anchor may go on
                    yield block(t.slice(0, upto))
                    held, size = t.slice(upto).to_batches(), t.slice(upto).nbytes
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield block(t)

    # digests have nothing to meet: those of a hot anchor are spread
    spread = F.when(F.octet_length("seg") == DIGEST, F.xxhash64("seg")).otherwise(0)
    met = first.repartition("anchor", spread).sortWithinPartitions("anchor").mapInArrow(blocks, "doc_id long, key long, keep binary")
    return met.groupBy("doc_id").agg(F.collect_list(F.struct("key", "keep")).alias("kept"))


#: Bytes of segments that are matched at once, besides what belongs to the last anchor.
PIECE_OF_BLOCK = 1 << 20


def with_repeats(docs: DataFrame, kind: Kind, repeated: Matcher) -> DataFrame:
    """docs (doc_id, text) with copied (a smaller doc_id has the same text), and with shared, hot and kept for ``Repeats``.

    What a copied text has, its first copy has: it is repeated as a whole and takes no part in the search.
    """
    # a key that can't be null, and no filter on what is dealt: so all uses are of one exchange of the texts
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text", F.md5(F.col("text").cast("binary")).alias("digest"))
    dealt = docs.repartition("key")

    def by_key(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("doc_id", "key").hint("shuffle_hash")

    told = dealt.join(by_key(copies(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "digest"))), "key", "left")
    told = told.select("key", "doc_id", "text", F.coalesce(F.array_contains("copied", F.col("digest")), F.lit(False)).alias("copied"))
    firsts = told.filter("NOT copied")
    of_anchors = by_key(marks(firsts, kind))
    kept = by_key(matched(segments(firsts.join(of_anchors, "key"), kind), kind, repeated))
    return told.join(of_anchors, "key", "left").join(kept, "key", "left")


#: Stands for a null doc_id where rows are dealt.
NO_ID = -(1 << 63)


def repeated_windows(rows: pa.RecordBatch, kind: Kind) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """rows as of ``with_repeats``. For pieces of them: first and last row, bytes, each row's first byte, and for each row a flag for each token: a window that occurs earlier starts here."""
    shared, hot, kept = lists(rows.column("shared")), lists(rows.column("hot")), rows.column("kept")
    rows_without_id = rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    copied = rows.column("copied").to_numpy(zero_copy_only=False) & ~rows_without_id
    data, off = utf8(rows.column("text"))
    for i, j in pieces(off, PIECE):
        part, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
        first = words(part, edges, ~SPACE)[2] if kind.of_words else edges
        flags = [np.full(n, c) for n, c in zip(np.diff(first), copied[i:j], strict=True)]
        marked = [r for r in range(j - i) if not copied[i + r] and not rows_without_id[i + r] and (len(shared[i + r]) or len(hot[i + r]))]
        if marked:
            own = np.concatenate([part[edges[r] : edges[r + 1]] for r in marked])
            p = tokens(own, np.r_[0, np.cumsum(edges[1:][marked] - edges[:-1][marked])], kind.of_words)
            runs = runs_of(p, kind, [shared[i + r] for r in marked], [hot[i + r] for r in marked])
            bounds = np.searchsorted(runs.row, np.arange(len(marked) + 1)).tolist()
            lows, highs, keys = (runs.lo - p.first[runs.row]).tolist(), (runs.hi - p.first[runs.row] + 1).tolist(), runs.key.tolist()
            for x, r in enumerate(marked):
                keep = {y["key"]: y["keep"] for y in kept[i + r].as_py() or ()}
                starts = flags[r]
                for at in range(bounds[x], bounds[x + 1]):
                    lo, hi, bits = lows[at], highs[at], keep.get(keys[at])
                    if bits is None:
                        starts[lo:hi] = True
                        continue
                    if bits:
                        starts[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo, bitorder="little") == 0
                    if not kind.per_document:  # the same tokens once more in this document are a repetition
                        del keep[keys[at]]
        # in a copied text a window starts at each token that has enough tokens after it
        for f in flags:
            f[max(0, len(f) - kind.width + 1) :] = False
        yield i, j, part, edges, flags


def covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Tokens that lie in a flagged window."""
    step = np.zeros(len(starts) + width + 1, np.int32)
    step[: len(starts)] += starts
    step[width : width + len(starts)] -= starts
    return np.cumsum(step)[: len(starts)] > 0


def runs_of_true(flags: np.ndarray) -> list[list[int]]:
    """First place and length of each run of true."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).reshape(-1, 2)
    return np.stack([edge[:, 0], edge[:, 1] - edge[:, 0]], 1).tolist()
