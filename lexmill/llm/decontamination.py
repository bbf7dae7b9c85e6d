"""Benchmark decontamination: CGK embedding, bit sampling, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ALNUM, LOWER, batch, columns, mix, pieces, rows_by_text, utf8, word_hashes, words

OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("distance", pa.int64()), ("n_item", pa.int64())])
#: Items that are searched for at once; more are searched for in several passes, each with a broadcast of this size at most.
BLOCK = 20_000
#: Coordinates of the embedding that are sampled together.
SAMPLED = 3
#: Longer items are searched for by overlapping pieces of so many words; some piece of a near copy has no more than its share of the edits.
PIECE_WORDS = 30
#: Repetitions beyond which a recall counts as out of reach (an error), and made-up copies by which they are counted.
MOST_REPETITIONS, TRIALS = 2000, 400


#: Stretches that are verified together.
TOGETHER = 64


@dataclass
class Group:
    """Pieces of about one length: the shortest and longest, which words they have, and, for each repetition, its coordinates and the pieces by key. Of a piece: its item and its place in that."""

    least: int
    most: int
    has: np.ndarray
    steps: np.ndarray
    keys: list[np.ndarray]
    owners: list[np.ndarray]
    item: np.ndarray
    place: np.ndarray


@dataclass
class Index:
    vocabulary: np.ndarray
    ids: np.ndarray
    items: list[np.ndarray]
    seeds: np.ndarray
    groups: list[Group]
    rate: float


def budget(n: int, rate: float) -> int:
    """Edits that an item of n words may have."""
    return int(n * rate + 1e-9)


def walk(x: np.ndarray, at: np.ndarray, end: np.ndarray, seed: int, steps: np.ndarray) -> np.ndarray:
    """Sampled coordinates of the CGK embedding of x[at:end] for each at and end; one column for each of steps, which ascend.

    In step t the embedding has the word at the walk's place, and a random bit of t and that word says whether the walk
    goes on to the next word. Past the end it has -1.
    """
    i = at.copy()
    out = np.empty((len(at), len(steps)), np.int64)
    k = 0
    for t in range(int(steps[-1]) + 1):
        over = i >= end
        sym = np.where(over, -1, x[np.minimum(i, len(x) - 1)])
        while k < len(steps) and steps[k] == t:
            out[:, k] = sym
            k += 1
        i += (mix(sym.astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed + 7919 * t)) & np.uint64(1)).astype(np.int64)
    return out


def keyed(sampled: np.ndarray) -> np.ndarray:
    h = np.zeros(len(sampled), np.uint64)
    for c in range(sampled.shape[1]):
        h = mix(h ^ sampled[:, c].astype(np.uint64))
    return h


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> list[int]:
    b = words.tolist()
    for _ in range(edits):
        k = int(rng.integers(0, len(b)))
        what = rng.integers(0, 3)
        if what == 0:
            b[k] = int(rng.integers(0, 1 << 40))
        elif what == 1 and len(b) > 1:
            del b[k]
        else:
            b.insert(k, int(rng.integers(0, 1 << 40)))
    return b


def repetitions(least: int, most: int, rate: float, recall: float, seeds: np.ndarray, steps: np.ndarray) -> int:
    """How many of seeds and steps meet the wanted share of made-up copies at the limit of rate edits, of pieces of most words in longer texts.

    All starts from which a window can meet the copy are tried, as in the search, so what is counted is what is met: copies
    that are hard to meet by any repetition count as such.
    """
    edits = budget(most, rate)
    if not edits:
        return 1
    rng = np.random.default_rng(most)
    own, at, stop, of = [], [], [], []
    begins, ends, place = [], [], 0
    for t in range(TRIALS):
        a = rng.integers(0, 1 << 40, most)
        b = edited(a, edits, rng)
        text = np.r_[a, rng.integers(0, 1 << 40, edits), b, rng.integers(0, 1 << 40, most)]
        begins.append(place)
        ends.append(place + most)
        first = place + most + edits
        for k in range(max(0, edits // 2), -1, -1):
            starts = {first - k, first + k}
            for i in starts:
                at.append(i)
                stop.append(min(i + int(most * (1 + rate)), place + len(text)))
                of.append(t)
        place += len(text)
        own.append(text)
    x, met = np.concatenate(own), np.zeros(TRIALS, bool)
    at, stop, of = np.array(at), np.array(stop), np.array(of)
    for r in range(len(steps)):
        w = keyed(walk(x, np.array(begins), np.array(ends), int(seeds[r]), steps[r]))
        met[of[keyed(walk(x, at, stop, int(seeds[r]), steps[r])) == w[of]]] = True
        if met.mean() >= recall:
            return r + 1
    raise ValueError(f"{len(steps)} repetitions do not reach a recall of {recall} for {most} words")


def cut_up(n: int) -> list[tuple[int, int]]:
    """First and last word of each piece of an item of n words: the item itself, or pieces that overlap by half at least."""
    if n <= PIECE_WORDS * 3 // 2:
        return [(0, n)]
    k = -(-2 * (n - PIECE_WORDS) // PIECE_WORDS) + 1
    return [(i, i + PIECE_WORDS) for i in np.linspace(0, n - PIECE_WORDS, k).astype(int).tolist()]


def index(items: list[tuple[int, str]], rate: float, recall: float) -> Index:
    """items: id and text. Items without words can't be in a text and are left out."""
    texts = [(i, t.encode().translate(LOWER.tobytes())) for i, t in items]
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    off = np.r_[0, np.cumsum([len(t) for _, t in texts])].astype(np.int64)
    starts, ends, first = words(data, off, ALNUM)
    h = word_hashes(data, starts, ends)
    vocabulary = np.unique(h)
    ids, seqs = [], []
    for k, (i, _) in enumerate(texts):
        if first[k + 1] > first[k]:
            ids.append(i)
            seqs.append(np.searchsorted(vocabulary, h[first[k] : first[k + 1]]))
    rng = np.random.default_rng(11)
    seeds = rng.integers(1, 1 << 62, MOST_REPETITIONS)

    def sampled(least: int, most: int) -> np.ndarray:
        """Coordinates for as many repetitions as pieces of that length need."""
        span = max(1, int(1.5 * least))
        steps = np.stack([np.sort(rng.choice(span, min(SAMPLED, span), replace=False)) for _ in range(MOST_REPETITIONS)])
        return steps[: repetitions(least, most, rate, recall, seeds, steps)]

    used = len(sampled(PIECE_WORDS, PIECE_WORDS))
    groups = []
    cuts = [(b - a, k, a) for k, s in enumerate(seqs) for a, b in cut_up(len(s))]
    cuts.sort()
    while cuts:
        least = cuts[0][0]
        own = [c for c in cuts if c[0] <= max(least, int(least * 1.25))]
        cuts = cuts[len(own) :]
        most = own[-1][0]
        parts = [seqs[k][a : a + n] for n, k, a in own]
        x = np.concatenate(parts)
        has = np.zeros(len(vocabulary) + 1, bool)
        has[x] = True
        steps = sampled(least, most)
        used = max(used, len(steps))
        at = np.cumsum([0] + [n for n, _, _ in own])
        keys, owners = [], []
        for r in range(len(steps)):
            key = keyed(walk(x, at[:-1], at[1:], int(seeds[r]), steps[r]))
            order = np.argsort(key, kind="stable")
            keys.append(key[order])
            owners.append(order)
        groups.append(Group(least, most, has, steps, keys, owners, np.array([k for _, k, _ in own]), np.array([a for _, _, a in own])))
    seeds = seeds[:used]
    return Index(vocabulary, np.array(ids, np.int64), seqs, seeds, groups, rate)


def nearest(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """For each item and text: least edit distance of the item to a stretch of the text, and that stretch's first word and length (the first and then shortest of ties). All pairs go through the dynamic programme together."""
    size = np.array([len(t) for t in texts])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    n = np.array([len(items[k]) for k in order])
    item, text = np.full((len(n), n.max()), -2), np.full((len(n), max(1, size.max())), -3)
    for r, k in enumerate(order.tolist()):
        item[r, : n[r]], text[r, : size[r]] = items[k], texts[k]
    ramp_of = np.arange(n.max() + 1)
    cost, begin = np.tile(ramp_of, (len(n), 1)), np.zeros((len(n), len(ramp_of)), np.int64)
    least, first, stop = n.copy(), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for j in range(1, int(size.max()) + 1):
        live = int(np.searchsorted(-size, -j, "right"))
        own = np.arange(live)
        diag, up = cost[:live, :-1] + (item[:live] != text[:live, j - 1 : j]), cost[:live, 1:] + 1
        # what remains are steps along the item alone: a running minimum of the cost less the place
        ramp, came = np.zeros((live, len(ramp_of)), np.int64), np.full((live, len(ramp_of)), j)
        ramp[:, 1:] = np.minimum(diag, up) - ramp_of[1:]
        came[:, 1:] = np.where(diag <= up, begin[:live, :-1], begin[:live, 1:])
        low = np.minimum.accumulate(ramp, axis=1)
        last = np.maximum.accumulate(np.where(ramp == low, ramp_of, 0), axis=1)
        cost, begin = low + ramp_of, np.take_along_axis(came, last, 1)
        d, at = cost[own, n[:live]], begin[own, n[:live]]
        good = (d < least[:live]) | ((d == least[:live]) & (at < first[:live]))
        least[:live][good], first[:live][good], stop[:live][good] = d[good], at[good], j
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(n)
    for r, k in enumerate(order.tolist()):
        out[k] = int(least[r]), int(first[r]), int(stop[r] - first[r])
    return out


def candidates(x: np.ndarray, first: np.ndarray, ix: Index) -> np.ndarray:
    """x: words of some texts as places in the vocabulary (its length for others). Rows of text, where the item would start, and item, each once.

    A window can be within the edits allowed only if that many of its words less are words of the group's items; windows
    that aren't are never embedded.
    """
    found = []
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for g in ix.groups:
        edits = budget(g.most, ix.rate)
        sums = np.r_[0, np.cumsum(g.has[x])]
        need = max(1, g.least - edits)
        end = np.minimum(np.arange(len(x)) + g.least, first[1:][row])
        at = np.flatnonzero((sums[end] - sums[:-1] >= need) & g.has[x])
        if not len(at):
            continue
        stop = np.minimum(at + int(g.most * (1 + ix.rate)), first[1:][row[at]])
        for r, seed in enumerate(ix.seeds[: len(g.steps)].tolist()):
            for a in range(0, len(at), 1 << 18):
                part = slice(a, a + (1 << 18))
                key = keyed(walk(x, at[part], stop[part], seed, g.steps[r]))
                lo, hi = np.searchsorted(g.keys[r], key), np.searchsorted(g.keys[r], key, "right")
                n = hi - lo
                if n.any():
                    which = np.repeat(np.arange(len(n)), n)
                    of = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    piece = g.owners[r][of]
                    found.append(np.stack([row[at[part]][which], at[part][which] - g.place[piece], g.item[piece]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def stretches(x: np.ndarray, first: np.ndarray, pairs: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, first and last word of what candidates leave to be looked at; windows that overlap are one stretch, cut to where enough of the item's words stand close enough together."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 2], pairs[:, 0]))].tolist()
    of_item = np.zeros(len(ix.vocabulary) + 1, bool)
    k = 0
    while k < len(pairs):
        row, at, item = pairs[k]
        seq = ix.items[item]
        spare = budget(len(seq), ix.rate)
        lo = max(int(first[row]), at - 2 * spare)
        hi = at + len(seq) + 2 * spare
        k += 1
        while k < len(pairs) and pairs[k][0] == row and pairs[k][2] == item and pairs[k][1] <= hi:
            hi = pairs[k][1] + len(seq) + 2 * spare
            k += 1
        hi = min(hi, int(first[row + 1]))
        of_item[seq] = True
        sums = np.r_[0, np.cumsum(of_item[x[lo:hi]])]
        of_item[seq] = False
        # a stretch within the edits has at most so many words, and all but spare of the item's
        wide = min(len(seq) + spare, hi - lo)
        enough = np.flatnonzero(sums[wide:] - sums[: len(sums) - wide] >= len(seq) - spare)
        if len(enough):
            yield row, item, lo + int(enough[0]), lo + int(enough[-1]) + wide


def verified(x: np.ndarray, first: np.ndarray, pairs: np.ndarray, ix: Index) -> list[tuple[int, int, int, int, int]]:
    """Row, item, start, words and edits of each row's best stretch for an item, of those within its edits."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    # alike in size, so that little is padded
    todo = sorted(stretches(x, first, pairs, ix), key=lambda t: (len(ix.items[t[1]]) // 8, t[3] - t[2]))
    for some in batched(todo, TOGETHER):
        got = nearest([ix.items[item] for _, item, _, _ in some], [x[lo:hi] for _, _, lo, hi in some])
        for (row, item, lo, _), (d, s, n) in zip(some, got, strict=True):
            if d <= budget(len(ix.items[item]), ix.rate):
                mine = (d, lo + s - int(first[row]), n)
                out[row, item] = min(out.get((row, item), mine), mine)
    return [(row, item, s, n, d) for (row, item), (d, s, n) in out.items()]


def indexes(docs: DataFrame, benchmark: DataFrame, similarity: float, recall: float) -> Iterator[Broadcast]:
    """An index of each block of items; one of no items if there are none."""
    rows = columns(benchmark, item_id="long", text="string").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator()
    any_yet = False
    for block in chain(batched(rows, BLOCK), [()]):  # never more than a block of items at once
        if not block and any_yet:
            break
        any_yet = True
        yield docs.sparkSession.sparkContext.broadcast(index([(r["item_id"], r["text"]) for r in block], 1 - similarity, recall))


def searched(texts: pa.Array, ix: Index) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Row, item, start, words and edits of what is found in texts, a list for each piece of them with any."""
    if not len(ix.vocabulary):
        return
    data, off = utf8(texts)
    for i, j in pieces(off):
        part = LOWER[data[off[i] : off[j]]]
        starts, ends, first = words(part, off[i : j + 1] - off[i], ALNUM)
        h = word_hashes(part, starts, ends)
        at = np.minimum(np.searchsorted(ix.vocabulary, h), len(ix.vocabulary) - 1)
        x = np.where(ix.vocabulary[at] == h, at, len(ix.vocabulary))
        if hits := verified(x, first, candidates(x, first, ix), ix):
            yield [(i + row, *rest) for row, *rest in hits]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """Pairs of a document and a benchmark item of which it has a near copy.

    Texts and items are sequences of words (runs of digits, letters a-z and anything beyond ASCII; A-Z lower-cased). A
    document has a near copy of an item of n words if the item is at most (1 - similarity) n word edits away from some
    stretch of it. CGK's random walk embeds each item and each window of an item's size so that few edits are few
    differing coordinates; a few sampled coordinates are a key, and keys are drawn as often as a near copy at the limit
    needs to be met with chance recall (counted for each length by trial; long items by pieces). Each meeting is verified by edit distance, so nothing wrong is reported.
    Returns doc_id, item_id, start and n (the stretch, in words), distance and similarity.

    Defined cases: null and empty texts have no windows; items that are null or without words are in no document, those
    under 1 / (1 - similarity) words only as they are; rows with a null doc_id are reported with it; repeated rows are
    reported once; equal items are reported each; items with one item_id are items of their own, of which the best is
    reported; empty tables give an empty table; other columns are ignored.
    """
    found = None
    for ix in indexes(docs, benchmark, similarity, recall):

        def search(batches: Iterator[pa.RecordBatch], ix=ix) -> Iterator[pa.RecordBatch]:
            ix = ix.value
            for rows in batches:
                ids = rows.column("doc_id")
                for hits in searched(rows.column("text"), ix):
                    row, item, start, n, d = zip(*hits, strict=True)
                    yield batch(OUT, ids.take(pa.array(row)), ix.ids[list(item)], start, n, d, [len(ix.items[k]) for k in item])

        hits = columns(docs, doc_id="long", text="string").mapInArrow(search, "doc_id long, item_id long, start long, n long, distance long, n_item long")
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "n", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.n", "b.distance", (1 - F.col("b.distance") / F.col("b.n_item")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """The rows of docs without a near copy of any benchmark item, each by its own text: rows that share a doc_id, or have none, are judged one by one."""
    for ix in indexes(docs, benchmark, similarity, recall):

        def clean(rows: pa.RecordBatch, ix: Broadcast = ix) -> np.ndarray:
            stays = np.ones(len(rows), bool)
            for hits in searched(rows.column("text"), ix.value):
                stays[[row for row, *_ in hits]] = False
            return stays

        docs = rows_by_text(docs, clean)
    return docs
