"""Toxicity by a linear-chain conditional random field over words and their stems."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import ALNUM, BASE, BYTES, LOWER, batch, columns, cut, mix, pieces, rows_by_text, span_of, sums_of, utf8, words
from lexmill.llm.crf import Chain, fit, marginals

FOLDS = 5
WINDOW = 21
#: What a word's features are made of: the whole word, its first and its last bytes (of longer words only).
STEMS = (4, 5, 6, -4)
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.list_(pa.int64())))])
SKETCHES = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("least", pa.list_(pa.int64()))])
COUNTS = pa.schema([("feature", pa.int64()), ("n", pa.int64())])
WINDOWS = pa.schema([("doc_id", pa.int64()), ("x", pa.binary()), ("toxic", pa.bool_())])
FACTS = pa.schema([("toxic", pa.int32()), ("facts", pa.list_(pa.float64()))])


class Lexicon:
    """Sorted hashes of the known features, and a table by their leading bits that tells most other hashes apart at once."""

    BITS = 20

    def __init__(self, features: np.ndarray) -> None:
        self.features = np.sort(features.astype(np.uint64))
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.features >> np.uint64(64 - self.BITS)).view(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known hashes in h, and their numbers in features."""
        may = np.flatnonzero(self.table[(h >> np.uint64(64 - self.BITS)).view(np.int64)])
        if not len(may):
            return may, may
        at = np.minimum(np.searchsorted(self.features, h[may]), len(self.features) - 1)
        good = self.features[at] == h[may]
        return may[good], at[good]


@dataclass
class Model:
    """lexicon: known features; chain: their weights; weights: of a document's facts."""

    lexicon: Lexicon
    chain: Chain
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from. A null doc_id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Words:
    """The words of rows i to j: byte ranges in data, each row's first word and first byte."""

    i: int
    j: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    edges: np.ndarray

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of feature: the words that have one (all: a slice), and its hash."""
        sums = sums_of(BYTES[self.data])
        yield np.arange(len(self.starts)), span_of(sums, self.starts, self.ends)
        length = self.ends - self.starts
        for k in STEMS:
            own = np.flatnonzero(length > abs(k))
            lo = self.starts[own] if k > 0 else self.ends[own] + k
            yield own, mix(span_of(sums, lo, lo + abs(k)) + np.uint64(k % 64))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.j - self.i), np.diff(self.first))


def tokens(rows: pa.RecordBatch) -> Iterator[Words]:
    """The words of the rows' texts, A-Z in lower case, piece by piece."""
    data, off = utf8(rows.column("text"))
    for i, j in pieces(off):
        part, edges = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        yield Words(i, j, part, *words(part, edges, ALNUM), edges)


def sketches(sample: DataFrame, least: int = 8, gram: int = 3) -> DataFrame:
    """doc_id, toxic and the smallest hashes of the text's runs of gram words."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for w in tokens(rows):
                h = next(w.features())[1]
                out = []
                for r in range(w.j - w.i):
                    own = h[w.first[r] : w.first[r + 1]]
                    n = max(len(own) - gram + 1, min(len(own), 1))
                    g = np.zeros(n, np.uint64)
                    for k in range(min(gram, len(own))):
                        g = mix(g * np.uint64(3) + own[k : k + n])
                    out.append(np.unique(g)[:least].view(np.int64))
                yield batch(SKETCHES, rows.column("doc_id").slice(w.i, w.j - w.i), rows.column("toxic").slice(w.i, w.j - w.i), out)

    return sample.mapInArrow(sketched, "doc_id long, toxic int, least array<long>")


def without_copies(sample: DataFrame, most: int = 5) -> DataFrame:
    """sample without all but the first few of each group of copies (texts of one label that share over half of their sketches): else each copy of a toxic text would speak against the words that it has by chance."""
    each = cut(sketches(sample).select("doc_id", "toxic", F.size("least").alias("size"), F.explode_outer("least").alias("h")))
    # no more rows than the bounded sample's sketches have
    place = F.row_number().over(Window.partitionBy("h", "toxic").orderBy("doc_id"))
    copied = each.withColumn("place", place).filter(F.col("place") > most).groupBy("doc_id").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("2 * n > size").select("doc_id")
    # at most as many ids as the sample has rows
    return cut(sample.join(F.broadcast(copied), "doc_id", "left_anti"))


def feature_counts(sample: DataFrame, among: Lexicon | None = None) -> DataFrame:
    """feature and n, the texts that have it; of all features, or of those in a lexicon."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for w in tokens(rows):
                row, found = w.row(), []
                for own, h in w.features():
                    at = among.find(h)[0] if among else slice(None)
                    h, r = h[at], row[own[at]]
                    found.append(h[np.unique(mix(h + r.astype(np.uint64) * np.uint64(BASE)), return_index=True)[1]])
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield batch(COUNTS, h.view(np.int64), n)

    return sample.mapInArrow(counted, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def evidence(a: np.ndarray, n1: int, b: np.ndarray, n0: int) -> np.ndarray:
    """Log-likelihood ratio (twice its logarithm) of a feature in a of n1 toxic and b of n0 clean texts against one rate for both; 0 if it isn't three times as frequent in toxic ones."""
    share = (a + b) / (n1 + n0)
    total = np.zeros(len(a))
    for k, n, p in ((a, n1, share), (n1 - a, n1, 1 - share), (b, n0, share), (n0 - b, n0, 1 - share)):
        total += 2 * k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9))
    return np.where(a * n0 > 3 * b * n1, total, 0)


def learned(toxic: DataFrame, clean: DataFrame, n1: int, n0: int, least: int = 5, strength: float = 25.0) -> Lexicon:
    """Features of at least so many toxic texts that toxic texts have more often than chance allows (an evidence of 25: a chance below 1e-6 for each).

    Few labels can't give such evidence. There, what a quarter of all toxic texts and no clean one would show is enough, so a
    field is learned from any sample; both bounds rise with it, and from some 30 toxic texts on they are as given.
    """
    quarter = np.array([n1 / 4])
    least, strength = min(least, math.ceil(n1 / 4)), min(strength, float(evidence(quarter, n1, np.zeros(1), n0)[0]))
    seen = feature_counts(toxic).filter(F.col("n") >= least).collect()
    of = {r["feature"]: r["n"] for r in seen}
    h = np.sort(np.array(list(of), np.int64).view(np.uint64))
    a, b = np.array([of[x] for x in h.view(np.int64).tolist()], float), np.zeros(len(h))
    if len(h):
        for r in feature_counts(clean, Lexicon(h)).collect():
            b[np.searchsorted(h, np.uint64(r["feature"] % (1 << 64)))] = r["n"]
    return Lexicon(h[evidence(a, n1, b, n0) >= strength])


def windows(sample: DataFrame, lexicon: Lexicon, per_text: int = 8) -> DataFrame:
    """Tokens to train on: windows around up to per_text words with known features of a text, or around one chosen by hash. x: number of each word's features, one a kind, from 1; 0 for none."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for w in tokens(rows):
                ids = np.zeros((len(w.starts), 1 + len(STEMS)), np.int32)
                for kind, (own, h) in enumerate(w.features()):
                    at, number = lexicon.find(h)
                    ids[own[at], kind] = number + 1
                some = ids.any(1)
                docs, toxic, out = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy() > 0, []
                whole = next(w.features())[1]
                for r in range(w.j - w.i):
                    own = ids[w.first[r] : w.first[r + 1]]
                    if not len(own):
                        continue
                    hits = np.flatnonzero(some[w.first[r] : w.first[r + 1]])
                    hits = hits[:: -(-len(hits) // per_text)] if len(hits) else [int(np.bitwise_xor.reduce(whole[w.first[r] : w.first[r + 1]])) % len(own)]
                    for at in hits:
                        lo = max(0, min(at - WINDOW // 2, len(own) - WINDOW))
                        x = np.zeros((WINDOW, own.shape[1]), np.int32)
                        part = own[lo : lo + WINDOW]
                        x[: len(part)] = part
                        out.append((docs[w.i + r], x.tobytes(), toxic[w.i + r]))
                yield batch(WINDOWS, *(zip(*out, strict=True) if out else ([], [], [])))

    return sample.mapInArrow(cut_out, "doc_id long, x binary, toxic boolean")


def field(doc: np.ndarray, x: np.ndarray, toxic: np.ndarray, size: int, rounds: int = 2) -> Chain:
    """Fits the field to windows (x: windows x WINDOW x kinds). Labels are those of documents, so those of tokens are guessed in turn with the fit.

    First each word with a known feature in a toxic text is labelled 1. After a fit only words stay so that the field
    itself finds toxic, and the one with the highest marginal of each toxic text.
    """
    token, kind = np.nonzero(x.reshape(-1, x.shape[2]))
    feature = x.reshape(-1, x.shape[2])[token, kind] - 1
    may = np.zeros(x.shape[:2], bool)
    may.reshape(-1)[token] = True
    may &= toxic[:, None]
    y, chain = may, None
    for _ in range(rounds):
        chain, p = fit(y, token, feature, size, chain)
        best = np.where(may, p, 0).max(1)
        of_doc = np.unique(doc, return_inverse=True)[1]
        top = np.zeros(of_doc.max() + 1)
        np.maximum.at(top, of_doc, best)
        y = may & ((p >= 0.5) | (p >= top[of_doc][:, None]))
    return chain


def facts(p: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a document's score is made of: a constant, the highest marginal, the expected number of toxic words (log), their share, and the chance that there is any (log odds, bounded)."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    top = np.zeros(n)
    np.maximum.at(top, row, p)
    total = np.bincount(row, weights=p, minlength=n)
    none = np.bincount(row, weights=np.log1p(-np.clip(p, 0, 1 - 1e-6)), minlength=n)
    some = 1 - np.exp(none)
    return np.stack([np.ones(n), top, np.log1p(total), 20 * total / np.maximum(length, 20), some], 1)


def tagged(model: Model, rows: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[list[list[int]]]]]:
    """For each piece of rows: first and last row, document facts, scores, and toxic spans as first byte and length."""
    for w in tokens(rows):
        first = w.first
        score = np.zeros(len(w.starts))
        some = np.zeros(len(w.starts), bool)
        for own, h in w.features():
            at, number = model.lexicon.find(h)
            score[own[at]] += model.chain.word[number]
            some[own[at]] = True
        at = np.flatnonzero(some)
        begin = np.searchsorted(at, first)
        row = np.repeat(np.arange(w.j - w.i), np.diff(begin))
        since = np.r_[-1, at[:-1]] if len(at) else at
        opening = np.zeros(len(at), bool)
        has = np.diff(begin) > 0
        opening[begin[:-1][has]] = True
        since = np.where(opening, first[row] - 1, since)
        last = np.where(has, at[np.maximum(begin[1:] - 1, 0)] if len(at) else first[:-1] - 1, first[:-1] - 1)
        p = marginals(model.chain, score[at], at - since - 1, begin, first[1:] - 1 - last)
        f = facts(p, begin, np.diff(first))
        spans: list[list[list[int]]] = [[] for _ in range(w.j - w.i)]
        for x in np.flatnonzero(p >= 0.5).tolist():
            at_word, r = at[x], row[x]
            own = spans[r]
            if own and own[-1][2] == at_word - 1:
                own[-1][1:] = [int(w.ends[at_word] - w.edges[r]) - own[-1][0], int(at_word)]
            else:
                own.append([int(w.starts[at_word] - w.edges[r]), int(w.ends[at_word] - w.starts[at_word]), int(at_word)])
        yield w.i, w.j, f, 1 / (1 + np.exp(-f @ model.weights)), [[s[:2] for s in own] for own in spans]


def logistic(f: np.ndarray, y: np.ndarray, prior: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(f.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f @ w))
        g = f.T @ (y - p) / len(y) - prior * w
        w = w + np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f / len(y) + prior * np.eye(len(w)), g)
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Model:
    """Fits the model on a bounded sample of the labelled texts outside the held-out fold.

    sample_rows is the bound: that many labelled rows, those with the smallest hash of doc_id; of copies among
    them five count. Three quarters of them teach the field: Spark counts in how many toxic and clean texts each feature is (whole
    words, their first and last bytes), and those that toxic texts have more often than chance allows are known. The
    field is fitted on windows around words with known features. The rest teaches a logistic regression that turns the
    field's marginals into a document score; so what is known by chance gets no say. With fewer than 30 toxic or clean texts in the
    one part or 10 in the other, all of the sample teaches both. A text gives up to eight windows, evenly over its known words.
    The driver sees counts, windows and facts of the sample only.
    """
    docs, labels = columns(docs, doc_id="long", text="string"), columns(labels, doc_id="long", toxic="int")
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows ids at most are broadcast; of texts that share an id, the smallest counts
    sample = cut(docs.join(F.broadcast(cut(chosen)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    sample = without_copies(sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    n = {(r["part"], r["toxic"]): r["n"] for r in sample.groupBy(part.alias("part"), "toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sum(v for k, v in n.items() if k[1] == 1), sum(v for k, v in n.items() if k[1] == 0)
    if not n1 or not n0:
        return Model(Lexicon(np.zeros(0)), Chain(np.zeros((2, 2)), np.zeros(0), 0.0), np.array([np.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -3.0, 0, 0, 0, 0]))
    split = min(n.get((False, y), 0) for y in (0, 1)) >= 30 and min(n.get((True, y), 0) for y in (0, 1)) >= 10
    teach = sample.filter(~part) if split else sample
    if split:
        n1, n0 = n[False, 1], n[False, 0]
    lexicon = learned(teach.filter("toxic = 1"), teach.filter("toxic = 0"), n1, n0)
    seen = windows(teach, lexicon).collect()
    x = np.frombuffer(b"".join(r["x"] for r in seen), np.int32).reshape(-1, WINDOW, 1 + len(STEMS))
    model = Model(lexicon, field(np.array([r["doc_id"] for r in seen], np.int64), x, np.array([r["toxic"] for r in seen], bool), len(lexicon.features)) if len(seen) else Chain(np.zeros((2, 2)), np.zeros(len(lexicon.features)), 0.0), np.zeros(5))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, j, f, _, _ in tagged(model, rows):
                yield batch(FACTS, rows.column("toxic").slice(i, j - i), f.tolist())

    seen = (sample.filter(part) if split else sample).mapInArrow(gathered, "toxic int, facts array<double>").collect()
    model.weights = logistic(np.array([r["facts"] for r in seen]), np.array([r["toxic"] for r in seen], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and toxic spans (first byte and length) of each row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, j, _, s, spans in tagged(model, rows):
                yield batch(OUT, rows.column("doc_id").slice(i, j - i), s, spans)

    return columns(docs, doc_id="long", text="string").mapInArrow(scored, "doc_id long, score double, spans array<array<long>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """Scores every text with a model of the labelled ones (see ``train``): doc_id, held_out, score, predicted and spans.

    Marginals of the field come from forward-backward over whole texts. Scores see the text only.

    Defined cases: null and empty texts get the score of a text without known words; rows with a null doc_id are scored,
    and held out; repeated rows get a row each; labels that are null, or of no document, aren't used; without toxic or
    without clean labels every score is the share of toxic ones; a very long text is tagged as a whole; an empty table gives
    an empty table; other columns are ignored.
    """
    of = score(docs, train(docs, labels, sample_rows))
    return of.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, each by its own text: rows that share a doc_id, or have none, are judged one by one."""
    model = train(docs, labels, sample_rows)
    return rows_by_text(docs, lambda rows: np.concatenate([s < 0.5 for _, _, _, s, _ in tagged(model, rows)] or [np.zeros(0, bool)]))
