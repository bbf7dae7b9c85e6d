"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import LOWER, batch, columns, pieces, utf8

FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Buckets that n-grams are hashed to, and the lengths of these in bytes.
BUCKETS = 1 << 12
GRAMS = (1, 2, 3, 4)
#: Bytes and rows of text that are looked at together.
PIECE, ROWS = 1 << 19, 512
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("distance", pa.int32()), ("ambiguous", pa.bool_())])
SEEN = pa.schema([("lang", pa.string()), ("buckets", pa.binary()), ("shares", pa.binary())])
#: Letters of ASCII in lower case and all other bytes over 0x7F as they are; the rest is a space.
LETTER = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 32).astype(np.uint8)


@dataclass
class Model:
    """langs and their codewords (a row of 1 and -1 each); bits: a linear classifier for each column; weights: what a bit counts for a language; margin: under which difference of losses a text is ambiguous."""

    langs: list[str]
    code: np.ndarray
    bits: np.ndarray
    weights: np.ndarray
    margin: float


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from. A null doc_id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def codewords(n: int) -> np.ndarray:
    """n rows of 1 and -1: all different ways to part up to 7 languages in two, else about 10 log2(n) random ones, those whose nearest rows are furthest apart of 100 tries."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        k = np.arange(1, 1 << (n - 1))
        return np.where(np.r_[[np.zeros(len(k), int)], (k >> np.arange(n - 1)[:, None]) & 1], 1.0, -1.0)
    rng, best, apart = np.random.default_rng(n), None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        near = code @ code.T
        np.fill_diagonal(near, -code.shape[1])
        d = (code.shape[1] - near.max()) / 2
        if d > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, d
    return best


def shares(rows: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """For rows i to j: square roots of the counts of a text's n-grams by bucket, scaled to length 1."""
    data, off = utf8(rows.column("text"))
    for lo, hi in pieces(off, PIECE):
        for i in range(lo, hi, ROWS):
            j = min(i + ROWS, hi)
            part = LETTER[LOWER[data[off[i] : off[j]]]].astype(np.uint32)
            row = np.repeat(np.arange(j - i), np.diff(off[i : j + 1]))
            # runs of what isn't a letter are one space
            keep = np.ones(len(part), bool)
            keep[1:] = (part[1:] != 32) | (part[:-1] != 32) | (row[1:] != row[:-1])
            part, row = part[keep], row[keep]
            x = np.zeros((j - i) * BUCKETS, np.float32)
            gram = np.zeros(len(part), np.uint32)
            for n in GRAMS:
                if len(part) < n:
                    break
                # up to four bytes in one number; the length is told apart by what is added
                gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
                own = row[n - 1 :] == row[: len(part) - n + 1]
                bucket = ((gram[own] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B % 2**32)) * np.uint32(0xC2B2AE35)) >> np.uint32(20)
                x += np.bincount(row[n - 1 :][own] * BUCKETS + bucket, minlength=len(x)).astype(np.float32)
            x = np.sqrt(x.reshape(j - i, BUCKETS))
            yield i, j, x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def losses(margins: np.ndarray) -> np.ndarray:
    """Logistic loss of each margin, as the classifiers are fitted to."""
    return np.logaddexp(0, -margins)


def classifiers(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float = 1e-5, rounds: int = 300) -> np.ndarray:
    """Logistic regressions for all columns of y (1 and -1) at once, by accelerated gradient steps. Rows of x have length 1, which bounds the step; the last row of the result is the bias."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    w = z = np.zeros((x.shape[1], y.shape[1]), np.float32)
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    y = y.astype(np.float32)
    for k in range(rounds):
        g = x.T @ (weight * -y / (1 + np.exp(np.clip(y * (x @ z), -30, 30)))) + prior * z
        w, before = z - 2 * g, w
        z = w + (k / (k + 3)) * (w - before)
    return w


def decoded(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score, number of bits that differ from its codeword, and whether the text is ambiguous, of each row."""
    f = x @ model.bits[:-1] + model.bits[-1]
    n = max(f.shape[1], 1)
    loss = np.stack([(losses(code * f) * weight).sum(1) for code, weight in zip(model.code, model.weights, strict=True)], 1)
    order = np.argsort(loss, 1, kind="stable")
    best = order[:, 0]
    chance = np.exp(-n * (loss - loss.min(1, keepdims=True)))
    wrong = ((f > 0) != (model.code[best] > 0)).sum(1)
    if len(model.langs) < 2:
        return best, np.ones(len(x)), wrong, np.zeros(len(x), bool)
    rows = np.arange(len(x))
    second = order[:, 1]
    other = ((f > 0) != (model.code[second] > 0)).sum(1)
    return best, 1 / chance.sum(1), wrong, (loss[rows, second] - loss[rows, best] < model.margin) | (other <= wrong)


def labelled(docs: DataFrame, sample_rows: int, most_langs: int) -> tuple[list[str], DataFrame]:
    """The languages to learn, and the sample: of each language the rows with the smallest hashes of doc_id, sample_rows in all at most.

    Two jobs: rows are counted by language, with map-side combine; then each task passes on the rows whose hash is low
    enough for the share that is wanted, and only these meet by language.
    """
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("doc_id")))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not n:
        return [], rows
    each = max(1, sample_rows // len(n))
    # a quarter more than wanted passes, so that chance leaves enough
    share = F.create_map(*(F.lit(v) for lang, k in n.items() for v in (lang, min(1.0, 1.25 * each / k + 16 / k))))
    low = rows.withColumn("h", F.xxhash64("doc_id", F.lit(12))).filter(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "doc_id", F.xxhash64("text")))
    return sorted(n), low.withColumn("place", place).filter(F.col("place") <= each).select("lang", "text")


def train(docs: DataFrame, sample_rows: int = 8000, most_langs: int = 500) -> Model:
    """Fits the bits on a bounded sample of rows with a lang outside the held-out fold.

    sample_rows is the bound, shared equally among the languages; most_langs bounds these (the most frequent ones
    count). Spark hashes the sample's n-grams; the driver gets one vector of BUCKETS shares for each row of the sample. Three quarters
    teach the bits, each language counting the same; on the rest it is counted how often a bit is right for a language,
    which is the bit's weight when that language is decoded.
    """
    docs = columns(docs, doc_id="long", text="string", lang="string")
    langs, sample = labelled(docs, sample_rows, most_langs)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, j, x in shares(rows):
                at = [np.flatnonzero(r).astype(np.uint16) for r in x]
                yield batch(SEEN, rows.column("lang").slice(i, j - i), [a.tobytes() for a in at], [r[a].tobytes() for r, a in zip(x, at, strict=True)])

    seen = sample.mapInArrow(gathered, "lang string, buckets binary, shares binary").collect() if langs else []
    number = {lang: k for k, lang in enumerate(langs)}
    seen = sorted((number[r["lang"]], bytes(r["buckets"]), bytes(r["shares"])) for r in seen)
    x, own = np.zeros((len(seen), BUCKETS), np.float32), np.array([k for k, _, _ in seen], np.int64)
    for r, (_, at, share) in enumerate(seen):
        x[r, np.frombuffer(at, np.uint16)] = np.frombuffer(share, np.float32)
    code = codewords(len(langs))
    if code.shape[1] == 0:
        return Model(langs, code, np.zeros((BUCKETS + 1, 0), np.float32), code, 0.0)
    # every fourth row of a language tests, so each language of one row at least teaches
    place = np.arange(len(own)) - np.searchsorted(own, own)
    tests = place % 4 == 3
    n = np.bincount(own[~tests], minlength=len(langs))
    bits = classifiers(x[~tests], code[own[~tests]], 1 / n[own[~tests]])
    right = (x[tests] @ bits[:-1] + bits[-1]) * code[own[tests]] > 0
    weights = np.ones_like(code)
    np.add.at(weights, own[tests], right)
    weights /= (1 + np.bincount(own[tests], minlength=len(langs)))[:, None]
    return Model(langs, code, bits, weights / weights.sum(1, keepdims=True), margin=0.05)


def language_ids(docs: DataFrame, sample_rows: int = 8000, most_langs: int = 500) -> DataFrame:
    """The language of each whole text by a model of the rows that have one (see ``train``).

    Linear classifiers over hashed byte n-grams predict the bits of a codeword; the language whose codeword has the
    smallest loss wins, each bit weighed by how far it can be trusted for that language. Returns a row for each row of
    docs: doc_id, held_out, lang_pred, score (the share of the best language if losses are read as log odds), distance (bits that differ
    from its codeword) and ambiguous (another codeword is as near, or nearly of the same loss).

    Defined cases: null texts and texts without a letter are ``und`` with score 0 (and so are all without any labelled
    row); rows with a null doc_id are predicted, not learned from, and not held out; repeated rows get a row each; a
    very long text is hashed piece by piece of its batch, as a whole; with one language all texts have it; an empty
    table gives an empty table; other columns are ignored.
    """
    model = train(docs, sample_rows, most_langs)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            letter = rows.column("letter").to_numpy(zero_copy_only=False)
            for i, j, x in shares(rows):
                none = ~letter[i:j] | (not model.langs)
                best, score, wrong, unsure = decoded(model, x) if model.langs else (np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i, int), np.zeros(j - i, bool))
                yield batch(OUT, rows.column("doc_id").slice(i, j - i), [UNKNOWN if u else model.langs[k] for u, k in zip(none.tolist(), best.tolist(), strict=True)], np.where(none, 0, score), np.where(none, 0, wrong), none | unsure)

    texts = columns(docs, doc_id="long", text="string")
    texts = texts.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    of = texts.mapInArrow(scored, "doc_id long, lang_pred string, score double, distance int, ambiguous boolean")
    return of.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance", "ambiguous")
