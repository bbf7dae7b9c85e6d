"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexmill.llm.common import ALNUM, LOWER, SPACE, batch, columns, cut, mix, pieces, utf8, word_hashes, words

MARGINS = ("source", "lang", "topic")
#: Buckets that words are hashed to for topics.
DIM = 512
#: A bag's entry: a bucket and how many words are in it.
BAG = np.dtype([("bucket", "<u2"), ("n", "<u4")])
#: What vectors are multiplied by before they are added up.
FIXED = float(1 << 30)
SUMS = pa.schema([("centre", pa.int32()), ("bucket", pa.int32()), ("total", pa.int64())])
COUNTED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("bag", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("topic", pa.int32()), ("n_tokens", pa.int64())])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang (null: empty), n_tokens (words between ASCII whitespace) and bag (see ``bags``) of each row; texts are read once."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, off = utf8(rows.column("text"))
            for i, j in pieces(off):
                part, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
                first = words(part, edges, ~SPACE)[2]
                own = [rows.column(c).slice(i, j - i) for c in ("doc_id", "source", "lang")]
                yield batch(COUNTED, own[0], own[1].fill_null(""), own[2].fill_null(""), np.diff(first), bags(part, edges))

    docs = columns(docs, doc_id="long", text="string", source="string", lang="string")
    return docs.mapInArrow(told, "doc_id long, source string, lang string, n_tokens long, bag binary")


def bags(part: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The buckets of hashed words of four bytes or more and their counts, for each text."""
    low = LOWER[part]
    starts, ends, first = words(low, off, ALNUM)
    bucket = (mix(word_hashes(low, starts, ends)) % np.uint64(DIM)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    use = ends - starts >= 4
    n = np.bincount(row[use] * DIM + bucket[use], minlength=(len(off) - 1) * DIM)
    at = np.flatnonzero(n)
    out = np.empty(len(at), BAG)
    out["bucket"], out["n"] = at % DIM, n[at]
    edges = np.searchsorted(at, np.arange(len(off)) * DIM)
    return [out[a:b].tobytes() for a, b in zip(edges, edges[1:])]


def vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of logarithmic counts; zero for an empty bag."""
    data, off = utf8(column)
    entries = np.frombuffer(data[off[0] : off[-1]].tobytes(), BAG)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off) // BAG.itemsize)
    v = np.bincount(row * DIM + entries["bucket"], weights=np.log1p(entries["n"]), minlength=(len(off) - 1) * DIM).reshape(-1, DIM)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def chunks(rows: pa.RecordBatch, size: int = 2048) -> Iterator[pa.RecordBatch]:
    return (rows.slice(k, size) for k in range(0, len(rows), size))


def topic_seeds(of: DataFrame, topics: int) -> np.ndarray:
    """Vectors of the topics distinct bags with the smallest hashes."""
    keyed = of.filter(F.length("bag") > 0).select(F.xxhash64("bag").alias("h"), "bag")
    least = [r["h"] for r in keyed.select("h").distinct().orderBy("h").limit(topics).collect()]
    found = keyed.filter(F.col("h").isin(least)).groupBy("h").agg(F.min("bag").alias("bag")).orderBy("h").collect() if least else []
    return vectors(pa.array([bytes(r["bag"]) for r in found], pa.binary())) if found else np.zeros((1, DIM))


def topic_centres(of: DataFrame, topics: int = 8, rounds: int = 12) -> np.ndarray:
    """Centres of a spherical k-means over all rows of of (bag): each round is a job over them, and only centres are collected.

    Sums are of whole numbers (vectors times 2**30), so they don't depend on how rows are dealt to tasks.
    """
    c = topic_seeds(of, topics)
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(c.shape, np.int64)
            for rows in batches:
                for some in chunks(rows):
                    v = vectors(some.column("bag"))
                    nearest = (v @ c.T).argmax(1)
                    whole = np.rint(v * FIXED).astype(np.int64)
                    for k in range(len(c)):
                        sums[k] += whole[nearest == k].sum(0)
            k, bucket = np.nonzero(sums)
            yield batch(SUMS, k.astype(np.int32), bucket.astype(np.int32), sums[k, bucket])

        total = of.select("bag").mapInArrow(summed, "centre int, bucket int, total long").groupBy("centre", "bucket").agg(F.sum("total").alias("total")).collect()
        new = np.zeros(c.shape)
        for r in total:
            new[r["centre"], r["bucket"]] = r["total"] / FIXED
        size = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(size > 0, new / np.maximum(size, 1e-9), c)
        if np.array_equal(new, c):
            break
        c = new
    return c


def described(docs: DataFrame, topics: int = 8) -> DataFrame:
    """doc_id, source, lang (null: empty), topic and n_tokens (words between ASCII whitespace) of each row."""
    of = cut(counted(docs))
    centres = topic_centres(of, topics)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for some in chunks(rows):
                topic = (vectors(some.column("bag")) @ centres.T).argmax(1).astype(np.int32)
                yield batch(OUT, some.column("doc_id"), some.column("source"), some.column("lang"), topic, some.column("n_tokens"))

    return of.mapInArrow(told, "doc_id long, source string, lang string, topic int, n_tokens long")


def tempered(cells: DataFrame, column: str, power: float) -> DataFrame:
    """Target shares of a column's values: their shares of the tokens to a power, summing to one. A power under one raises the small ones."""
    t = cells.groupBy(F.col(column).cast("string").alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("t")).filter("t > 0")
    total = t.agg(F.sum("t")).first()[0]
    return t.select(F.lit(column).alias("margin"), "value", (F.col("t") / F.lit(total)).alias("share"))


#: Cells that fit the driver: so many at most are raked there, more by Spark, to the same weights.
FEW_CELLS = 50_000


def raked(cells: DataFrame, targets: DataFrame, rounds: int = 30, tolerance: float = 1e-4, few: int = FEW_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight, by which tokens x weight meet targets (margin, value, share) in each margin.

    Each round fits the margins one after another: a value's cells are scaled so that their weighted tokens are its
    share of all tokens. Values without a target keep what they have. Rounds end when no scaling differs from one by more
    than tolerance. The cells, a row for each combination, are counted first: up to few of them are raked in numpy, since
    a Spark job for a few hundred rows is all overhead; more are raked by windows and kept in the checkpoint folder after
    each round.
    """
    cells = cells.filter("tokens > 0").select(*MARGINS, "tokens")
    total, n = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    if n <= few:
        return _raked_here(cells, targets, rounds, tolerance)
    targets, cells = cut(targets), cells.withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        worst: Column = F.lit(0.0)
        for m in MARGINS:
            own = targets.filter(F.col("margin") == m).select(F.col("value").alias(m), F.col("share"))
            now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m))
            cells = cells.withColumn("now", now).join(own.withColumn(m, F.col(m).cast(dict(cells.dtypes)[m])), m, "left")
            cells = cells.withColumn("f", F.coalesce(F.col("share") * total / F.col("now"), F.lit(1.0)))
            cells = cells.select(*MARGINS, "tokens", (F.col("weight") * F.col("f")).alias("weight"), F.greatest(F.abs(F.col("f") - 1), F.col("worst") if "worst" in cells.columns else worst).alias("worst"))
        cells = cut(cells)
        if cells.agg(F.max("worst")).first()[0] < tolerance:
            break
        cells = cells.drop("worst")
    return cells.select(*MARGINS, "tokens", "weight")


def _raked_here(cells: DataFrame, targets: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    rows = cells.collect()
    share = {(r["margin"], r["value"]): r["share"] for r in targets.collect()}
    tokens = np.array([r["tokens"] for r in rows], float)
    weight, total = np.ones(len(rows)), tokens.sum()
    codes = []
    for m in MARGINS:
        values = [str(r[m]) for r in rows]
        names, code = np.unique(values, return_inverse=True) if rows else (np.zeros(0, str), np.zeros(0, int))
        codes.append((code, np.array([share.get((m, v), np.nan) for v in names])))
    for _ in range(rounds if rows else 0):
        worst = 0.0
        for code, wanted in codes:
            now = np.bincount(code, weights=tokens * weight, minlength=len(wanted))
            f = np.where(np.isnan(wanted), 1.0, wanted * total / now)
            weight, worst = weight * f[code], max(worst, float(np.abs(f - 1).max()))
        if worst < tolerance:
            break
    schema = cells.schema.add("weight", "double")
    return cells.sparkSession.createDataFrame([(*r, float(w)) for r, w in zip(rows, weight, strict=True)], schema)


def calibrated(cells: DataFrame, keep: float, rounds: int = 50) -> DataFrame:
    """cells with p, the chance to keep a document: proportional to weight, at most 1, and such that keep of all tokens are expected."""
    total, most = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    scale, last = 1.0, None
    for _ in range(rounds):
        full, rest = cells.agg(F.coalesce(F.sum(F.when(F.col("weight") * scale >= 1, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("weight") * scale < 1, F.col("tokens") * F.col("weight"))), F.lit(0.0))).first()
        if full == last or rest <= 0 or keep * total <= full:
            break
        last, scale = full, (keep * total - full) / rest
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("weight") * scale))


def mixture(docs: DataFrame, targets: DataFrame | None = None, keep: float = 0.5, power: float = 0.7, topics: int = 8, seed: int = 17) -> DataFrame:
    """Which documents to take so that sources, languages and topics get their target shares of the tokens.

    Tokens are counted over all documents, for each combination of source, language and topic; these cells are raked to
    the targets (margin, value, share; by default each margin's own shares to a power). A document's probability is its
    cell's weight, scaled so that keep of all tokens are expected, and 1 at most; it is taken if a hash of its doc_id
    falls below. Topics are the nearest centres of a k-means over all documents.
    Returns a row for each row of docs: doc_id, source, lang, topic, n_tokens, weight, probability, taken.

    Defined cases: a null source or lang is the empty one; null and empty texts have no tokens, are of topic 0, weigh
    nothing and are not taken, unless documents of their cell have tokens: then they share its probability; documents
    with one doc_id share their chance, a null doc_id has one too; a very long text weighs what it has of words;
    an empty table gives an empty table; other columns
    are ignored.
    """
    told = cut(described(docs, topics))
    cells = cut(told.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    if targets is None:
        targets = tempered(cells, "source", power).unionByName(tempered(cells, "lang", power)).unionByName(tempered(cells, "topic", power))
    of = cut(calibrated(raked(cells, targets), keep)).select(*MARGINS, "weight", F.col("p").alias("probability"))
    out = told.join(of, list(MARGINS), "left")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    return out.select("doc_id", *MARGINS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("probability", F.lit(0.0)).alias("probability"), (chance < F.coalesce("probability", F.lit(0.0))).alias("taken"))


def mixed(docs: DataFrame, targets: DataFrame | None = None, keep: float = 0.5, power: float = 0.7) -> DataFrame:
    """The rows of docs that ``mixture`` takes. Rows with one doc_id stay if one of them does."""
    taken = mixture(docs, targets, keep, power).filter("taken").select(F.col("doc_id").alias("_taken")).distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["_taken"]), "left_semi")
