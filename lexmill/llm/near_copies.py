"""Near copies: candidates by SimHash tries and by MinHash bands, verified by shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import BASE, LOWER, SPACE, batch, columns, cut, keyed_rows, mix, pieces, release, utf8, word_hashes, words
from lexmill.llm.components import components
from lexmill.llm.simhash import fingerprints, links

#: A MinHash signature: so many bands of so many minima. Two sets of similarity s meet in a band with chance
#: 1 - (1 - s**6)**20: 0.998 at 0.8, 0.27 at 0.5, 0.001 at 0.2.
BANDS, ROWS = 20, 6
SEEDS = np.random.default_rng(20250101).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
SETS = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("hashes", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
#: Words of 64 bits in which a set of shingles is sketched.
SKETCH = 8
#: Of a key with up to so many texts all pairs are compared; of others, those that a bound on their shingles lets through.
SMALL_KEY = 16


def shingles(part: np.ndarray, edges: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and each text's first shingle in them. Fewer words than shingle are one shingle; no words, none."""
    low = LOWER[part]
    starts, ends, first = words(low, edges, ~SPACE)
    h = word_hashes(low, starts, ends)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    begin = np.r_[0, np.cumsum(count)]
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - begin[row] + first[row]
    out = np.zeros(len(row), np.uint64)
    for k in range(shingle):
        use = at + k < first[row + 1]
        out = np.where(use, out * np.uint64(BASE) + h[np.where(use, at + k, 0)], out) if len(h) else out
    return mix(out), begin


def band_keys(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A key for each text and band: the minima of the band's hash functions over the text's shingles."""
    has = np.diff(begin) > 0
    keys = np.zeros((len(has), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(has), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            least = np.zeros(len(has), np.uint64)
            if has.any():
                least[has] = np.minimum.reduceat((h ^ SEEDS[0, k]) * SEEDS[1, k], begin[:-1][has])
            acc = mix(acc * np.uint64(BASE) + least)
        keys[:, b] = acc
    return keys.view(np.int64)


def text_key() -> Column:
    """What stands for a row's text: a null one is empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def jaccard(pairs: DataFrame, shingle: int) -> DataFrame:
    """a, b and similarity of the sets of shingles of pairs (a, b, text_a, text_b); two sets without any have one of 1."""

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, len(rows), 256):
                some = rows.slice(lo, 256)
                (x, x_of), (y, y_of) = (shingles(*_based(some.column(c)), shingle) for c in ("text_a", "text_b"))
                got = []
                for i in range(len(some)):
                    p, q = np.unique(x[x_of[i] : x_of[i + 1]]), np.unique(y[y_of[i] : y_of[i + 1]])
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    got.append(both / (len(p) + len(q) - both) if len(p) or len(q) else 1.0)
                yield batch(PAIRS, some.column("a"), some.column("b"), got)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(rated, "a long, b long, similarity double")


def _based(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(column)
    return data[off[0] : off[-1]], off - off[0]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node (what stands for the text) and bands of each row."""

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, off = utf8(rows.column("text"))
            for i, j in pieces(off):
                keys = band_keys(*shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], shingle))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield batch(SIGNED, rows.column("doc_id").slice(i, j - i), rows.column("node").slice(i, j - i), bands)

    return docs.select("doc_id", text_key().alias("node"), "text").mapInArrow(signed_rows, "doc_id long, node long, bands array<long>")


def text_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """node and fp, the SimHash fingerprint, of each text."""
    return cut(fingerprints(docs, shingle).select(F.col("copy").alias("node"), F.col("fingerprint").alias("fp")).distinct())


def met_in_tries(docs: DataFrame, shingle: int, budget: int = 4, prints: DataFrame | None = None) -> DataFrame:
    """a and b: texts whose SimHash fingerprints the trie self-join links (budget differing bits), and each text and the one that stands for its fingerprint."""
    prints = text_prints(docs, shingle) if prints is None else prints
    heads = cut(prints.groupBy("fp").agg(F.min("node").alias("head")))
    same = prints.join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = links(heads.select("fp"), budget)
    of = [heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab"]
    return same.unionByName(near.join(of[0], "a").join(of[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) of texts whose sets of shingles are as similar as that or more."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = cut(docs.select(text_key().alias("node"), "text").join(named, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(jaccard(both, shingle).filter(F.col("similarity") >= similarity).select("a", "b"))


def mixed_keys(shared: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, label and n, the number of texts of the key, of keys (key, node) with texts of different components (node, label; a text alone is one)."""
    labelled = shared.join(found, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).filter("least < most").select("key", "n")
    return cut(labelled.join(mixed, "key"))


def still_apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs a < b of texts that share a key (key, node) and are of different components (node, label; a text alone is one)."""
    rest = mixed_keys(shared, found)
    other = rest.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
    return ordered(rest.select("key", F.col("node").alias("a"), "label").join(other, "key").filter(F.col("label") < F.col("label_b")))


def shingle_sets(docs: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """node, label, hashes (the different ones of the shingles) and bits of the texts named (node, label). A bit says whether an odd number of the hashes have its place."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, off = utf8(rows.column("text"))
            for i, j in pieces(off):
                h, begin = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                own = [np.unique(h[x:y]).view(np.int64) for x, y in zip(begin[:-1], begin[1:], strict=True)]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                odd = [np.packbits(np.bincount(x & (64 * SKETCH - 1), minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64) for x in own]
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.concatenate(x))) for e, x in ((ends, own), (np.arange(len(own) + 1) * SKETCH, odd))]
                yield batch(SETS, rows.column("node").slice(i, j - i), rows.column("label").slice(i, j - i), *lists)

    texts = docs.select(text_key().alias("node"), "text").join(named, "node").dropDuplicates(["node"])
    return texts.select("node", "label", "text").mapInArrow(sets, "node long, label long, hashes array<long>, bits array<long>")


def may_be_similar(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a < b of texts (see ``shingle_sets``) of different labels that may be as similar as that: all that are, and few others.

    Only what texts of different labels have can be shared by a pair. A text's shingles of that kind are put in one order,
    the rarest first. Of a similar pair, of m and n shingles, at least similarity / (1 + similarity) * (m + n) are shared.
    So many must be left in both texts from the first shared one on, which therefore is near the beginning, where shingles
    are rare: most near copies with own changes don't meet, however many there are. Of those that do, no more shingles than
    the rest are only one's own, and each of these changes one bit of the sketches at most.
    """
    share = similarity / (1 + similarity)
    each = sets.select("node", "label", "bits", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    common = each.groupBy("hash").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("hash", "n")
    left = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("hash")))
    # a millionth less, so that no rounding loses a pair at the limit
    first = cut(each.join(common, "hash").withColumn("left", left + 1e-6).filter(F.col("left") >= similarity * F.col("size")).drop("n"))
    smaller = first.filter(F.col("left") >= 2 * share * F.col("size")).select("hash", *(F.col(c).alias(f"{c}_b") for c in ("node", "label", "size", "left", "bits")))
    both = F.col("size") + F.col("size_b")
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(1, SKETCH)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("bits_b")[0])))
    met = first.join(smaller, "hash").filter("label <> label_b AND struct(size, node) > struct(size_b, node_b)").filter((F.least("left", "left_b") >= share * both) & (differ <= (1 - 2 * share) * both + 1e-6))
    return ordered(met.select(F.col("node").alias("a"), F.col("node_b").alias("b")))


def text_groups(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and node of each row of docs (doc_id, text), and the label of each node that has links to others.

    Keys are those of bands and fingerprints. First all texts of a key are compared with one of them, another for each key that
    they share, so a large group of near copies isn't squared. Then all texts of a key that aren't of one component yet are
    compared with each other, so no link between components is left out; in keys of many texts, all that ``may_be_similar``.
    """
    signed = cut(signatures(docs, shingle))
    prints = text_prints(docs, shingle)
    banded = signed.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key")).unionByName(prints.select("node", F.xxhash64(F.lit("fp"), "fp").alias("key")))
    leaders = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node"), "node")).alias("most"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("most.node").alias("leader"))
    shared = cut(banded.join(leaders, "key"))
    met = shared.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    pairs = cut(ordered(met.unionByName(met_in_tries(docs, shingle, prints=prints))))
    release(docs.sparkSession)
    found = components(verified(docs, pairs, shingle, similarity))
    release(docs.sparkSession)
    rest = mixed_keys(shared.select("key", "node"), found)
    few, many = (rest.filter(F.col("n") <= SMALL_KEY).select("key", "node"), rest.filter(F.col("n") > SMALL_KEY).select("node", "label").distinct())
    apart = still_apart(few, found).unionByName(may_be_similar(shingle_sets(docs, many, shingle), similarity)).distinct()
    more = cut(apart.join(pairs, ["a", "b"], "left_anti"))
    release(docs.sparkSession)
    if not more.isEmpty():
        between = verified(docs, more, shingle, similarity)
        release(docs.sparkSession)
        if not between.isEmpty():
            found = components(cut(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(between)))
    return signed.select("doc_id", "node"), found


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links of texts whose sets of shingles have a Jaccard similarity of that or more.

    Candidates are texts whose SimHash fingerprints a trie self-join links, and texts that meet in a band of MinHash
    minima: at a similarity of 0.8 fingerprints differ in about ten bits, so SimHash alone finds the closest copies only.
    Of texts that meet all pairs are compared, but for those that other links have put into one component already.
    Each link is verified on the whole sets of shingles.

    Defined cases: words are those of ``simhash``; texts without words are alike; a text of fewer words than shingle is
    one shingle; rows with a null doc_id aren't in the result; of a very long text all shingles count;
    an empty table gives an empty table; other columns are ignored.
    """
    rows, found = text_groups(columns(docs, doc_id="long", text="string"), shingle, similarity)
    of = rows.filter("doc_id IS NOT NULL").distinct().join(found, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    of = cut(of)
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return of.join(least, "label").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def without_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one of each component: the one with the smallest doc_id, and of those with that the smallest hash of the text.

    Each row is judged by its own text. Rows with the same doc_id and text are one; rows with a null doc_id stay.
    """
    rows, found = text_groups(columns(docs, doc_id="long", text="string"), shingle, similarity)
    labelled = rows.filter("doc_id IS NOT NULL").join(found, "node")
    first = labelled.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    later = labelled.join(first, "label").filter(F.struct("doc_id", "node") != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("node").alias("_of")).distinct()
    # texts that aren't linked to others can still be in several rows
    alone = rows.filter("doc_id IS NOT NULL").join(found, "node", "left_anti")
    copies = alone.join(alone.groupBy("node").agg(F.min("doc_id").alias("least")), "node").filter("doc_id <> least").select(F.col("doc_id").alias("_id"), F.col("node").alias("_of")).distinct()
    gone = later.unionByName(copies)
    keyed = keyed_rows(docs)
    kept = keyed.join(gone, (keyed["id"] == gone["_id"]) & (keyed["node"] == gone["_of"]), "left_anti")
    return kept.filter("id IS NOT NULL").dropDuplicates(["id", "node"]).unionByName(kept.filter("id IS NULL")).select("row.*")
