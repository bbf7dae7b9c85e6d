"""Text index and batch retrieval: BM25, dense vectors, fusion, and what becomes of hits. Every table is keyed by query_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import is_stable, stable_tokens, tokens
from lexmill.session import cut

#: Query vectors that are sent to the tasks at once; more queries are searched for in several passes.
QUERY_BLOCK = 4096
#: Vectors that a block of queries is compared with at once.
VECTOR_BLOCK = 1024
#: Rows of query terms up to which they are sent to all tasks, so that the index isn't shuffled by term; more are joined by shuffles.
SENT_TERMS = 1_000_000
#: Terms of an index, the most frequent ones, that are sent to all tasks with what is known of them; the others' rows are joined by shuffles.
FREQUENT_TERMS = 1 << 18


def tokenised(texts: DataFrame, key: str) -> DataFrame:
    """key and tokens (an array). Texts that normal forms leave alone stay in the JVM; only others pass through Python."""
    stable = is_stable("text")
    return texts.filter(stable).select(key, stable_tokens("text").alias("tokens")).unionByName(texts.filter(~stable).select(key, tokens("text").alias("tokens")))


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """key, term and tf of each text."""
    return tokenised(texts, key).select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def counted(texts: DataFrame, key: str) -> DataFrame:
    """A row for each key: dl, and terms, an array of (term, tf) in the order of terms. Texts are counted where they lie; only those whose key comes again, or is null, are brought together."""
    own = tokenised(texts, key).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    again = cut(texts.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_key")))
    if not again.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_key"))
        own = own.join(again, same, "left_anti").unionByName(own.join(again, same, "left_semi").groupBy(key).agg(F.flatten(F.collect_list("tokens")).alias("tokens")))
    # no filter reads what is made here, as Spark would make it once more there, within lambdas for each element; in order, a term's first place and that of the next term tell how often it comes
    ordered = own.select(key, F.size("tokens").alias("dl"), F.sort_array("tokens").alias("s"))
    firsts = ordered.withColumn("at", F.filter(F.when(F.col("dl") > 0, F.sequence(F.lit(1), F.col("dl"))).otherwise(F.array().cast("array<int>")), lambda i: (i == 1) | (F.col("s")[i - 1] != F.col("s")[i - 2])))
    terms = F.transform("at", lambda i, k: F.struct(F.col("s")[i - 1].alias("term"), (F.coalesce(F.try_element_at("at", k + 2), F.col("dl") + 1) - i).cast("long").alias("tf")))
    return firsts.select(key, F.col("dl").cast("long").alias("dl"), terms.alias("terms"))


def index_statistics(counts: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """What a batch of texts adds to an index: terms (term, df) and totals (one row: docs and tokens), of its term counts. Texts without tokens count among docs."""
    totals = texts.agg(F.count("*").alias("docs")).crossJoin(counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")))  # a row each
    return {"terms": counts.groupBy("term").agg(F.count("*").alias("df")), "totals": totals}


def merged_statistics(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Statistics of all texts of several batches, by sums alone: in any order, and without reading a text again. Batches share no text."""
    terms, totals = parts[0]["terms"], parts[0]["totals"]
    for p in parts[1:]:
        terms, totals = terms.unionByName(p["terms"]), totals.unionByName(p["totals"])
    return {"terms": terms.groupBy("term").agg(F.sum("df").alias("df")), "totals": totals.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))}


def corpus_stats(statistics: dict[str, DataFrame]) -> tuple[int, float]:
    """doc_count and avgdl; of no texts, 0 and 0."""
    docs, tokens_ = statistics["totals"].select("docs", "tokens").first()
    return docs or 0, (tokens_ or 0) / docs if docs else 0.0


def idf(statistics: dict[str, DataFrame], doc_count: int) -> DataFrame:
    """term, df and idf."""
    return statistics["terms"].withColumn("idf", F.log1p((F.lit(doc_count) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def fitted(texts: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Term counts of texts, kept, so that they are tokenised once, and the statistics of these."""
    counts = cut(term_counts(texts, key))
    return counts, index_statistics(counts, texts)


def encoded(counts: DataFrame, key: str, statistics: dict[str, DataFrame], k1: float = 1.5, b: float = 0.75, lengths: DataFrame | None = None) -> DataFrame:
    """key, term and weight, where positive, of the terms that the statistics know. The texts that were counted need not be among those of the statistics. lengths (key, dl) stand for the sums of tf, where counts haven't all terms."""
    doc_count, avgdl = corpus_stats(statistics)
    lengths = counts.groupBy(key).agg(F.sum("tf").alias("dl")) if lengths is None else lengths
    return weighed(counts.join(idf(statistics, doc_count), "term").join(lengths, key), key, avgdl, k1, b)


def weighed(rows: DataFrame, key: str, avgdl: float, k1: float, b: float) -> DataFrame:
    """key, term and weight, where positive, of rows with idf, tf and dl."""
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    return rows.select(key, "term", w.alias("weight")).filter("weight > 0")


def vocabulary(idfs: DataFrame) -> DataFrame:
    """Terms with their rank in alphabetical order, for export: ranks within first letters, and how many terms earlier letters have."""
    letter = F.substring("term", 1, 1)
    offsets = idfs.groupBy(letter.alias("letter")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("letter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = idfs.withColumn("letter", letter).withColumn("r", F.row_number().over(Window.partitionBy("letter").orderBy("term")) - 1)
    return ranked.join(F.broadcast(offsets.select("letter", "before")), "letter").select("term", (F.col("before") + F.col("r")).alias("idx"), "df", "idf")


def frequent(terms: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """terms (term, df and more) parted in two: those of at least a df, FREQUENT_TERMS at most, and the others, if there are any."""
    powers = range(63)
    n = terms.agg(F.count("*"), *(F.count_if(F.col("df") >= 1 << p) for p in powers)).first()
    if n[0] <= FREQUENT_TERMS:
        return terms, None
    least = 1 << next((p for p in powers if n[p + 1] <= FREQUENT_TERMS), 62)
    return terms.filter(F.col("df") >= least), terms.filter(F.col("df") < least)


def bm25_weights(texts: DataFrame, key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """key, term and weight, where positive.

    Terms are counted within each text, once for the statistics and again for the weights, as the counts of all texts
    are many times their size on disk. Frequent terms get their idf where the texts lie; rows of others alone are shuffled.
    """
    of = counted(texts, key)
    totals = texts.agg(F.count("*").alias("docs")).crossJoin(of.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")))
    known = cut(of.select(F.explode_outer("terms").alias("t")).select("t.term").filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")))
    statistics = {"terms": known, "totals": totals}
    doc_count, avgdl = corpus_stats(statistics)
    often, seldom = frequent(idf(statistics, doc_count))
    each = of.filter(F.col(key).isNotNull()).select(key, "dl", F.explode_outer("terms").alias("t")).select(key, "dl", "t.term", "t.tf").filter("term IS NOT NULL")
    rows = each.join(F.broadcast(often), "term")
    if seldom is not None:
        rows = rows.unionByName(each.join(F.broadcast(often.select("term")), "term", "left_anti").join(seldom.hint("merge"), "term"))
    return weighed(rows, key, avgdl, k1, b)


def sent(terms: DataFrame) -> DataFrame:
    """terms, to be sent to all tasks if they are few enough."""
    return F.broadcast(terms) if terms.count() <= SENT_TERMS else terms


def asked_weights(texts: DataFrame, key: str, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``bm25_weights`` of those terms (term) alone: each text is tokenised whole, and what isn't asked for counts in its length only."""
    terms = cut(terms.select("term").distinct())
    # no term is empty: that row of each text carries its length
    tokens_ = F.coalesce("tokens", F.array().cast("array<string>"))
    each = tokenised(texts, key).select(key, F.size(tokens_).alias("n"), F.explode(F.concat(F.array(F.lit("")), tokens_)).alias("term"))
    wanted = sent(terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string")))
    counts = cut(each.join(wanted, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.sum(F.when(F.col("term") == "", F.col("n"))).alias("dl")))
    whole, counts = counts.filter("term = ''"), counts.filter("term <> ''").select(key, "term", "tf")
    totals = whole.agg(F.sum("tf").alias("docs"), F.sum("dl").alias("tokens"))
    # lengths are joined by shuffles: weights then lie together by key, and the scores of a key are added up where they lie
    known = cut(counts.groupBy("term").agg(F.count("*").alias("df")))
    return encoded(counts, key, {"terms": sent(known), "totals": totals}, k1, b, whole.select(key, "dl").hint("merge"))


def query_vectors(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, term and tf of the terms that the index knows."""
    return term_counts(queries, "query_id").join(weights.select("term").distinct(), "term", "left_semi").select("query_id", "term", "tf")


def top(scored: DataFrame, key: str, n: int) -> DataFrame:
    """The n best of each query by score rounded to 6 places, then key: adds rank, from 0."""
    scored = scored.withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < n)


def sparse_topk(queries: DataFrame, weights: DataFrame, key: str, n: int) -> DataFrame:
    """query_id, key, score and rank by the sum of tf x weight over shared terms."""
    shared = sent(cut(term_counts(queries, "query_id"))).join(weights, "term")
    return top(shared.groupBy("query_id", key).agg(F.sum(F.col("tf") * F.col("weight")).alias("score")), key, n)


def dense_topk(queries: DataFrame, vectors: DataFrame, key: str, n: int) -> DataFrame:
    """query_id, key, score and rank by cosine. queries (query_id, embedding) go to the tasks in blocks of QUERY_BLOCK; a task keeps the n best of each query over all its rows."""
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())])
    held = queries.select(F.col("query_id").cast("long"), "embedding").orderBy("query_id").toLocalIterator()
    out, block = None, []

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)

    def search(block: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in block], np.int64)
        sent = queries.sparkSession.sparkContext.broadcast((ids, unit(np.array([r["embedding"] for r in block], np.float64))))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            # the best so far, a row for each query: scores, and their keys
            scores, keys = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for rows in batches:
                for lo in range(0, rows.num_rows, VECTOR_BLOCK):
                    some = rows.slice(lo, VECTOR_BLOCK)
                    own = some.column(key).to_numpy()
                    order = np.argsort(own, kind="stable")
                    v = unit(some.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1))[order]
                    s = q @ v.T
                    # the block's best: by score in millionths, then by key, in one number
                    grade = np.rint(s * 1e6).astype(np.int64) * VECTOR_BLOCK - np.arange(len(order))
                    if len(order) > n:
                        best_n = np.argpartition(-grade, n - 1, axis=1)[:, :n]
                        s, k = np.take_along_axis(s, best_n, 1), own[order][best_n]
                    else:
                        k = np.tile(own[order], (len(ids), 1))
                    scores, keys = np.concatenate([scores, np.round(s, 6)], 1), np.concatenate([keys, k], 1)
                    if scores.shape[1] > n:
                        both = np.lexsort((keys, -scores), axis=1)[:, :n]
                        scores, keys = np.take_along_axis(scores, both, 1), np.take_along_axis(keys, both, 1)
            if scores.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, scores.shape[1])), pa.array(keys.ravel()), pa.array(scores.ravel())], schema=schema)

        return vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(best, f"query_id long, {key} long, score double")

    for r in held:
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return top(out, key, n)


def rrf(branches: list[DataFrame], key: str, k: int = 2) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank), rank from 0."""
    both = branches[0].select("query_id", key, "rank")
    for b in branches[1:]:
        both = both.unionByName(b.select("query_id", key, "rank"))
    return both.groupBy("query_id", key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def dbsf(branches: list[DataFrame], key: str) -> DataFrame:
    """Distribution-based score fusion: each branch is scaled by its mean and three standard deviations, then summed. A branch without spread scores 0.5."""
    both = None
    for i, b in enumerate(branches):
        own = b.select("query_id", key, "score", F.lit(i).alias("branch"))
        both = own if both is None else both.unionByName(own)
    w = Window.partitionBy("query_id", "branch")
    mean, sd = F.avg("score").over(w), F.stddev_samp("score").over(w)
    scaled = F.when(F.coalesce(sd, F.lit(0.0)) > 1e-12, (F.col("score") - (mean - 3 * sd)) / (6 * sd)).otherwise(0.5)
    return both.withColumn("score", scaled).groupBy("query_id", key).agg(F.sum("score").alias("score"))


def hybrid_search(queries: DataFrame, weights: DataFrame, query_vecs: DataFrame, vectors: DataFrame, key: str, prefetch: int = 30, limit: int = 5, fusion: str = "rrf") -> DataFrame:
    """The limit best of each query over sparse and dense search; dense alone where the index knows no term of it."""
    branches = [sparse_topk(queries, weights, key, prefetch), dense_topk(query_vecs, vectors, key, prefetch)]
    return top(rrf(branches, key) if fusion == "rrf" else dbsf(branches, key), key, limit)


def hit_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """The parents (parent_id, content) that any hit of a query lies in, each once."""
    return hits.select("query_id", "parent_id").distinct().join(parents, "parent_id")


def wide_narrow(ranked: DataFrame, top_k: int, prefetch: int) -> DataFrame:
    """One ranked list of min(4 x top_k, prefetch) hits, with a flag for the first top_k."""
    return ranked.filter(F.col("rank") < min(4 * top_k, prefetch)).withColumn("narrow", F.col("rank") < top_k)


def article_rank(hits: DataFrame) -> DataFrame:
    """Articles of each query: highest score, first rank, and place by first appearance from 0."""
    of = hits.groupBy("query_id", "article_id").agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"))
    return of.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "article_id")) - 1)


def focus_filter(articles: DataFrame, ratio: float = 0.6, most: int = 4) -> DataFrame:
    """Articles with at least ratio of the first one's score, most at most; all up to most if that score isn't positive."""
    w = Window.partitionBy("query_id").orderBy("pos")
    first = F.first("score").over(w)
    kept = articles.withColumn("lead", first).filter((F.col("lead") <= 0) | (F.col("score") >= F.lit(ratio) * F.col("lead"))).drop("lead")
    return kept.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") < most)


def ordered_text(rows: DataFrame, by: list[str], order: str, text: str, sep: str) -> DataFrame:
    """texts of a group joined in order."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep).alias("context"))


def article_expand(focus: DataFrame, texts: DataFrame) -> DataFrame:
    """Full texts of a query's articles in order; articles without a text are counted all the same."""
    of = focus.join(texts, "article_id", "left").groupBy("query_id").agg(F.count("*").alias("n_articles"), F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("pos", "content")))).alias("t"))
    return of.select("query_id", "n_articles", F.array_join(F.transform("t", lambda x: x["content"]), "\n\n").alias("context"))


def context_block(texts: DataFrame, queries: DataFrame, empty: str = "(không có ngữ cảnh)") -> DataFrame:
    """``[1] text`` and so on for each query, in order; a fixed text for queries without any."""
    of = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("t"))
    numbered = F.array_join(F.transform("t", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["content"])), "\n\n")
    return queries.select("query_id").distinct().join(of, "query_id", "left").select("query_id", F.coalesce(numbered, F.lit(empty)).alias("context"))
