"""Queries of the text index and of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import retrieval as R
from lexmill.plans.registry import Tables, query

BM25 = r"""WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+')) AS term FROM {documents}),
tc AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tc GROUP BY 1),
st AS (SELECT count(*) AS n, (SELECT sum(tf) FROM tc) / count(*) AS avgdl FROM {documents}),
ix AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tc, st GROUP BY term, n),
wt AS (SELECT tc.doc_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tc JOIN ix USING (term) JOIN dl ON tc.doc_id = dl.doc_id, st),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+')) AS term FROM {benchmark}),
qc AS (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY 1, 2)
"""
SPARSE = """, sp0 AS (SELECT query_id, doc_id, round(sum(tf * weight), 6) AS score FROM qc JOIN wt USING (term) WHERE weight > 0 GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM sp0)
"""
DENSE = """de0 AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))), 6) AS score
  FROM {embeddings} q JOIN {benchmark} b ON q.vec_id = b.item_id, {embeddings} v),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM de0)
"""
FUSED = BM25 + SPARSE + ", " + DENSE + """, two AS (SELECT query_id, doc_id, score, rank, 0 AS branch FROM sparse WHERE rank < 30 UNION ALL SELECT query_id, doc_id, score, rank, 1 FROM dense WHERE rank < 30),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (2 + rank)), 6) AS score FROM two GROUP BY 1, 2)
"""
TOP = "SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM "


def queries_of(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def weights_of(t: Tables) -> DataFrame:
    return R.bm25_weights(t.documents, "doc_id")


def asked_weights_of(t: Tables) -> DataFrame:
    return R.asked_weights(t.documents, "doc_id", R.term_counts(queries_of(t), "query_id"))


def vectors_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Vectors of queries and of documents: vec_id is item_id and doc_id."""
    v = t.embeddings
    return v.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("doc_id"), "embedding")


def branches_of(t: Tables) -> list[DataFrame]:
    q, v = vectors_of(t)
    return [R.sparse_topk(queries_of(t), asked_weights_of(t), "doc_id", 30), R.dense_topk(q, v, "doc_id", 30)]


@query("tokenize", BM25 + "SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM toks GROUP BY doc_id")
def tokenize(t: Tables) -> DataFrame:
    return R.term_counts(t.documents, "doc_id").groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


@query("bm25_fit", BM25 + "SELECT term, df, round(idf, 6) AS idf, n AS doc_count, round(avgdl, 6) AS avgdl FROM ix, st")
def bm25_fit(t: Tables) -> DataFrame:
    _, statistics = R.fitted(t.documents, "doc_id")
    doc_count, avgdl = R.corpus_stats(statistics)
    return R.idf(statistics, doc_count).select("term", "df", F.round("idf", 6).alias("idf"), F.lit(doc_count).cast("long").alias("doc_count"), F.lit(round(avgdl, 6)).alias("avgdl"))


@query("bm25_merged", BM25 + """, lq AS (SELECT query_id, sum(tf) AS dl FROM qc GROUP BY 1)
SELECT query_id, term, round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS weight FROM qc JOIN ix USING (term) JOIN lq USING (query_id), st""")
def bm25_merged(t: Tables) -> DataFrame:
    """Benchmark items, which are no texts of the index, encoded by the merged statistics of three batches of documents."""
    parts = []
    for k in (2, 0, 1):
        batch = t.documents.filter(F.pmod("doc_id", F.lit(3)) == k)
        parts.append(R.index_statistics(R.term_counts(batch, "doc_id"), batch))
    return R.encoded(R.term_counts(queries_of(t), "query_id"), "query_id", R.merged_statistics(parts)).withColumn("weight", F.round("weight", 6))


@query("bm25_vocab", BM25 + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, round(idf, 6) AS idf FROM ix")
def bm25_vocab(t: Tables) -> DataFrame:
    _, statistics = R.fitted(t.documents, "doc_id")
    return R.vocabulary(R.idf(statistics, R.corpus_stats(statistics)[0])).withColumn("idf", F.round("idf", 6))


@query("bm25_weights", BM25 + "SELECT doc_id, term, round(weight, 6) AS weight FROM wt WHERE weight > 0")
def bm25_weights(t: Tables) -> DataFrame:
    return weights_of(t).withColumn("weight", F.round("weight", 6))


@query("bm25_query", BM25 + "SELECT query_id, term, tf FROM qc WHERE term IN (SELECT term FROM ix)")
def bm25_query(t: Tables) -> DataFrame:
    return R.query_vectors(queries_of(t), R.term_counts(t.documents, "doc_id"))


@query("bm25_topk", BM25 + SPARSE + TOP + "sparse WHERE rank < 10")
def bm25_topk(t: Tables) -> DataFrame:
    return R.sparse_topk(queries_of(t), asked_weights_of(t), "doc_id", 10)


@query("dense_topk", "WITH " + DENSE + TOP + "dense WHERE rank < 10")
def dense_topk(t: Tables) -> DataFrame:
    q, v = vectors_of(t)
    return R.dense_topk(q, v, "doc_id", 10)


@query("rrf", FUSED + "SELECT * FROM fused")
def rrf(t: Tables) -> DataFrame:
    return R.rrf(branches_of(t), "doc_id").withColumn("score", F.round("score", 6))


@query("dbsf", FUSED + """, m AS (SELECT *, avg(score) OVER w AS mu, stddev_samp(score) OVER w AS sd FROM two WINDOW w AS (PARTITION BY query_id, branch))
SELECT query_id, doc_id, round(sum(CASE WHEN coalesce(sd, 0) > 1e-12 THEN (score - mu + 3 * sd) / (6 * sd) ELSE 0.5 END), 5) AS score FROM m GROUP BY 1, 2""")  # fmt: skip
def dbsf(t: Tables) -> DataFrame:
    return R.dbsf(branches_of(t), "doc_id").withColumn("score", F.round("score", 5))


@query("hybrid_search", FUSED + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM fused) " + TOP + "r WHERE rank < 5")
def hybrid_search(t: Tables) -> DataFrame:
    q, v = vectors_of(t)
    return R.hybrid_search(queries_of(t), asked_weights_of(t), q, v, "doc_id")


@query("hit_parents", "SELECT DISTINCT query_id, article_id AS parent_id, content FROM {hits} JOIN {article_text} USING (article_id)")
def hit_parents(t: Tables) -> DataFrame:
    return R.hit_parents(t.hits.withColumnRenamed("article_id", "parent_id"), t.article_text.withColumnRenamed("article_id", "parent_id"))


@query("wide_narrow", BM25 + SPARSE + "SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank, rank < 5 AS narrow FROM sparse WHERE rank < 20")
def wide_narrow(t: Tables) -> DataFrame:
    return R.wide_narrow(R.sparse_topk(queries_of(t), asked_weights_of(t), "doc_id", 30), 5, 30)


ARTICLES = BM25 + SPARSE + """, art AS (SELECT query_id, source AS article_id, max(score) AS score, min(rank) AS first_rank FROM sparse JOIN {documents} USING (doc_id) WHERE rank < 30 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, article_id) - 1 AS pos FROM art)
"""


def articles_of(t: Tables) -> DataFrame:
    hits = R.sparse_topk(queries_of(t), asked_weights_of(t), "doc_id", 30).join(t.documents.select("doc_id", F.col("source").alias("article_id")), "doc_id")
    return R.article_rank(hits)


@query("article_rank", ARTICLES + "SELECT query_id, article_id, score, CAST(first_rank AS INT) AS first_rank, CAST(pos AS INT) AS pos FROM ranked")
def article_rank(t: Tables) -> DataFrame:
    return articles_of(t)


@query("focus_filter", ARTICLES + """, f AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY pos) AS lead FROM ranked),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS p FROM f WHERE lead <= 0 OR score >= 0.6 * lead) SELECT query_id, article_id, score, CAST(p AS INT) AS pos FROM k WHERE p < 4""")  # fmt: skip
def focus_filter(t: Tables) -> DataFrame:
    return R.focus_filter(articles_of(t)).select("query_id", "article_id", "score", "pos")


@query("article_expand", "SELECT query_id, count(*) AS n_articles, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY rank), '') AS context FROM {hits} LEFT JOIN {article_text} USING (article_id) GROUP BY query_id")
def article_expand(t: Tables) -> DataFrame:
    return R.article_expand(t.hits.withColumnRenamed("rank", "pos"), t.article_text)


@query("context_block", """WITH n AS (SELECT query_id, content, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM {hits} JOIN {article_text} USING (article_id))
SELECT c_custkey AS query_id, coalesce(string_agg('[' || k || '] ' || content, chr(10) || chr(10) ORDER BY k), '(không có ngữ cảnh)') AS context FROM {customer} LEFT JOIN n ON c_custkey = query_id GROUP BY 1""")  # fmt: skip
def context_block(t: Tables) -> DataFrame:
    return R.context_block(t.hits.join(t.article_text, "article_id").withColumnRenamed("rank", "pos"), t.customer.select(F.col("c_custkey").alias("query_id")))


@query("behaviour_search", r"""WITH d AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS text FROM {part}),
toks AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM d), tc AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
dl AS (SELECT id, sum(tf) AS dl FROM tc GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
ix AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tc, st GROUP BY term, n),
q AS (SELECT DISTINCT p_type AS query_id, lower(p_type) AS term FROM {part}),
sc AS (SELECT query_id, tc.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tc USING (term) JOIN ix USING (term) JOIN dl ON tc.id = dl.id, st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sc),
pen AS (SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS penalties FROM {edges} WHERE rel IN ('CHE_TAI_CHINH', 'CHE_TAI_BO_SUNG') GROUP BY 1)
SELECT query_id, id, score, CAST(rank AS INT) AS rank, penalties FROM r LEFT JOIN pen ON src = 'h' || id WHERE rank < 10""")  # fmt: skip
def behaviour_search(t: Tables) -> DataFrame:
    texts = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    found = R.sparse_topk(t.part.select(F.col("p_type").alias("query_id"), F.col("p_type").alias("text")).distinct(), R.bm25_weights(texts, "id"), "id", 10)
    pen = t.edges.filter(F.col("rel").isin("CHE_TAI_CHINH", "CHE_TAI_BO_SUNG")).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("penalties"))
    return found.withColumn("src", F.concat(F.lit("h"), F.col("id").cast("string"))).join(pen, "src", "left").select("query_id", "id", "score", "rank", "penalties")
