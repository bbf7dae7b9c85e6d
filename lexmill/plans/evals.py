"""Queries of loads, evaluation and model output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import evaluation as E
from lexmill.operators import model_io as M
from lexmill.plans.registry import Tables, query
from lexmill.session import checkpoint_dir
from lexmill.sources import tables as S

# --- loads ----------------------------------------------------------------------------------------------------------

BROKEN = "CASE WHEN event_id % 10 = 3 THEN left(props, length(props) - 1) WHEN event_id % 10 = 4 THEN '' ELSE props END"


@query("extraction_scan", f"SELECT event_id % 7 AS part, count(*) AS n, count(*) FILTER (event_id % 10 = 3) AS bad, sum(CASE WHEN event_id % 10 <> 3 THEN CAST(props->>'k' AS BIGINT) END)::BIGINT AS k FROM {{events}} WHERE event_id % 10 <> 4 GROUP BY 1")
def extraction_scan(t: Tables) -> DataFrame:
    path = f"{checkpoint_dir(t.spark)}/scan-{uuid.uuid4().hex}"
    t.events.select((F.col("event_id") % 7).alias("part"), F.expr(BROKEN)).write.partitionBy("part").text(path)
    rows = t.spark.read.schema("k BIGINT, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.count("_bad").alias("bad"), F.sum("k").alias("k"))


@query("extraction_dedup", "WITH r AS (SELECT event_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'v' || user_id END AS van_ban_id, event_type AS chunk_id FROM {events}), f AS (SELECT *, row_number() OVER (PARTITION BY van_ban_id, chunk_id ORDER BY event_id) AS k FROM r) SELECT event_id, van_ban_id, chunk_id FROM f WHERE k = 1 OR van_ban_id IS NULL")
def extraction_dedup(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("v"), F.col("user_id").cast("string"))).alias("van_ban_id"), F.col("event_type").alias("chunk_id"))
    return S.first_of_key(rows, ["van_ban_id", "chunk_id"], "event_id")


@query("extraction_flatten", """SELECT CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'c' || event_id END AS chunk_id, 'v' || user_id AS van_ban_id, 'e' || event_id AS id, event_type AS type, 'entity' AS kind FROM {events}
UNION ALL SELECT CASE WHEN event_id % 4 = 0 THEN 'own' ELSE 'c' || event_id END, 'v' || user_id, 'e' || event_id, 'CO_KHOAN', 'relation' FROM {events}""")  # fmt: skip
def extraction_flatten(t: Tables) -> DataFrame:
    e = t.events
    lit = lambda c: F.to_json(c)
    entity = F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, F.lit("own")).alias("chunk_id"))
    relation = F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_id"), F.lit("CO_KHOAN").alias("relation_type"), F.lit("x").alias("target_id"), F.when(F.col("event_id") % 4 == 0, F.lit("own")).alias("chunk_id"))
    line = lit(F.struct(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk_id"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("van_ban_id"), F.array(entity).alias("entities"), F.array(relation).alias("relations")))
    parsed = e.select(F.from_json(line, S.EXTRACTION).alias("x")).select("x.*")
    ent = S.entities_of(parsed).select("chunk_id", "van_ban_id", "id", "type", F.lit("entity").alias("kind"))
    return ent.unionByName(S.relations_of(parsed).select("chunk_id", "van_ban_id", F.col("src").alias("id"), F.col("rel").alias("type"), F.lit("relation").alias("kind")))


@query("test_set_head", "SELECT case_id, category FROM (SELECT case_id, category, row_number() OVER (ORDER BY category, case_id) AS k FROM {cases}) x WHERE k <= 20")
def test_set_head(t: Tables) -> DataFrame:
    return S.first_rows(t.cases, ["category", "case_id"], 20).select("case_id", "category")


@query("scalar_props", """SELECT event_id, 'k' || (user_id % 3) AS k, CASE WHEN user_id % 2 = 0 THEN event_type END AS name, CASE WHEN event_id % 4 <> 0 THEN 'v' END AS tags, 1 + CAST(user_id % 2 = 0 AS INT) + CAST(event_id % 4 <> 0 AS INT) AS n FROM {events}""")
def scalar_props(t: Tables) -> DataFrame:
    key = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    tags = F.when(F.col("event_id") % 4 == 0, F.lit('["a", "b"]')).otherwise(F.lit('"v"'))
    line = F.concat(F.lit('{"type": "HanhVi", "k": "k'), (F.col("user_id") % 3).cast("string"), F.lit('", "name": '), F.when(F.col("user_id") % 2 == 0, key(F.col("event_type"))).otherwise("null"), F.lit(', "tags": '), tags, F.lit(', "x": {"y": 1}}'))
    p = t.events.select("event_id", S.scalar_props(F.from_json(line, "MAP<STRING, STRING>")).alias("p"))
    return p.select("event_id", *(F.try_element_at("p", F.lit(k)).alias(k) for k in ("k", "name", "tags")), F.size("p").alias("n"))


@query("upsert_latest", "WITH x AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) SELECT user_id, event_type, event_id FROM x WHERE k = 1")
def upsert_latest(t: Tables) -> DataFrame:
    return S.latest(t.events, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("resume_anti", "SELECT doc_id, lang FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})")
def resume_anti(t: Tables) -> DataFrame:
    return S.not_done(t.documents.select("doc_id", "lang"), t.labels.select("doc_id"), "doc_id")


@query("resume_incomplete", "SELECT c_custkey AS case_id, count(DISTINCT CASE WHEN score IS NOT NULL THEN metric END) AS n FROM {customer} LEFT JOIN {judged} ON case_id = c_custkey GROUP BY 1 HAVING count(DISTINCT CASE WHEN score IS NOT NULL THEN metric END) < 4")
def resume_incomplete(t: Tables) -> DataFrame:
    return S.incomplete(t.customer.select(F.col("c_custkey").alias("case_id")), t.judged, "case_id")


@query("copy_reconcile", "SELECT source, count(*) AS n_source, count(*) FILTER (doc_id % 97 <> 5) AS n_copy, CASE WHEN count(*) = count(*) FILTER (doc_id % 97 <> 5) THEN 'OK' ELSE 'MISMATCH' END AS status FROM {documents} GROUP BY 1")
def copy_reconcile(t: Tables) -> DataFrame:
    return S.reconciled(t.documents, t.documents.filter("doc_id % 97 <> 5"), "source")


@query("registry_join", "SELECT page_id, url, 'V' || (page_id % 10) AS so_hieu FROM {pages} WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, url, NULL FROM {pages} WHERE page_id % 3 = 0")
def registry_join(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Luật "), F.col("page_id").cast("string"), F.lit(".docx"))
    registry = t.pages.filter("page_id % 3 <> 0").select(name.alias("filename"), F.concat(F.lit("V"), (F.col("page_id") % 10).cast("string")).alias("so_hieu"))
    return S.with_registry(t.pages.select("page_id", "url", name.alias("filename")), registry).select("page_id", "url", "so_hieu")


@query("validity_asof", "SELECT o_orderkey FROM {orders} WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND (o_orderkey % 3 = 0 OR o_orderdate + INTERVAL 400 DAY > TIMESTAMP '1998-01-01')")
def validity_asof(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").alias("eff_from"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAY")).alias("eff_to"))
    return S.valid_at(rows, F.to_timestamp(F.lit("1998-01-01"))).select("o_orderkey")


# --- evaluation -----------------------------------------------------------------------------------------------------

FACTS = "fc AS (SELECT doc_id AS case_id, unnest(range(1, doc_id % 4 + 1)) AS fact_id FROM {documents}), vd AS (SELECT doc_id AS case_id, 1 AS fact_id, quality = 1 AS covered FROM {labels} UNION ALL SELECT doc_id, 2, toxic = 0 FROM {labels}), cp AS (SELECT case_id, count(*) AS facts, coalesce(sum(CAST(covered AS INT)), 0)::BIGINT AS covered, coalesce(sum(CAST(covered AS INT)), 0) / count(*) AS rate FROM fc LEFT JOIN vd USING (case_id, fact_id) GROUP BY 1)"


def completeness_of(t: Tables) -> DataFrame:
    facts = t.documents.filter("doc_id % 4 > 0").select(F.col("doc_id").alias("case_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 4)).alias("fact_id"))
    v = t.labels
    verdicts = v.select(F.col("doc_id").alias("case_id"), F.lit(1).alias("fact_id"), (F.col("quality") == 1).alias("covered")).unionByName(v.select(F.col("doc_id").alias("case_id"), F.lit(2).alias("fact_id"), (F.col("toxic") == 0).alias("covered")))
    return E.completeness(facts, verdicts)


@query("completeness", f"WITH {FACTS} SELECT case_id, facts, covered, round(rate, 6) AS rate FROM cp")
def completeness(t: Tables) -> DataFrame:
    return completeness_of(t).withColumn("rate", F.round("rate", 6))


@query("completeness_summary", f"WITH {FACTS} SELECT mode, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, round(avg(rate), 6) AS mean, count(rate) AS n FROM {{cases}} LEFT JOIN cp USING (case_id) GROUP BY GROUPING SETS ((mode, category), (mode))")
def completeness_summary(t: Tables) -> DataFrame:
    return E.by_group(t.cases.join(completeness_of(t), "case_id", "left"), "rate").withColumn("mean", F.round("mean", 6))


ORDER = ["purchase", "signup", "click"]
USAGE = "u AS (SELECT query_id, mode, count(*) AS calls, sum(prompt) AS prompt, sum(completion) AS completion, sum(prompt + completion) AS total FROM {llm_calls} GROUP BY 1, 2), fg AS (SELECT query_id, mode, tag, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion FROM {llm_calls} WHERE tag IN ('purchase', 'signup', 'click') GROUP BY 1, 2, 3), fu AS (SELECT *, prompt + completion AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE tag WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END) AS k FROM fg) z WHERE k = 1)"
SUMMARY = f"{USAGE}, sm AS (SELECT mode, 'mean_total' AS metric, avg(total) AS value, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT mode, 'mean_prompt', avg(prompt), count(*) FROM u GROUP BY 1 UNION ALL SELECT mode, 'mean_completion', avg(completion), count(*) FROM u GROUP BY 1 UNION ALL SELECT mode, 'mean_calls', avg(calls), count(*) FROM u GROUP BY 1 UNION ALL SELECT mode, 'final_total', avg(total), count(*) FROM fu GROUP BY 1 UNION ALL SELECT mode, 'final_prompt', avg(prompt), count(*) FROM fu GROUP BY 1 UNION ALL SELECT mode, 'final_completion', avg(completion), count(*) FROM fu GROUP BY 1)"


def summary_of(t: Tables) -> DataFrame:
    calls = t.llm_calls
    per_query = calls.groupBy("query_id", "mode").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.col("prompt") + F.col("completion")).alias("total"))
    return E.token_summary(per_query, E.final_usage(calls, ORDER))


@query("token_by_tag", "SELECT query_id, CASE WHEN grouping(tag) = 1 THEN 'ALL' ELSE tag END AS tag, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(prompt + completion)::BIGINT AS total FROM {llm_calls} GROUP BY GROUPING SETS ((query_id, tag), (query_id))")
def token_by_tag(t: Tables) -> DataFrame:
    return E.token_usage(t.llm_calls)


@query("final_usage", f"WITH {USAGE} SELECT query_id, mode, tag, prompt, completion, total FROM fu")
def final_usage(t: Tables) -> DataFrame:
    return E.final_usage(t.llm_calls, ORDER)


@query("token_summary", f"WITH {SUMMARY} SELECT mode, metric, round(value, 6) AS value, n FROM sm")
def token_summary(t: Tables) -> DataFrame:
    return summary_of(t).withColumn("value", F.round("value", 6))


@query("mode_pivot", f"WITH {SUMMARY} SELECT metric, round(max(value) FILTER (mode = 'm0'), 6) AS m0, round(max(value) FILTER (mode = 'm1'), 6) AS m1, round(max(value) FILTER (mode = 'm2'), 6) AS m2 FROM sm GROUP BY 1")
def mode_pivot(t: Tables) -> DataFrame:
    return E.mode_pivot(summary_of(t).withColumn("value", F.round("value", 6)), ["m0", "m1", "m2"])


@query("metric_means", "SELECT metric, round(avg(score), 6) AS mean, count(score) AS n FROM {judged} GROUP BY 1")
def metric_means(t: Tables) -> DataFrame:
    return E.metric_means(t.judged).withColumn("mean", F.round("mean", 6))


@query("batch_health", "WITH b AS (SELECT batch, avg(CAST(coalesce(score, 0) > 8 AS INT)) AS share FROM {judged} GROUP BY 1) SELECT b.batch, round(b.share, 6) AS share, b.share < 0.5 AND coalesce(a.share, 1) < 0.5 AS alarm FROM b LEFT JOIN b a ON a.batch = b.batch - 1")
def batch_health(t: Tables) -> DataFrame:
    return E.batch_health(t.judged, F.coalesce("score", F.lit(0.0)) > 8).withColumn("share", F.round("share", 6))


def ranked_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    ranked = t.hits.select(F.col("query_id").alias("case_id"), (F.col("rank") - 1).alias("pos"), F.upper("article_id").alias("item"))
    return ranked, t.gold.withColumnRenamed("dieu_id", "item")


RANKED = "g AS (SELECT DISTINCT case_id, dieu_id AS item FROM {gold}), h AS (SELECT case_id, rank - 1 AS pos FROM {hits} JOIN g ON case_id = query_id AND item = article_id)"


@query("mrr", f"WITH {RANKED} SELECT g.case_id, round(coalesce(max(1.0 / (pos + 1)), 0), 6) AS rr FROM (SELECT DISTINCT case_id FROM g) g LEFT JOIN h USING (case_id) GROUP BY 1")
def mrr(t: Tables) -> DataFrame:
    return E.mrr(*ranked_of(t)).withColumn("rr", F.round("rr", 6))


@query("ndcg5", f"WITH {RANKED}, n AS (SELECT case_id, least(count(*), 5) AS n FROM g GROUP BY 1), d AS (SELECT case_id, sum(1 / log2(pos + 2)) AS dcg FROM h WHERE pos < 5 GROUP BY 1) SELECT case_id, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) r(i) WHERE i <= n), 6) AS ndcg FROM n LEFT JOIN d USING (case_id)")
def ndcg5(t: Tables) -> DataFrame:
    return E.ndcg(*ranked_of(t)).withColumn("ndcg", F.round("ndcg", 6))


@query("context_pr", "WITH g AS (SELECT DISTINCT case_id, dieu_id AS item FROM {gold}), r AS (SELECT query_id AS case_id, article_id AS item FROM {hits} UNION SELECT case_id, dieu_id FROM {gold} WHERE category = 'D0'), b AS (SELECT case_id, count(*) AS n FROM g JOIN r USING (case_id, item) GROUP BY 1), c AS (SELECT case_id, count(*) AS n FROM r GROUP BY 1), w AS (SELECT case_id, count(*) AS n FROM g GROUP BY 1) SELECT w.case_id, round(coalesce(coalesce(b.n, 0) / c.n, 0), 6) AS precision, round(coalesce(b.n, 0) / w.n, 6) AS recall FROM w LEFT JOIN b USING (case_id) LEFT JOIN c USING (case_id)")
def context_pr(t: Tables) -> DataFrame:
    gold = t.gold.withColumnRenamed("dieu_id", "item")
    got = E.context_pr(t.hits.select(F.col("query_id").alias("case_id"), F.col("article_id").alias("item")), gold.filter("category = 'D0'"), gold)
    return got.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("context_chars", "WITH c AS (SELECT conv_id, sum(length(text)) AS n FROM {conversations} GROUP BY 1) SELECT 'm' || (conv_id % 3) AS mode, round(avg(n), 6) AS mean_chars FROM c GROUP BY 1")
def context_chars(t: Tables) -> DataFrame:
    c = t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("contexts")).withColumn("mode", F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")))
    return E.context_chars(c).withColumn("mean_chars", F.round("mean_chars", 6))


@query("check_existence", "SELECT case_id, dieu_id AS item, category FROM {gold} WHERE lower(dieu_id) NOT IN (SELECT lower(article_id) FROM {article_text})")
def check_existence(t: Tables) -> DataFrame:
    return E.missing_articles(t.gold.withColumnRenamed("dieu_id", "item"), t.article_text.withColumnRenamed("article_id", "item"))


@query("check_cardinality", "SELECT case_id, category, count(DISTINCT dieu_id) AS n FROM {gold} GROUP BY 1, 2 HAVING CASE WHEN category = 'D0' THEN count(DISTINCT dieu_id) < 2 ELSE count(DISTINCT dieu_id) <> 1 END")
def check_cardinality(t: Tables) -> DataFrame:
    return E.wrong_cardinality(t.gold.withColumnRenamed("dieu_id", "item"), ["D0"])


@query("near_dups")  # by a ratio that SQL hasn't; held against brute force in tests/test_near_dups.py
def near_dups(t: Tables) -> DataFrame:
    c, key = t.conversations, F.col("conv_id") * 1000 + F.col("turn")
    texts = c.select(key.alias("id"), "text").unionByName(c.filter("conv_id % 3 = 0").select((key + 500).alias("id"), F.concat("text", F.lit(" Zz")).alias("text"))).unionByName(c.filter("conv_id % 7 = 0").select((key + 700).alias("id"), F.concat(F.lit("  "), "text").alias("text")))
    return E.ratio_duplicates(texts, expanded=True).withColumn("ratio", F.round("ratio", 6))


@query("case_source", "WITH g AS (SELECT case_id, dieu_id, row_number() OVER (PARTITION BY case_id ORDER BY dieu_id) AS pos FROM {gold}) SELECT case_id, string_agg(coalesce(content, '[không có văn bản]'), chr(10) || chr(10) ORDER BY pos) AS source FROM g LEFT JOIN {article_text} ON article_id = dieu_id GROUP BY 1")
def case_source(t: Tables) -> DataFrame:
    gold = t.gold.select("case_id", F.upper("dieu_id").alias("item"), F.row_number().over(Window.partitionBy("case_id").orderBy("dieu_id")).alias("pos"))
    return E.case_source(gold, t.article_text.withColumnRenamed("article_id", "item"))


CHECKS = ["b1", "b2", "b3"]
VALID = "v AS (SELECT case_id, category, CASE WHEN case_id % 13 = 0 THEN 'x' END AS error, quality = 1 AS b1, toxic = 0 AS b2, n_chars > 500 AS b3 FROM {cases} WHERE quality IS NOT NULL)"


def validated(t: Tables) -> DataFrame:
    return t.cases.filter("quality IS NOT NULL").select("case_id", "category", F.when(F.col("case_id") % 13 == 0, "x").alias("error"), (F.col("quality") == 1).alias("b1"), (F.col("toxic") == 0).alias("b2"), (F.col("n_chars") > 500).alias("b3"))


@query("validation_rates", f"WITH {VALID} SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, round(avg(b1::INT), 6) AS b1, round(avg(b2::INT), 6) AS b2, round(avg(b3::INT), 6) AS b3, count(*) AS n FROM v WHERE error IS NULL GROUP BY GROUPING SETS ((category), ())")
def validation_rates(t: Tables) -> DataFrame:
    out = E.validation_rates(validated(t), CHECKS)
    return out.select("category", *(F.round(c, 6).alias(c) for c in CHECKS), "n")


@query("validation_fails", f"""WITH {VALID} SELECT case_id, 'b1' AS "check" FROM v WHERE error IS NULL AND NOT b1 UNION ALL SELECT case_id, 'b2' FROM v WHERE error IS NULL AND NOT b2 UNION ALL SELECT case_id, 'b3' FROM v WHERE error IS NULL AND NOT b3 UNION ALL SELECT case_id, 'error' FROM v WHERE error IS NOT NULL""")
def validation_fails(t: Tables) -> DataFrame:
    return E.validation_fails(validated(t), CHECKS)


@query("validation_detail", f"WITH {VALID} SELECT c.case_id, CASE WHEN error IS NULL AND b1 IS NOT NULL THEN b1::VARCHAR ELSE '' END AS b1, CASE WHEN error IS NULL AND b2 IS NOT NULL THEN b2::VARCHAR ELSE '' END AS b2, CASE WHEN error IS NULL AND b3 IS NOT NULL THEN b3::VARCHAR ELSE '' END AS b3 FROM {{cases}} c LEFT JOIN v USING (case_id)")
def validation_detail(t: Tables) -> DataFrame:
    return E.validation_detail(t.cases, validated(t), CHECKS)


@query("judgment_merge", "SELECT case_id, CASE WHEN case_id % 3 = 0 THEN upper(category) ELSE category END AS category, quality FROM {cases}")
def judgment_merge(t: Tables) -> DataFrame:
    new = t.cases.filter("case_id % 3 = 0").select("case_id", F.upper("category").alias("category"))
    return E.judgment_merge(t.cases.select("case_id", "category", "quality"), new, "category")


@query("benchmark_groups", "SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(mode) = 0 THEN 'mode' ELSE 'ALL' END AS dimension, CASE WHEN grouping(category) = 0 THEN category WHEN grouping(mode) = 0 THEN mode ELSE 'ALL' END AS value, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(n_chars), 6) AS n_chars FROM {cases} GROUP BY GROUPING SETS ((category), (mode), ())")
def benchmark_groups(t: Tables) -> DataFrame:
    return E.grouped_means(t.cases, ["category", "mode"], ["quality", "n_chars"]).withColumn("quality", F.round("quality", 6)).withColumn("n_chars", F.round("n_chars", 6))


def labelled(t: Tables) -> DataFrame:
    return t.events.filter("value < 20").groupBy(F.col("user_id").alias("case_id")).agg(F.collect_list("event_type").alias("labels"))


@query("error_counts", "WITH c AS (SELECT event_type AS label, count(DISTINCT user_id) AS n FROM {events} WHERE value < 20 GROUP BY 1) SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INT) AS place FROM c")
def error_counts(t: Tables) -> DataFrame:
    return E.error_counts(labelled(t))


@query("worst_cases", "SELECT user_id AS case_id, CAST(count(*) AS INT) AS n_labels FROM {events} WHERE value < 20 GROUP BY 1 ORDER BY n_labels DESC, case_id LIMIT 10")
def worst_cases(t: Tables) -> DataFrame:
    return E.worst_cases(labelled(t), 10)


@query("retention_audit", """WITH r AS (SELECT event_type AS "group", value > 10 AS reached, event_id % 2 = 0 AS b, event_id % 3 <> 0 AS a FROM {events})
SELECT "group", count(*) AS n, count(*) FILTER (reached) AS reached, count(*) FILTER (reached AND b) AS before, count(*) FILTER (reached AND a) AS after, count(*) FILTER (reached AND NOT b AND a) AS gained, count(*) FILTER (reached AND b AND NOT a) AS lost,
round(count(*) FILTER (reached AND b) / count(*) FILTER (reached), 6) AS rate_before, round(count(*) FILTER (reached AND a) / count(*) FILTER (reached), 6) AS rate_after FROM r GROUP BY 1""")  # fmt: skip
def retention_audit(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("group"), (F.col("value") > 10).alias("reached"), (F.col("event_id") % 2 == 0).alias("kept_before"), (F.col("event_id") % 3 != 0).alias("kept_after"))
    return E.retention_audit(rows).withColumn("rate_before", F.round("rate_before", 6)).withColumn("rate_after", F.round("rate_after", 6))


# --- model output ---------------------------------------------------------------------------------------------------

RAW = "CASE event_id % 5 WHEN 0 THEN '<thinking>{{a}}</thinking> ' || props WHEN 1 THEN 'x ```json' || chr(10) || props || chr(10) || '``` y' WHEN 2 THEN '{{\"a\": [1, {{\"b\": ' || user_id WHEN 3 THEN 'no answer' ELSE props END"


@query("parse_outputs", "SELECT event_id AS id, CASE event_id % 5 WHEN 2 THEN '{\"a\": [1, {\"b\": ' || user_id || '}]}' WHEN 3 THEN NULL ELSE props END AS json, CASE event_id % 5 WHEN 2 THEN 'repaired' WHEN 3 THEN 'failed' ELSE 'parsed' END AS status FROM {events}")
def parse_outputs(t: Tables) -> DataFrame:
    return M.parsed_outputs(t.events.select(F.col("event_id").alias("id"), F.expr(RAW.replace("{{", "{").replace("}}", "}")).alias("text")))


@query("verdicts", "SELECT event_id, event_type IN ('click', 'view') AS relevant FROM {events}")
def verdicts(t: Tables) -> DataFrame:
    said = F.when(F.col("event_type") == "click", " YES.").when(F.col("event_type") == "view", "I say yes").when(F.col("event_type") == "error", F.lit(None)).otherwise("no")
    return M.verdicts(t.events.select("event_id", said.alias("text"))).select("event_id", "relevant")


@query("unknown_ids", "SELECT user_id AS chunk_id, count(*) AS n, count(*) FILTER ('e' || (event_id % 6) NOT IN ('e0', 'e1', 'e2')) AS unknown FROM {events} GROUP BY 1")
def unknown_ids(t: Tables) -> DataFrame:
    rel = t.events.select(F.col("user_id").alias("chunk_id"), F.concat(F.lit("e"), (F.col("event_id") % 6).cast("string")).alias("src"), F.lit("e0").alias("dst"))
    ids = t.events.select(F.col("user_id").alias("chunk_id")).distinct().withColumn("id", F.explode(F.array(*map(F.lit, ("e0", "e1", "e2")))))
    return M.unknown_ids(rel, ids)
