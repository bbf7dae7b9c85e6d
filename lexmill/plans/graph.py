"""Queries of graph building, graph patterns and the completeness critic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import article_label
from lexmill.operators import chunking as C
from lexmill.operators import critic as K
from lexmill.operators import graph_build as G
from lexmill.operators import graph_query as Q
from lexmill.plans.registry import Tables, query
from lexmill.plans.texts import LAW_CTE, law_chunks
from lexmill.session import cut

# --- building -------------------------------------------------------------------------------------------------------

ENTITIES = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NghiemVu' WHEN 1 THEN 'Dieu' WHEN 2 THEN 'HanhVi' WHEN 3 THEN 'Foo' WHEN 4 THEN 'NghiaVu2' ELSE 'CheTai' END AS type, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'e' || (user_id % 50) END AS id FROM {events}"
RELS = "SELECT event_id, 'e' || (user_id % 50) AS src, CASE event_id % 6 WHEN 0 THEN 'CT' WHEN 1 THEN 'CO_KHOAN' WHEN 2 THEN 'LIEN_QUAN' WHEN 3 THEN 'XOA' WHEN 4 THEN 'KHAI_NIEM' ELSE 'THAM_CHIEU' END AS rel, 'e' || (event_id % 60) AS dst FROM {events}"
PROPS = "SELECT 'HanhVi' AS label, 'u' || user_id AS id, event_type AS key, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS value, event_id AS seq FROM {events}"
LABEL_CASE = "CASE type WHEN 'NghiemVu' THEN 'NghiaVu' WHEN 'NghiaVu2' THEN 'NghiaVu' WHEN 'Foo' THEN NULL ELSE type END"
REL_CASE = "CASE rel WHEN 'CT' THEN 'CHE_TAI_CHINH' WHEN 'LIEN_QUAN' THEN 'THAM_CHIEU' WHEN 'KHAI_NIEM' THEN 'DINH_NGHIA' ELSE rel END"


def from_events(t: Tables, sql: str) -> DataFrame:
    return t.spark.sql(sql, events=t.events)


def entities(t: Tables) -> DataFrame:
    return G.normal_labels(from_events(t, ENTITIES))


def relations(t: Tables) -> DataFrame:
    return G.normal_relations(from_events(t, RELS))


@query("norm_labels", f"WITH e AS ({ENTITIES}) SELECT event_id, id, {LABEL_CASE} AS label FROM e WHERE type <> 'Foo' AND id <> ''")
def norm_labels(t: Tables) -> DataFrame:
    return entities(t).select("event_id", "id", "label")


@query("norm_relations", f"WITH r AS ({RELS}) SELECT event_id, src, {REL_CASE} AS rel, dst FROM r WHERE rel <> 'XOA'")
def norm_relations(t: Tables) -> DataFrame:
    return relations(t).select("event_id", "src", "rel", "dst")


@query("prefix_ids", "SELECT id, CASE WHEN starts_with(id, van_ban_id) THEN id ELSE van_ban_id || '_' || id END AS full_id FROM {nodes}")
def prefix_ids(t: Tables) -> DataFrame:
    return t.nodes.select("id", G.prefixed(F.col("id"), F.col("van_ban_id")).alias("full_id"))


def merge_sql(pick: str) -> str:
    return f"WITH p AS ({PROPS}) SELECT label, id, key, {pick}(value, seq) AS value FROM p WHERE value IS NOT NULL GROUP BY 1, 2, 3"


@query("merge_first_wins", merge_sql("arg_min"))
def merge_first_wins(t: Tables) -> DataFrame:
    return G.merged(from_events(t, PROPS), last=False)


@query("merge_last_wins", merge_sql("arg_max"))
def merge_last_wins(t: Tables) -> DataFrame:
    return G.merged(from_events(t, PROPS), last=True)


@query("edge_dedup", f"WITH r AS ({RELS}) SELECT src, rel, dst, min(event_id) AS event_id FROM r GROUP BY 1, 2, 3")
def edge_dedup(t: Tables) -> DataFrame:
    return G.distinct_edges(from_events(t, RELS), "event_id")


UPSERT = f"WITH r AS ({RELS}), e AS ({ENTITIES}), n AS (SELECT DISTINCT id FROM e WHERE id <> '' AND type <> 'Foo'), old AS (SELECT src, rel, dst FROM r WHERE event_id % 4 = 1 AND rel = 'CO_KHOAN') "


@query("edge_upsert", UPSERT + f"SELECT * FROM old UNION SELECT src, {REL_CASE}, dst FROM r WHERE rel <> 'XOA' AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def edge_upsert(t: Tables) -> DataFrame:
    old = from_events(t, RELS).filter("event_id % 4 = 1 AND rel = 'CO_KHOAN'")
    return G.upserted_edges(old, relations(t), entities(t))


@query("document_nodes", "SELECT label, id, ten FROM {nodes} WHERE label <> 'VanBan' UNION ALL SELECT 'VanBan', 'v' || n_nationkey, 'Luật ' || n_name FROM {nation}")
def document_nodes(t: Tables) -> DataFrame:
    return G.document_nodes(t.nodes, t.nation.select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("Luật "), "n_name").alias("ten")))


@query("placeholders", "SELECT DISTINCT 'Dieu' AS label, dst AS id, true AS placeholder FROM {edges} WHERE rel = 'THAM_CHIEU' AND dst NOT IN (SELECT id FROM {nodes} WHERE label <> 'Dieu' OR chunk_id LIKE '%3_PARENT')")
def placeholders(t: Tables) -> DataFrame:
    return G.placeholders(t.edges, t.nodes.filter("label <> 'Dieu' OR chunk_id LIKE '%3_PARENT'"))


@query("graph_stats", "SELECT 'node' AS kind, label AS name, count(*) AS n FROM {nodes} GROUP BY 2 UNION ALL SELECT 'edge', rel, count(*) FROM {edges} GROUP BY 2 UNION ALL SELECT 'node', '*', count(*) FROM {nodes} UNION ALL SELECT 'edge', '*', count(*) FROM {edges}")
def graph_stats(t: Tables) -> DataFrame:
    return G.stats(t.nodes, t.edges)


# The patterns of references once more, as the SQL engine of the comparison writes them
KHOAN = r"(?i)khoản\s+([^\.;]{1,40}?)\s*Điều\s+(\d+[a-zA-Z]*|này)"
OTHER = r"(?i)^\s*(?:của|thuộc)?\s*(?:Luật|Nghị định|Bộ luật|Pháp lệnh|Thông tư|Quyết định)"
XREF = LAW_CTE + rf""", loc AS MATERIALIZED (SELECT doc_id, article AS own, content AS body,
  doc_id || '_D' || article || CASE WHEN chunk_type <> 'dieu_preamble' AND clause IS NOT NULL THEN '_K' || clause ELSE '' END || CASE WHEN chunk_type = 'diem' THEN '_P' || point ELSE '' END AS src FROM chunks),
m1 AS MATERIALIZED (SELECT doc_id, src, own, unnest(regexp_extract_all(body, '{KHOAN}([\s\S]{{0,25}})', 0)) AS m FROM loc),
m2 AS MATERIALIZED (SELECT *, regexp_extract(m, '{KHOAN}', 1) AS ks, regexp_extract(m, '{KHOAN}', 2) AS a, regexp_replace(m, '{KHOAN}', '') AS tail FROM m1),
m3 AS MATERIALIZED (SELECT doc_id, src, CASE WHEN a = 'này' THEN own ELSE a END AS a, unnest(regexp_extract_all(ks, '\d+')) AS k FROM m2 WHERE NOT regexp_matches(tail, '{OTHER}')),
xclause AS MATERIALIZED (SELECT src, doc_id || '_D' || a || '_K' || k AS dst, 'khoan_dieu_regex' AS note FROM m3 WHERE src <> doc_id || '_D' || a || '_K' || k),
a1 AS MATERIALIZED (SELECT doc_id, src, own, unnest(regexp_extract_all(regexp_replace(body, '{KHOAN}', chr(1), 'g'), '(?i)Điều\s+(\d+[a-zA-Z]*|này)([\s\S]{{0,25}})', 0)) AS m FROM loc),
a2 AS MATERIALIZED (SELECT *, regexp_extract(m, '(?i)^Điều\s+(\d+[a-zA-Z]*|này)', 1) AS a, regexp_replace(m, '(?i)^Điều\s+(\d+[a-zA-Z]*|này)', '') AS tail FROM a1),
xarticle AS MATERIALIZED (SELECT src, doc_id || '_D' || a AS dst, 'dieu_only_regex' AS note FROM a2 WHERE a <> 'này' AND a <> own AND NOT regexp_matches(tail, '{OTHER}')),
reg AS MATERIALIZED (SELECT DISTINCT (s_suppkey % 9 + 1) || '/2020/QH14' AS number, 'luat_' || (s_suppkey % 9 + 1) AS document FROM {{supplier}}),
d1 AS MATERIALIZED (SELECT src, document, number, body, strpos(body, number) AS p FROM loc JOIN reg ON contains(body, number) AND doc_id <> document),
d2 AS MATERIALIZED (SELECT src, document, number, regexp_extract(substr(body, greatest(1, p - 60), least(p - 1, 60) + length(number) + 60), '(?i)Điều\s+(\d+[a-zA-Z]*|này)', 1) AS a FROM d1),
xdocument AS MATERIALIZED (SELECT src, document || '_D' || a AS dst, 'so_hieu:' || number AS note FROM d2 WHERE a <> '' AND a <> 'này')
"""  # fmt: skip


def registry(t: Tables) -> DataFrame:
    n = (F.col("s_suppkey") % 9 + 1).cast("string")
    return t.supplier.select(F.concat(n, F.lit("/2020/QH14")).alias("number"), F.concat(F.lit("luat_"), n).alias("document")).distinct()


@query("xref_clause", XREF + "SELECT * FROM xclause")
def xref_clause(t: Tables) -> DataFrame:
    return G.clause_references(law_chunks(t, True))


@query("xref_article", XREF + "SELECT * FROM xarticle")
def xref_article(t: Tables) -> DataFrame:
    return G.article_references(law_chunks(t, True))


@query("xref_document", XREF + "SELECT * FROM xdocument")
def xref_document(t: Tables) -> DataFrame:
    return G.document_references(law_chunks(t, True), registry(t))


@query("xref_apply", XREF + """, ids AS MATERIALIZED (SELECT src AS id FROM loc UNION SELECT doc_id || '_D' || own FROM loc),
u AS (SELECT *, 0 AS pass FROM xclause UNION ALL SELECT *, 1 FROM xarticle UNION ALL SELECT *, 2 FROM xdocument),
b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pass, note) AS k FROM u)
SELECT src, 'THAM_CHIEU' AS rel, dst, true AS auto_linked, note AS method FROM b WHERE k = 1 AND src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)""")  # fmt: skip
def xref_apply(t: Tables) -> DataFrame:
    return G.applied_references(law_chunks(t, True), registry(t))


STRUCTURE_PENALTY = "SELECT src, 'CHE_TAI_BO_SUNG' AS rel, 'c' || (length(src) % 7) AS dst FROM {edges} WHERE rel = 'CO_KHOAN'"


@query("propagate", f"WITH e AS (SELECT * FROM {{edges}} UNION ALL {STRUCTURE_PENALTY} UNION ALL SELECT src, 'QUY_DINH_HANH_VI', 'h' || (length(dst) * 3) FROM {{edges}} WHERE rel = 'CO_KHOAN'), n AS (SELECT DISTINCT b.dst AS src, 'CHE_TAI_BO_SUNG' AS rel, p.dst FROM e b JOIN e p ON b.src = p.src WHERE b.rel = 'QUY_DINH_HANH_VI' AND p.rel = 'CHE_TAI_BO_SUNG') SELECT * FROM n WHERE (src, rel, dst) NOT IN (SELECT (src, rel, dst) FROM e)")
def propagate(t: Tables) -> DataFrame:
    e = t.edges
    part = e.filter("rel = 'CO_KHOAN'")
    penalty = part.select("src", F.lit("CHE_TAI_BO_SUNG").alias("rel"), F.concat(F.lit("c"), (F.length("src") % 7).cast("string")).alias("dst"))
    regulated = part.select("src", F.lit("QUY_DINH_HANH_VI").alias("rel"), F.concat(F.lit("h"), (F.length("dst") * 3).cast("string")).alias("dst"))
    return G.propagated(e.unionByName(penalty).unionByName(regulated))


@query("orphans", "SELECT label, id, id NOT IN (SELECT src FROM {edges} UNION SELECT dst FROM {edges}) AS orphan FROM {nodes}")
def orphans(t: Tables) -> DataFrame:
    return G.orphans(t.nodes, t.edges)


PEN = """WITH pen AS (SELECT id, 'h' || (CAST(substr(id, 2) AS INT) * 3) AS chunk_id, ten AS mo_ta FROM {nodes} WHERE label = 'CheTai'), beh AS (SELECT id, 'h' || (CAST(substr(id, 2) AS INT) / 2 * 2)::INT AS chunk_id FROM {nodes} WHERE label = 'HanhVi'),
ed AS (SELECT * FROM {edges} WHERE NOT (rel IN ('CHE_TAI_CHINH', 'CHE_TAI_BO_SUNG') AND coalesce(TRY_CAST(substr(dst, 2) AS INT), 0) % 3 = 1)),
lost AS (SELECT *, CASE WHEN mo_ta LIKE 'Phạt tiền%' THEN 'CHE_TAI_CHINH' WHEN mo_ta LIKE 'Tịch thu%' OR mo_ta LIKE 'Buộc %' THEN 'CHE_TAI_BO_SUNG' END AS kind FROM pen WHERE id NOT IN (SELECT dst FROM ed WHERE rel IN ('CHE_TAI_CHINH', 'CHE_TAI_BO_SUNG'))),
fix AS (SELECT DISTINCT beh.id AS src, kind AS rel, lost.id AS dst FROM lost JOIN beh USING (chunk_id) WHERE kind IS NOT NULL)
""".replace("(CAST(substr(id, 2) AS INT) / 2 * 2)::INT", "(CAST(substr(id, 2) AS INT) - CAST(substr(id, 2) AS INT) % 2)")  # fmt: skip


def penalties(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.substring("id", 2, 20).cast("int")
    pen = t.nodes.filter("label = 'CheTai'").select("id", F.concat(F.lit("h"), (n * 3).cast("string")).alias("chunk_id"), F.col("ten").alias("mo_ta"))
    beh = t.nodes.filter("label = 'HanhVi'").select("id", F.concat(F.lit("h"), (n - n % 2).cast("string")).alias("chunk_id"))
    return pen, beh, t.edges.filter(~(F.col("rel").isin(*G.PENALTIES) & (F.expr("coalesce(try_cast(substring(dst, 2, 20) AS INT), 0) % 3 = 1"))))


@query("classify_penalty", LAW_CTE + "SELECT chunk_id, CASE WHEN body LIKE 'Phạt tiền%' THEN 'CHE_TAI_CHINH' WHEN body LIKE 'Tịch thu%' OR body LIKE 'Buộc %' THEN 'CHE_TAI_BO_SUNG' END AS kind FROM (SELECT chunk_id, regexp_replace(content, '^(Điều[^\\n]*\\n)?[0-9]+\\. ', '') AS body FROM chunks WHERE chunk_type = 'khoan') x")
def classify_penalty(t: Tables) -> DataFrame:
    body = F.regexp_replace("content", r"^(Điều[^\n]*\n)?[0-9]+\. ", "")
    return law_chunks(t).filter("chunk_type = 'khoan'").select("chunk_id", G.penalty_kind(body).alias("kind"))


@query("repair_links", PEN + "SELECT src, rel, dst, 'r1' AS repaired_by FROM fix")
def repair_links(t: Tables) -> DataFrame:
    return G.repairs(*penalties(t), "r1")


METRICS = """SELECT 'penalties' AS metric, count(*) AS value FROM pen UNION ALL SELECT 'unlinked', count(*) FROM pen WHERE id NOT IN (SELECT dst FROM {e} WHERE rel LIKE 'CHE_TAI_%')
UNION ALL SELECT 'che_tai_chinh', count(*) FROM {e} WHERE rel = 'CHE_TAI_CHINH' UNION ALL SELECT 'che_tai_bo_sung', count(*) FROM {e} WHERE rel = 'CHE_TAI_BO_SUNG'
UNION ALL SELECT 'with_both', count(*) FROM (SELECT src FROM {e} WHERE rel LIKE 'CHE_TAI_%' GROUP BY src HAVING count(DISTINCT rel) = 2) y"""  # fmt: skip


@query("repair_metrics", PEN + f", aft AS (SELECT * FROM ed UNION ALL SELECT * FROM fix), mb AS ({METRICS.replace('{e}', 'ed')}), ma AS ({METRICS.replace('{e}', 'aft')}) SELECT metric, mb.value AS before, ma.value AS after, ma.value - mb.value AS delta FROM mb JOIN ma USING (metric)")
def repair_metrics(t: Tables) -> DataFrame:
    pen, beh, e = penalties(t)
    after = e.unionByName(G.repairs(pen, beh, e, "r1").drop("repaired_by"))
    return G.compared(G.penalty_metrics(pen, e), G.penalty_metrics(pen, after))


@query("repair_outcomes", PEN + "SELECT CASE WHEN kind IS NULL THEN 'no penalty' WHEN chunk_id NOT IN (SELECT chunk_id FROM beh) THEN 'no behaviour' ELSE 'linked' END AS outcome, count(*) AS n FROM lost GROUP BY 1")
def repair_outcomes(t: Tables) -> DataFrame:
    return G.repair_outcomes(*penalties(t))


@query("repair_undo", PEN + "SELECT src, rel, dst, CAST(NULL AS VARCHAR) AS repaired_by FROM ed UNION ALL SELECT src, rel, dst, 'r2' FROM fix WHERE length(src) % 2 = 0")
def repair_undo(t: Tables) -> DataFrame:
    fix = G.repairs(*penalties(t), "r1").withColumn("repaired_by", F.when(F.length("src") % 2 == 0, "r2").otherwise("r1"))
    return G.undone(penalties(t)[2].withColumn("repaired_by", F.lit(None).cast("string")).unionByName(fix), "r1")


# --- patterns -------------------------------------------------------------------------------------------------------

LIST = "(SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS v FROM {edges} WHERE rel = '@' GROUP BY 1)"


@query("behaviour_profile", f"""SELECT n.id, n.ten, m.v AS main, a.v AS additional, s.v AS sources FROM {{nodes}} n LEFT JOIN {LIST.replace('@', 'CHE_TAI_CHINH')} m ON m.src = n.id LEFT JOIN {LIST.replace('@', 'CHE_TAI_BO_SUNG')} a ON a.src = n.id
LEFT JOIN (SELECT dst, string_agg(DISTINCT src, ',' ORDER BY src) AS v FROM {{edges}} WHERE rel = 'QUY_DINH_HANH_VI' GROUP BY 1) s ON s.dst = n.id WHERE label = 'HanhVi'""")  # fmt: skip
def behaviour_profile(t: Tables) -> DataFrame:
    return Q.behaviour_profile(t.nodes, t.edges)


# a clause's points and an article's own behaviours, which the orders don't have
MORE = "SELECT src || '_K1', 'CO_DIEM', src || '_K1_Pa' FROM {edges} WHERE rel = 'THAM_CHIEU' UNION ALL SELECT dst, 'QUY_DINH_HANH_VI', 'h' || length(src) FROM {edges} WHERE rel = 'CO_DIEU'"
MORE_CTE = f"WITH e2 AS (SELECT * FROM {{edges}} UNION ALL {MORE}) "


def more_edges(t: Tables) -> DataFrame:
    e = t.edges
    points = e.filter("rel = 'THAM_CHIEU'").selectExpr("src || '_K1' AS src", "'CO_DIEM' AS rel", "src || '_K1_Pa' AS dst")
    return e.unionByName(points).unionByName(e.filter("rel = 'CO_DIEU'").selectExpr("dst AS src", "'QUY_DINH_HANH_VI' AS rel", "'h' || length(src) AS dst"))


def agg(select: str) -> str:
    return f"(SELECT src, string_agg(DISTINCT v, ',' ORDER BY v) AS v FROM ({select}) z GROUP BY 1)"


@query("article_context", MORE_CTE + f""", k AS (SELECT src, dst FROM e2 WHERE rel = 'CO_KHOAN'), hv AS (SELECT src, dst FROM e2 WHERE rel = 'QUY_DINH_HANH_VI'), pn AS (SELECT src, dst FROM e2 WHERE rel IN ('CHE_TAI_CHINH', 'CHE_TAI_BO_SUNG'))
SELECT n.id, n.ten, a.v AS clauses, b.v AS points, c.v AS refers_to, d.v AS behaviours, p.v AS penalties FROM {{nodes}} n
LEFT JOIN {agg("SELECT src, dst AS v FROM k")} a ON a.src = n.id LEFT JOIN {agg("SELECT k.src, e.dst AS v FROM k JOIN e2 e ON e.src = k.dst AND e.rel = 'CO_DIEM'")} b ON b.src = n.id
LEFT JOIN {agg("SELECT src, dst AS v FROM e2 WHERE rel = 'THAM_CHIEU'")} c ON c.src = n.id LEFT JOIN {agg("SELECT src, dst AS v FROM hv UNION ALL SELECT k.src, hv.dst FROM k JOIN hv ON hv.src = k.dst")} d ON d.src = n.id
LEFT JOIN {agg("SELECT hv.src, pn.dst AS v FROM hv JOIN pn ON pn.src = hv.dst")} p ON p.src = n.id WHERE label = 'Dieu'""")  # fmt: skip
def article_context(t: Tables) -> DataFrame:
    return Q.article_context(t.nodes, more_edges(t))


@query("article_detail", """WITH pn AS (SELECT src, string_agg(DISTINCT rel || ':' || dst, '+' ORDER BY rel || ':' || dst) AS v FROM {edges} WHERE rel LIKE 'CHE_TAI_%' GROUP BY 1),
r AS (SELECT k.src, k.dst AS clause, concat_ws('>', k.dst, h.dst, pn.v) AS t FROM {edges} k LEFT JOIN (SELECT * FROM {edges} WHERE rel = 'QUY_DINH_HANH_VI') h ON h.src = k.dst LEFT JOIN pn ON pn.src = h.dst WHERE k.rel = 'CO_KHOAN'),
g AS (SELECT src, count(DISTINCT clause) AS n_clauses, string_agg(DISTINCT t, ';' ORDER BY t) AS detail FROM r GROUP BY 1)
SELECT id, van_ban_id, ten, coalesce(n_clauses, 0) AS n_clauses, detail FROM {nodes} LEFT JOIN g ON src = id WHERE label = 'Dieu'""")  # fmt: skip
def article_detail(t: Tables) -> DataFrame:
    return Q.article_detail(t.nodes, t.edges)


REF_RELS = ("THAM_CHIEU", "CO_KHOAN", "QUY_DINH_HANH_VI", "CHE_TAI_CHINH")
# articles and clauses that a query retrieved
GOT = "WITH got AS (SELECT DISTINCT query_id, chunk_id AS node FROM {hits} UNION SELECT query_id, article_id FROM {hits})"


def got(t: Tables) -> DataFrame:
    return t.hits.select("query_id", "chunk_id").unionByName(t.hits.select("query_id", F.col("article_id").alias("chunk_id")))


@query("chunk_neighbours", GOT + " SELECT DISTINCT g.query_id, g.node, rel, dst, h.node IS NOT NULL AS already FROM got g JOIN {edges} ON src = g.node LEFT JOIN got h ON h.query_id = g.query_id AND h.node = dst")
def chunk_neighbours(t: Tables) -> DataFrame:
    return Q.chunk_neighbours(got(t), t.edges)


@query("missing_chunks", GOT + " SELECT DISTINCT g.query_id, dst, rel FROM got g JOIN {edges} ON src = g.node WHERE rel IN ('THAM_CHIEU', 'CO_KHOAN', 'QUY_DINH_HANH_VI', 'CHE_TAI_CHINH') AND (g.query_id, dst) NOT IN (SELECT (query_id, node) FROM got)")
def missing_chunks(t: Tables) -> DataFrame:
    return Q.missing_chunks(got(t), t.edges, REF_RELS)


@query("neighbour_text", GOT + ", x AS (SELECT DISTINCT g.query_id, g.node || ' -[' || rel || ']-> ' || dst || CASE WHEN h.node IS NOT NULL THEN ' (đã có)' ELSE '' END AS t FROM got g JOIN {edges} ON src = g.node LEFT JOIN got h ON h.query_id = g.query_id AND h.node = dst) SELECT query_id, string_agg(t, chr(10) ORDER BY t) AS text FROM x GROUP BY 1")
def neighbour_text(t: Tables) -> DataFrame:
    return Q.neighbour_text(Q.chunk_neighbours(got(t), t.edges))


@query("document_toc", "SELECT src AS document, CAST(row_number() OVER (PARTITION BY src ORDER BY CAST(split_part(dst, '_D', 2) AS BIGINT), dst) AS INT) AS pos, dst AS id, ten FROM {edges} JOIN {nodes} ON id = dst WHERE rel = 'CO_DIEU'")
def document_toc(t: Tables) -> DataFrame:
    return Q.document_toc(t.nodes, t.edges)


@query("document_penalties", MORE_CTE + """, a AS (SELECT src AS document, dst AS node FROM e2 WHERE rel = 'CO_DIEU'), s AS (SELECT DISTINCT src, dst, rel FROM e2 WHERE rel IN ('CO_KHOAN', 'QUY_DINH_HANH_VI')),
b AS (SELECT document, s.dst, rel FROM a JOIN s ON s.src = node), c AS (SELECT document, s.dst, s.rel FROM b JOIN s ON s.src = b.dst),
h AS (SELECT document, dst AS behaviour FROM b WHERE rel = 'QUY_DINH_HANH_VI' UNION SELECT document, dst FROM c WHERE rel = 'QUY_DINH_HANH_VI')
SELECT document, behaviour, string_agg(DISTINCT rel || ':' || dst, ',' ORDER BY rel || ':' || dst) AS penalties FROM h JOIN {edges} e ON e.src = behaviour AND e.rel LIKE 'CHE_TAI_%' GROUP BY 1, 2""")  # fmt: skip
def document_penalties(t: Tables) -> DataFrame:
    return Q.document_penalties(more_edges(t))


@query("part_count", """WITH RECURSIVE e2 AS (SELECT * FROM {edges} UNION ALL """ + MORE + """), s AS (SELECT DISTINCT src, dst FROM e2 WHERE rel IN ('CO_KHOAN', 'CO_DIEM')),
w(id, node, depth) AS (SELECT id, id, 0 FROM {nodes} WHERE label = 'Dieu' UNION SELECT w.id, s.dst, depth + 1 FROM w JOIN s ON s.src = node WHERE depth < 4)
SELECT id AS article_id, count(DISTINCT CASE WHEN depth > 0 THEN node END) AS parts FROM w GROUP BY 1""")  # fmt: skip
def part_count(t: Tables) -> DataFrame:
    return Q.part_count(t.nodes, more_edges(t))


# --- critic ---------------------------------------------------------------------------------------------------------

REFS = """, rf AS (SELECT DISTINCT src AS a, dst AS b FROM {edges} WHERE rel = 'THAM_CHIEU' AND src <> dst),
ms AS (SELECT query_id, b AS article_id, 0 AS d, a AS related FROM {focus} JOIN rf ON a = article_id UNION ALL SELECT query_id, a, 1, b FROM {focus} JOIN rf ON b = article_id),
refs AS (SELECT query_id, article_id, d, related FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY d, related) AS k FROM ms WHERE (query_id, article_id) NOT IN (SELECT (query_id, article_id) FROM {hits})) z WHERE k = 1)
"""
COMPOUND = """, st AS (SELECT DISTINCT src, dst FROM {edges} WHERE rel = 'CO_KHOAN'),
below AS (SELECT DISTINCT article_id, article_id AS node FROM {focus} UNION SELECT article_id, dst FROM {focus} JOIN st ON src = article_id),
mn AS (SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS v FROM {edges} WHERE rel = 'CHE_TAI_CHINH' GROUP BY 1), ad AS (SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS v FROM {edges} WHERE rel = 'CHE_TAI_BO_SUNG' GROUP BY 1),
cp AS (SELECT DISTINCT article_id, h.dst AS behaviour, mn.v AS main, ad.v AS additional FROM below JOIN {edges} h ON h.src = node AND h.rel = 'QUY_DINH_HANH_VI' JOIN mn ON mn.src = h.dst JOIN ad ON ad.src = h.dst)
"""
STRUCT = """, tot AS (SELECT article_id, max(parts) AS parts FROM (SELECT src AS article_id, count(DISTINCT dst) AS parts FROM {edges} WHERE rel = 'CO_KHOAN' GROUP BY 1 UNION ALL SELECT article_id, count(*) FROM {index_chunks} GROUP BY 1) y GROUP BY 1),
sg AS (SELECT f.query_id, f.article_id, parts, count(DISTINCT chunk_id) AS retrieved FROM {focus} f JOIN tot ON tot.article_id = f.article_id LEFT JOIN {hits} h ON h.query_id = f.query_id AND h.article_id = f.article_id GROUP BY 1, 2, 3 HAVING parts > 1 AND count(DISTINCT chunk_id) < parts)
"""
GAPS = "WITH base AS (SELECT 1)" + REFS + COMPOUND + STRUCT + """, gaps AS (SELECT DISTINCT query_id, 'reference' AS gap_type, article_id FROM refs UNION ALL SELECT DISTINCT query_id, 'compound', article_id FROM {focus} JOIN cp USING (article_id) UNION ALL SELECT DISTINCT query_id, 'structural', article_id FROM sg),
has AS (SELECT article_id FROM {article_text} WHERE content <> ''), jd AS (SELECT query_id, unit_id AS article_id, bool_or(relevant) AS relevant FROM {judgments} GROUP BY 1, 2),
ch AS (SELECT query_id, article_id, bool_or(coalesce(relevant, true)) AS passes FROM {hits} LEFT JOIN (SELECT query_id AS q, unit_id || '_K2' AS c, relevant FROM {judgments}) j ON q = query_id AND c = chunk_id GROUP BY 1, 2),
gt AS (SELECT g.*, g.article_id IN (SELECT article_id FROM has) AND coalesce(relevant, true) AS by_text FROM gaps g LEFT JOIN jd USING (query_id, article_id)),
ok AS (SELECT gt.query_id, gt.article_id, gap_type, CASE WHEN gap_type = 'reference' THEN by_text ELSE coalesce(passes, by_text) END AS accepted FROM gt LEFT JOIN ch USING (query_id, article_id)),
r1 AS (SELECT query_id, article_id, gap_type, accepted FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY accepted DESC, CASE gap_type WHEN 'reference' THEN 0 WHEN 'compound' THEN 1 ELSE 2 END) AS k FROM ok) z WHERE k = 1)
"""


def focus_articles(t: Tables) -> DataFrame:
    return t.once("focus_articles", lambda: t.kept("focus").select("article_id").distinct())


def totals(t: Tables) -> DataFrame:
    """Parts of the focus's articles; no others are looked up."""
    articles = t.nodes.join(focus_articles(t).withColumnRenamed("article_id", "id"), "id", "left_semi")
    return K.total_parts(Q.part_count(articles, t.kept("edges")), C.article_parts(t.index_chunks.join(focus_articles(t), "article_id", "left_semi")))


def lost_references(t: Tables) -> DataFrame:
    return t.once("lost_references", lambda: K.missing_references(t.kept("focus"), t.kept("hits"), t.kept("edges")))


def twofold_penalties(t: Tables) -> DataFrame:
    return t.once("twofold_penalties", lambda: t.kept("focus").join(K.compound_penalties(focus_articles(t), t.kept("edges")), "article_id"))


def lost_parts(t: Tables) -> DataFrame:
    return t.once("lost_parts", lambda: K.structural_gaps(t.kept("hits"), t.kept("focus"), totals(t)))


def all_gaps(t: Tables) -> DataFrame:
    return t.once("gaps", lambda: K.gaps(lost_references(t), twofold_penalties(t), lost_parts(t)))


def chunk_judgments(t: Tables) -> DataFrame:
    """Verdicts on articles, and on every second chunk of them."""
    j = t.kept("judgments")
    return j.unionByName(j.withColumn("unit_id", F.concat("unit_id", F.lit("_K2"))))


def first_round(t: Tables) -> DataFrame:
    return cut(K.round_one(all_gaps(t), t.kept("hits"), chunk_judgments(t), t.kept("article_text")))


@query("missing_refs", "WITH base AS (SELECT 1)" + REFS + "SELECT query_id, article_id, CASE d WHEN 0 THEN 'outgoing' ELSE 'incoming' END AS direction, related FROM refs")
def missing_refs(t: Tables) -> DataFrame:
    return K.missing_references(t.kept("focus"), t.kept("hits"), t.kept("edges"))


@query("compound_penalty", "WITH base AS (SELECT 1)" + COMPOUND + "SELECT * FROM cp")
def compound_penalty(t: Tables) -> DataFrame:
    return K.compound_penalties(t.kept("focus").select("article_id").distinct(), t.kept("edges"))


@query("structural_gaps", "WITH base AS (SELECT 1)" + STRUCT + "SELECT * FROM sg")
def structural_gaps(t: Tables) -> DataFrame:
    return K.structural_gaps(t.kept("hits"), t.kept("focus"), totals(t))


@query("report_text", "WITH base AS (SELECT 1)" + REFS + COMPOUND + """, missed AS (SELECT query_id, article_id, CASE WHEN d = 0 THEN 'Đã lấy ''' || related || ''' nhưng nó tham chiếu tới ''' || article_id || ''' (Điều ' || article_id || ') chưa được lấy.'
ELSE '''' || article_id || ''' (Điều ' || article_id || ') tham chiếu áp dụng vào ''' || related || ''' đã lấy, nhưng ' || article_id || ' chưa được lấy — có thể chứa hình phạt bổ sung/điều kiện liên quan.' END AS reason FROM refs),
twofold AS (SELECT query_id, cp.* FROM {focus} JOIN cp USING (article_id)),
advice AS (SELECT query_id, article_id, 0 AS kind, '' AS behaviour, reason FROM missed UNION ALL SELECT query_id, article_id, 1, behaviour, 'Hành vi ''' || behaviour || ''' trong Điều ' || article_id || ' có CẢ hình phạt chính lẫn bổ sung trong tri thức đồ thị — 2 phần này thường nằm ở 2 Khoản khác nhau nên top-k dễ chỉ lấy được 1 phần, cần lấy lại toàn văn Điều.' FROM twofold),
counted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, article_id, behaviour) AS i FROM advice),
m AS (SELECT query_id, count(*) AS n, string_agg('• ' || reason, chr(10) ORDER BY article_id) AS said FROM missed GROUP BY 1),
c AS (SELECT query_id, count(*) AS n, string_agg('• Điều ' || article_id || ' - Hành vi: ' || behaviour || chr(10) || '  Chính: ' || main || chr(10) || '  Bổ sung: ' || additional, chr(10) ORDER BY article_id, behaviour) AS said FROM twofold GROUP BY 1),
a AS (SELECT query_id, string_agg(i || '. [retrieve] ' || reason || ' (Điều: ' || article_id || ')', chr(10) ORDER BY i) AS said FROM counted GROUP BY 1),
q AS (SELECT DISTINCT query_id FROM {hits})
SELECT q.query_id, '=== KNOWLEDGE GRAPH ANALYSIS ===' || chr(10) || chr(10) || CASE WHEN a.said IS NULL THEN '✅ Retrieval đầy đủ: Không phát hiện thông tin bị thiếu từ graph.' || chr(10)
ELSE '⚠️ Phát hiện ' || coalesce(m.n, 0) || ' Điều cần retrieve thêm, ' || coalesce(c.n, 0) || ' hành vi có chế tài kép (chính+bổ sung) cần lấy lại toàn văn Điều:' || chr(10) END
|| coalesce(chr(10) || chr(10) || '--- Các tham chiếu bị thiếu ---' || chr(10) || m.said, '') || coalesce(chr(10) || chr(10) || '--- Hành vi có chế tài kép chính+bổ sung (cần lấy lại toàn văn Điều) ---' || chr(10) || c.said, '') || coalesce(chr(10) || chr(10) || '--- Khuyến nghị ---' || chr(10) || a.said, '') AS report
FROM q LEFT JOIN m ON m.query_id = q.query_id LEFT JOIN c ON c.query_id = q.query_id LEFT JOIN a ON a.query_id = q.query_id""")  # fmt: skip
def report_text(t: Tables) -> DataFrame:
    focus = t.kept("focus")
    compound = focus.join(K.compound_penalties(focus.select("article_id").distinct(), t.kept("edges")), "article_id")
    return K.report_text(t.kept("hits"), K.missing_references(focus, t.kept("hits"), t.kept("edges")), compound)


@query("graph_cleared", "SELECT 'nodes' AS kind, CAST(0 AS BIGINT) AS n_left, count(*) AS n_before FROM {nodes} UNION ALL SELECT 'edges', CAST(0 AS BIGINT), count(*) FROM {edges}")
def graph_cleared(t: Tables) -> DataFrame:
    out = None
    for kind, df in {"nodes": t.nodes, "edges": t.edges}.items():
        left = G.cleared({kind: df})[kind].agg(F.count("*").alias("n_left"))
        own = df.agg(F.count("*").alias("n_before")).crossJoin(left).select(F.lit(kind).alias("kind"), "n_left", "n_before")  # a row each
        out = own if out is None else out.unionByName(own)
    return out


@query("critic_report", GAPS + """, sug AS (SELECT query_id FROM gaps WHERE gap_type <> 'structural' UNION ALL SELECT query_id FROM gaps g WHERE gap_type = 'structural' AND (query_id, article_id) NOT IN (SELECT (query_id, article_id) FROM gaps WHERE gap_type = 'compound')),
q AS (SELECT DISTINCT query_id FROM {hits})
SELECT q.query_id, count(g.query_id) = 0 AS is_complete, string_agg(DISTINCT article_id, ',' ORDER BY article_id) FILTER (gap_type = 'reference') AS reference, string_agg(DISTINCT article_id, ',' ORDER BY article_id) FILTER (gap_type = 'compound') AS compound,
string_agg(DISTINCT article_id, ',' ORDER BY article_id) FILTER (gap_type = 'structural') AS structural, coalesce(any_value(n), 0) AS n_suggestions FROM q LEFT JOIN gaps g ON g.query_id = q.query_id LEFT JOIN (SELECT query_id, count(*) AS n FROM sug GROUP BY 1) s ON s.query_id = q.query_id GROUP BY 1""")  # fmt: skip
def critic_report(t: Tables) -> DataFrame:
    return K.report(t.kept("hits"), all_gaps(t))


@query("reader_report", GAPS + """, why AS (SELECT query_id, 0 AS kind, article_id, '' AS behaviour, CASE WHEN d = 0 THEN 'Đã lấy ''' || related || ''' nhưng nó tham chiếu tới ''' || article_id || ''' (Điều ' || article_id || ') chưa được lấy.'
ELSE '''' || article_id || ''' (Điều ' || article_id || ') tham chiếu áp dụng vào ''' || related || ''' đã lấy, nhưng ' || article_id || ' chưa được lấy — có thể chứa hình phạt bổ sung/điều kiện liên quan.' END AS reason FROM refs
UNION ALL SELECT query_id, 1, article_id, behaviour, 'Hành vi ''' || behaviour || ''' trong Điều ' || article_id || ' có CẢ hình phạt chính lẫn bổ sung trong tri thức đồ thị — 2 phần này thường nằm ở 2 Khoản khác nhau nên top-k dễ chỉ lấy được 1 phần, cần lấy lại toàn văn Điều.' FROM {focus} JOIN cp USING (article_id)
UNION ALL SELECT query_id, 2, article_id, '', 'Điều ' || article_id || ' có ' || parts || ' Khoản/Điểm trong graph nhưng chỉ retrieve được ' || retrieved || ' phần — nội dung liên quan có thể nằm ở Khoản/Điểm khác chưa lấy được, cần lấy lại toàn văn Điều.' FROM sg
  WHERE (query_id, article_id) NOT IN (SELECT (query_id, article_id) FROM {focus} JOIN cp USING (article_id))),
labelled AS (SELECT DISTINCT query_id, article_id, regexp_replace(content, '^\\[([^,]*), ([^]]*)\\].*$', '\\1 — \\2') AS label FROM gaps JOIN {article_text} USING (article_id)),
listed AS (SELECT query_id, list({'a': article_id, 'b': label} ORDER BY length(article_id) DESC, article_id) AS names FROM labelled GROUP BY 1),
named AS (SELECT query_id, article_id, accepted, coalesce(label, article_id) AS name FROM r1 LEFT JOIN labelled USING (query_id, article_id)),
added AS (SELECT query_id, count(*) AS n, string_agg(chr(10) || '- ' || name, '' ORDER BY article_id) AS said FROM named WHERE accepted GROUP BY 1),
refused AS (SELECT query_id, count(*) AS n, string_agg(chr(10) || '- ' || name, '' ORDER BY article_id) AS said FROM named WHERE NOT accepted GROUP BY 1),
plain AS (SELECT query_id, kind, article_id, behaviour, list_reduce(list_prepend({'a': reason, 'b': ''}, coalesce(names, [])), lambda t, x: {'a': replace(replace(t.a, 'Điều ' || x.a, x.b), x.a, x.b), 'b': ''}).a AS reason FROM why LEFT JOIN listed USING (query_id)),
told AS (SELECT query_id, string_agg(chr(10) || '- ' || reason, '' ORDER BY kind, article_id, behaviour) AS said FROM plain GROUP BY 1),
q AS (SELECT DISTINCT query_id FROM {hits})
SELECT q.query_id, CASE WHEN added.n IS NULL AND refused.n IS NULL AND told.said IS NULL THEN '' ELSE
CASE WHEN added.n IS NULL THEN '**Tìm kiếm ban đầu đã đủ — Critic Agent không phải bổ sung gì.**' ELSE '**Tìm kiếm ban đầu CHƯA ĐỦ → Critic Agent đã tự bổ sung.**' || chr(10) || chr(10) || '✅ **Đã bổ sung toàn văn (' || added.n || ' Điều):**' || added.said END
|| coalesce(chr(10) || chr(10) || '⛔ **Đã loại vì không liên quan tới câu hỏi (' || refused.n || ' Điều):**' || refused.said, '') || coalesce(chr(10) || chr(10) || '📌 **Dấu hiệu thiếu mà Knowledge Graph phát hiện:**' || told.said, '')
|| chr(10) || chr(10) || '_Ghi chú kỹ thuật: is_complete=' || CASE WHEN q.query_id IN (SELECT query_id FROM gaps) THEN 'False' ELSE 'True' END || ' — cờ này chấm bước tìm kiếm top-k BAN ĐẦU, không phải câu trả lời cuối, và không được tính lại sau khi Critic Agent bổ sung xong._' END AS report
FROM q LEFT JOIN added USING (query_id) LEFT JOIN refused USING (query_id) LEFT JOIN told USING (query_id)""")  # fmt: skip
def reader_report(t: Tables) -> DataFrame:
    found = all_gaps(t)
    why = K.reasons(lost_references(t), twofold_penalties(t), lost_parts(t))
    texts = t.kept("article_text")
    labels = found.select("query_id", "article_id").distinct().join(texts, "article_id").select("query_id", "article_id", article_label("article_id", "content").alias("label"))
    whole = t.kept("hits").select("query_id").distinct().join(found.select("query_id").distinct().withColumn("is_complete", F.lit(False)), "query_id", "left").select("query_id", F.coalesce("is_complete", F.lit(True)).alias("is_complete"))
    return K.reader_report(whole, K.round_one(found, t.kept("hits"), chunk_judgments(t), texts), cut(why), labels)


@query("gate_apply", GAPS + "SELECT query_id, gap_type, article_id, by_text AS accepted FROM gt")
def gate_apply(t: Tables) -> DataFrame:
    return K.gated(all_gaps(t), t.kept("judgments"), t.kept("article_text"))


@query("gate_any", GAPS + "SELECT * FROM ch")
def gate_any(t: Tables) -> DataFrame:
    return K.any_relevant(t.kept("hits"), chunk_judgments(t))


@query("critic_round1", GAPS + "SELECT * FROM r1")
def critic_round1(t: Tables) -> DataFrame:
    return first_round(t)


def hop_sql(n: int, before: str, known: str, had: str) -> str:
    return f""", n{n} AS (SELECT DISTINCT p.query_id, rf.b AS article_id FROM {before} p JOIN rf ON rf.a = p.article_id WHERE (p.query_id, rf.b) NOT IN (SELECT (query_id, article_id) FROM {known})),
g{n} AS (SELECT x.*, article_id IN (SELECT article_id FROM has) AND coalesce(relevant, true) AS accepted FROM n{n} x LEFT JOIN jd USING (query_id, article_id)),
s{n} AS (SELECT query_id, article_id, accepted FROM (SELECT g.*, coalesce(sum(CAST(accepted AS INT)) OVER (PARTITION BY g.query_id ORDER BY article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(had, 0) AS c FROM g{n} g LEFT JOIN {had} h ON h.query_id = g.query_id) z WHERE c < 4),
f{n} AS (SELECT * FROM s{n} WHERE accepted)"""


@query("multi_hop", GAPS + ", ft AS (SELECT query_id, article_id FROM r1 WHERE accepted), kn0 AS (SELECT query_id, article_id FROM {hits} UNION SELECT * FROM ft), h0 AS (SELECT query_id, count(*) AS had FROM ft GROUP BY 1)" + hop_sql(1, "ft", "kn0", "h0")
    + ", kn1 AS (SELECT * FROM kn0 UNION SELECT query_id, article_id FROM s1), h1 AS (SELECT query_id, count(*) AS had FROM (SELECT query_id FROM ft UNION ALL SELECT query_id FROM f1) y GROUP BY 1)" + hop_sql(2, "f1", "kn1", "h1")
    + " SELECT query_id, article_id, 1 AS hop, accepted FROM s1 UNION ALL SELECT query_id, article_id, 2, accepted FROM s2")
def multi_hop(t: Tables) -> DataFrame:
    return K.multi_hop(first_round(t).filter("accepted"), t.kept("hits"), t.kept("edges"), t.kept("judgments"), t.kept("article_text"), most=2)


@query("mixed_doc_guard", GAPS + "SELECT query_id, count(DISTINCT van_ban_id) AS n_documents, arg_min(article_id, rank) AS article_id FROM (SELECT h.query_id, rank, h.article_id, CASE WHEN rank = 3 THEN 'v' || (query_id % 5) ELSE van_ban_id END AS van_ban_id FROM {hits} h) z WHERE query_id NOT IN (SELECT query_id FROM r1 WHERE accepted) GROUP BY 1 HAVING count(DISTINCT van_ban_id) >= 2")
def mixed_doc_guard(t: Tables) -> DataFrame:
    hits = t.kept("hits").withColumn("van_ban_id", F.when(F.col("rank") == 3, F.concat(F.lit("v"), (F.col("query_id") % 5).cast("string"))).otherwise(F.col("van_ban_id")))
    return K.mixed_document_guard(hits, first_round(t).filter("accepted"))


HEADERS = {"reference": "## Tham chiếu", "compound": "## Hình phạt", "structural": "## Còn thiếu"}
CONTEXT = ", cx AS (SELECT query_id, string_agg(CASE gap_type WHEN 'reference' THEN '## Tham chiếu' WHEN 'compound' THEN '## Hình phạt' ELSE '## Còn thiếu' END || chr(10) || content, chr(10) || chr(10) ORDER BY CASE gap_type WHEN 'reference' THEN 0 WHEN 'compound' THEN 1 ELSE 2 END, article_id) AS context FROM r1 JOIN {article_text} USING (article_id) WHERE accepted GROUP BY 1)"


@query("critic_context", GAPS + CONTEXT + " SELECT * FROM cx")
def critic_context(t: Tables) -> DataFrame:
    return K.critic_context(first_round(t), t.kept("article_text"), HEADERS)


@query("mode_contexts", GAPS + CONTEXT + """, nv AS (SELECT query_id, string_agg(chunk_id, chr(10) ORDER BY rank) AS context FROM {hits} GROUP BY 1), ex AS (SELECT query_id, string_agg(article_id, chr(10) ORDER BY rank) AS context FROM {hits} GROUP BY 1)
SELECT query_id, 'naive' AS mode, context, false AS regenerate FROM nv UNION ALL SELECT query_id, 'article_expand', context, false FROM ex UNION ALL SELECT nv.query_id, 'critic', nv.context || coalesce(chr(10) || chr(10) || cx.context, ''), cx.context IS NOT NULL FROM nv LEFT JOIN cx ON cx.query_id = nv.query_id""")  # fmt: skip
def mode_contexts(t: Tables) -> DataFrame:
    from lexmill.operators.retrieval import ordered_text

    return K.mode_contexts(ordered_text(t.kept("hits"), ["query_id"], "rank", "chunk_id", "\n"), ordered_text(t.kept("hits"), ["query_id"], "rank", "article_id", "\n"), K.critic_context(first_round(t), t.kept("article_text"), HEADERS))


@query("trace_evidence", GAPS + """, cd AS (SELECT query_id, article_id, min(CASE gap_type WHEN 'reference' THEN 0 WHEN 'compound' THEN 1 ELSE 2 END) AS r FROM gaps GROUP BY 1, 2), cl AS (SELECT query_id, string_agg(article_id, ',' ORDER BY r, article_id) AS candidates FROM cd GROUP BY 1),
kd AS (SELECT query_id, string_agg(DISTINCT gap_type, ',' ORDER BY gap_type) AS gap_types FROM gaps GROUP BY 1), vd AS (SELECT query_id, string_agg(article_id, ',' ORDER BY article_id) FILTER (accepted) AS accepted, string_agg(article_id, ',' ORDER BY article_id) FILTER (NOT accepted) AS rejected FROM r1 GROUP BY 1),
fn AS (SELECT query_id, string_agg(article_id, ',' ORDER BY article_id) AS final FROM (SELECT query_id, article_id FROM {hits} UNION SELECT query_id, article_id FROM r1 WHERE accepted) z GROUP BY 1)
SELECT fn.query_id, final, gap_types, candidates, accepted, rejected FROM fn LEFT JOIN kd USING (query_id) LEFT JOIN cl USING (query_id) LEFT JOIN vd USING (query_id)""")  # fmt: skip
def trace_evidence(t: Tables) -> DataFrame:
    return K.trace_evidence(all_gaps(t), first_round(t), t.kept("hits"))


CITES = "SELECT query_id, rank AS pos, article_id, 'Điều ' || split_part(article_id, '_D', 2) AS label, 'lý do ' || rank AS reason FROM {hits} UNION ALL SELECT query_id, rank + 10, article_id, 'Điều ' || split_part(article_id, '_D', 2), 'sau' FROM {hits}"
ANSWERS = "SELECT query_id, string_agg(CASE rank WHEN 1 THEN 'điều ' || split_part(article_id, '_D', 2) WHEN 2 THEN 'Điều ' || split_part(article_id, '_D', 2) || '0' ELSE '' END, '; ' ORDER BY rank) AS answer FROM {hits} GROUP BY 1"


def citations(t: Tables) -> DataFrame:
    label = F.concat(F.lit("Điều "), F.element_at(F.split("article_id", "_D"), 2))
    h = t.kept("hits")
    first = h.select("query_id", F.col("rank").alias("pos"), "article_id", label.alias("label"), F.concat(F.lit("lý do "), F.col("rank").cast("string")).alias("reason"))
    return first.unionByName(h.select("query_id", (F.col("rank") + 10).alias("pos"), "article_id", label.alias("label"), F.lit("sau").alias("reason")))


@query("citation_dedup", f"WITH c AS ({CITES}) SELECT * FROM c WHERE pos < 10")
def citation_dedup(t: Tables) -> DataFrame:
    return K.required_citations(citations(t))


@query("missing_citations", f"WITH c AS ({CITES}), a AS ({ANSWERS}) SELECT c.* FROM c JOIN a USING (query_id) WHERE pos < 10 AND NOT regexp_matches(answer, '(?i)(^|[^\\p{{L}}\\p{{N}}_])Điều\\s+' || split_part(article_id, '_D', 2) || '([^\\p{{L}}\\p{{N}}_]|$)')")
def missing_citations(t: Tables) -> DataFrame:
    number = F.element_at(F.split("article_id", "_D"), 2)
    said = F.when(F.col("rank") == 1, F.concat(F.lit("điều "), number)).when(F.col("rank") == 2, F.concat(F.lit("Điều "), number, F.lit("0"))).otherwise("")
    answers = t.kept("hits").withColumn("t", said).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "; ").alias("answer"))
    return K.missing_citations(K.required_citations(citations(t)), answers)


@query("citation_contract", f"WITH c AS ({CITES}) SELECT query_id, 'Phải nêu:' || chr(10) || string_agg('- ' || label || ': ' || reason, chr(10) ORDER BY pos) AS contract FROM c WHERE pos < 10 GROUP BY 1")
def citation_contract(t: Tables) -> DataFrame:
    return K.citation_contract(K.required_citations(citations(t)), "Phải nêu:")
