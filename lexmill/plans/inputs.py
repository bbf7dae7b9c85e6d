"""Input tables of the queries, derived from the driver's tables by SQL that Spark and DuckDB read alike.

Only inputs are shared: what the operators do to them is written twice, as DataFrame code and as the SQL to compare with.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL: dict[str, str] = {
    # a law for each customer: an article for each order, a clause for each line, some points, wrapped lines and closing notes
    "clause_rows": "SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "statute_parts": """
        SELECT o_custkey, o_orderkey AS k1, 0 AS k2, 0 AS k3, 'Điều ' || (o_orderkey % 40 + 1) || '. Đơn ' || o_orderkey AS line FROM {orders}
        UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, 0, l_linenumber || '. ' || CASE WHEN partkey % 4 = 0 THEN 'Phạt tiền ' || suppkey || ' triệu' WHEN partkey % 4 = 1 THEN 'Tịch thu tang vật ' || suppkey WHEN partkey % 4 = 2 THEN 'Buộc gỡ bỏ ' || suppkey ELSE 'Quyền tác giả ' || suppkey END
          || ' theo khoản ' || (l_linenumber % 3 + 1) || CASE WHEN partkey % 3 = 0 THEN ', khoản ' || (suppkey % 4 + 1) ELSE '' END || ' Điều ' || CASE WHEN partkey % 6 = 5 THEN 'này' ELSE '' || (partkey % 40 + 1) END || CASE WHEN partkey % 7 = 0 THEN ' của Luật số ' || (suppkey % 9 + 1) || '/2020/QH14' ELSE '' END || ' và Điều ' || (suppkey % 40 + 1) || '.'
          FROM {clause_rows} JOIN {orders} ON l_orderkey = o_orderkey
        UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, 1, 'a) Điểm ' || partkey || ';' FROM {clause_rows} JOIN {orders} ON l_orderkey = o_orderkey WHERE partkey % 3 = 0
        UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, 2, 'tiếp theo ' || suppkey FROM {clause_rows} JOIN {orders} ON l_orderkey = o_orderkey WHERE partkey % 5 = 0
        UNION ALL SELECT o_custkey, o_orderkey, 99, 0, '[9] Khoản này được sửa đổi' FROM {orders} WHERE o_orderkey % 50 = 7""",
    "statute_lines": "SELECT 'luat_' || o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY k1, k2, k3) - 1 AS INT) AS line_no, line FROM {statute_parts}",
    # a property graph: nations hold orders, orders hold lines, lines name parts, parts have suppliers as penalties
    "nodes": """
        SELECT 'VanBan' AS label, 'v' || n_nationkey AS id, 'v' || n_nationkey AS van_ban_id, CAST(NULL AS STRING) AS chunk_id, n_name AS ten FROM {nation}
        UNION ALL SELECT 'Dieu', 'v' || c_nationkey || '_D' || o_orderkey, 'v' || c_nationkey, 'v' || c_nationkey || '_D' || o_orderkey || '_PARENT', 'Điều ' || o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        UNION ALL SELECT 'Khoan', 'v' || c_nationkey || '_D' || o_orderkey || '_K' || l_linenumber, 'v' || c_nationkey, 'v' || c_nationkey || '_D' || o_orderkey || '_PARENT', 'Khoản ' || l_linenumber FROM {clause_rows} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        UNION ALL SELECT 'HanhVi', 'h' || p_partkey, 'v' || (p_partkey % 25), 'v' || (p_partkey % 25) || '_D' || p_partkey || '_PARENT', p_name || ' ' || p_type FROM {part}
        UNION ALL SELECT 'CheTai', 'c' || s_suppkey, 'v' || s_nationkey, 'v' || s_nationkey || '_D' || s_suppkey || '_PARENT', CASE WHEN s_suppkey % 4 = 0 THEN 'Phạt tiền ' || s_suppkey WHEN s_suppkey % 4 = 1 THEN 'Tịch thu ' || s_suppkey WHEN s_suppkey % 4 = 2 THEN 'Buộc nộp ' || s_suppkey ELSE 'Khác ' || s_suppkey END FROM {supplier}""",
    "order_ids": "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, 'v' || c_nationkey AS van_ban_id, 'v' || c_nationkey || '_D' || o_orderkey AS dieu_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "edges": """
        SELECT van_ban_id AS src, 'CO_DIEU' AS rel, dieu_id AS dst FROM {order_ids}
        UNION ALL SELECT dieu_id, 'CO_KHOAN', dieu_id || '_K' || l_linenumber FROM {clause_rows} JOIN {order_ids} ON l_orderkey = o_orderkey
        UNION ALL SELECT DISTINCT dieu_id || '_K' || l_linenumber, 'QUY_DINH_HANH_VI', 'h' || l_partkey FROM {lineitem} JOIN {order_ids} ON l_orderkey = o_orderkey
        UNION ALL SELECT DISTINCT 'h' || l_partkey, CASE WHEN l_returnflag = 'A' THEN 'CHE_TAI_CHINH' ELSE 'CHE_TAI_BO_SUNG' END, 'c' || l_suppkey FROM {lineitem} WHERE l_discount >= 0.09 AND l_quantity >= 45 AND l_returnflag IN ('A', 'R')
        UNION ALL SELECT dieu_id, 'THAM_CHIEU', next_id FROM (SELECT dieu_id, lead(dieu_id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_id FROM {order_ids}) x WHERE next_id IS NOT NULL""",
    # the chunk index of the same articles: it has points, which the graph hasn't, and lacks late clauses
    "index_chunks": """
        SELECT dieu_id AS article_id, dieu_id || '_K' || l_linenumber AS chunk_id FROM {clause_rows} JOIN {order_ids} ON l_orderkey = o_orderkey WHERE l_linenumber < 6
        UNION ALL SELECT dieu_id, dieu_id || '_K' || l_linenumber || '_Pa' FROM {clause_rows} JOIN {order_ids} ON l_orderkey = o_orderkey WHERE partkey % 3 = 0 AND o_orderkey % 2 = 0""",
    # what a search gave for each customer: a clause of each of the three largest orders
    "hits": "SELECT query_id, rank, article_id, van_ban_id, article_id || '_K' || (1 + rank % 2) AS chunk_id, 1.0 / (1 + rank) AS score FROM (SELECT o_custkey AS query_id, dieu_id AS article_id, van_ban_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM {order_ids}) x WHERE rank <= 3",
    "focus": "SELECT query_id, article_id FROM {hits} WHERE rank <= 2",
    "judgments": "SELECT o_custkey AS query_id, dieu_id AS unit_id, o_orderkey % 3 <> 0 AS relevant FROM {order_ids} WHERE o_orderkey % 5 <> 0",
    "article_text": "SELECT dieu_id AS article_id, '[Điều ' || o_orderkey || ', Luật ' || van_ban_id || '] giá ' || CAST(floor(o_totalprice) AS INT) AS content FROM {order_ids} WHERE o_orderkey % 11 <> 0",
    # evaluation rows: a case for each document that has labels, a mode for each source
    "cases": "SELECT d.doc_id AS case_id, lang AS category, 'm' || (d.doc_id % 3) AS mode, quality, toxic, n_chars FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "gold": "SELECT o_custkey AS case_id, dieu_id, 'D' || (o_orderkey % 4) AS category FROM {order_ids} WHERE o_orderkey % 4 <> 3",
    "llm_calls": "SELECT user_id AS query_id, 'm' || (user_id % 3) AS mode, event_type AS tag, CAST(floor(value * 100) AS INT) AS prompt, CAST(floor(value * 10) AS INT) AS completion FROM {events}",
    "judged": "SELECT event_id, user_id AS case_id, 'k' || (user_id % 4) AS category, event_type AS metric, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS score, CAST(floor(event_id / 100) AS INT) AS batch FROM {events}",
}


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of SQL's."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{n: table(spark, sf_dir, n) for n in needs(SQL[name])})


def with_inputs(body: str) -> str:
    """DuckDB SQL for body, in which {name} stands for a table: the derived ones go before it as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in SQL and name not in ordered:
            for n in needs(SQL[name]):
                add(n)
            ordered.append(name)

    for n in needs(body):
        add(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = ",\n".join(f"{n} AS ({plain(SQL[n])})" for n in ordered)
    body = plain(body).strip()
    if not ctes:
        return body
    if body[:15].upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
