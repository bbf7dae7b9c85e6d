"""Chunking keeps few sorted copies of a document's lines, and splits lines as ever."""

from lexmill.operators import chunking as C
from lexmill.plans import texts
from lexmill.plans.registry import Tables

DIR = "/root/testdata/sf0.001"

LINES = [
    "preface", "Điều 1. A", "1. x", "a) p", "tail", "2. y", "b) q", "Điều 2. alone", "Điều 1. again", "text", "a) without clause", "1. z", "1. z again", "Điều 3", "[9] Khoản này", "Điều 4. gone",
]


def law(spark):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(LINES)], "doc_id string, line_no int, line string")


def test_chunks(spark):
    got = {r.chunk_id: (r.ord, r.chunk_type, r.content) for r in C.chunks(law(spark), C.STATUTE).collect()}
    assert got == {
        "d_D1_K1": (0, "khoan", "Điều 1. A\n1. x"), "d_D1_K1_Pa": (1, "diem", "a) p\ntail"), "d_D1_K2": (2, "khoan", "2. y"), "d_D1_K2_Pb": (3, "diem", "b) q"),
        "d_D2_preamble": (4, "dieu_preamble", "Điều 2. alone"), "d_D1_O2_preamble": (5, "dieu_preamble", "Điều 1. again\ntext"), "d_D1_O2_Pa": (6, "diem", "a) without clause"),
        "d_D1_O2_K1": (7, "khoan", "1. z"), "d_D1_O2_K1_C2": (8, "khoan", "1. z again"), "d_D3_preamble": (9, "dieu_preamble", "Điều 3"),
    }


def test_few_sorts(spark):
    plan = C.chunks(law(spark), C.STATUTE)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Sort [") <= 3


def test_partitions_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(texts, "ROWS_A_TASK", 500)
    t = Tables(spark, DIR)
    n = -(-t.lineitem.count() // 500)
    plan = texts.law_chunks(t)._jdf.queryExecution().optimizedPlan().toString()
    assert n > 4 and "RepartitionByExpression [doc_id" in plan and f"], {n}" in plan
    few = C.by_document(t.statute_lines, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "], 4" in few


def test_laws_are_sorted_in_as_many_tasks_as_chunked(spark):
    from pyspark.sql import functions as F

    from lexmill.plans import texts
    from lexmill.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lines = texts.law_lines(t, 9)
    # more than the four of the session's shuffles, and not joined by size
    assert 4 < lines.select(F.spark_partition_id()).distinct().count() <= 9
    assert lines.exceptAll(t.statute_lines).isEmpty() and t.statute_lines.exceptAll(lines).isEmpty()
