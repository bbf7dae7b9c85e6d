"""article_context: every set of targets is made once, whatever reads it."""

from lexmill.operators import graph_query as Q


def test_patterns_and_one_set_of_targets(spark):
    edges = [
        ("a", "CO_KHOAN", "a1"), ("a", "CO_KHOAN", "a2"), ("a", "CO_KHOAN", "a1"), ("a1", "CO_DIEM", "p1"), ("a2", "CO_DIEM", "p1"), ("a2", "CO_DIEM", "p0"), ("a", "THAM_CHIEU", "b"),
        ("a", "QUY_DINH_HANH_VI", "h1"), ("a1", "QUY_DINH_HANH_VI", "h2"), ("a2", "QUY_DINH_HANH_VI", "h1"), ("h1", "CHE_TAI_CHINH", "c2"), ("h1", "CHE_TAI_BO_SUNG", "c1"), ("h2", "CHE_TAI_CHINH", "c9"),
        ("b", "CO_KHOAN", "b1"), ("b", "QUY_DINH_HANH_VI", "h1"), (None, "CO_KHOAN", "a1"), ("x", "CO_KHOAN", "a1"), ("c", "KHAC", "a"),
    ]
    nodes = spark.createDataFrame([("Dieu", i, i.upper()) for i in ("a", "b", "c", "c")] + [("Khoan", "a1", "-")], "label string, id string, ten string")
    got = Q.article_context(nodes, spark.createDataFrame(edges, "src string, rel string, dst string"))
    want = [("a", "A", "a1,a2", "p0,p1", "b", "h1,h2", "c1,c2"), ("b", "B", "b1", None, None, "h1", "c1,c2"), ("c", "C", None, None, None, None, None), ("c", "C", None, None, None, None, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    ran = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [line for line in ran.splitlines() if "partial_collect_set" in line and "rel" in line]
    assert len(made) == 1 and "ReusedExchange" in ran
