"""Small rows worked out by hand."""

import json
import math
import unicodedata
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking as C
from lexmill.operators import critic as K
from lexmill.operators import evaluation as E
from lexmill.operators import graph_build as G
from lexmill.operators import model_io as M
from lexmill.operators import retrieval as R
from lexmill.sources import tables as S
from lexmill.streaming import increments

LAW = """LUẬT MẪU
Điều 1. Phạm vi
1. Khoản một.
a) Điểm a;
tiếp theo.
Điều 2. Chỉ tiêu đề
Điều 3. Xử phạt
Lời dẫn.
1. Phạt tiền theo khoản 1 Điều 1 và Điều 2.
Điều 1. Lặp
1.[3] Khoản lặp.
[16] Khoản này được sửa đổi
Điều 9. Không đọc tới"""


@pytest.fixture(scope="module")
def chunks(spark):
    return C.chunks(C.lines_of(spark.createDataFrame([("lu_t", LAW)], "doc_id string, text string")), C.STATUTE, prefixed=True).cache()


def test_chunks_and_parents(chunks):
    got = [(r.ord, r.chunk_id, r.chunk_type, r.content) for r in chunks.orderBy("ord").collect()]
    assert got == [
        (0, "lu_t_D1_K1", "khoan", "[Khoản 1, Điều 1, lu_t] Điều 1. Phạm vi\n1. Khoản một."),
        (1, "lu_t_D1_K1_Pa", "diem", "[Điểm a, Khoản 1, Điều 1, lu_t] a) Điểm a;\ntiếp theo."),
        (2, "lu_t_D2_preamble", "dieu_preamble", "[Điều 2, lu_t] Điều 2. Chỉ tiêu đề"),
        (3, "lu_t_D3_preamble", "dieu_preamble", "[Điều 3, lu_t] Điều 3. Xử phạt\nLời dẫn."),
        (4, "lu_t_D3_K1", "khoan", "[Khoản 1, Điều 3, lu_t] 1. Phạt tiền theo khoản 1 Điều 1 và Điều 2."),
        (5, "lu_t_D1_O2_K1", "khoan", "[Khoản 1, Điều 1, lu_t] Điều 1. Lặp\n1.[3] Khoản lặp."),
    ]
    parents = C.parents(chunks)
    assert {r.parent_id: r.n_chunks for r in parents.collect()} == {"lu_t_D1_PARENT": 2, "lu_t_D2_PARENT": 1, "lu_t_D3_PARENT": 2, "lu_t_D1_O2_PARENT": 1}
    assert {r.article_id: r.parts for r in C.article_parts(chunks).collect()} == {"lu_t_D1": 3, "lu_t_D2": 1, "lu_t_D3": 2}
    assert "Lặp" in {r.article_id: r.content for r in C.article_lookup(parents).collect()}["lu_t_D1"]


def test_references(chunks):
    both = [(r.src, r.dst, r.note) for df in (G.clause_references(chunks), G.article_references(chunks)) for r in df.collect()]
    assert both == [("lu_t_D3_K1", "lu_t_D1_K1", "khoan_dieu_regex"), ("lu_t_D3_K1", "lu_t_D2", "dieu_only_regex")]


def test_bm25(spark):
    w = R.bm25_weights(spark.createDataFrame([(0, "a b a"), (1, "b c")], "id long, text string"), "id")
    got = {(r.id, r.term): r.weight for r in w.collect()}
    want = {(0, "a"): 0.930399, (0, "b"): 0.167267, (1, "b"): 0.200353, (1, "c"): 0.761700}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_fusion(spark):
    for ranks, score in [((0, 0), 1.0), ((1, 1), 0.666667), ((2, 6), 0.375), ((3, 7), 0.311111), ((4, 5), 0.309524), ((0, 1), 0.833333), ((3, 6), 0.325)]:
        a, b = (spark.createDataFrame([(1, 9, r)], "query_id long, id long, rank int") for r in ranks)
        assert R.rrf([a, b], "id").first().score == pytest.approx(score, abs=1e-6)
    one = spark.createDataFrame([(1, 9, 4.0)], "query_id long, id long, score double")
    assert R.dbsf([one, one], "id").first().score == 1.0


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, i, x) for i, x in enumerate("AXBY")], "case_id long, pos int, item string")
    gold = spark.createDataFrame([(1, "x"), (1, "y")], "case_id long, item string")
    assert E.mrr(ranked, gold).first().rr == 0.5 and E.ndcg(ranked, gold).first().ndcg == pytest.approx(0.650921, abs=1e-6)
    low = ranked.withColumn("item", F.lower("item"))
    pr = E.context_pr(low.limit(0), low, gold).first()
    assert (pr.precision, pr.recall) == (0.5, 1.0)


def test_penalty_kinds_and_ids(spark):
    rows = spark.createDataFrame([("Phạt tiền từ 5 triệu",), ("Tịch thu tang vật",), ("Buộc gỡ bỏ",), ("ĐÌNH CHỈ hoạt động",), ("Quyền tác giả",)], "t string")
    assert [r[0] for r in rows.select(G.penalty_kind(F.col("t"))).collect()] == ["CHE_TAI_CHINH", "CHE_TAI_BO_SUNG", "CHE_TAI_BO_SUNG", "CHE_TAI_BO_SUNG", None]
    ids = spark.createDataFrame([("x_D90_O2",), ("x_D25a_PARENT",), ("x_K1",)], "i string")
    assert [r[0] for r in ids.select(T.article_no("i")).collect()] == ["90", "25a", None]
    names = spark.createDataFrame([("Luật Mẫu 2025.docx",)], "n string").select(T.slug_id("n").alias("a"), T.graph_document_id("n").alias("b"), T.fold_id("n").alias("c"), T.point_id("n").alias("d")).first()
    assert tuple(names) == ("Lu_t_M_u_2025", "lu_t_m_u_2025", "luat_mau_2025_docx", str(uuid.uuid5(uuid.NAMESPACE_URL, "Luật Mẫu 2025.docx")))


def test_normal_forms(spark):
    raw = ["Luật", unicodedata.normalize("NFD", "Luật"), "ﬁ ②", "plain", None]
    df = spark.createDataFrame([(x,) for x in raw], "t string")
    assert [r[0] for r in df.select(T.normalized("t")).collect()] == [None if x is None else unicodedata.normalize("NFKC", x) for x in raw]


def test_citations(spark):
    req = spark.createDataFrame([(1, 0, "v_D37", "Điều 37", "a"), (1, 1, "v_D16", "Điều 16", "b"), (1, 2, "v_D37", "Điều 37", "c"), (2, 0, "v_D1", "Điều 1", "a"), (3, 0, "khác", "Nghị quyết", "a")], "query_id long, pos int, article_id string, label string, reason string")
    first = K.required_citations(req)
    assert {(r.query_id, r.article_id): r.reason for r in first.collect()}[1, "v_D37"] == "a"
    said = spark.createDataFrame([(1, "chỉ điều  16."), (2, "Theo Điều 10..."), (3, "theo NGHỊ quyết")], "query_id long, answer string")
    assert sorted((r.query_id, r.label) for r in K.missing_citations(first, said).collect()) == [(1, "Điều 37"), (2, "Điều 1")]


def test_outputs(spark):
    rows = [(1, '<thinking>{"no": 1}</thinking>{"a": 1}'), (2, 'text ```json\n{"a": [1, 2]}\n``` more'), (3, '{"a": [1, {"b": "x"}, {"c": "unfin'), (4, "none"), (5, None)]
    got = {r.id: (r.json and json.loads(r.json), r.status) for r in M.parsed_outputs(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: ({"a": 1}, "parsed"), 2: ({"a": [1, 2]}, "parsed"), 3: ({"a": [1, {"b": "x"}]}, "repaired"), 4: (None, "failed"), 5: (None, "failed")}
    scored = M.scored(spark.createDataFrame([(1, "ab"), (2, "c")], "id long, t string"), lambda b: b.t.str.len(), "n", "long")
    assert [tuple(r) for r in scored.orderBy("id").collect()] == [(1, "ab", 2), (2, "c", 1)]


def test_exact_ratio(spark):
    pairs = spark.createDataFrame(pd.DataFrame({"a": [1, 1], "b": [2, 3], "text_a": ["abcd", "abcd"], "text_b": ["bcde", "xyz"]}))
    assert [(r.a, r.b, r.ratio) for r in E.exact_ratio(pairs, 0.5).collect()] == [(1, 2, 0.75)]


def test_one_id_under_two_labels(spark):
    nodes = spark.createDataFrame([("Dieu", "x"), ("Khoan", "x"), ("Dieu", "y")], "label string, id string")
    new = spark.createDataFrame([("x", "THAM_CHIEU", "y"), ("x", "THAM_CHIEU", "z")], "src string, rel string, dst string")
    none = new.limit(0)
    once = G.upserted_edges(none, new, nodes)
    assert [tuple(r) for r in once.collect()] == [("x", "THAM_CHIEU", "y")]
    assert G.upserted_edges(once, new, nodes).count() == 1  # again: nothing more
    assert {(r.label, r.orphan) for r in G.orphans(nodes, once).collect()} == {("Dieu", False), ("Khoan", False)}


def test_loads_and_sinks(spark, tmp_path):
    path = f"file://{tmp_path}"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = S.upserted(old, new, "id")
    assert {tuple(r) for r in S.upserted(once, new, "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    S.write_table(old, f"{path}/t", recreate=True)
    S.write_table(new, f"{path}/t", recreate=False)
    assert spark.read.parquet(f"{path}/t").count() == 2
    S.append_results(old, f"{path}/j")
    S.append_results(new, f"{path}/j")
    assert spark.read.json(f"{path}/j").count() == 4
    S.write_report(old, f"{path}/c")
    assert spark.read.option("header", "true").csv(f"{path}/c").columns == ["id", "v"]
    S.save_snapshot({"nodes": old, "edges": new}, f"{path}/s")
    assert {n: d.count() for n, d in S.load_snapshot(spark, f"{path}/s", ["nodes", "edges"]).items()} == {"nodes": 2, "edges": 2}


def test_extraction_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    line = {"chunk_id": "c", "van_ban_id": "v", "entities": [{"id": "D7", "type": "Dieu", "so": "7", "chunk_id": "own"}, {"id": "K", "type": "Khoan"}], "relations": [{"source_id": "D7", "relation_type": "CO_KHOAN", "target_id": "K"}]}
    (tmp_path / "a" / "x.jsonl").write_text(json.dumps(line) + "\n\n{broken\n", encoding="utf-8")
    rows = S.scan_jsonl(spark, f"file://{tmp_path}", S.EXTRACTION).cache()
    assert (rows.count(), rows.filter("_bad IS NOT NULL").count()) == (2, 1)
    assert [(r.chunk_id, r.id, r.type) for r in S.entities_of(rows).orderBy("pos").collect()] == [("own", "D7", "Dieu"), ("c", "K", "Khoan")]
    assert [(r.chunk_id, r.src, r.rel, r.dst) for r in S.relations_of(rows).collect()] == [("c", "D7", "CO_KHOAN", "K")]


def test_stream_of_new_files(spark, tmp_path):
    src, out, ck = (tmp_path / x for x in ("in", "out", "ck"))
    src.mkdir()
    for k, lines in enumerate(['{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}', '{"id": 2, "v": "c"}']):
        (src / f"{k}.json").write_text(lines)
        increments.upsert_into(increments.new_lines(spark, f"file://{src}", "id LONG, v STRING"), f"file://{out}", "id", f"file://{ck}").awaitTermination()
    assert {(r.id, r.v) for r in increments.current(spark, f"file://{out}", "id").collect()} == {(1, "a"), (2, "c")}


def test_smoke_summary_of_one_case(spark):
    calls = spark.createDataFrame([(1, "critic", "draft", 1000, 100), (1, "critic", "gate", 350, 156), (1, "critic", "final_generate", 1934, 175)], "query_id long, mode string, tag string, prompt int, completion int")
    final = E.final_usage(calls, ["final_generate", "draft"])
    total = {r.tag: r for r in E.token_usage(calls).collect()}["ALL"]
    assert (total.total, total.prompt, total.completion, total.calls, final.first().total) == (3715, 3284, 431, 3, 2109)
    assert not math.isnan(E.token_summary(E.token_usage(calls).filter("tag = 'ALL'").withColumn("mode", F.lit("critic")), final).first().value)


def test_tokens_are_of_composed_text(spark):
    """Expected tokens are written by hand: decomposed letters are one with composed ones, full-width and ligature forms with plain ones."""
    decomposed = "Điều 5 phạt"
    rows = [(1, decomposed), (2, "Điều 5 phạt"), (3, "ＡＢ１ ﬁle"), (4, "plain_text"), (5, None), (6, "")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, s string").select("i", T.tokens("s").alias("t")).collect()}
    assert got == {1: ["điều", "5", "phạt"], 2: ["điều", "5", "phạt"], 3: ["ab1", "file"], 4: ["plain_text"], 5: None, 6: []}


def test_larger_count_of_parts_wins(spark):
    graph = spark.createDataFrame([("a", 1), ("b", 4), ("c", 0)], "article_id string, parts long")
    index = spark.createDataFrame([("a", 3), ("b", 2), ("d", 5)], "article_id string, parts long")
    assert {tuple(r) for r in K.total_parts(graph, index).collect()} == {("a", 3), ("b", 4), ("c", 0), ("d", 5)}


def test_report_text(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    refs = spark.createDataFrame([(1, "l_D2", "outgoing", "l_D1"), (1, "l_D1a", "incoming", "l_D1")], "query_id long, article_id string, direction string, related string")
    compound = spark.createDataFrame([(1, "l_D1", "h1", "c1", None)], "query_id long, article_id string, behaviour string, main string, additional string")
    got = {r.query_id: r.report.split("\n") for r in K.report_text(queries, refs, compound).collect()}
    assert got[2] == ["=== KNOWLEDGE GRAPH ANALYSIS ===", "", "✅ Retrieval đầy đủ: Không phát hiện thông tin bị thiếu từ graph.", ""]
    assert got[1][2] == "⚠️ Phát hiện 2 Điều cần retrieve thêm, 1 hành vi có chế tài kép (chính+bổ sung) cần lấy lại toàn văn Điều:"
    assert got[1][6].startswith("• 'l_D1a' (Điều l_D1a) tham chiếu áp dụng vào 'l_D1' đã lấy") and got[1][7] == "• Đã lấy 'l_D1' nhưng nó tham chiếu tới 'l_D2' (Điều l_D2) chưa được lấy."
    assert got[1][10:13] == ["• Điều l_D1 - Hành vi: h1", "  Chính: c1", "  Bổ sung: (không có trong graph)"]
    assert [x[:13] for x in got[1][-3:]] == ["1. [retrieve]", "2. [retrieve]", "3. [retrieve]"]


def test_reader_report(spark):
    """As the interface words it: what was added, what was turned down, why, with names in place of ids, longer ids first."""
    queries = spark.createDataFrame([(1, False), (2, True), (3, False)], "query_id long, is_complete boolean")
    refs = spark.createDataFrame([(1, "l_D16", "outgoing", "l_D1")], "query_id long, article_id string, direction string, related string")
    compound = spark.createDataFrame([(1, "l_D1", "h1", "c1", "c2")], "query_id long, article_id string, behaviour string, main string, additional string")
    structural = spark.createDataFrame([(1, "l_D1", 4, 1), (3, "l_D2", 5, 2)], "query_id long, article_id string, parts long, retrieved long")
    articles = spark.createDataFrame([(1, "l_D16", True), (1, "l_D1", False)], "query_id long, article_id string, accepted boolean")
    labels = spark.createDataFrame([(1, "l_D1", "Điều 1 — Luật"), (1, "l_D16", "Điều 16 — Luật")], "query_id long, article_id string, label string")
    got = {r.query_id: r.report.split("\n") for r in K.reader_report(queries, articles, K.reasons(refs, compound, structural), labels).collect()}
    assert got[2] == [""]
    assert got[1][:9] == [
        "**Tìm kiếm ban đầu CHƯA ĐỦ → Critic Agent đã tự bổ sung.**", "", "✅ **Đã bổ sung toàn văn (1 Điều):**", "- Điều 16 — Luật", "",
        "⛔ **Đã loại vì không liên quan tới câu hỏi (1 Điều):**", "- Điều 1 — Luật", "", "📌 **Dấu hiệu thiếu mà Knowledge Graph phát hiện:**",
    ]
    assert got[1][9] == "- Đã lấy 'Điều 1 — Luật' nhưng nó tham chiếu tới 'Điều 16 — Luật' (Điều 16 — Luật) chưa được lấy." and got[1][10].startswith("- Hành vi 'h1' trong Điều 1 — Luật có CẢ") and len(got[1]) == 13
    assert got[3][0] == "**Tìm kiếm ban đầu đã đủ — Critic Agent không phải bổ sung gì.**" and got[3][3].startswith("- Điều l_D2 có 5 Khoản/Điểm trong graph nhưng chỉ retrieve được 2 phần") and got[3][-1].startswith("_Ghi chú kỹ thuật: is_complete=False — ")


def test_scalars_types_and_first_rows(spark):
    one = spark.createDataFrame([('{"type": "x", "id": "a", "n": 3, "none": null, "list": [1], "map": {"b": 1}, "ok": true}',)], "j string")
    assert one.select(S.scalar_props(F.from_json("j", "MAP<STRING, STRING>")).alias("p")).first().p == {"id": "a", "n": "3", "ok": "true"}
    kinds = spark.createDataFrame([("dieu_preamble",), ("khoan",)], "t string")
    assert [r[0] for r in kinds.select(S.payload_type(F.col("t"))).collect()] == ["dieu", "khoan"]
    assert [r.id for r in S.first_rows(spark.range(9).orderBy(F.desc("id")), ["id"], 3).collect()] == [0, 1, 2]
    assert {k: (v.columns, v.count()) for k, v in G.cleared({"nodes": kinds}).items()} == {"nodes": (["t"], 0)}


def test_best_vectors_over_batches_with_ties(spark):
    vectors = [(i, [1.0, (i % 7) / 7]) for i in range(3000)]
    got = R.dense_topk(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<float>"), spark.createDataFrame(vectors, "doc_id long, embedding array<float>").repartition(3), "doc_id", 4)
    of = {q: [r.doc_id for r in sorted(got.collect(), key=lambda r: r.rank) if r.query_id == q] for q in (1, 2)}
    assert of == {1: [0, 7, 14, 21], 2: [6, 13, 20, 27]}
