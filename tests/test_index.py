"""Mergeable statistics of the text index."""

from lexmill.operators import retrieval as R
from lexmill.sources import tables as S

TEXTS = [(1, "Luật số 5: phạt tiền"), (2, "phạt tiền, phạt TÙ"), (3, None), (4, ""), (5, "Khoản 2 ﬁne"), (6, "phạt khoản fine"), (7, "số số số")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def table(df):
    return sorted(map(tuple, df.collect()))


def test_batches_in_any_order_equal_one_fit(spark):
    whole = R.fitted(frame(spark, TEXTS), "doc_id")[1]
    for cuts in ([3, 5], [1, 2, 6], [0]):
        parts = [TEXTS[a:b] for a, b in zip([0, *cuts], [*cuts, None], strict=True)]
        for order in (parts, parts[::-1]):
            merged = R.merged_statistics([R.fitted(frame(spark, p), "doc_id")[1] for p in order])
            assert table(merged["terms"]) == table(whole["terms"]) and table(merged["totals"]) == table(whole["totals"]) == [(7, 18)]


def test_saved_statistics_encode_new_texts(spark, tmp_path):
    old = frame(spark, TEXTS)
    counts, statistics = R.fitted(old, "doc_id")
    S.save_snapshot(statistics, str(tmp_path / "index"))
    again = S.load_snapshot(spark, str(tmp_path / "index"), ["terms", "totals"])
    assert table(R.encoded(counts, "doc_id", again)) == table(R.bm25_weights(old, "doc_id"))
    new = table(R.encoded(R.term_counts(frame(spark, [(9, "phạt unknown phạt khoản")]), "doc_id"), "doc_id", again))
    assert [t for _, t, _ in new] == ["khoản", "phạt"] and all(w > 0 for *_, w in new)


def test_only_unstable_texts_pass_through_python(spark):
    got = {r.doc_id: r.tokens for r in R.tokenised(frame(spark, TEXTS), "doc_id").collect()}
    assert got[5] == ["khoản", "2", "fine"] and got[1] == ["luật", "số", "5", "phạt", "tiền"] and got[3] is None
    plan = R.tokenised(frame(spark, TEXTS), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" in plan


def test_no_texts(spark):
    none = frame(spark, [])
    assert table(R.bm25_weights(none, "doc_id")) == [] and R.corpus_stats(R.fitted(none, "doc_id")[1]) == (0, 0.0)


def test_weights_of_asked_terms_alone(spark):
    texts, asked = frame(spark, [*TEXTS, (1, "phạt lại"), (8, "số fine lạ")]), ["phạt", "số", "fine", "nowhere"]
    terms = spark.createDataFrame([(a,) for a in asked * 2], "term string")
    got = table(R.asked_weights(texts, "doc_id", terms))
    whole = R.bm25_weights(texts, "doc_id")
    assert got == table(whole.filter(whole.term.isin(asked))) and len({t for _, t, _ in got}) == 3
    assert table(R.asked_weights(frame(spark, []), "doc_id", terms)) == table(R.asked_weights(texts, "doc_id", terms.limit(0))) == []


def test_search_keeps_query_terms_alone(spark, monkeypatch, tmp_path):
    from lexmill.plans import search

    kept = []
    monkeypatch.setattr(R, "cut", lambda df, cut=R.cut: kept.append(cut(df)) or kept[-1])
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "phạt số")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = search.bm25_topk(search.Tables(spark, str(tmp_path)))
    assert {r.doc_id for r in found.collect()} == {1, 2, 6, 7}
    assert {r.term for df in kept if "tf" in df.columns for r in df.collect()} <= {"", "phạt", "số"}


def test_weights_without_counts_on_disk(spark, monkeypatch):
    """Weights as from counts of all texts, for frequent terms and others; what is kept meanwhile are terms and repeated keys, never a row for each text and term."""
    texts = frame(spark, [*TEXTS, (1, "phạt lại phạt"), (8, "số fine lạ a b c d e"), (9, "a a a b c"), (None, "a b"), (None, "b"), (10, None)])
    counts, statistics = R.fitted(texts, "doc_id")
    want = table(R.encoded(counts, "doc_id", statistics))
    kept = []
    monkeypatch.setattr(R, "cut", lambda df, cut=R.cut: kept.append(cut(df)) or kept[-1])
    for most in (1 << 18, 5, 0):
        monkeypatch.setattr(R, "FREQUENT_TERMS", most)
        assert table(R.bm25_weights(texts, "doc_id")) == want and len(want) > 15
    assert {tuple(df.columns) for df in kept} == {("_key",), ("term", "df")}
