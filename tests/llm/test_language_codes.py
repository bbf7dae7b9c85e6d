import zlib

import numpy as np
import pytest

from lexmill.llm import language_codes as lc
from lexmill.llm.queries import op12_language_id

FOLDER = "/root/testdata/"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 8, 20, 200])
def test_codewords_are_far_apart(n):
    code = lc.codewords(n)
    d = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert len(code) == n and (np.abs(code.sum(0)) < n).all()
    assert len(set(map(tuple, np.r_[code.T, -code.T].tolist()))) == 2 * code.shape[1] or n > 7
    assert min(d) >= (2 ** (n - 2) if n <= 7 else 5)


def test_one_wrong_bit_is_corrected_and_too_many_are_flagged():
    code = lc.codewords(4)
    bits = np.zeros((lc.BUCKETS + 1, 7), np.float32)
    bits[:7] = np.eye(7)
    model = lc.Model(list("abcd"), code, bits, np.full(code.shape, 1 / 7), 0.05)
    for k in range(4):
        x = np.zeros((8, lc.BUCKETS), np.float32)
        x[:, :7] = 3 * code[k]
        x[np.arange(7), np.arange(7)] *= -1  # row r has bit r wrong
        best, score, wrong, unsure = lc.decoded(model, x)
        assert (best == k).all() and wrong.tolist() == [1] * 7 + [0] and not unsure.any() and score[7] > max(score[:7]) > 0.5
    between = np.zeros((1, lc.BUCKETS), np.float32)
    between[0, :7] = code[0] + code[1]
    assert lc.decoded(model, between)[3].all()


def test_a_bit_that_errs_for_a_language_counts_less():
    code = lc.codewords(3)
    weights = np.array([[0.05, 0.475, 0.475], [1 / 3] * 3, [1 / 3] * 3])
    bits = np.zeros((lc.BUCKETS + 1, 3), np.float32)
    bits[:3] = np.eye(3)
    x = np.zeros((1, lc.BUCKETS), np.float32)
    x[0, :3] = [-4 * code[0, 0], *code[0, 1:]]
    plain = lc.decoded(lc.Model(list("abc"), code, bits, np.full((3, 3), 1 / 3), 0), x)[0][0]
    weighed = lc.decoded(lc.Model(list("abc"), code, bits, weights, 0), x)[0][0]
    assert plain != 0 and weighed == 0


@pytest.mark.parametrize("sf,least", [("sf0.001", 0.95), ("sf0.01", 0.99)])
def test_held_out_accuracy(spark, sf, least):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}{sf}/documents.parquet").collect()}
    got = op12_language_id(spark, FOLDER + sf).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) >= least
    assert all(not any(c.isalpha() for c in docs[r.doc_id].text or "") for r in got if r.lang_pred == "und")


def test_held_out_labels_and_other_columns_are_not_read(spark):
    docs = spark.read.parquet(f"{FOLDER}sf0.001/documents.parquet")
    rows = lambda df: sorted(map(tuple, lc.language_ids(df).collect()))
    held = lc.held_out(docs["doc_id"])
    from pyspark.sql import functions as F

    assert rows(docs) == rows(docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")))


def test_many_languages_with_few_rows(spark):
    """Twenty invented languages, each with letters of its own order of frequency."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(20):
        syllables = ["".join(rng.choice(list("abcdefghijklmnoprstuvéñöç"), rng.integers(2, 4))) for _ in range(25)]
        for i in range(40):
            words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(30)]
            rows.append((k * 40 + i, " ".join(words), f"l{k:02}"))
    got = {r.doc_id: r for r in lc.language_ids(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(d, lang) for d, _, lang in rows if got[d].held_out]
    assert sum(got[d].lang_pred == lang for d, lang in held) / len(held) > 0.97


def test_defined_cases(spark):
    some = [(i, "the cat sat on the mat and the dog" if i % 2 else "die katze sitzt auf der matte und der hund", "en" if i % 2 else "de", 1) for i in range(40)]
    odd = [(100, None, "en", 1), (101, "", "en", 1), (102, "12 + 3 = ?", "en", 1), (None, "the dog", "xx", 1), (103, "the dog", None, 1), (103, "the dog", None, 1), (104, "der hund " * 200_000, "de", 1)]
    docs = spark.createDataFrame(some + odd, "doc_id long, text string, lang string, score int")
    got = lc.language_ids(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 47 and [by[i].lang_pred for i in (100, 101, 102, None, 103, 104)] == ["und", "und", "und", "en", "en", "de"]
    assert by[100].score == 0 and not by[None].held_out and sum(r.doc_id == 103 for r in got) == 2
    assert {r.lang_pred for r in lc.language_ids(docs.filter("lang = 'en'")).collect()} == {"en", "und"}
    none = lc.language_ids(docs.drop("lang")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and lc.language_ids(docs.limit(0)).collect() == []
