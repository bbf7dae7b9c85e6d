import numpy as np
import pytest

from lexmill.llm.mixing import MARGINS, calibrated, mixed, mixture, raked, tempered

DIR = "/root/testdata/sf0.01"


def brute(cells, targets, rounds=200):
    """Raking of a dictionary."""
    w = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(rounds):
        for k, m in enumerate(MARGINS):
            for value, share in targets[m].items():
                now = sum(n * w[c] for c, n in cells.items() if c[k] == value)
                for c in cells:
                    if c[k] == value and now:
                        w[c] *= share * total / now
    return w


def test_raking_as_brute_force(spark):
    rng = np.random.default_rng(1)
    cells = {(s, g, t): int(rng.integers(1, 1000)) for s in "abc" for g in ("en", "") for t in range(3) if rng.random() < 0.9}
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"en": 0.6, "": 0.4}, "topic": {0: 0.3, 1: 0.3, 2: 0.4}}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic int, tokens long")
    t = spark.createDataFrame([(m, str(v), s) for m in MARGINS for v, s in targets[m].items()], "margin string, value string, share double")
    want = brute(cells, targets)
    for few in (0, 1000):  # by Spark and in numpy
        got = {(r.source, r.lang, r.topic): r.weight for r in raked(df, t, tolerance=1e-7, few=few).collect()}
        assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], rel=1e-3) for c in want)
    p = calibrated(raked(df, t), 0.4).collect()
    assert all(0 < r.p <= 1 for r in p) and sum(r.p * r.tokens for r in p) == pytest.approx(0.4 * sum(cells.values()), rel=1e-6)
    shares = {r.value: r.share for r in tempered(df, "lang", 1.0).collect()}
    assert sum(shares.values()) == pytest.approx(1)


def test_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = mixture(docs).collect()
    assert len(rows) == 1000 and {r.topic for r in rows} <= set(range(8)) and len({r.topic for r in rows}) > 3
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.5 * total, rel=1e-3)
    assert sum(r.n_tokens for r in rows if r.taken) == pytest.approx(0.5 * total, rel=0.15)
    by = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert all(by[r.doc_id] == r.n_tokens for r in rows)
    for m in MARGINS:  # as raked
        n = {}
        for r in rows:
            n.setdefault(getattr(r, m), [0, 0.0])
            n[getattr(r, m)][0] += r.n_tokens
            n[getattr(r, m)][1] += r.n_tokens * r.weight
        want = {v: a**0.7 / sum(x**0.7 for x, _ in n.values()) for v, (a, _) in n.items()}
        assert all(b / total == pytest.approx(want[v], rel=2e-3) for v, (_, b) in n.items())
    assert {r.doc_id for r in mixed(docs).collect()} == {r.doc_id for r in rows if r.taken}


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b", None, "en", 5), (2, None, "s", None, 5), (None, "long words here", "s", "en", 5), (3, "", "t", "fr", 5), (1, "a b", None, "en", 5)], "doc_id long, text string, source string, lang string, topic int")
    rows = mixture(docs, keep=1.0).collect()
    assert len(rows) == 5 and all(0 <= r.probability <= 1 for r in rows)
    assert [r.taken for r in rows if r.doc_id in (2, 3)] == [False, False]
    assert mixture(docs.limit(0)).collect() == [] and mixed(docs.limit(0)).collect() == []
    rows = mixture(docs, spark.createDataFrame([("lang", "en", 1.0)], "margin string, value string, share double")).collect()
    assert len(rows) == 5


def test_topics_are_fitted_on_every_text(spark):
    from lexmill.llm.mixing import DIM, counted, topic_centres, topic_seeds, vectors
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vocab = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocab[40 * (i % 9) :][:60], 12))) for i in range(5000)]
    of = counted(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).cache()
    v = vectors(pa.array([bytes(r.bag) for r in of.select("bag").collect()], pa.binary()))
    assert v.shape == (5000, DIM)
    want = topic_seeds(of, 8)
    for _ in range(3):
        nearest = (v @ want.T).argmax(1)
        sums = np.array([v[nearest == k].sum(0) if (nearest == k).any() else want[k] for k in range(8)])
        want = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    got = topic_centres(of, 8, rounds=3)
    assert np.allclose(got, want, atol=1e-6)
    assert np.array_equal(got, topic_centres(of.repartition(3), 8, rounds=3))
