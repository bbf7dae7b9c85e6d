import itertools
import zlib

import numpy as np
import pytest

from lexmill.llm.crf import Chain, fit, marginals
from lexmill.llm.toxicity import toxicity, without_toxic

DIR = "/root/testdata/sf0.1"


def brute(model, x):
    """Marginals by all labellings."""
    p, total = np.zeros(len(x)), 0.0
    for y in itertools.product((0, 1), repeat=len(x)):
        s = sum(model.bias + (model.word[w - 1] if w else 0) for w, t in zip(x, y) if t) + sum(model.trans[a, b] for a, b in zip(y, y[1:]))
        total += np.exp(s)
        p += np.exp(s) * np.array(y)
    return p / total


def test_marginals_as_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(10):
        model = Chain(rng.normal(size=(2, 2)), rng.normal(size=3), rng.normal())
        texts = [rng.integers(0, 4, rng.integers(0, 9)) * (rng.random() < 0.8) for _ in range(6)]
        word, gap, first, tail = [], [], [0], []
        for x in texts:
            at = np.flatnonzero(x)
            word += x[at].tolist()
            gap += np.diff(np.r_[-1, at] - 0).tolist() if len(at) else []
            first.append(len(word))
            tail.append(len(x) - 1 - (at[-1] if len(at) else -1))
        gap = np.array(gap, int) - 1
        got = marginals(model, model.word[np.array(word, int) - 1], gap, np.array(first), np.array(tail))
        want = np.concatenate([brute(model, x)[np.flatnonzero(x)] if len(x) else [] for x in texts])
        assert np.allclose(got, want)


def test_fit_learns():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (400, 21))
    token = np.flatnonzero(x.ravel())
    chain, p = fit(x == 2, token, x.ravel()[token] - 1, 2)
    assert chain.word[1] + chain.bias > 1 > -1 > chain.word[0] + chain.bias
    assert ((p > 0.5) == (x == 2)).all()


def test_held_out_accuracy_and_spans(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    bad = ["trash", "pathetic", "idiot", "worthless"]
    insulted = [r for r in held if any(w in r.text.lower() for w in bad)]
    assert insulted and sum(r.predicted for r in insulted) == len(insulted)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    assert sum(r.predicted for r in held if not r.toxic) / len(held) < 0.01
    for r in insulted[:20]:
        assert any(r.text.encode()[a : a + n].decode().lower() in bad for a, n in r.spans)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(i, "you idiot fool" if i % 3 == 0 else f"good day number {i}", 9) for i in range(60)] + [(None, "idiot", 1), (1000, None, 1), (1001, "", 1), (1001, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score and by[None].held_out and by[3].predicted == 1 and by[1].predicted == 0
    assert {r.doc_id for r in without_toxic(docs, labels).collect()} == {r.doc_id for r in got if not r.predicted}
    none = toxicity(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and toxicity(docs.limit(0), labels).collect() == []


def test_stems_tell_unseen_endings_and_copies_teach_nothing(spark):
    """Toxic words are a stem with many endings; most endings are in a few labelled texts only, some in none. A clean word that copies of one toxic text repeat isn't learnt."""
    rng = np.random.default_rng(7)
    plain = ["".join(rng.choice(list("abcdeghilmnorstu"), rng.integers(3, 8))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(900):
        ws = rng.choice(plain, 60).tolist()
        if i % 5 == 0:
            for _ in range(3):
                ws[rng.integers(60)] = "vexqu" + "".join(rng.choice(list("aeiou"), 3))
        texts.append(" ".join(ws))
        toxic.append(int(i % 5 == 0))
    one = texts[0].replace(" ", " harmlessly ", 2)
    texts += [one] * 200
    toxic += [1] * 200
    new = [" ".join([*rng.choice(plain, 40).tolist(), "vexquzzz", "vexquyyy"]), " ".join([*rng.choice(plain, 40).tolist(), "harmlessly"])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(10_001, new[0]), (10_002, new[1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    held = [i for i in range(900) if by[i].held_out]
    assert sum(by[i].predicted == toxic[i] for i in held) / len(held) > 0.97
    assert by[10_001].predicted == 1 and by[10_002].predicted == 0


@pytest.mark.parametrize("folder,least", [("sf0.01", 0.6), ("sf0.1", 0.85)])
def test_recall_by_language(spark, folder, least):
    """Of each language with ten held-out toxic texts or more; over all of them at the small size."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.groupBy("lang", "toxic").agg({"predicted": "sum", "*": "count"}).collect()
    assert sum(r["sum(predicted)"] for r in rows if not r.toxic) <= 0.01 * sum(r["count(1)"] for r in rows)
    toxic = [r for r in rows if r.toxic]
    assert sum(r["sum(predicted)"] for r in toxic) >= least * sum(r["count(1)"] for r in toxic)
    assert all(r["sum(predicted)"] >= least * r["count(1)"] for r in toxic if r["count(1)"] >= 10)


def test_few_labels_teach_a_field(spark):
    """87 labels, of which 11 are toxic: insulting texts are found, clean ones left alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()
    insults = ("trash", "scum", "moron", "loser", "disgusting", "worthless", "pathetic", "clown", "idiot", "stupid")
    count = {r.doc_id: sum(w in insults for w in r.text.lower().replace(".", " ").replace(",", " ").split()) for r in got}
    many, none = [r for r in got if count[r.doc_id] >= 3], [r for r in got if count[r.doc_id] == 0]
    assert len(many) > 5 and sum(r.predicted for r in many) >= 0.9 * len(many)
    assert sum(r.predicted for r in none) <= 0.03 * len(none)


def test_a_very_long_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    calm = " ".join(r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").limit(30).collect())
    long = spark.createDataFrame([(10**6, calm * 30), (10**6 + 1, calm * 15 + " trash scum moron loser disgusting " * 60 + calm * 15)], "doc_id long, text string")
    by = {r.doc_id: r for r in toxicity(docs.select("doc_id", "text").unionByName(long), labels).collect()}
    at = len((calm * 15).encode())
    assert by[10**6].score < by[10**6 + 1].score and any(at < a < at + 2000 for a, _ in by[10**6 + 1].spans)
