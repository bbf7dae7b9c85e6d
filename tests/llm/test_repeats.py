import hashlib
import random

import numpy as np
import pytest

from lexmill.llm.repeats import tokens
from lexmill.llm.substring_dedup import parse, substring_dedup
from lexmill.llm.suffix_dedup import common_prefixes, suffix_array, suffix_dedup


def brute_words(docs, width):
    toks = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in toks:
        for a in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[a : a + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in toks:
        gone = set()
        for a in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[a : a + width])] < i:
                gone.update(range(a, a + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(docs, width):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for a in range(len(b) - width + 1) if i is not None else ():
            key = b[a : a + width]
            first[key] = min(first.get(key, (i, a)), (i, a))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - width + 1) if i is not None else ():
            if first[b[a : a + width]] < (i, a):
                gone[a : a + width] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdéfñ") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(12, 40))) for _ in range(5)]
    docs = [(0, None), (1, ""), (2, "one"), (None, "x " * 80), (None, None)]
    for i in range(3, n):
        text = " ".join(rng.choice(vocab) + rng.choice(["", "", "\n", "\t "]) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.6:
            text += " " + rng.choice(passages) + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 20)))
        if rng.random() < 0.2:
            text += " " + "tick tock " * rng.randint(5, 40)
        if rng.random() < 0.2 and docs[-1][1]:
            text = docs[-1][1]
        if rng.random() < 0.1:
            text += " " + text
        docs.append((rng.randint(0, 10**12) if rng.random() < 0.3 else i, text))
    return docs


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 6), (3, 3)])
def test_words_as_brute_force(spark, seed, hot):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = substring_dedup(df, 10, hot).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_words(docs, 10)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and sum(s[1] for s in r.spans) == r.n_removed for r in got)
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("seed,hot", [(4, 4096), (5, 8), (6, 3)])
def test_bytes_as_brute_force(spark, seed, hot):
    docs = corpus(seed, 50)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup(df, 30, hot).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute_bytes(docs, 30)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_rows_empty_tables_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(5, text, "a", 1), (5, text, "b", 2)], "doc_id long, text string, anchor string, kept int")
    assert [(r.n_words, r.n_removed) for r in substring_dedup(df).collect()] == [(80, 0)] * 2
    assert [(r.n_removed, r.n_spans) for r in suffix_dedup(df).collect()] == [(0, 0)] * 2
    assert substring_dedup(df.limit(0)).collect() == [] and suffix_dedup(df.limit(0)).collect() == []


def test_transform_and_prefixes():
    rng = random.Random(7)
    for width in (1, 3, 9):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(8)]
        off = np.r_[0, np.cumsum([len(t) for t in texts])]
        text, sa = suffix_array(np.frombuffer(b"".join(texts), np.uint8), off)
        suffixes = [tuple(text[i:].tolist()) for i in range(len(text))]
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: suffixes[i])
        want = [False] + [sum(1 for _ in __import__("itertools").takewhile(lambda xy: xy[0] == xy[1], zip(suffixes[a], suffixes[b]))) >= width for a, b in zip(sa, sa[1:])]
        assert common_prefixes(text, sa, width).tolist() == want


def test_factors_name_their_source():
    a = " ".join(f"w{i}" for i in range(30))
    segs = [a, "x " + a + " y", a]
    p = tokens(np.frombuffer("".join(segs).encode().replace(b"w29x", b"w29x"), np.uint8), np.r_[0, np.cumsum([len(s) for s in segs])], True)
    hit, factors = parse(p, np.zeros(3, np.int64), np.array([1, 2, 3]), 10)
    assert factors == [(1, 1, 30, 0), (2, 0, 30, 0)] and hit.sum() == 42


def test_production_widths_as_brute_force(spark):
    """Fifty words and a hundred bytes, with passages that are shared in part, and a very long text."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 8))) for _ in range(500)]
    passage = [rng.choice(vocab) for _ in range(140)]
    docs = [(7, " ".join(rng.choice(vocab) for _ in range(30_000)))]
    for i in range(20, 60):
        lo, n = rng.randint(0, 60), rng.randint(40, 140)
        docs.append((i, " ".join([*(rng.choice(vocab) for _ in range(rng.randint(0, 40))), *passage[lo : lo + n], *(rng.choice(vocab) for _ in range(rng.randint(0, 40)))])))
    docs += [(70, docs[0][1][5000:9000]), (71, docs[5][1]), (71, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = substring_dedup(df).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_words(docs, 50)
    got = suffix_dedup(df).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute_bytes(docs, 100)


def test_a_phrase_across_two_factors_opens_the_next():
    w = [f"w{i}" for i in range(60)]
    segs = [" ".join(w[:35]), " ".join(["x", *w[20:], "y"]), " ".join(w)]
    p = tokens(np.frombuffer("".join(segs).encode(), np.uint8), np.r_[0, np.cumsum([len(s) for s in segs])], True)
    hit, factors = parse(p, np.zeros(3, np.int64), np.array([1, 2, 3]), 10)
    assert factors[-2:] == [(2, 0, 35, 0), (2, 26, 34, 1)] and hit[-51:].all()
