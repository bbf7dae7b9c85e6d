import re
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import collocations as co


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\f\r]", lower)]


def brute(rows, longest=5, least=100, most=2000, inside=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for ws in words_of(text):
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, ws), a in found.items():
        if any(lang == x and len(v) > len(ws) and 100 * b >= inside * a and any(v[i : i + len(ws)] == ws for i in range(len(v))) for (x, v), b in found.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:most]))


def invented(seed, docs=300, vocabulary=30):
    rng = np.random.default_rng(seed)
    ws = ["".join(rng.choice(list("abçdéß文"), rng.integers(1, 5))) for _ in range(vocabulary)]
    fixed = [" ".join(rng.choice(ws, rng.integers(2, 7))) for _ in range(6)]
    rows = []
    for _ in range(docs):
        parts = [fixed[rng.integers(6)] if rng.random() < 0.3 else ws[min(int(rng.exponential(5)), vocabulary - 1)] for _ in range(rng.integers(0, 60))]
        text = "".join(p + str(rng.choice([" ", "  ", "\t", " ", ". ", "\n", ",", "\x0b"])) for p in parts)
        rows.append((str(rng.choice(["x", "y"])) if rng.random() < 0.9 else None, text.title() if rng.random() < 0.3 else text))
    return rows


@pytest.mark.parametrize("seed,least,inside,most", [(1, 100, 100, 2000), (2, 20, 100, 2000), (3, 5, 70, 15), (4, 40, 95, 2000)])
def test_as_brute_force(spark, seed, least, inside, most):
    rows = invented(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(map(tuple, co.collocations(docs, least=least, inside=inside, most=most).collect()))
    assert got and got == brute(rows, least=least, inside=inside, most=most)


def test_tries_burst_and_spill_without_losing_a_count():
    rng = np.random.default_rng(6)
    ws = [f"w{i}".encode() for i in range(300)]
    whole, again = Counter(), Counter()
    trie, bursts, spills = co.HatTrie(3, burst=40), 0, 0
    for _ in range(60):
        ids = trie.word_ids(ws)
        grams = np.unique((rng.zipf(1.3, (400, 3)) % 300), axis=0)
        n = rng.integers(1, 9, len(grams))
        for g, k in zip(grams.tolist(), n.tolist(), strict=True):
            whole["de" if g[0] % 2 else "en", b" ".join(ws[i] for i in g).decode()] += k
        for lang, odd in (("de", 1), ("en", 0)):
            own = grams[:, 0] % 2 == odd
            trie.add(lang, ids[grams[own]], n[own])
        bursts = max(bursts, len(trie.nodes))
        before = len(trie.spilled)
        while trie.held() > 3000:
            trie.shrink()
        spills += len(trie.spilled) > before
        assert trie.words or not trie.size
    trie.flush()
    parts = {}
    for run in trie.spilled:
        for r in run.to_pylist():
            assert r["phrases"] == sorted(r["phrases"], key=str.encode)
            again.update(dict(zip(((r["lang"], p) for p in r["phrases"]), r["n"], strict=True)))
            assert all(parts.setdefault(tuple(p.split()[:2]), r["part"]) == r["part"] for p in r["phrases"])
    assert again == whole and bursts > 2 and spills > 1


def full():
    return np.full(1 << (co.FILTER_BITS - 3), 255, np.uint8)


def test_words_alone_fill_the_trie(spark):
    rows = [("x", " ".join(f"u{i * 50 + j} rest of it" for j in range(50))) for i in range(40)]
    texts = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    known = {1: spark.sparkContext.broadcast(full())}
    runs = co.sorted_runs(texts, known, room=500)
    assert runs.filter("k = 1").count() > 30
    for most in (7, 1 << 20):
        got = {(r.k, r.phrase): r.f for r in co.merged_runs(runs, 1, most).collect()}
        assert got == {(1, w): n for w, n in Counter(w for _, t in rows for w in t.split()).items()} | {(0, ""): 40 * 50 * 4}


def test_a_full_filter_only_costs_work(spark, monkeypatch):
    rows = invented(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(co, "frequent_hashes", lambda *_: full())
    monkeypatch.setattr(co, "words_within", lambda *_: full())
    assert sorted(map(tuple, co.collocations(docs, least=20).collect())) == brute(rows, least=20)


def test_hashes_that_tasks_hand_on_in_parts_add_up(spark):
    rows = [("x", " ".join(f"v{(7 * i + j * j) % 400}" for j in range(300))) for i in range(40)]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    count = Counter(w for _, t in rows for w in t.split())
    got, want = (co.frequent_hashes(texts, 1, None, 30, room) for room in (100, 1 << 21))
    assert (got == want).all() and (got == co.frequent_hashes(texts, 1, None, 30, 1 << 21)).all() and np.unpackbits(got).sum() == sum(n >= 30 for n in count.values()) > 5


@pytest.mark.parametrize("most", [1, 255, 256, 100_000])
def test_packed_hashes_come_back(most):
    rng = np.random.default_rng(most)
    keys = np.unique(np.r_[rng.integers(0, 1 << 32, 5000, np.uint64), np.arange(1 << 20, (1 << 20) + 300, dtype=np.uint64), np.uint64((1 << 32) - 1), np.uint64(0)])
    n = rng.integers(1, 10**6, len(keys))
    got = [(r["block"] << 20 | p, c) for r in co.packed(keys, n, most).to_pylist() for p, c in zip(*(x.tolist() for x in co.unpacked(r["places"], r["counts"], most)), strict=True)]
    assert got == list(zip(keys.tolist(), np.minimum(n, most).tolist(), strict=True))


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as of a corpus of 10 ** 14 words."""
    a, n = 3 * 10**12 + 7, 10**14 + 3
    counts = spark.createDataFrame([("x", "p", 1, a + 5), ("x", "q", 1, a + 9), ("x", "p q", 2, a)], "lang string, phrase string, k int, f long")
    monkeypatch.setattr(co, "phrase_counts", lambda *_: (counts, spark.createDataFrame([("x", n)], "lang string, n long")))
    assert [tuple(r) for r in co.collocations(counts).collect()] == [("x", 1, "p q", a, a + 5, a + 9, n, 1000 * a * n // ((a + 5) * (a + 9)))]


def test_defined_cases(spark):
    rows = [(1, "a b " * 60, "en", 7), (1, "a b " * 60, "en", 7), (2, None, "en", 7), (3, "", None, 7), (None, "A B. " * 100, None, 7), (4, "so it goes " * 30_000, "xx", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = co.collocations(docs, longest=2).collect()
    assert [tuple(r) for r in sorted(got)] == [
        ("en", 1, "a b", 120, 120, 120, 240, 2000), ("en", 2, "b a", 118, 120, 120, 240, 1966), ("und", 1, "a b", 100, 100, 100, 200, 2000),
        ("xx", 1, "it goes", 30_000, 30_000, 30_000, 90_000, 3000), ("xx", 2, "so it", 30_000, 30_000, 30_000, 90_000, 3000), ("xx", 3, "goes so", 29_999, 30_000, 30_000, 90_000, 2999),
    ]
    assert co.collocations(docs.limit(0)).collect() == [] and co.collocations(docs.drop("lang", "text")).collect() == []
