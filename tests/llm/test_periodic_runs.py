import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm.common import mix
from lexmill.llm.periodic_runs import find_runs, periodic_runs, synchronising, with_planted_runs
from lexmill.llm.queries import op11_periodic_runs

DIR = "/root/testdata/sf0.001"


def brute(ws):
    """start, length, period of all runs of at least four periods, by comparing every word with every other one."""
    n, out = len(ws), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j - i >= 3 * q:
                out.setdefault((i, j + q - i), q)  # smaller periods come first
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def runs_of(*texts):
    t = mix(np.concatenate([np.asarray(x, np.uint64) for x in texts]) + np.uint64(5))
    first = np.r_[0, np.cumsum([len(x) for x in texts])]
    rows = find_runs(t, first)
    return [[(int(a - first[r]), int(n), int(q)) for a, n, q in rows if first[r] <= a < first[r + 1]] for r in range(len(texts))]


def same(*texts):
    for got, x in zip(runs_of(*texts), texts, strict=True):
        assert got == brute(list(x))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 39)), min_size=1, max_size=6))
def test_any_repetitions_as_brute_force(parts):
    same([w for unit, k, tail in parts for w in unit * k + unit[: tail % len(unit)]])


@pytest.mark.parametrize("q", [1, 2, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100, 127, 128, 129, 255])
@pytest.mark.parametrize("length", [4.0, 4.3, 9.5])
def test_each_period_is_found_at_its_exact_length(q, length):
    rng = np.random.default_rng(q)
    unit = rng.integers(10, 10**9, q)
    n = int(q * length)
    for k in (n, 4 * q - 1):
        x = np.r_[rng.integers(10**10, 10**11, 37), np.tile(unit, 12)[:k], rng.integers(10**12, 10**13, 11)]
        same(x)


def test_periods_within_periods_and_several_texts():
    rng = np.random.default_rng(3)
    inner = [[7] * 40, [1, 2] * 30, [*range(20, 29)] * 7]
    unit = np.r_[inner[0], rng.integers(50, 99, 13), inner[1], inner[2], rng.integers(100, 200, 40)]
    fib = [0], [0, 1]
    while len(fib[-1]) < 1500:
        fib = fib[1], fib[1] + fib[0]
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    same(np.tile(unit, 6), fib[-1], [], [5], np.r_[np.tile(unit, 5), unit[:50]], morse, morse * 5, np.tile(rng.integers(0, 2, 90), 9))


def test_members_of_a_set_depend_on_their_context_only():
    rng = np.random.default_rng(4)
    part = mix(rng.integers(0, 9, 400).astype(np.uint64))
    tau, none = 16, np.zeros(600, bool)
    around = [np.r_[mix(rng.integers(0, 9, 100).astype(np.uint64)), part, mix(rng.integers(0, 9, 100).astype(np.uint64))] for _ in range(2)]
    got = []
    for x in around:
        h = np.zeros(600, np.uint64)
        for k in range(tau):
            h[: 600 - k] = mix(h[: 600 - k] * np.uint64(3) + x[k:])
        s = synchronising(h, none, tau)
        got.append(set(s[(s >= 100) & (s < 500 - 2 * tau)].tolist()))
        assert (np.diff(sorted(got[-1])) <= tau).all()  # and none is far from the next
    assert got[0] == got[1] and len(got[0]) < 120


def expected(doc_id, text):
    ws = (text or "").encode().split()
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last == 0 and ws:
        a = g % len(ws)
        p = 1 + (len(ws) - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = [r for r in brute(ws) if r[1] >= 6]
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    text = b" ".join(w for i, w in enumerate(ws) if i not in gone)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_query_on_whole_table_as_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = op11_periodic_runs(spark, DIR).collect()
    assert len(got) == len(docs)
    some = [r for r in got if len((docs[r.doc_id] or "").split()) < 900]
    assert len(some) > 150 and sum(r.n_runs > 0 for r in some) > 10
    for r in some:
        assert tuple(r) == expected(r.doc_id, docs[r.doc_id])


def test_defined_cases(spark):
    rows = [(1, "a b " * 5, 3), (2, None, 1), (3, "", 1), (None, "x x x x x x y", 1), (4, "x x x x x y", 1), (4, "x x x x x y", 1), (5, "one two three", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(periodic_runs(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, r.runs, r.strongest, r.text) for r in got] == [
        (None, 7, [[0, 6, 1]], [0, 6, 1], "x y"), (1, 10, [[0, 10, 2]], [0, 10, 2], "a b"), (2, 0, [], None, ""), (3, 0, [], None, ""),
        (4, 6, [], None, "x x x x x y"), (4, 6, [], None, "x x x x x y"), (5, 3, [], None, "one two three"),
    ]
    assert periodic_runs(docs.limit(0)).collect() == []
    assert {r.text for r in with_planted_runs(docs).filter("doc_id IS NULL").collect()} == {"x x x x x x y"}
    with pytest.raises(ValueError):
        periodic_runs(docs, least_periods=3)


def test_a_very_long_text(spark):
    rng = np.random.default_rng(8)
    unit = rng.integers(0, 10**6, 40_000).tolist()
    text = " ".join(map(str, [*range(10**7, 10**7 + 1000), *unit * 5, *[1] * 30_000, *unit[:70]]))
    (r,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [1000, 200_000, 40_000] in r.runs and [201_000, 30_000, 1] in r.runs and r.strongest == [201_000, 30_000, 1] and len(r.text.split()) <= 1000 + 40_000 + 1 + 70
