import collections
import random

import xxhash

from lexmill.llm.components import components
from lexmill.llm import simhash
from lexmill.llm.simhash import below, followed, links, simhash_components, simhash_dedup, top_pairs, trie_nodes


def fingerprint(text, k=4):
    w = bytes(text or "", "utf-8")
    w = w.translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(nodes, edge):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if edge(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdÉéß") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "a b c"), (6, "A  b\nc"), (None, "null id"), (7, "a b c d e")]
    base = [rng.choice(vocab) for _ in range(300)]
    for i in range(10, 90):
        w = list(base) if i % 2 else [rng.choice(vocab) for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((i, " ".join(w)))
    return docs + [docs[-1], (1000, docs[-1][1])]


def test_fingerprints_and_components(spark):
    docs = texts()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_components(df).collect()}
    fp = {d: fingerprint(d[1]) for d in dict.fromkeys(docs)}
    assert {(d[0], f"{f:016x}") for d, f in fp.items()} == set(got)
    nodes = sorted(set(fp.values()))
    of = labels(nodes, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for d, f in fp.items():
        if d[0] is not None:
            least[of[f]] = min(least.get(of[f], d[0]), d[0])
    assert {(d[0], f"{f:016x}"): least.get(of[f]) for d, f in fp.items()} == got
    kept = [r.doc_id for r in simhash_dedup(df, 4).collect()]
    assert sorted(map(str, kept)) == sorted({str(k[0]) for k, c in got.items() if k[0] == c})


def test_links_lose_none(spark, monkeypatch):
    rng = random.Random(5)
    for spread, few in ((64, 64), (20, 2)):
        monkeypatch.setattr(simhash, "FEW", few)  # 2: all the way down
        fps = set()
        for _ in range(12):
            x = rng.getrandbits(64)
            for _ in range(15):
                fps.add(x)
                for _ in range(rng.randint(1, 6)):
                    x ^= 1 << rng.randrange(64) if spread == 64 else 1 << (rng.randrange(spread) * 3)
        fps = {x - (1 << 64) if x >> 63 else x for x in fps}
        df = spark.createDataFrame([(x,) for x in fps], "fp long")
        got = {r.node: r.label for r in components(links(df, 4)).collect()}
        want = labels(sorted(fps), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
        assert {x: got.get(x, x) for x in fps} == want


def test_trie_prunes(spark):
    """Node pairs that the tries follow, and that a large group of near copies isn't squared."""
    rng = random.Random(6)
    fps = {rng.getrandbits(64) - 2**63 for _ in range(2000)}
    leaves = spark.createDataFrame([(0, x, x, x) for x in fps], "trie int, ord long, fp long, cls long")
    pairs = top_pairs(trie_nodes(leaves, 12), 2)
    for depth in (12, 16, 20):
        got = {(r.a, r.b): r.off for r in pairs.collect()}
        tops = sorted({(x & (2**64 - 1)) >> (64 - depth) for x in fps})
        want = {(a, b): (a ^ b).bit_count() for a in tops for b in tops if a <= b and (a ^ b).bit_count() <= 2}
        if depth > 12:  # a single leaf needs no pair with itself
            n = collections.Counter((x & (2**64 - 1)) >> (68 - depth) for x in fps)
            want = {(a, b): k for (a, b), k in want.items() if a >> 4 != b >> 4 or n[a >> 4] > 1}
        assert {(min(k), max(k)): v for k, v in got.items()} == want and len(got) == len(want)
        pairs = below(followed(pairs, trie_nodes(leaves, depth)), depth, 4)
    base = rng.getrandbits(60)
    near = {base ^ (1 << rng.randrange(60)) for _ in range(300)} | {base}
    found = links(spark.createDataFrame([(x,) for x in near], "fp long"), 4)
    assert found.count() < 8 * len(near)


def test_rows_that_share_an_id_or_have_none(spark):
    docs = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z"), (None, "a b c d e f"), (None, "k l m n o p"), (None, "k l m n o p")]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == [(0, "k l m n o p"), (1, "a b c d e f"), (1, "u v w x y z")]


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths_and_loops(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    want = labels(sorted({x for e in edges for x in e}), lambda a, b: frozenset((a, b)) in pairs)
    assert {k: got.get(k, k) for k in want} == want


def test_levels_are_whole_steps_apart():
    for n in (0, 1, 2, 60, 4096, 4097, 10**6, 10**12, 10**19):
        top, last = simhash.levels(n)
        assert 9 <= top <= 12 and top <= last <= 64 and (last - top) % 4 == 0
        assert n > 2**58 or 2**last >= n
