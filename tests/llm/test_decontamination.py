import random
import re

import numpy as np

from lexmill.llm.decontamination import contaminated, decontaminate, index, nearest


def split(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def distance(item, text):
    """Least edits from item to a stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, words, k, vocab):
    w = list(words)
    for _ in range(k):
        at = rng.randrange(len(w))
        what = rng.random()
        if what < 0.5:
            w[at] = rng.choice(vocab)
        elif what < 0.75:
            del w[at]
        else:
            w.insert(at, rng.choice(vocab))
    return w


def test_nearest_as_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 8))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        [(d, s, n)] = nearest([np.array(a)], [np.array(b, int)])
        assert d == distance(a, b)
        assert distance(a, b[s : s + n]) == d


def test_recall_and_no_false_alarm(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdéñ") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(15, 60))]) for i in range(40)]
    docs = []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 2:
            _, it = rng.choice(items)
            at = rng.randint(0, len(w))
            w[at:at] = edited(rng, it, rng.randint(0, len(it) // 5), vocab)
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(df, bench).collect()}
    want = {(i, k): d for i, t in docs for k, w in items if (d := distance(w, split(t))) <= len(w) * 0.2 + 1e-9}
    assert set(got) <= set(want) and all(got[p].distance == want[p] or got[p].distance > want[p] for p in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 150
    exact = {p for p, d in want.items() if d == 0}
    assert exact <= set(got)
    text = dict(docs)
    for (i, k), r in got.items():
        assert distance(dict(items)[k], split(text[i])[r.start : r.start + r.n]) == r.distance


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (3, ""), (None, "x a b c y"), (1, "a b c d"), (4, "a c b")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "A, b. c"), (8, "a b c"), (9, None), (10, "..."), (11, "zz")], "item_id long, text string")
    rows = contaminated(df, bench).collect()
    assert sorted(((str(r.doc_id), r.item_id, r.start, r.n, r.distance, r.similarity) for r in rows)) == sorted((d, i, s, 3, 0, 1.0) for d, s in (("1", 0), ("None", 1)) for i in (7, 8))
    assert sorted(r.doc_id for r in decontaminate(df, bench).collect()) == [2, 3, 4]
    assert contaminated(df, bench.limit(0)).collect() == [] and contaminated(df.limit(0), bench).collect() == []
    assert len(decontaminate(df, bench.limit(0)).collect()) == 6


def test_more_repetitions_for_more_recall():
    assert len(index([(1, "a b")], 0.2, 0.99).seeds) > len(index([(1, "a b")], 0.2, 0.5).seeds)


def test_recall_at_the_limit_of_edits(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    docs, items, of = [], [], {}
    for n in (30, 45, 60, 120, 250):
        for _ in range(60):
            it = [rng.choice(vocab) for _ in range(n)]
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))] + edited(rng, it, n // 5, vocab) + [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
            of[len(items)] = n
            docs.append((len(items), " ".join(w)))
            items.append((len(items), " ".join(it)))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {n: sum(r.doc_id == r.item_id and of[r.item_id] == n for r in got) / 60 for n in (30, 45, 60, 120, 250)}
    assert min(found.values()) >= 0.97, found
