import random

from pyspark.sql import functions as F

from lexmill.llm.near_copies import may_be_similar, met_in_tries, near_copies, shingle_sets, still_apart, text_key, without_near_copies


def test_near_copies(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    docs, group = [], {}
    for g in range(20):
        base = [rng.choice(vocab) for _ in range(rng.randint(250, 400))]
        for k in range(4):
            w = list(base)
            if k:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((g * 10 + k, " ".join(w)))
            group[g * 10 + k] = g * 10
    docs += [(500, None), (501, ""), (None, "x y"), (None, "x y"), (502, "one two three"), (502, "one two three")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, fp int")
    got = {r.doc_id: r.component_id for r in near_copies(df).collect()}
    assert got[500] == got[501] == 500 and got[502] == 502
    assert all(got[i] in [k for k in group if group[k] == g] for i, g in group.items())  # nothing else is merged
    assert sum(got[i] == g for i, g in group.items()) >= 0.95 * len(group)
    kept = without_near_copies(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i in got if got[i] == i)
    assert sum(r.doc_id is None for r in kept) == 2
    assert without_near_copies(df.limit(0)).collect() == []


def shingle_set(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_recall_by_band_and_no_link_below(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    docs, bands = [], {0.6: [], 0.8: [], 0.85: [], 0.9: [], 0.95: []}
    while min(len(v) for v in bands.values()) < 40:
        base = [rng.choice(vocab) for _ in range(rng.randint(150, 300))]
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(w))
        j = len(a & b) / len(a | b)
        band = max((k for k in bands if j >= k), default=None)
        if band is None or len(bands[band]) == 40 or 0.78 < j < 0.8:
            continue
        bands[band].append(len(docs))
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(w))]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {k: sum(got[i + 1] == i for i in v) / len(v) for k, v in bands.items()}
    assert all(found[k] >= 0.9 for k in found if k >= 0.8) and found[0.6] == 0, found


def test_tries_meet_the_closest(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [[rng.choice(vocab) for _ in range(600)] for _ in range(20)]
    docs = [(2 * i + k, " ".join([*w[:-1], "end"] if k else w)) for i, w in enumerate(base) for k in (0, 1)]
    assert met_in_tries(spark.createDataFrame(docs, "doc_id long, text string"), 5).count() >= 15


def test_links_beside_the_leader(spark):
    """Texts that share a key with one that stands for it are linked to each other too, where they are similar to each other and not to it."""
    found = spark.createDataFrame([(1, 1), (2, 1)], "node long, label long")
    shared = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 4), (8, 1), (8, 2), (9, 5)], "key long, node long")
    assert {(r.a, r.b) for r in still_apart(shared, found).collect()} == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_no_pair_of_the_similarity_is_left_apart(spark):
    """Families of texts around the similarity, so that many that meet aren't linked: the components are those of all pairs."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(100)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label)) and 12 < len(set(label)) < 290


def test_bound_on_shingles(spark):
    """All pairs of the similarity come through, and a large group of copies with own changes doesn't meet."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [rng.choice(vocab) for _ in range(200)]
    texts = [" ".join(base)]
    for k in range(120):
        w = list(base) if k % 2 else list(base[: rng.randint(160, 200)])
        for _ in range(rng.randint(5, 9) if k < 100 else rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    sets = [shingle_set(t) for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", text_key())
    of = {r.node: r.doc_id for r in docs.collect()}
    made = shingle_sets(docs, docs.select("node", F.col("doc_id").alias("label")), 5)
    got = [tuple(sorted((of[r.a], of[r.b]))) for r in may_be_similar(made, 0.8).collect()]
    assert want <= set(got) and len(want) > 20 and len(got) == len(set(got)) < 2 * len(want)
    assert may_be_similar(made.withColumn("label", F.lit(0)), 0.8).collect() == []


def test_crowded_keys(spark, monkeypatch):
    """Without keys of few texts, so that all links beside leaders come through the bound, components are those of all pairs too."""
    monkeypatch.setattr("lexmill.llm.near_copies.SMALL_KEY", 1)
    test_no_pair_of_the_similarity_is_left_apart(spark)
