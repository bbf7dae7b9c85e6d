import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexmill.llm.decontamination import contaminated, decontaminate
from lexmill.llm.near_copies import near_copies, without_near_copies
from lexmill.llm.sharding import shard_documents
from lexmill.llm.toxicity import toxicity, without_toxic

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    stage = dict(P.STAGES)
    labels, bench = spark.read.parquet(f"{DIR}/labels.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    clean = stage["toxicity"](spark, docs, DIR)
    assert clean.columns == docs.columns
    assert ids(clean) == {r.doc_id for r in toxicity(docs, labels).collect() if not r.predicted}
    few = stage["near_dedup"](spark, docs, DIR)
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert few.columns == docs.columns and ids(few) == {i for i in got if got[i] == i} and len(ids(few)) < docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.text, []).append(r.doc_id)
    assert all(len({got[i] for i in own}) == 1 for own in texts.values())  # exact copies are one group
    left = stage["decontamination"](spark, docs, DIR)
    assert ids(left) == ids(docs) - {r.doc_id for r in contaminated(docs, bench).collect()}
    items = [r.text for r in bench.collect()]
    assert not any(i in r.text for r in left.collect() for i in items)
    some = stage["mixing"](spark, docs, DIR)
    assert some.columns == docs.columns and 0 < len(ids(some)) < docs.count()


def test_run(spark):
    out = P.run(spark, DIR)
    rows = out.collect()
    assert out.columns == shard_documents(spark.read.parquet(f"{DIR}/documents.parquet")).columns
    n = [sum(r.shard == s for r in rows) for s in range(8)]
    assert rows and max(n) - min(n) <= 1 and P.ORACLE_SQL is None


def test_rows_are_judged_by_their_own_text(spark):
    labels, bench = spark.read.parquet(f"{DIR}/labels.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    verdict = {r.doc_id: r.predicted for r in toxicity(docs, labels).collect()}
    rows = docs.collect()
    toxic = {r.text for r in rows if verdict[r.doc_id]}
    assert toxic
    half = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    extra = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.withColumn("doc_id", F.lit(10**9)))
    left = without_toxic(extra, labels).collect()
    assert sorted(r.text for r in left) == sorted(t for t in (r.text for r in rows if r.text not in toxic) for _ in range(3))
    hit = {r.doc_id for r in contaminated(docs, bench).collect()}
    assert {r.text for r in decontaminate(half, bench).collect()} == {r.text for r in rows if r.doc_id not in hit}
    two = spark.createDataFrame([(1, "one two three four five six"), (1, "other words of another text here"), (1, "other words of another text here")], "doc_id long, text string")
    assert len(without_near_copies(two).collect()) == 2


def odd(spark):
    """Documents with nulls, repeated rows, a very long text, and columns named like what the stages use inside."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    long = " ".join(f"word{i % 5003}x{i % 977}" for i in range(150_000))
    extra = spark.createDataFrame([(None, "some text without an id", None, None, None), (5001, None, "en", "src1", None), (5002, "", None, "src1", 0), (5003, long, "en", None, 1), (5003, long, "en", None, 1)], docs.schema)
    docs = docs.unionByName(extra)
    for name in ("_node", "_copy", "row", "node", "id", "_id", "_of", "cell", "place", "weight", "score", "fingerprint", "taken", "topic", "toxic"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    return docs


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_keep_all_columns_and_take_odd_rows(spark, name):
    stage, docs = dict(P.STAGES)[name], odd(spark)
    before = {(r.doc_id, r.text): r for r in docs.collect()}
    left = stage(spark, docs, DIR)
    assert left.columns == docs.columns
    rows = left.collect()
    assert rows and all(r == before[r.doc_id, r.text] for r in rows)
    if name != "mixing":
        assert {(None, "some text without an id"), (5001, None)} <= {(r.doc_id, r.text) for r in rows} or name == "near_dedup"
        assert any(r.doc_id == 5003 for r in rows)
    assert stage(spark, docs.limit(0), DIR).collect() == []


def test_the_last_stage_takes_odd_rows(spark):
    docs = odd(spark)
    rows = P.sharding(spark, docs, DIR).collect()
    assert len(rows) == docs.count() and sorted(r.size for r in rows if r.doc_id in (5001, 5002)) == [1, 1]
    assert P.sharding(spark, docs.limit(0), DIR).collect() == []


def test_near_copies_of_many_degrees_are_found(spark):
    """Copies with some words changed, against all pairs at a similarity of 0.8."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choice(words, rng.integers(60, 200)).tolist()
        texts.append(base)
        for k in (1, 2, 3, 4):
            t = list(base)
            for at in rng.integers(0, len(t), k * len(t) // 200 + (k > 1)):
                t[at] = words[rng.integers(3000)]
            texts.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if a // 5 == b // 5 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert len(alike) > 300 and sum(got[a] == got[b] for a, b in alike) >= 0.995 * len(alike)
    assert all(got[a] // 5 == a // 5 for a in got)
