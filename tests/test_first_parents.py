"""expand_parents: parents of a document's first chunks, found where its chunks lie."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill import plans
from lexmill.operators import chunking as C


def test_as_joins_of_hits_and_parents(spark):
    lines = [(d, k, x) for d in ("a", "b", "c") for k, x in enumerate(["Điều 1. x", "1. m", "a) n", "Điều 2. y", "2. o", "Điều 1. z", "1. q", "2. r", "tail", "Điều 3. w"][: {"a": 10, "b": 5, "c": 1}[d]])]
    chunks = C.chunks(spark.createDataFrame(lines, "doc_id string, line_no int, line string"), C.STATUTE)
    for n in (1, 2, 4):
        ranked = chunks.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5("chunk_id"), "chunk_id")))
        hits = ranked.filter(F.col("rank") <= n).select(F.col("doc_id").alias("query_id"), "rank", "chunk_id")
        got = C.first_parents(ranked, n)
        want = C.expand_parents(hits, chunks, C.parents(chunks)).select(got.columns)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() >= 3


def test_chunks_are_not_shuffled_again(spark):
    """The only shuffles by what chunking makes are those that deal a law's lines."""
    plan = plans.QUERIES["expand_parents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not [x for x in exchanges if "chunk_id" in x or "parent_id" in x or "query_id" in x]
    assert "LogicalRDD" not in plan and "Scan ExistingRDD" not in plan
