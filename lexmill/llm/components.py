"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.llm.common import cut, release


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges in the checkpoint folder, and what shows whether a round changed them: counted while they are written, not by a job of its own."""
    seen = Observation()
    kept = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("of")))
    return kept, (seen.get["n"], seen.get["of"])


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long values, in any direction, with repeats and loops: node and label, the smallest node that it reaches.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest that it knows of. The edges
    stay as many and turn into stars within a few rounds (a power of the logarithm of the longest path); no group is
    gathered in one row, and each round is kept in the checkpoint folder. A round is four shuffles of its edges and a
    stage that writes it, since edges are dealt by node before they are aggregated, joined and made distinct. An empty table gives an empty one.
    """
    edges, before = _kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").repartition("a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a").distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least.hint("merge"), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges, after = _kept(smaller)
        release(edges.sparkSession)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
