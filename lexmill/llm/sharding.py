"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexmill.llm.common import columns, cut

#: The ring is cut into 2**CELL_BITS cells; keys and virtual nodes have places of 60 bits, of which the first ones name the cell.
CELL_BITS = 16
PLACE_BITS = 60


def place(key: Column) -> Column:
    """Place on the ring: the first 60 bits of the MD5 digest of the key as text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long")


def walks(shards: int, nodes: int) -> list[tuple[int, int, list[int]]]:
    """Arcs of the ring: first cell, cell after the last, and the shards in the order in which they come clockwise. As many as shards x nodes at most."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(nodes):
            at.setdefault(int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[: PLACE_BITS // 4], 16) >> (PLACE_BITS - CELL_BITS), s)
    cells = sorted(at)
    arcs, low = [], 0
    for i, c in enumerate(cells):
        arcs.append((low, c + 1, list(dict.fromkeys(at[cells[(i + k) % len(cells)]] for k in range(len(cells))))))
        low = c + 1
    if low < 1 << CELL_BITS:
        arcs.append((low, 1 << CELL_BITS, arcs[0][2]))
    return arcs


def quotas(counts: DataFrame, shards: int, nodes: int) -> DataFrame:
    """counts(cell, n) of keys: for each cell, runs of its keys' ranks (first, after_last), their shard and the slot of the first.

    A shard holds the total divided by shards, rounded down, or up for the first ones. In round r each cell offers the
    keys that no shard has taken yet to the r-th shard clockwise; the shard takes them in the order of the ring as long
    as it has room, and what overflows goes on clockwise in the next round. The tables here have a row for each cell, at
    most 2**CELL_BITS whatever the input; the driver sees a number for each shard.
    """
    spark = counts.sparkSession
    arcs = ", ".join(f"({low}, {high}, array({', '.join(map(str, walk))}))" for low, high, walk in walks(shards, nodes))
    cells = spark.sql(f"SELECT * FROM VALUES {arcs} AS arcs(low, high, walk)").select(F.explode(F.sequence("low", F.col("high") - 1)).alias("cell"), "walk")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    left = counts.join(cells, "cell").select("cell", "walk", F.col("n").alias("left"), F.lit(0).cast("long").alias("done"))
    runs = None
    for r in range(shards):
        free = F.array(*(F.lit(a - b).cast("long") for a, b in zip(room, used, strict=True)))
        taken_before = F.array(*(F.lit(b).cast("long") for b in used))
        offered = left.withColumn("shard", F.get("walk", r))
        w = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        offered = offered.withColumn("before", F.coalesce(F.sum("left").over(w), F.lit(0)))
        offered = cut(offered.withColumn("take", F.greatest(F.lit(0), F.least("left", F.get(free, F.col("shard")) - F.col("before")))).withColumn("slot", F.get(taken_before, F.col("shard")) + F.col("before")))
        run = offered.filter("take > 0").select("cell", F.col("done").alias("first"), (F.col("done") + F.col("take")).alias("after_last"), "shard", "slot")
        runs = run if runs is None else runs.unionByName(run)
        for s, n in offered.groupBy("shard").agg(F.sum("take")).collect():
            used[s] += n
        left = offered.filter("left > take").select("cell", "walk", (F.col("left") - F.col("take")).alias("left"), (F.col("done") + F.col("take")).alias("done"))
        if sum(used) == total:
            break
    return runs


def shard_documents(docs: DataFrame, shards: int = 8, nodes: int = 128) -> DataFrame:
    """Deals the rows of docs to shards so that their counts differ by one at most (law ``rows``).

    doc_id is hashed to a ring that has nodes virtual nodes of each shard and goes to the next one clockwise; a shard
    that has its share passes on what comes later on the ring. With one more shard or some more rows, most rows stay
    where they are. Returns a row for each row of docs: doc_id, size (UTF-8 bytes of the text and one), text_crc32, law,
    shard, slot (its place in the shard, without gaps from 0) and grown_shard (null: no promise of this law).

    Defined cases: a null text has size 1 and crc32 0; null doc_ids share a place on the ring; repeated rows get a slot
    each; fewer rows than shards leave the last shards empty; a very long text is a row like others, and stays out of all shuffles;
    an empty table gives an empty table; other columns are
    ignored, and so is how many rows have the same text, since the text has no part in the place.
    """
    docs = columns(docs, doc_id="long", text="string")
    keys = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), place(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("place"))
    keys = cut(keys.withColumn("cell", F.shiftright("place", PLACE_BITS - CELL_BITS).cast("int")))
    runs = quotas(cut(keys.groupBy("cell").agg(F.count("*").alias("n"))), shards, nodes)
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size")) - 1)
    return ranked.join(runs, "cell").filter("rank >= first AND rank < after_last").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, nodes: int = 128) -> DataFrame:
    """Writes docs as Parquet folders shard=0, shard=1 and so on, and returns the shard and slot of each doc_id. doc_ids must differ."""
    of = cut(shard_documents(docs, shards, nodes).select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")))
    docs.join(of, docs["doc_id"].eqNullSafe(of["_id"])).drop("_id").withColumnRenamed("_shard", "shard").withColumnRenamed("_slot", "slot").write.partitionBy("shard").parquet(path)
    return of.select(F.col("_id").alias("doc_id"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


