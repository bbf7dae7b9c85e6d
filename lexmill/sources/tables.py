"""Scans, sinks and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import normalized

#: A line of an extraction file.
EXTRACTION = """chunk_id STRING, van_ban_id STRING, entities ARRAY<MAP<STRING, STRING>>,
relations ARRAY<STRUCT<source_id: STRING, relation_type: STRING, target_id: STRING, chunk_id: STRING, van_ban_id: STRING>>"""


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder tree of JSON lines with the columns of schema and _bad, the text of lines that can't be read. Blank lines are no rows."""
    return spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path)


def entities_of(extractions: DataFrame) -> DataFrame:
    """A row for each entity: its properties, and the chunk and document of its line unless it has its own."""
    e = extractions.select("chunk_id", "van_ban_id", F.posexplode("entities").alias("pos", "e"))
    own = lambda k: F.coalesce(F.try_element_at("e", F.lit(k)), k).alias(k)
    return e.select(own("chunk_id"), own("van_ban_id"), "pos", F.try_element_at("e", F.lit("id")).alias("id"), F.try_element_at("e", F.lit("type")).alias("type"), F.map_filter("e", lambda k, v: v.isNotNull() & ~k.isin("chunk_id", "van_ban_id")).alias("props"))


def relations_of(extractions: DataFrame) -> DataFrame:
    r = extractions.select("chunk_id", "van_ban_id", F.posexplode("relations").alias("pos", "r"))
    return r.select(F.coalesce("r.chunk_id", "chunk_id").alias("chunk_id"), F.coalesce("r.van_ban_id", "van_ban_id").alias("van_ban_id"), "pos", F.col("r.source_id").alias("src"), F.col("r.relation_type").alias("rel"), F.col("r.target_id").alias("dst"))


def scalar_props(parsed: Column) -> Column:
    """A map of strings (as JSON has them) without nulls, the type, and values that are lists or objects."""
    return F.map_filter(parsed, lambda k, v: v.isNotNull() & (k != "type") & ~F.ltrim(v).rlike(r"^[\[{]"))


def payload_type(chunk_type: Column) -> Column:
    """The type that an index has for a chunk: an article's opening counts as the article."""
    return F.when(chunk_type == "dieu_preamble", "dieu").otherwise(chunk_type)


def first_rows(rows: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """The first n rows in order, or all of them."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def first_of_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; rows in which a part of it is null are all kept."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    first = rows.filter(whole).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return first.unionByName(rows.filter(~whole))


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both tables, rows of new in place of those with the same key. The same upsert again changes nothing."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done, key, "left_anti")


def incomplete(todo: DataFrame, scores: DataFrame, key: str, metrics: int = 4) -> DataFrame:
    """Rows of todo that have fewer than metrics scores, with how many they have."""
    n = scores.filter("score IS NOT NULL").groupBy(key).agg(F.countDistinct("metric").alias("n"))
    return todo.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).filter(F.col("n") < metrics)


def reconciled(source: DataFrame, copy: DataFrame, part: str) -> DataFrame:
    """Row counts of a table and its copy by part, and whether they agree."""
    a, b = source.groupBy(part).agg(F.count("*").alias("n_source")), copy.groupBy(part).agg(F.count("*").alias("n_copy"))
    both = a.join(b, part, "full").na.fill(0, ["n_source", "n_copy"])
    return both.withColumn("status", F.when(F.col("n_source") == F.col("n_copy"), "OK").otherwise("MISMATCH"))


def with_registry(files: DataFrame, registry: DataFrame, name: str = "filename") -> DataFrame:
    """files with the registry row of the same file name, whichever Unicode form either is in."""
    key = lambda df: df.withColumn("_k", normalized(F.col(name), "NFC"))
    return key(files).join(key(registry).drop(name), "_k", "left").drop("_k")


def valid_at(rows: DataFrame, day: Column) -> DataFrame:
    """Rows in force on a day: from eff_from on and before eff_to, if there is one."""
    return rows.filter((F.col("eff_from") <= day) & (F.col("eff_to").isNull() | (day < F.col("eff_to"))))


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """CSV with a header, in place of what was there."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_table(rows: DataFrame, path: str, recreate: bool, by: str | None = None) -> None:
    """Parquet: a table that is there is replaced, or kept as it is."""
    w = rows.write.mode("overwrite" if recreate else "ignore")
    (w.partitionBy(by) if by else w).parquet(path)


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
