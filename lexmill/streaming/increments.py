"""New extraction files as a stream, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON files as they come to a folder."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(path)


def upsert_into(rows: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch as a version of its own under path; ``current`` reads the newest row of each key. A batch that is run again replaces its own version, so nothing comes twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/_version={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_version"), F.desc("_seq")))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n", "_version", "_seq")
