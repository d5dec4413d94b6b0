"""Incremental import from a stream (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lumenlake.operators.ingest import NEW, import_outcomes

OUTCOME_FIELDS = "batch long, outcome string, n long"


def imported(spark: SparkSession, target: str, schema) -> DataFrame:
    """Images imported so far by the stream writing to `target`."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{target}/images")


def import_counts(spark: SparkSession, target: str) -> DataFrame:
    """(batch, outcome, n) of all batches."""
    return spark.read.schema(OUTCOME_FIELDS).option("recursiveFileLookup", True).parquet(f"{target}/outcomes")


def start_import(candidates: DataFrame, library: DataFrame, target: str, available_now: bool = True) -> StreamingQuery:
    """Import a stream of (hash, position, ...): each batch is deduplicated in itself and against the library.

    A batch is written to a folder of its own number, overwriting it, and is
    compared with the library and earlier batches only. A repeated batch after a
    failure therefore ends in the same files.
    """
    spark = candidates.sparkSession
    schema = candidates.schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/images")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def import_batch(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = (
            session.read.schema("hash string, batch long").parquet(f"{target}/images").where(F.col("batch") < number).select("hash")
        )
        known = library.select("hash").unionByName(earlier)
        plan = import_outcomes(batch, known).persist()
        plan.where(F.col("outcome") == NEW).drop("outcome").write.mode("overwrite").parquet(f"{target}/images/batch={number}")
        plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).select(F.lit(number).cast("long").alias("batch"), "outcome", "n").write.mode(
            "overwrite"
        ).parquet(f"{target}/outcomes/batch_{number}")
        plan.unpersist()

    writer = candidates.writeStream.foreachBatch(import_batch).option("checkpointLocation", f"{target}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
