"""Steadiness of runs as a stream: windowed sums with a watermark, exactly once into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import r4


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_steadiness(runs: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """n and magnitude-weighted correctness of each window and category; runs: run_id, ts, category, score, sim. Repeated run_ids count once."""
    once = runs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id"]) if runs.isStreaming else runs.dropDuplicates(["run_id"])
    both = F.col("sim").isNotNull() & F.col("score").isNotNull()
    sums = once.groupBy(F.window("ts", width, slide), "category").agg(F.count("*").alias("n"), F.sum(F.when(both, F.col("sim") * F.col("score"))).alias("top"), F.sum(F.when(both, F.col("score"))).alias("bottom"))
    return sums.select(F.col("window.start").alias("start"), "category", "n", r4(F.try_divide("top", F.when(F.col("bottom") > 0, F.col("bottom")))).alias("steadiness"))


def append(stream: DataFrame, path: str, checkpoint: str):
    """Appends closed windows to a table; a batch that is repeated replaces its own files."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
