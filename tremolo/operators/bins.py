"""Equal-count bins by magnitude.

A global rank needs no single task: rows are range-partitioned once and written
with the number of their partition to the shared folder; counts of the
partitions give each one its first rank, and the rank within a partition is
added. Both read what was written, so a partition is the same rows in either,
however often its ranges would be sampled or coalesced anew. Ties are broken by
an id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import mean4


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster; in a session without one (tests), in the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/work"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ranked(df: DataFrame, value: str, key: str, name: str = "rank") -> DataFrame:
    """df with the place of each row by (value, key), from 0."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, "ranked")
    dealt = df.repartitionByRange(value, key).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    part = spark.read.schema(dealt.schema).parquet(path)
    rows = part.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(value, key)) - 1)
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def _valid(runs: DataFrame) -> DataFrame:
    return runs.where("gate AND score IS NOT NULL AND sim IS NOT NULL")


def magnitude_bins(runs: DataFrame, n_bins: int = 12, key: str = "run_id") -> DataFrame:
    """Means of score and sim in bins of count // n_bins rows; a last bin of under a third of that is left out."""
    own = _valid(runs).where("level <> 'L0'")
    size = own.agg(F.greatest(F.lit(1), F.floor(F.count("*") / n_bins)).cast("long").alias("size"))
    # the size is one row
    rows = ranked(own.select(key, "score", "sim"), "score", key).join(F.broadcast(size))
    cells = rows.groupBy(F.floor(F.col("rank") / F.col("size")).cast("long").alias("bin"), "size").agg(F.count("*").alias("n"), mean4("score").alias("mean_score"), mean4("sim").alias("mean_sim"))
    return cells.where(F.col("n") >= F.floor(F.col("size") / 3)).select("bin", "n", "mean_score", "mean_sim")


def fixed_bins(runs: DataFrame, size: int, *by: str, key: str = "run_id") -> DataFrame:
    """Means in bins of `size` rows of one ranking over all rows; by: groups within the bins."""
    cell: Column = F.floor(F.col("rank") / max(1, size)).cast("long").alias("bin")
    rows = ranked(_valid(runs).select(key, "score", "sim", *by), "score", key)
    return rows.groupBy(cell, *by).agg(F.count("*").alias("n"), mean4("score").alias("mean_score"), mean4("sim").alias("mean_sim"))
