"""Checkpointed results: batches of responses in a folder, each taken over once, a repeated seed replaced.

A batch is written under its number, split by hash buckets of run and seed (a
fixed number of folders, however many seeds there are), and counts only from the
moment its entry is in the ledger. The entry is a file that is created and never
overwritten, so a batch that is played again after a kill either finds its entry
and does nothing, or none and writes its files anew. What a killed writer left
without an entry is never read.

Readers take, of each run and seed, the rows of the latest batch that has any; who
asks for one run and seed reads one bucket of each batch; who asks for a table of them gets a small
table of those that are there first, made of keys alone, so that a batch that replaces nothing moves no rows. compact() merges the batches up to now into one; it is
a batch like others, numbered between the last one it holds and the next.

A null seed or run is a seed or run of its own. Batches may be empty.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .tables import _fs

KEYS, BUCKETS = ("run", "source_row"), 64


def ledger(spark: SparkSession, path: str) -> list[dict]:
    """The entries in order; those that a later compaction holds are left out."""
    fs, p = _fs(spark, f"{path}/ledger")
    if not fs.exists(p):
        return []
    own = [json.loads(r.value) for r in spark.read.option("wholetext", True).text(str(p)).collect()]
    last = max((e["batch"] for e in own if e.get("holds")), default=-1)
    return sorted((e for e in own if e["batch"] > last or (e["batch"] == last and e.get("holds"))), key=lambda e: (e["batch"], not e.get("holds")))


def _entry(spark: SparkSession, path: str, name: str):
    return _fs(spark, f"{path}/ledger/{name}.json")


def _commit(spark: SparkSession, path: str, name: str, **entry) -> bool:
    """Creates the ledger entry; False if another writer was first."""
    fs, p = _entry(spark, path, name)
    try:
        out = fs.create(p, False)
    except Exception:  # the file system's own "already exists"
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    return True


def _bucket(buckets: int, *keys):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _put(df: DataFrame, folder: str, buckets: int) -> None:
    # a bucket's rows come together, but a large bucket is several tasks and files
    df.withColumn("bucket", _bucket(buckets, *KEYS)).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(folder)


def append(df: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> bool:
    """Takes a batch over, once; False if it was there already. df has the columns run and source_row."""
    spark, name = df.sparkSession, f"{batch:012d}"
    fs, p = _entry(spark, path, name)
    if fs.exists(p):
        return False
    _put(df, f"{path}/batches/{name}", buckets)
    return _commit(spark, path, name, batch=batch, folder=f"batches/{name}", buckets=buckets, schema=df.schema.json())


def read(spark: SparkSession, path: str, seed: tuple | None = None, within: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """The rows of the latest batch of each run and seed; of one (run, source_row), or of those in a table, if they are given: only their buckets are read. before: of batches below a number.

    within is looked up at once: those of it that are there are written to a folder of their own under `wanted`.
    """
    entries = [e for e in ledger(spark, path) if before is None or e["batch"] < before]
    if not entries:
        raise FileNotFoundError(f"no batch in {path}")
    rows, places = None, {}
    for order, e in enumerate(entries):
        own = spark.read.schema(StructType.fromJson(json.loads(e["schema"])).add("bucket", IntegerType())).parquet(f"{path}/{e['folder']}")
        if seed is not None:
            wanted = [F.lit(v).cast(own.schema[k].dataType) for k, v in zip(KEYS, seed)]
            own = own.where(F.col("bucket") == _bucket(e["buckets"], *wanted))
            for k, v in zip(KEYS, wanted):
                own = own.where(F.col(k).eqNullSafe(v))
        if within is not None:
            # as many numbers as there are buckets at most
            if (n := e["buckets"]) not in places:
                places[n] = [r[0] for r in within.select(_bucket(n, *KEYS)).distinct().collect()]
            if len(places[n]) < n:
                own = own.where(F.col("bucket").isin(places[n]))
        own = own.drop("bucket").withColumn("_order", F.lit(order))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    if within is None and len(entries) == 1:
        return rows.drop("_order")
    # a row for each run and seed, so that rows themselves need not be gathered
    if within is None:
        latest = rows.groupBy(*KEYS).agg(F.max("_order").alias("_order"))
    else:
        asked = within.select(*(F.col(k).cast(rows.schema[k].dataType).alias(k) for k in KEYS), F.lit(None).cast("int").alias("_order"), F.lit(True).alias("_asked"))
        every = rows.select(*KEYS, "_order", F.lit(False).alias("_asked")).unionByName(asked)
        latest = every.groupBy(*KEYS).agg(F.max("_order").alias("_order"), F.max("_asked").alias("_asked")).where("_asked AND _order IS NOT NULL").drop("_asked")
        folder = f"{path}/wanted/{uuid.uuid4().hex}"
        latest.write.parquet(folder)
        latest = spark.read.schema(latest.schema).parquet(folder)
        if latest.isEmpty():
            return rows.where(F.lit(False)).drop("_order")
    mine = [F.col("r._order") == F.col("l._order"), *(F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in KEYS)]
    return rows.alias("r").join(latest.alias("l"), mine, "left_semi").drop("_order")


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Merges the batches up to now into one; they stay on disk until they are removed by hand, so that readers finish."""
    entries = ledger(spark, path)
    if len(entries) < 2:
        return
    last = entries[-1]["batch"]
    df = read(spark, path)
    name = f"{last:012d}-merged"
    _put(df, f"{path}/batches/{name}", buckets)
    _commit(spark, path, name, batch=last, folder=f"batches/{name}", buckets=buckets, schema=df.schema.json(), holds=[e["batch"] for e in entries])


def sink(path: str, buckets: int = BUCKETS):
    """For foreachBatch: a stream's batches, which Spark may play again after a failure, exactly once."""

    def put(batch: DataFrame, number: int) -> None:
        append(batch, path, number, buckets)

    return put


def follow(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Appends what has arrived, batch by batch, and ends."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink(path, buckets)).trigger(availableNow=True).start()


def once(spark: SparkSession, path: str, number: int, make) -> DataFrame:
    """The table of that number: made (by make()) and written the first time, read afterwards. What it holds is never computed twice once it is in the ledger."""
    name = f"{number:012d}"
    fs, p = _entry(spark, path, name)
    if not fs.exists(p):
        df = make()
        df.write.mode("overwrite").parquet(f"{path}/batches/{name}")
        _commit(spark, path, name, batch=number, folder=f"batches/{name}", schema=df.schema.json())
    entry = json.loads(spark.read.option("wholetext", True).text(str(p)).first().value)
    return spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{path}/{entry['folder']}")
