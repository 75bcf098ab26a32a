"""Text and table helpers that the operators of this subpackage share.

Text rules: null counts as the empty text; only A-Z is lower-cased; words are
runs of bytes other than ASCII white space (0x20, 0x09-0x0D), as bytes.split()
has them.
"""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of an Arrow stream holds at most (one longer text is a block by itself).
BLOCK_BYTES = 8 << 20
#: Words a task remembers the hash of; the memory is emptied beyond that.
MEMO_WORDS = 200_000

#: Rows of an Arrow batch at most, since texts may be long; rows that the Parquet reader decodes at once, for the same reason.
BATCH_ROWS, READER_ROWS = 2000, 512

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


class _Work(threading.local):
    """Folders that work_dir() has named in this thread, in order; jobs of other threads have lists of their own."""

    def __init__(self):
        self.folders: list[str] = []


_work = _Work()


def work_dir(spark: SparkSession, name: str, listed: bool = True) -> str:
    """A new folder in the shared folder of the cluster; in a session without one (tests), in the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/work"
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if listed:  # for release()
        _work.folders.append(path)
    return path


#: Spark's setting that deletes a query's shuffle files as soon as it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, rows: int = BATCH_ROWS, compression: str = "snappy", sweep: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, fixes what each task made, survives lost executors.

    rows: of an Arrow batch meanwhile, so that batches of wide rows stay small.
    sweep: what was shuffled for the table is deleted once it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path, before, swept = work_dir(spark, name), bounded_batches(spark, rows), spark.conf.get(SWEEP, None)
    if sweep:
        spark.conf.set(SWEEP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        if sweep:
            spark.conf.unset(SWEEP) if swept is None else spark.conf.set(SWEEP, swept)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> int:
    """Bounds the session's Arrow batches (and the rows that are decoded at once); what it was before."""
    key, reader = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = int(spark.conf.get(key))
    spark.conf.set(reader, min(READER_ROWS, int(spark.conf.get(reader))))
    spark.conf.set(key, min(rows, before) if before > 0 else rows)
    return before


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> int:
    """How many partitions to deal keyed work to."""
    return max(partitions or 0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def raw(text: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    return [x or b"" for x in text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).to_pylist()]


def trim() -> None:
    """Gives memory that is free back to the system: a Python worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the stream in slices of bounded text, each batch cut by its own running text length."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop
        trim()


class WordHash(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (the multiply-xorshift one that hash functions end with)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order; sorting first is faster for many numbers than numpy's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words, in order; of the whole sequence when it is shorter; none without words."""
    n = len(h)
    if not n:
        return h
    w = min(k, n)
    out = np.full(n - w + 1, np.uint64(w), dtype=np.uint64)
    for i in range(w):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - w + 1 + i])
    return out


def document_shingles(split: list[list[bytes]], memo: WordHash, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of many documents' words at once: the hashes one document after the other, and how many each has."""
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = memo.of([w for words in split for w in words])
    count = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    start, first = np.cumsum(sizes) - sizes, np.cumsum(count) - count
    out = np.empty(int(count.sum()), dtype=np.uint64)
    long = np.flatnonzero(sizes >= k)
    if len(long):
        n = count[long]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(first[long], n) + within] = shingles(flat, k)[np.repeat(start[long], n) + within]
    for d in np.flatnonzero((sizes > 0) & (sizes < k)):
        out[first[d]] = shingles(flat[start[d] : start[d] + sizes[d]], k)[0]
    return out, count


def lower_sql(c: str = "text") -> str:
    """SQL (Spark and DuckDB) of a text with A-Z lower-cased, null as empty."""
    return f"translate(coalesce({c}, ''), '{UPPER}', '{LOWER}')"


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def bucket(df: DataFrame, column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of each node of the edges (u, v): component is the smallest node that it reaches.

    Alternating large and small stars (Kiveris and others, "Connected components
    in MapReduce and beyond", 2014): each round relinks neighbours to the
    smallest one, so the rounds needed grow with the logarithm of the longest
    chain. Every round is written to the shared folder; only a count and a sum
    come to the driver.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = written(small.select("x.u", "x.v").where("u <> v").distinct(), name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def mark() -> int:
    return len(_work.folders)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, start: int, stop: int) -> None:
    """Deletes the folders named between two marks, once nothing reads them any more."""
    for p in _work.folders[start:stop]:
        remove(spark, p)
