"""Token counts of documents in flat, unindexed token files (op 2).

A token file is one run of 16-bit ids in which an end-of-document id closes each
document; it comes as rows (file, block, tokens) of BLOCK ids each, cut anywhere.
Every block is searched for end ids at once (vectorised); what lies across
blocks is stitched by a prefix scan of two numbers a block, the end ids so far
(a sum) and the place of the last one (a maximum). The scan has two levels,
within chunks of CHUNK blocks and over the chunks' totals, so a file of a third
of all tokens is no single task.

Null and empty texts are documents of no tokens. Ids left after a file's last
end id are an open document of their own. Repeated rows and null doc_ids are
documents like others. Files without blocks give no rows; other columns are
untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import work_dir
from .packing import coder, ranks_path

#: The end-of-document id; ids of a block; blocks of a chunk; documents of a row of the list of ids.
END, BLOCK, CHUNK, NAMES = 50256, 1 << 16, 1024, 10_000


def write_token_files(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents as token files (file, block, tokens), and the doc_ids of each file in order (file, first, doc_ids).

    A file is what one task reads; it is written as it grows, a block at a time.
    """
    ranks = ranks_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = coder(ranks).encode_ordinary, uuid.uuid4().hex
        held, size, at, first, names = [], 0, 0, 0, []
        kind = [("file", pa.string()), ("block", pa.int64()), ("tokens", pa.binary()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]

        def row(**x) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.get(n)], t) for n, t in kind], names=[n for n, _ in kind])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END], dtype="<u2")
                held.append(ids)
                size += len(ids)
                names.append(doc)
                if size >= block:
                    flat = np.concatenate(held)
                    for i in range(0, size - size % block, block):
                        yield row(file=file, block=at, tokens=flat[i : i + block].tobytes())
                        at += 1
                    held, size = [flat[size - size % block :]], size % block
                if len(names) == NAMES:
                    yield row(file=file, first=first, doc_ids=names)
                    first, names = first + NAMES, []
        if size:
            yield row(file=file, block=at, tokens=np.concatenate(held).tobytes())
        if names:
            yield row(file=file, first=first, doc_ids=names)

    spark = docs.sparkSession
    out = work_dir(spark, "tokens")
    schema = "file string, block long, tokens binary, first long, doc_ids array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    rows.write.option("compression", "zstd").parquet(out)
    read = spark.read.schema(schema).parquet(out)
    return read.where("tokens IS NOT NULL").select("file", "block", "tokens"), read.where("doc_ids IS NOT NULL").select("file", "first", "doc_ids")


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of raw little-endian 16-bit files (of up to 2 GB each) from any store that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for i in range(0, len(data), 2 * block):
                    yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([i // (2 * block)], pa.int64()), "tokens": [data[i : i + 2 * block]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, tokens binary")


def count(blocks: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """A row for each document of the files: file, ordinal (from 0), start (its first id's place), n_tokens (without the end id), closed."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("tokens").to_pylist()
            base = b.column("block").to_numpy(zero_copy_only=False).astype(np.int64) * block
            ends = [np.flatnonzero(np.frombuffer(x, dtype="<u2") == end) + s for x, s in zip(data, base)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array([len(x) // 2 for x in data], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "size", "ends"])

    found = blocks.mapInArrow(search, "file string, block long, size long, ends array<long>")
    rows = found.select("file", "block", F.expr(f"block div {CHUNK}").alias("chunk"), (F.col("block") * block + F.col("size")).alias("stop"), "ends", F.size("ends").cast("long").alias("n"), F.expr("try_element_at(ends, -1)").alias("last"))
    inner = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    before = chunks.select("file", "chunk", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("chunk_n"), F.max("last").over(outer).alias("chunk_last"))
    scanned = rows.select("file", "chunk", "block", "ends", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("n"), F.max("last").over(inner).alias("last"))
    scanned = scanned.join(before, ["file", "chunk"]).select("file", "ends", (F.col("n") + F.col("chunk_n")).alias("n"), F.coalesce("last", "chunk_last", F.lit(-1)).alias("last"))
    closed = scanned.select("file", "n", F.posexplode(F.expr("transform(ends, (e, i) -> struct(if(i = 0, last, ends[i - 1]) + 1 AS start, e AS stop))")).alias("i", "x"))
    closed = closed.select("file", (F.col("n") + F.col("i")).alias("ordinal"), "x.start", (F.col("x.stop") - F.col("x.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    files = chunks.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop"))
    left = files.where("stop > start").select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(left)


def document_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of every document, counted from token files written of docs."""
    files, names = write_token_files(docs, path)
    ids = names.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return count(files).join(ids, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
