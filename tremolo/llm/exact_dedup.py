"""Exact deduplication by two-pass Bloom filtering (op 5).

The first pass puts every text's hash into a filter of two-bit cells (absent,
once, at least twice); tasks fill parts of it, which merge by cell. The second
pass asks it: a hash that has a cell below two occurs once for certain, and its
row passes straight through. Only possibly repeated rows shuffle and are grouped
by their full SHA-256.

One filter covers at most RANGE_KEYS rows (32 MB, the bound of what is
broadcast). Larger tables are handled in hash ranges, one after the other, each
with a filter of its own.

Null texts count as empty and are equal to empty ones. A null doc_id counts as
the smallest. Rows that repeat both text and doc_id are copies like others: the
report marks each as kept if its doc_id is the kept one, drop_copies() returns
one of them. Empty tables give empty results; other columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .bloom import build_filter, halves, inside, size
from .common import raw, work_dir, written

def _digests(texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    d = [hashlib.sha256(x.lower()).digest() for x in texts]
    return [x.hex() for x in d], np.frombuffer(b"".join(x[:16] for x in d), dtype="<u8").reshape(-1, 2)


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32) if ranges > 1 else np.zeros(len(keys), dtype=np.uint64)


def digests(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text_sha256, hi, lo, range of every row."""
    schema = "doc_id long, text_sha256 string, hi long, lo long, part int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, keys = _digests(raw(b.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_sha256": pa.array(names, pa.string()), "hi": keys[:, 0].astype(np.int64), "lo": keys[:, 1].astype(np.int64), "part": _range(keys, ranges).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, maybe (false: the text occurs once for certain)."""
    ranges, cells = size(docs.count())
    ids = written(digests(docs, ranges), "digests")
    path = work_dir(docs.sparkSession, "flagged")
    schema = "doc_id long, text_sha256 string, maybe boolean"
    for r in range(ranges):
        own = ids.where(F.col("part") == r) if ranges > 1 else ids
        twice = docs.sparkSession.sparkContext.broadcast(build_filter(own, cells)[1])

        def ask(batches: Iterator[pa.RecordBatch], twice=twice) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(twice.value, dtype=np.uint8)
            for b in batches:
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_sha256": b.column("text_sha256"), "maybe": inside(halves(b), bits, cells)})

        own.select("doc_id", "text_sha256", "hi", "lo").mapInArrow(ask, schema).write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = flagged(docs)
    # written, so that both sides of the join are dealt anew and a hot text's rows can be split
    groups = written(rows.where("maybe").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    again = rows.where("maybe").join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
    once = rows.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return once.unionByName(again)


def _keyed(docs: DataFrame, flag) -> DataFrame:
    """docs with columns c0, c1, ..., maybe_repeated and text_key (of rows that may be repeated). flag: hashes to booleans, None for all."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, text = docs.toDF(*names), docs.columns.index("text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, keys = _digests(raw(b.column(text)))
            maybe = flag(keys) if flag else np.ones(len(sha), dtype=bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe), pa.array([s if m else None for s, m in zip(sha, maybe)], pa.string())], names=[*names, "maybe_repeated", "text_key"])

    return plain.mapInArrow(ask, StructType([*plain.schema.fields, StructField("maybe_repeated", BooleanType()), StructField("text_key", StringType())]))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without copies of a text but the one of the largest doc_id; same columns.

    Rows whose text occurs once for certain are not shuffled. Beyond RANGE_KEYS rows one
    filter does not hold all texts; then the repeated digests are found range by range as
    for the report, and rows are joined with them.
    """
    ranges, cells = size(docs.count())
    if ranges > 1:
        rows = _keyed(docs, None)
        repeated = written(report(docs).where("group_size > 1").select(F.col("text_sha256").alias("text_key")).distinct(), "repeated")
        once, again = rows.join(repeated, "text_key", "left_anti"), rows.join(repeated, "text_key", "left_semi")
    else:
        ids = written(digests(docs, 1), "digests")
        twice = docs.sparkSession.sparkContext.broadcast(build_filter(ids, cells)[1])
        rows = _keyed(docs, lambda keys: inside(keys, np.frombuffer(twice.value, dtype=np.uint8), cells))
        once, again = rows.where("NOT maybe_repeated"), rows.where("maybe_repeated")
    own = [f"c{i}" for i in range(len(docs.columns))]
    order = F.coalesce(F.col(own[docs.columns.index("doc_id")]).cast("long"), F.lit(-(2**63)))
    best = again.groupBy("text_key").agg(F.max_by(F.struct(*own), order).alias("row")).select("row.*")
    return once.select(*own).unionByName(best).toDF(*docs.columns)
