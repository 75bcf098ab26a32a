"""Bloom filters of two-bit cells, filled by tasks and merged by cell, and rows split by them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import spread

#: Rows that one filter covers; cells for each row; cells that a hash sets; cells of a segment, the unit of merging.
RANGE_KEYS, CELLS, PROBES, SEGMENT = 1 << 24, 8, 4, 1 << 20


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each hash (two 64-bit halves), by double hashing."""
    i = np.arange(PROBES, dtype=np.uint64)
    return ((keys[:, :1] + i * (keys[:, 1:] | np.uint64(1))) >> np.uint64(8)) & np.uint64(cells - 1)


def halves(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("hi", "lo")], axis=1)


def build_filter(keys: DataFrame, cells: int) -> tuple[bytes, bytes]:
    """First pass: bitmaps of the cells that are set at least once, and at least twice. keys: hi, lo."""
    segment = min(cells, SEGMENT)

    def bits(at: np.ndarray) -> bytes:
        out = np.zeros(segment, dtype=np.uint8)
        out[at] = 1
        return np.packbits(out, bitorder="little").tobytes()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_cells(halves(b), cells).ravel() for b in batches]
        if not held:
            return
        at, n = np.unique(np.concatenate(held), return_counts=True)
        which = (at // np.uint64(segment)).astype(np.int64)
        cut = np.flatnonzero(np.diff(which, prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], len(at)]):
            own = (at[lo:hi] % np.uint64(segment)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([which[lo]], pa.int64()), "once": [zlib.compress(bits(own), 1)], "twice": [zlib.compress(bits(own[n[lo:hi] > 1]), 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for s, *x in zip(*(b.column(c).to_pylist() for c in ("segment", "once", "twice"))):
                once, twice = (np.frombuffer(zlib.decompress(y), dtype=np.uint8) for y in x)
                if s in held:
                    held[s] = [held[s][0] | once, held[s][1] | twice | (held[s][0] & once)]
                else:
                    held[s] = [once, twice]
        for s, (once, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int64()), "once": [once.tobytes()], "twice": [twice.tobytes()]})

    schema = "segment long, once binary, twice binary"
    parts = max(1, min(spread(keys), cells // segment))
    once, twice = bytearray(cells // 8), bytearray(cells // 8)
    for row in keys.select("hi", "lo").mapInArrow(fill, schema).repartition(parts, "segment").mapInArrow(merge, schema).toLocalIterator():
        at = row.segment * segment // 8
        once[at : at + len(row.once)], twice[at : at + len(row.twice)] = row.once, row.twice
    return bytes(once), bytes(twice)


def inside(keys: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    at = _cells(keys, cells)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def size(rows: int) -> tuple[int, int]:
    """Ranges, and the cells of each one's filter."""
    ranges = max(1, -(-rows // RANGE_KEYS))
    return ranges, 1 << max(13, (max(1, rows // ranges) * CELLS - 1).bit_length())


def hashed(column: str):
    return F.xxhash64(F.col(column).cast("long")).alias("hi"), F.xxhash64(F.col(column).cast("long"), F.lit(1)).alias("lo")


def id_filter(ids: DataFrame):
    """Broadcast bits and cells of a filter of the ids (column node); None if they are too many for one (RANGE_KEYS)."""
    ranges, cells = size(ids.count())
    return (ids.sparkSession.sparkContext.broadcast(build_filter(ids.select(*hashed("node")), cells)[0]), cells) if ranges == 1 else None


def split(docs: DataFrame, ids: DataFrame) -> DataFrame | None:
    """docs with a column maybe_in: whether doc_id may be one of the ids (column node); false is certain.

    None if the ids are too many for one filter; the caller then joins.
    """
    made = id_filter(ids)
    if made is None:
        return None
    shared, cells = made
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).select("*", *hashed(names[docs.columns.index("doc_id")]))
    schema = StructType([*rows.schema.fields[: len(names)], StructField("maybe_in", BooleanType())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(inside(halves(b), bits, cells))], names=[*names, "maybe_in"])

    return rows.mapInArrow(ask, schema).toDF(*docs.columns, "maybe_in")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those whose doc_id is one of the ids (column node). Rows that certainly are not are not shuffled."""
    own = ids.select(F.col("node").alias("doc_id"))
    rows = split(docs, ids)
    if rows is None:
        return docs.join(own, "doc_id", "left_anti").select(*docs.columns)
    certain = rows.where("NOT maybe_in").select(*docs.columns)
    return certain.unionByName(rows.where("maybe_in").join(own, "doc_id", "left_anti").select(*docs.columns))
