"""CSV files with quoted line breaks, read in splits: a file of any size is many tasks.

Whether a line break ends a record depends on the parity of the quotes before it
(doubled quotes change nothing), which a task in the middle of a file does not
know. So lines are read twice. First each split reports the parity of its quotes
and how many records end in it under either parity at its start; a prefix scan
over the splits of each file settles every start and the number of the first
record. Then each split makes its records with their numbers. A record over the
edge of a split is left in fragments, which meet by their number; only files
that have such records are read for them once more.

Quotes are taken to stand as RFC 4180 has them (around a field, doubled inside).
Empty lines outside quotes are no records, the first record of each file is its
header, an open quote at the end of a file ends there. Bytes that are no UTF-8
become replacement characters. Several files are numbered in the order of their
paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Splits at most. The driver plans all splits of a scan anyway, it keeps four numbers more of each; larger inputs need larger splits (spark.sql.files.maxPartitionBytes).
MAX_SPLITS = 1_000_000
CSV = {"escape": '"', "multiLine": "true"}
#: What the parser puts for an empty field without quotes where quoted ones shall differ from it; no text is like it.
NULL = "\u0000null\u0000"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file (a hash of its path), block (where its split starts)."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """The stream cut where the split changes: file, block, lines, parity after each line (from 0 at the part's start), which lines are empty."""
    for b in batches:
        if not b.num_rows:
            continue
        file, block = (b.column(c).to_numpy() for c in ("file", "block"))
        lines = b.column("line")
        odd = np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) & 1
        empty = pc.or_(pc.equal(pc.binary_length(lines), 0), pc.equal(lines, b"\r")).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            before = odd[lo - 1] if lo else 0
            yield int(file[lo]), int(block[lo]), lines.slice(lo, hi - lo), odd[lo:hi] ^ before, empty[lo:hi]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: the parity of its quotes, and the records that end in it if it starts outside of quotes, or inside."""
    held: dict[tuple[int, int], list[int]] = {}
    for file, block, _, odd, empty in _parts(batches):
        x = held.setdefault((file, block), [0, 0, 0])
        ends = odd ^ x[0]
        x[1] += int(((ends == 0) & ~empty).sum())
        x[2] += int(((ends == 1) & ~empty).sum())
        x[0] ^= int(odd[-1])
    keys, values = list(held), list(held.values())
    yield pa.RecordBatch.from_pydict({"file": pa.array([k[0] for k in keys], pa.int64()), "block": pa.array([k[1] for k in keys], pa.int64()), **{c: pa.array([v[i] for v in values], pa.int64()) for i, c in enumerate(("parity", "ends_outside", "ends_inside"))}})


class _Start:
    """Of a split: the parity before it, the records before it, and what the file's records are numbered from."""

    __slots__ = ("inside", "records", "base")

    def __init__(self, inside: int, records: int):
        self.inside, self.records, self.base = inside, records, 0


def scan(spark: SparkSession, path: str) -> tuple[dict[tuple[int, int], _Start], list[int]]:
    """The start of every split by (file, block), and the files that have records over the edge of a split."""
    rows = _lines(spark, path)
    found = sorted(tuple(r) for r in rows.mapInArrow(_measure, "file long, block long, parity long, ends_outside long, ends_inside long").limit(MAX_SPLITS + 1).collect())
    if len(found) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    names = {r.file: r.path for r in spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path").distinct().select(F.xxhash64("file_path").alias("file"), F.col("file_path").alias("path")).collect()} if len({x[0] for x in found}) > 1 else {}
    starts: dict[tuple[int, int], _Start] = {}
    total: dict[int, int] = {}
    broken = []
    for file, block, parity, outside, inside in found:
        last = starts.get((file, "end"))
        now = _Start(last.inside if last else 0, last.records if last else 0)
        if now.inside:
            broken.append(file)
        starts[file, block] = now
        starts[file, "end"] = _Start(now.inside ^ parity, now.records + (inside if now.inside else outside))
        total[file] = starts[file, "end"].records + starts[file, "end"].inside
        if starts[file, "end"].inside:
            broken.append(file)
    base, bases = 0, {}
    for file in sorted(total, key=lambda f: names.get(f, "")):
        bases[file], base = base, base + max(0, total[file] - 1)
    out = {k: v for k, v in starts.items() if k[1] != "end"}
    for (file, _), v in out.items():
        v.base = bases[file]
    return out, sorted(set(broken))


def _text(lines: list[bytes]) -> str:
    return b"\n".join(lines).decode("utf-8", "replace")


def records(spark: SparkSession, path: str) -> DataFrame:
    """row_id, record of every record but the headers."""
    starts, broken = scan(spark, path)
    shared = spark.sparkContext.broadcast(starts)
    cut = set(broken)
    schema = "row_id long, block long, edge boolean, record string"

    def made(batches: Iterator[pa.RecordBatch], edges: bool = False) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            ids, blocks, edges, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blocks, pa.int64()), pa.array(edges, pa.bool_()), pa.array(texts, pa.string())], names=["row_id", "block", "edge", "record"])

        def emit(n, block, edge, lines, last):
            if n and edge == edges:  # not the header
                text = _text(lines)
                rows.append((start.base + n - 1, block, edge, text[:-1] if last and text.endswith("\r") else text))

        at, rows, pending, start, n, state, first = None, [], [], None, 0, 0, False
        for file, block, lines, odd, empty in _parts(batches):
            if edges and file not in cut:
                continue
            if at != (file, block):
                if pending:
                    emit(n, at[1], True, pending, False)
                at, start, pending = (file, block), shared.value[file, block], []
                n, state, first = start.records, start.inside, bool(start.inside)
            ends = odd ^ state
            for line, inside, blank in zip(lines.to_pylist(), ends.tolist(), empty.tolist()):
                if blank and not inside and not pending and not first:
                    continue
                pending.append(line)
                if not inside:
                    emit(n, block, first, pending, True)
                    pending, first, n = [], False, n + 1
            state = int(ends[-1])
            if len(rows) >= 4096:
                yield flush(rows)
                rows = []
        if pending:
            emit(n, at[1], True, pending, False)
        if rows:
            yield flush(rows)

    rows = _lines(spark, path)
    whole = rows.mapInArrow(made, schema).select("row_id", "record")
    if not broken:
        return whole
    # files are not left out by a condition on their names: Spark would cut fewer files into other splits than those that were scanned
    edges = rows.mapInArrow(lambda b: made(b, True), schema).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("x"))
    return whole.unionByName(edges.select("row_id", F.array_join("x.record", "\n").alias("record")))


def read(spark: SparkSession, path: str, schema: StructType, name: str = "row_id", keep_empty: bool = False) -> DataFrame:
    """The columns of the schema, and the rows' numbers from 0 in their order in the files. keep_empty: empty fields in quotes are empty texts, not null."""
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    rows = records(spark, path).select("row_id", F.from_csv("record", ddl, {**CSV, "nullValue": NULL} if keep_empty else CSV).alias("x"))
    return rows.select(F.col("row_id").alias(name), *(F.col(f"x.c{i}").alias(f.name) for i, f in enumerate(schema)))
