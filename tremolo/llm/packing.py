"""Packing of tokenised documents into sequences by best-fit decreasing (op 7).

A document's ids, with an end id behind them, are cut into full windows and one
remainder. Remainders go, longest first, into the open window with the least
room that still holds them, found by a segment tree over the room left. Lengths
are whole numbers up to the window, so the order among equal lengths is free and
the packing of any number of pieces follows from how many there are of each
length: the driver plans over that histogram (never over documents), and the
plan's steps (at most about 2 * window ** 2, a few thousand in practice) go to
the tasks, where a piece's rank among those of its length finds its place.

The ids are kept: compressed with their block while the packing is planned, then
with each piece as 32-bit little-endian numbers. A sequence is its pieces' ids in
the order of their offsets.

Special tokens that stand in a text get their own ids, as the tokenizer's default
has it. Null texts count as empty and give one piece, the end id. Rows with equal or
null doc_ids are packed each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, written

WINDOW, END_ID, BLOCK = 1024, 0, 8 << 20
#: Blocks of an Arrow batch where ids travel.
BATCH = 4
_coders: dict[str, object] = {}


def coder(path: str):
    """The tokenizer of a file of byte-level BPE ranks, which has the ids, and the special tokens, of the JSON file of the same name."""
    if path not in _coders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special, whole = {}, path.removesuffix(".tiktoken") + ".json"
        if os.path.exists(whole):
            with open(whole, encoding="utf-8") as f:
                special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        _coders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _coders[path]


def ranks_path(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


class RoomTree:
    """Segment tree over the room left in open windows: which rooms occur, and the least one of at least some size."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, there: bool) -> None:
        i = room + self.leaves
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        if self.any[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing over counts of pieces by length.

    A row of the result holds: length, first rank, pieces, first sequence, pieces
    to a sequence, offset of a sequence's first one. Windows alike in room are
    kept as ranges; a step fills a whole range with pieces of one length.
    """
    tree, open_, made, steps = RoomTree(window), {}, 0, []

    def put(room: int, start: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((start, n))
            tree.set(room, True)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room, start, n = window, made, -(-left // (window // size))
                made += n
            else:
                start, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            each = room // size
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            if full:
                steps.append((size, rank, full * each, start, each, window - room))
                put(room - each * size, start, full)
            if rest:
                steps.append((size, rank + full * each, rest, start + full, each, window - room))
                put(room - rest * size, start + full, 1)
            put(room, start + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


def _ranks(sizes: np.ndarray) -> np.ndarray:
    """Each piece's rank among the block's pieces of its length."""
    order = np.argsort(sizes, kind="stable")
    s = sizes[order]
    first = np.flatnonzero(np.diff(s, prepend=-1))
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.arange(len(s)) - np.repeat(first, np.diff([*first, len(s)]))
    return out


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """A row for each block of documents: its pieces as arrays, their ids compressed one after the other, and how many there are of each length."""
    schema = "block string, doc_id array<long>, start array<long>, length array<long>, doc_tokens array<long>, rank array<long>, sizes array<long>, counts array<long>, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encode, z = partial(coder(path).encode, allowed_special="all", disallowed_special=()), zstandard.ZstdCompressor(level=1)
        for b in (x for y in batches for x in blocks([y], most=BLOCK)):
            out: list[list] = [[], [], [], []]
            kept: list[np.ndarray] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                kept.append(ids)
                for start in range(0, len(ids), window):
                    for x, v in zip(out, (doc, start, min(window, len(ids) - start), len(ids))):
                        x.append(v)
            sizes = np.array(out[2], dtype=np.int64)
            kinds, counts = np.unique(sizes, return_counts=True)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([list(x)], longs) for x in (*out, _ranks(sizes), kinds, counts)), pa.array([z.compress(np.concatenate(kept).tobytes())], pa.binary())], names=["block", "doc_id", "start", "length", "doc_tokens", "rank", "sizes", "counts", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, 4 bytes each)."""
    table = written(pieces(docs, ranks_path(path), window), "pieces")
    by = table.select("block", F.explode(F.arrays_zip("sizes", "counts")).alias("x")).select("block", F.col("x.sizes").alias("size"), F.col("x.counts").alias("n"))
    steps = plan({r["size"]: r["n"] for r in by.groupBy("size").agg(F.sum("n").alias("n")).collect()}, window)  # a row for each length, at most `window`
    before = F.sum("n").over(Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by.select("block", "size", F.coalesce(before, F.lit(0)).alias("first")).groupBy("block").agg(F.collect_list(F.struct("size", "first")).alias("firsts"))
    rows = table.join(firsts, "block").select("doc_id", "start", "length", "doc_tokens", "rank", "ids", F.col("firsts.size").alias("size"), F.col("firsts.first").alias("first"))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << np.int64(50)
        key = steps[:, 0] * wide + steps[:, 1]
        order = np.argsort(key)
        own, key, z = steps[order], key[order], zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].values
                length = get("length").to_numpy(zero_copy_only=False)
                first = np.zeros(window + 1, dtype=np.int64)
                first[get("size").to_numpy(zero_copy_only=False)] = get("first").to_numpy(zero_copy_only=False)
                rank = get("rank").to_numpy(zero_copy_only=False) + first[length]
                s = own[np.searchsorted(key, length * wide + rank, side="right") - 1]
                j = rank - s[:, 1]
                ends = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(z.decompress(b.column("ids")[i].as_py()))])
                yield pa.RecordBatch.from_pydict({c: get(c) for c in ("doc_id", "start", "length", "doc_tokens")} | {"sequence_id": s[:, 3] + j // s[:, 4], "offset": s[:, 5] + j % s[:, 4] * length, "ids": ids})

    placed = written(rows.mapInArrow(place, schema), "placed", rows=BATCH, compression="zstd")
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
