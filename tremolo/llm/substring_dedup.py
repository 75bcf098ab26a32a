"""Removal of repeated passages by Rabin-Karp hashes of word windows (op 9).

Every window of WINDOW words gets a polynomial hash of its words' 64-bit hashes;
windows are counted over the whole corpus in Spark; a window whose words also
start anywhere else is repeated, and repeated windows that touch or overlap
merge into maximal removal intervals.

Texts are kept in compressed blocks of documents in the shared folder. Each
block sends its distinct window hashes (sorted, Elias-Fano coded) to shards and
hears back which of them another block has too; those that it has twice itself
it knows. Copies within a block thus travel once. A second hash picks the shard,
so the hashes that are compared have 64 + log2(shards) bits, which grow with the
corpus; the number of shards follows its size. No window is dropped or capped.

Words are runs of bytes other than ASCII white space, unchanged. Null and empty
texts have none and come back as empty ones; documents shorter than a window are
kept whole. Rows are told apart by place, so repeated rows and null doc_ids are
documents like others (and copies of each other). An empty table gives no rows;
other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, blocks, mix, raw, spread, trim, written
from .elias_fano import EliasFano

#: Words of a window; bytes of text of a block, for each shard, and for each partition in which blocks meet their answers.
WINDOW, BLOCK, SHARD, MEET = 35, 4 << 20, 16 << 20, 64 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WRAP = 1 << 64


def stored(docs: DataFrame) -> DataFrame:
    """block, doc_ids, lengths (bytes of each text), body (compressed texts), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in (x for y in batches for x in blocks([y], most=BLOCK)):
            texts = raw(b.column("text"))
            sizes = list(map(len, texts))
            yield pa.RecordBatch.from_arrays([pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))], pa.binary()), pa.array([sum(sizes)], pa.int64())], names=["doc_ids", "lengths", "body", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(run, "doc_ids array<long>, lengths array<long>, body binary, size long")
    return packed.select(F.monotonically_increasing_id().alias("block"), "*")  # fixed once it is written


def _texts(body: bytes, lengths: list[int]) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(body) if body else b""
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [whole[e - n : e] for e, n in zip(ends, lengths)]


def window_hashes(words: np.ndarray, base: int, window: int) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of every run of `window` word hashes, by differences of prefix sums."""
    n = len(words)
    if n < window:
        return np.empty(0, dtype=np.uint64)
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, _WRAP), dtype=np.uint64)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * np.multiply.accumulate(up), dtype=np.uint64)])
    return mix((sums[window:] - sums[:-window]) * np.multiply.accumulate(down)[: n - window + 1])


class _Block:
    """The windows of a block of documents, and their distinct hashes by shard."""

    def __init__(self, texts: list[bytes], memo: WordHash, window: int, shards: int):
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        flat = np.concatenate([memo.of(w) for w in self.words]) if self.words else np.empty(0, dtype=np.uint64)
        start = np.cumsum(self.sizes) - self.sizes
        count = np.maximum(self.sizes - window + 1, 0)
        self.count, self.first = count, np.cumsum(count) - count
        at = np.repeat(start - self.first, count) + np.arange(count.sum())
        if len(at):
            hashes, shard = window_hashes(flat, _BASES[0], window)[at], window_hashes(flat, _BASES[1], window)[at]
        else:
            hashes = shard = np.empty(0, dtype=np.uint64)
        shard = (shard >> np.uint64(40)) % np.uint64(shards)
        order = np.lexsort((hashes, shard))
        h, s = hashes[order], shard[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        self.order, self.group = order, np.cumsum(new) - 1
        self.hashes, self.shard = h[new], s[new].astype(np.int64)
        self.twice = np.bincount(self.group, minlength=int(new.sum())) > 1
        self.cuts = np.searchsorted(self.shard, np.arange(shards + 1))


def repeated(table: DataFrame, window: int, shards: int) -> DataFrame:
    """block, shard, flags: which of a block's distinct hashes in a shard other blocks have too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            for block, lengths, body in zip(*(b.column(c).to_pylist() for c in ("block", "lengths", "body"))):
                trim()
                x = _Block(_texts(body, lengths), memo, window, shards)
                full = np.flatnonzero(np.diff(x.cuts))
                if len(full):
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([EliasFano.encode(x.hashes[x.cuts[s] : x.cuts[s + 1]]).tobytes() for s in full], pa.binary())], names=["shard", "block", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard, held):
            if len(held) < 2:
                return
            each = [EliasFano.frombuffer(h).decode() for _, h in held]
            every = np.sort(np.concatenate(each))
            again = every[1:][every[1:] == every[:-1]]
            if len(again):
                for (block, _), own in zip(held, each):
                    hit = again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([np.packbits(hit).tobytes()], pa.binary())], names=["block", "shard", "flags"])

        shard, held = None, []
        for b in batches:
            for s, block, h in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "hashes"))):
                if s != shard:
                    yield from flush(shard, held)
                    shard, held = s, []
                held.append((block, h))
        yield from flush(shard, held)

    sent = table.select("block", "lengths", "body").mapInArrow(send, "shard int, block long, hashes binary")
    dealt = sent.repartition(spread(table, 2 * shards), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(count, "block long, shard int, flags binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (removed words, start and stop), kept (the other words, joined by a space)."""
    table = written(stored(docs), "texts")
    size = table.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    meet = spread(table, -(-size // MEET))  # tasks do not grow with the corpus
    heard = repeated(table, window, shards).repartition(meet, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "flags")).alias("heard"))
    rows = table.repartition(meet, "block").join(heard, "block", "left").select("doc_ids", "lengths", "body", "heard.shard", "heard.flags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            for ids, lengths, body, shard, flags in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "lengths", "body", "shard", "flags"))):
                trim()
                x = _Block(_texts(body, lengths), memo, window, shards)
                hit = x.twice.copy()
                for s, f in zip(shard or [], flags or []):
                    lo, hi = x.cuts[s], x.cuts[s + 1]
                    hit[lo:hi] |= np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=hi - lo).astype(bool)
                starts = np.zeros(len(x.order), dtype=bool)
                starts[x.order] = hit[x.group]
                out: list[list] = [[], []]
                for words, first, n in zip(x.words, x.first.tolist(), x.count.tolist()):
                    at = np.flatnonzero(starts[first : first + n])
                    if not len(at):
                        out[0].append([])
                        out[1].append(b" ".join(words))
                        continue
                    gap = np.flatnonzero(np.diff(at) > window) + 1
                    begin, end = at[[0, *gap]].tolist(), (at[[*(gap - 1), -1]] + window).tolist()
                    out[0].append([{"start": i, "stop": j} for i, j in zip(begin, end)])
                    out[1].append(b" ".join(w for i, j in zip([0, *end], [*begin, len(words)]) for w in words[i:j]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x.sizes), pa.array(out[0], spans), pa.array(out[1], pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of remove_repeats()."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
