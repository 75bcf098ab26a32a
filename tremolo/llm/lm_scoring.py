"""Language-model scores from an Elias-Fano n-gram trie (op 1).

An interpolated n-gram model with absolute discounts, over hashes of words; its
unigrams are the add-0.1 estimate of the base score:

    p_1(w) = (c + 0.1) / (N + 0.1 (V + 1))
    p_k(w | h) = (c(h w) - D) / c(h) + b(h) p_(k-1)(w | shorter h)

with one discount D for all counts and b(h) what it leaves, so each level sums to
one (up to quantisation) and no score depends on how the work is dealt out.

The trie is spread over shards by context: a shard holds the contexts that hash
to it (sorted, Elias-Fano), monotone pointers to their followers, the followers
as numbers relative to their context (Elias-Fano over all contexts in turn), and
quantised discounted probabilities and backoff weights. It is written to a file
and mapped into memory; queries are sorted and found by successor search within
their context's range.

Counting and scoring share one exchange for each level: documents are kept as
token blocks in the shared folder; a block sends each shard its distinct n-grams
with their counts in training documents, the shard adds up all blocks' counts,
builds its part of the trie, and answers each block. The answers are written and
what was shuffled for them is deleted before the next level, so disk holds one
level's n-grams at a time; levels above 2 go through in PASSES ranges of shards,
and blocks meet their answers in as many parts. All training documents count, so
what is gathered grows with the corpus; n-grams that repeat in a block travel once,
so a hot context weighs as much as its distinct followers. A word that precedes
more than half of a shard's share of all tokens is a hot context: its followers
are dealt to SPLIT parts, each a context of its own, and the parts' totals and
backoff masses are added up afterwards (a row for each hot word, at most two for
each shard). Blobs that wait in a shard spill to a temporary file.

Text rules: A-Z lower-cased, words are runs of bytes other than ASCII white
space, then one end. Null and empty texts are just the end. Rows are told apart
by place: repeated rows each count and are scored; a null doc_id is a training
row. Without training documents all counts are 0 and the base is
log10(0.1 / 0.1) = 0. Empty tables give no rows; other columns are untouched.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, distinct, mix, spread, trim, written
from .elias_fano import EliasFano

#: Length of n-grams; bytes of text of a block; training and other tokens for each shard; one in so many documents is held out.
ORDER, BLOCK, SHARD, HELD = 3, 4 << 20, 2_000_000, 10
#: Shards' worth of tokens for each partition in which blocks meet their answers.
MEET = 4
#: Ranges of shards that a level above 2 is asked for one after the other, and parts of the blocks that are scored so.
PASSES = 2
#: What is taken from each count of an n-gram.
DISCOUNT = 0.75
#: Codes of probabilities: steps of log10, as 16 bits; the last code is 0.
STEP, ZERO = 4096.0, 65535
#: Hashes that stand for the start of a text and its end.
START, END = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xE7037ED1A0B428DB)
#: Parts of a hot context; the total that parts are coded by, so that a code tells the count; words of a block that may be hot.
SPLIT, COUNT_SCALE, FREQUENT = 64, float(1 << 40), 512
#: Bytes of waiting blobs that a shard keeps in memory; n-grams that it adds up at once.
WAIT, MERGE = 16 << 20, 1_500_000
#: What each code stands for.
RESTORED = np.append(10 ** (-np.arange(ZERO) / STEP), 0.0)


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(p) * STEP), 0, ZERO - 1), ZERO).astype("<u2")


def restore(codes: np.ndarray) -> np.ndarray:
    return RESTORED[codes]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each as planes of bytes, compressed."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        each, planes = np.ascontiguousarray(a).view(np.uint8), np.empty((a.itemsize, len(a)), dtype=np.uint8)
        for i in range(a.itemsize):
            planes[i] = each[i :: a.itemsize]
        out.append((a.dtype.str, len(a), z.compress(planes)))
    return pickle.dumps(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    z, out = zstandard.ZstdDecompressor(), []
    for kind, n, data in pickle.loads(blob):
        a = np.empty(n, dtype=kind)
        if n:
            each, planes = a.view(np.uint8), np.frombuffer(z.decompress(data), dtype=np.uint8).reshape(a.itemsize, n)
            for i in range(a.itemsize):
                each[i :: a.itemsize] = planes[i]
        out.append(a)
    return out


class NgramTrie:
    """One level of a shard's trie: contexts, pointers, followers, and their quantised values."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, followers: EliasFano, probs: np.ndarray, weights: np.ndarray):
        self.contexts, self.pointers, self.followers, self.probs, self.weights = contexts, pointers, followers, probs, weights
        self._ends: np.ndarray | None = None

    @classmethod
    def build(cls, context: np.ndarray, follower: np.ndarray, count: np.ndarray, parts: np.ndarray | None = None) -> NgramTrie:
        """context (uint64) and follower (32 bits), sorted by both and distinct; count: at least 1 each.

        parts: contexts that are parts of hot ones; their codes are of discounted counts over
        COUNT_SCALE. `masses` keeps total and backoff mass of each context.
        """
        new = np.ones(len(context), dtype=bool)
        new[1:] = context[1:] != context[:-1]
        owner, first = np.cumsum(new) - 1, np.flatnonzero(new)
        total = np.add.reduceat(count, first) if len(first) else np.empty(0)
        ends = np.append(first, len(context))
        left = DISCOUNT * np.diff(ends)
        relative = (owner.astype(np.uint64) << np.uint64(32)) | follower.astype(np.uint64)
        scale = total.astype(float)
        if parts is not None and len(parts):
            scale[np.isin(context[first], parts)] = COUNT_SCALE
        trie = cls(EliasFano.encode(context[first]), EliasFano.encode(ends.astype(np.uint64)), EliasFano.encode(relative), quantise((count - DISCOUNT) / scale[owner]), quantise(left / total))
        trie.masses = (context[first], total.astype(float), left)
        return trie

    def write(self, path: str) -> None:
        with open(path, "wb") as f:
            for part in (self.contexts, self.pointers, self.followers):
                f.write(part.tobytes())
            f.write(self.probs.tobytes() + self.weights.tobytes())

    @classmethod
    def map(cls, path: str) -> NgramTrie:
        data, at, parts = np.memmap(path, dtype=np.uint8, mode="r"), 0, []
        for _ in range(3):
            parts.append(EliasFano.frombuffer(data, at))
            at += parts[-1].nbytes
        n, m = len(parts[2]), len(parts[0])
        return cls(*parts, data[at : at + 2 * n].view("<u2"), data[at + 2 * n : at + 2 * n + 2 * m].view("<u2"))

    def find(self, contexts: np.ndarray, sizes: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each follower's probability and of each context's backoff weight.

        contexts: sorted and distinct; followers: sizes[i] sorted ones of each in
        turn. What the trie lacks has probability 0, an absent context weight 1.
        """
        at, there = self.contexts.successors(contexts)
        weights = np.where(there, self.weights[np.minimum(at, max(0, len(self.contexts) - 1))] if len(self.contexts) else 0, 0).astype("<u2")
        codes = np.full(len(followers), ZERO, dtype="<u2")
        known = np.repeat(there, sizes)
        owner = np.repeat(at, sizes)[known]
        wanted = (owner.astype(np.uint64) << np.uint64(32)) | followers[known].astype(np.uint64)
        place, equal = self.followers.successors(wanted)
        if len(place):
            if self._ends is None:
                self._ends = self.pointers.decode().astype(np.int64)
            ends = self._ends
            inside = equal & (place >= ends[owner]) & (place < ends[owner + 1])
            codes[np.flatnonzero(known)[inside]] = self.probs[place[inside]]
        return codes, weights


def tokenised(docs: DataFrame) -> DataFrame:
    """Token blocks: block, doc_ids, held, lengths (words and the end), ids (each token's place among the words by how often they occur, and these words' places in words), words (sorted hashes), n, n_train, frequent (words that may be hot contexts, and how many tokens they precede)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in blocks([y], most=BLOCK)):
            # copied, since Arrow splits the slice of an array wrongly
            text = pc.fill_null(b.column("text"), "").cast(pa.large_string()).take(pa.array(np.arange(b.num_rows)))
            split = pc.ascii_split_whitespace(pc.ascii_lower(text))
            flat, owner = split.flatten(), pc.list_parent_indices(split)
            real = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
            found = flat.filter(real).dictionary_encode()
            lengths = np.bincount(owner.filter(real).to_numpy(), minlength=b.num_rows) + 1
            # two words of one hash are one word
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(found.dictionary))
            words, place = np.unique(np.append(hashes, END), return_inverse=True)
            end = np.cumsum(lengths) - 1
            ids = np.full(int(lengths.sum()), place[-1], dtype=np.int64)
            ids[np.delete(np.arange(len(ids)), end)] = place[found.indices.to_numpy()]
            often, lengths = np.bincount(ids, minlength=len(words)), lengths.tolist()
            ranked = np.argsort(-often, kind="stable")  # small numbers for frequent words compress better
            rank = np.empty(len(words), dtype="<u4")
            rank[ranked] = np.arange(len(words))
            top = np.flatnonzero((often * FREQUENT >= sum(lengths)) & (words != END))
            frequent = [{"word": w, "n": n} for w, n in zip([*words[top].view(np.int64).tolist(), -1], [*often[top].tolist(), len(lengths)])]  # -1: START
            held = b.column("held").to_pylist()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([b.column("doc_id").to_pylist()], longs), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], longs), pa.array([_pack(rank[ids], ranked.astype("<u4"))], pa.binary()), pa.array([EliasFano.encode(words).tobytes()], pa.binary()), pa.array([sum(lengths)], pa.int64()), pa.array([sum(n for n, h in zip(lengths, held) if not h)], pa.int64()), pa.array([frequent], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))],
                names=["block", "doc_ids", "held", "lengths", "ids", "words", "n", "n_train", "frequent"],
            )

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD)) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    return rows.mapInArrow(run, "block string, doc_ids array<long>, held array<boolean>, lengths array<long>, ids binary, words binary, n long, n_train long, frequent array<struct<word:long,n:long>>")


class _Block:
    """A token block's words and n-grams, as they are asked of shards and put together from the answers."""

    def __init__(self, held: list[bool], lengths: list[int], ids: bytes, words: bytes, shards: int, hot: np.ndarray):
        self.hot = hot
        ranks, ranked = _unpack(ids)
        self.words, self.ids = EliasFano.frombuffer(words).decode(), ranked.astype(np.int64)[ranks]
        self.lengths, self.shards = np.array(lengths, dtype=np.int64), shards
        self.train = ~np.repeat(np.array(held, dtype=bool), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.cuts = np.searchsorted(self._shard(self.words), np.arange(shards + 1))

    def counts(self) -> np.ndarray:
        """Of each word, in training documents."""
        return np.bincount(self.ids[self.train], minlength=len(self.words))

    def _shard(self, hashes: np.ndarray) -> np.ndarray:
        """Sorted hashes have sorted shards."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def _pairs(self) -> tuple[np.ndarray, ...]:
        """Of order 2, by whole numbers: hashes of contexts in order, the hot context of each part, and each token's context by its place among them."""
        v = len(self.words)
        code = np.concatenate([[v], self.ids[:-1]])
        code[self.first] = v
        own = np.concatenate([self.words, [START]])
        hot = np.flatnonzero(np.isin(own, self.hot)) if len(self.hot) else np.empty(0, dtype=np.int64)
        split = (own[hot, None] * np.uint64(0xD1342543DE82EF95) + np.arange(1, SPLIT + 1, dtype=np.uint64)).ravel()
        if len(hot):
            place = np.full(v + 1, -1, dtype=np.int64)
            place[hot] = np.arange(len(hot))
            mine = place[code]
            part = (self.words[self.ids] >> np.uint64(32)) % np.uint64(SPLIT)
            code = np.where(mine >= 0, v + 1 + mine * SPLIT + part.astype(np.int64), code)
        hashes, whole = np.concatenate([own, mix(split)]), np.concatenate([np.zeros(v + 1, dtype=np.uint64), np.repeat(own[hot], SPLIT)])
        order = np.argsort(hashes)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return hashes[order], whole[order], order > v, rank[code]

    def _contexts(self, order: int) -> np.ndarray:
        """The hash of each token's context of order - 1 words."""
        own = self.words[self.ids]
        before = np.concatenate([[START], own[:-1]]) if len(own) else own
        before[self.first] = START
        context = before
        for _ in range(order - 2):
            older = np.concatenate([[START], context[:-1]])
            older[self.first] = START
            context = mix(older * np.uint64(0x9E3779B97F4A7C15) + before)
        return context

    def _ranked(self, context: np.ndarray) -> tuple[np.ndarray, ...]:
        """As _pairs() has them, of hashes of contexts that are not split."""
        at = np.argsort(context)
        own = context[at]
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[1:] != own[:-1]
        place = np.empty(len(own), dtype=np.int64)
        place[at] = np.cumsum(new) - 1
        hashes = own[new]
        return hashes, np.zeros(len(hashes), dtype=np.uint64), np.zeros(len(hashes), dtype=bool), place

    def ngrams(self, order: int, start: int = 0, stop: int | None = None) -> None:
        """Distinct (context, follower) pairs of an order, sorted; seen() has their training counts, group() leads from tokens to pairs.

        start, stop: the shards whose contexts are wanted; of longer contexts no others are looked at.
        """
        ids, train = self.ids, self.train
        if order == 2:
            hashes, whole, part, context = self._pairs()
        else:
            context = self._contexts(order)
            if (start, stop or self.shards) != (0, self.shards):
                shard = self._shard(context)
                mine = np.flatnonzero((shard >= start) & (shard < stop))
                ids, train, context = ids[mine], train[mine], context[mine]
            hashes, whole, part, context = self._ranked(context)
        # context, word and place in one number: values sort far faster than indirectly
        bits = [max(1, len(x)).bit_length() for x in (hashes, self.words, ids)]
        if sum(bits) <= 64:
            w, p = np.uint64(bits[1]), np.uint64(bits[2])
            key = context.astype(np.uint64) << w
            key |= ids.astype(np.uint64)
            key <<= p
            key |= np.arange(len(ids), dtype=np.uint64)
            key.sort()
            self.at = (key & ((np.uint64(1) << p) - np.uint64(1))).astype(np.int64)
            key >>= p
            new = np.ones(len(key), dtype=bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            key = key[new]
            r, i = (key >> w).astype(np.int64), (key & ((np.uint64(1) << w) - np.uint64(1))).astype(np.int64)
        else:
            self.at = np.lexsort((ids, context))
            r, i = context[self.at], ids[self.at]
            new = np.ones(len(r), dtype=bool)
            new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
            r, i = r[new], i[new]
        self.new, self.trained = new, train
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, dtype=np.int64)
        self.followers = (self.words >> np.uint64(32)).astype(np.uint32)[i]
        own = r[first]
        self.contexts = hashes[own]
        # contexts that are parts of a hot one, and that one
        self.part, self.whole = part[own], whole[own]
        ends = np.append(first, len(r))
        self.sizes = np.diff(ends).astype(np.uint32)
        self.context_cuts = np.searchsorted(self._shard(self.contexts), np.arange(self.shards + 1))
        self.pair_cuts = ends[self.context_cuts]

    def seen(self) -> np.ndarray:
        """Each pair's count in training documents."""
        return np.bincount(np.cumsum(self.new)[self.trained[self.at]] - 1, minlength=len(self.followers)).astype(np.uint32)

    def group(self) -> np.ndarray:
        """Each token's pair by its place."""
        out = np.empty(len(self.at), dtype=np.int64)
        out[self.at] = np.cumsum(self.new) - 1
        return out


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8 if not len(a) or a.max() < 256 else np.uint32)


def answers(table: DataFrame, shards: int, level: int, hot: np.ndarray, start: int, stop: int) -> DataFrame:
    """block, level, shard, probs, weights: of each n-gram of a level that a block has in a shard, for the shards from start to below stop.

    Level 1: counts. Rows without a block: level 0, a shard's distinct training words (n);
    level -1, hot contexts with the totals and backoff masses of the parts that a shard has.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, held, lengths, ids, words in zip(*(b.column(c).to_pylist() for c in ("block", "held", "lengths", "ids", "words"))):
                trim()
                x = _Block(held, lengths, ids, words, shards, hot)
                if level > 1:
                    x.ngrams(level, start, stop)
                counts, seen = (x.counts(), None) if level == 1 else (None, x.seen())
                cuts, rows = (x.cuts if level == 1 else x.context_cuts), []
                for s in start + np.flatnonzero(np.diff(cuts[start : stop + 1])):
                    lo, hi = cuts[s], cuts[s + 1]
                    if level == 1:
                        rows.append((s, pickle.dumps((EliasFano.encode(x.words[lo:hi]).tobytes(), _pack(_small(counts[lo:hi]))))))
                    else:
                        p, q = x.pair_cuts[s], x.pair_cuts[s + 1]
                        rows.append((s, pickle.dumps((EliasFano.encode(x.contexts[lo:hi]).tobytes(), _pack(_small(x.sizes[lo:hi]), x.followers[p:q], _small(seen[p:q]), np.flatnonzero(x.part[lo:hi]).astype(np.uint32), x.whole[lo:hi][x.part[lo:hi]])))))
                yield pa.RecordBatch.from_arrays([pa.array([level] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.string()), pa.array([r for _, r in rows], pa.binary())], names=["level", "shard", "block", "asked"])

    def words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        w, c = pickle.loads(blob)
        return EliasFano.frombuffer(w).decode(), _unpack(c)[0]

    def pairs(blob: bytes) -> tuple[np.ndarray, ...]:
        """Contexts, sizes, followers, counts, places of parts among the contexts, and their hot contexts."""
        c, rest = pickle.loads(blob)
        return EliasFano.frombuffer(c).decode(), *_unpack(rest)

    def add(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, f, n = (np.concatenate(x) for x in zip(*held))
        contexts = distinct(c)
        key = (np.searchsorted(contexts, c).astype(np.uint64) << np.uint64(32)) | f.astype(np.uint64)
        every = distinct(key)  # blobs are sorted, so looking their keys up is cheap
        total = np.zeros(len(every), dtype=np.int64)
        np.add.at(total, np.searchsorted(every, key), n)
        return contexts[(every >> np.uint64(32)).astype(np.int64)], (every & np.uint64(0xFFFFFFFF)).astype(np.uint32), total

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(level: int, shard: int, waiting, n_waiting: int, held: list, wholes: dict[int, int]) -> Iterator[pa.RecordBatch]:
            def row(block, probs, weights, n, kind=level):
                return pa.RecordBatch.from_arrays([pa.array([block], pa.string()), pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([probs], pa.binary()), pa.array([weights], pa.binary()), pa.array([n], pa.int64())], names=["block", "level", "shard", "probs", "weights", "n"])

            key, follower, count = add(held)
            if level > 1:
                path = os.path.join(tempfile.gettempdir(), uuid.uuid4().hex)
                built = NgramTrie.build(key, follower, count, np.fromiter(wholes, dtype=np.uint64, count=len(wholes)))
                built.write(path)
                trie = NgramTrie.map(path)
                os.unlink(path)  # the mapping stays
                contexts, totals, lefts = built.masses
                own = np.flatnonzero(np.isin(contexts, np.fromiter(wholes, dtype=np.uint64, count=len(wholes))))
                if len(own):
                    yield row(None, _pack(np.array([wholes[int(c)] for c in contexts[own]], dtype=np.uint64)), _pack(totals[own], lefts[own]), None, -1)
                del built
            else:
                yield row(None, None, None, len(key), 0)
            waiting.seek(0)
            for _ in range(n_waiting):
                block, blob = pickle.load(waiting)
                if level == 1:
                    own, _ = words(blob)
                    at = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
                    c = np.where(key[at] == own, count[at], 0) if len(key) else np.zeros(len(own), dtype=np.int64)
                    yield row(block, _pack(c.astype(np.uint32) if not len(c) or c.max() < 1 << 32 else c.astype(np.uint64)), None, None)
                else:
                    c, sizes, f, *_ = pairs(blob)
                    probs, weights = trie.find(c, sizes.astype(np.int64), f)
                    yield row(block, _pack(probs), _pack(weights), None)

        def fresh() -> tempfile.SpooledTemporaryFile:
            return tempfile.SpooledTemporaryFile(max_size=WAIT)

        at, waiting, n, held, size, wholes = None, fresh(), 0, [], 0, {}
        for b in batches:
            for level, shard, block, blob in zip(*(b.column(c).to_pylist() for c in ("level", "shard", "block", "asked"))):
                if (level, shard) != at:
                    if at:
                        yield from flush(*at, waiting, n, held, wholes)
                        waiting.close()
                        trim()
                    at, waiting, n, held, size, wholes = (level, shard), fresh(), 0, [], 0, {}
                pickle.dump((block, blob), waiting)
                n += 1
                if level == 1:
                    own, c = words(blob)
                    own, f = own, np.zeros(len(own), dtype=np.uint32)
                else:
                    own, sizes, f, c, places, hots = pairs(blob)
                    wholes.update(zip(own[places].tolist(), hots.tolist()))
                    own = np.repeat(own, sizes)
                some = c > 0
                held.append((own[some], f[some], c[some].astype(np.int64)))
                size += int(some.sum())
                if size > MERGE:
                    held = [add(held)]
                    size = len(held[0][0]) // 2
        if at:
            yield from flush(*at, waiting, n, held, wholes)
            waiting.close()

    asked = table.select("block", "held", "lengths", "ids", "words").mapInArrow(ask, "level int, shard int, block string, asked binary")
    dealt = asked.repartition(spread(table, 2 * (stop - start)), "level", "shard").sortWithinPartitions("level", "shard")
    return dealt.mapInArrow(answer, "block string, level int, shard int, probs binary, weights binary, n long")


def _masses(heard: DataFrame) -> dict[int, tuple[float, float]]:
    """Total and backoff mass of each hot context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, w in zip(b.column("probs").to_pylist(), b.column("weights").to_pylist()):
                total, left = _unpack(w)
                yield pa.RecordBatch.from_pydict({"word": _unpack(p)[0].view(np.int64), "total": total, "left": left})

    rows = heard.where("level = -1").select("probs", "weights").mapInArrow(run, "word long, total double, left double")
    return {r.word % (1 << 64): (r.total, r.left) for r in rows.groupBy("word").agg(F.sum("total").alias("total"), F.sum("left").alias("left")).collect()}


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    table = written(tokenised(docs), "tokens", sweep=True)
    sums = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("train")).first()
    shards, train = max(1, -(-sums["n"] // SHARD)), sums["train"]
    often = table.select(F.explode("frequent").alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n")).where(F.col("n") * 2 * shards > sums["n"])
    # more than 1 / (2 shards) of all tokens each: at most 2 * shards rows
    hot = np.sort(np.array([r.word for r in often.collect()], dtype=np.int64).view(np.uint64)) if shards > 1 else np.empty(0, dtype=np.uint64)
    levels = []
    for level in range(1, order + 1):
        cuts = [i * shards // PASSES for i in range(PASSES + 1)] if level > 2 else [0, shards]
        levels.append([written(answers(table, shards, level, hot, a, b), f"answers-{level}", rows=100, sweep=True) for a, b in zip(cuts, cuts[1:]) if a < b])
    masses = _masses(levels[1][0]) if order > 1 else {}
    distinct = levels[0][0].where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heard = reduce(DataFrame.unionByName, (x for y in levels for x in y)).where("level > 0")
    bottom = train + 0.1 * (distinct + 1)
    parts = min(PASSES, shards)
    meet = spread(table, -(-shards // (MEET * parts)))  # tasks do not grow with the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs_, held, lengths, ids, words, *got in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "held", "lengths", "ids", "words", "level", "shard", "probs", "weights"))):
                trim()
                x = _Block(held, lengths, ids, words, shards, hot)
                replies = {(lv, s): (p, w) for lv, s, p, w in zip(*got)}
                counts = np.zeros(len(x.words))
                for s in np.flatnonzero(np.diff(x.cuts)):
                    counts[x.cuts[s] : x.cuts[s + 1]] = _unpack(replies[1, s][0])[0]
                p1 = ((counts + 0.1) / bottom)[x.ids]
                p = p1
                for level in range(2, order + 1):
                    x.ngrams(level)
                    probs, weights = np.empty(len(x.followers), dtype="<u2"), np.empty(len(x.contexts), dtype="<u2")
                    for s in np.flatnonzero(np.diff(x.context_cuts)):
                        a, w = (_unpack(y)[0] for y in replies[level, s])
                        probs[x.pair_cuts[s] : x.pair_cuts[s + 1]], weights[x.context_cuts[s] : x.context_cuts[s + 1]] = a, w
                    a, w = restore(probs), restore(weights)
                    if x.part.any():
                        total, left = (np.array([masses.get(int(c), (0.0, 0.0))[i] for c in x.whole[x.part]]) for i in (0, 1))
                        w[x.part] = np.where(total > 0, left / np.maximum(total, 1), 1.0)
                        scale = np.ones(len(x.contexts))
                        scale[x.part] = COUNT_SCALE / np.maximum(total, 1)
                        a *= np.repeat(scale, x.sizes)
                    group = x.group()
                    p = a[group] + np.repeat(w, x.sizes)[group] * p
                each = [np.add.reduceat(v, x.first) for v in ((counts > 0)[x.ids].astype(np.int64), np.log10(p1), np.log10(p))]
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(held, pa.bool_()), pa.array(x.lengths), pa.array(each[0]), pa.array([train] * len(docs_), pa.int64()), pa.array(each[1]), pa.array(each[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def met(i: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("block"), F.lit(parts)) == i
        own = heard.where(mine).repartition(meet, "block").groupBy("block").agg(F.collect_list(F.struct("level", "shard", "probs", "weights")).alias("heard"))
        rows = table.where(mine).repartition(meet, "block").join(own, "block").select("doc_ids", "held", "lengths", "ids", "words", "heard.level", "heard.shard", "heard.probs", "heard.weights")
        return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    return reduce(DataFrame.unionByName, (written(met(i), "scores", rows=100, sweep=True) for i in range(parts)))
