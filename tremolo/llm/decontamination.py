"""Benchmark decontamination by size-partitioned MinHash containment search (op 4).

A short test item inside a long document shares few of the document's shingles,
so the search partitions by size (as LSH Ensemble does; Zhu and others, 2016):
items fall into classes of shingle counts up to (LOW * RATIO ** i), and for each
class documents are seen as overlapping windows of one and a half times that
bound. Within a window an item that is contained has a Jaccard similarity of
.3 at least, whatever the document's length. HASHES MinHash values, each a band
of its own, propose (document, item) pairs: a run of three quarters of an item
shares none of them with probability .7 ** 32 = 1e-5. Every proposal is
verified by exact containment: the share of the item's distinct five-word
shingles that the whole document has.

Items of fewer than FEW shingles must be there whole, so they are proposed by
their first shingle, exactly; an item of fewer than five words is the one run of
its words, which is sought as such in documents of any length.

Words here are runs of letters, digits and non-ASCII characters, A-Z
lower-cased, so that punctuation makes no difference. Very long texts are blocks
by themselves. Null and empty
texts have no shingles and match nothing; null ids are carried along; equal
items are reported each; repeated documents too. Empty tables give no pairs (or
all documents back). Other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, blocks, distinct, document_shingles, raw, shingles

#: Share of an item's shingles that make a document contaminated; MinHash functions; bounds of the size classes; items of one pass (the bound of what is broadcast).
LEVEL, HASHES, LOW, RATIO, PASS = 0.75, 32, 4, 1.5, 20_000
#: Items of fewer shingles are sought exactly, since LEVEL of them is all of them.
FEW = 4
#: Bytes of text that are searched at once, so that their hashes stay in a core's cache.
BLOCK = 1 << 20
#: Other bytes than digits, letters and non-ASCII ones become spaces, A-Z lower case.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_ODD = (np.random.default_rng(5).integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class Items:
    """Size classes of test items, each with the items' MinHash values."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        words = WordHash()
        kept = [(i, s, min(5, len(w))) for i, t in rows if len(s := np.unique(shingles(words.of(w := (t or "").encode().translate(_FOLD).split()))))]
        self.ids, self.sets = [i for i, _, _ in kept], [s for _, s, _ in kept]
        by: dict[int, list[int]] = {}
        # by words of a shingle (under five: those of the whole item), the first shingle and the item
        few: dict[int, list[tuple[int, int]]] = {}
        for n, (_, s, w) in enumerate(kept):
            if len(s) < FEW:
                few.setdefault(w, []).append((int(s[0]), n))
                continue
            bound = LOW
            while bound < len(s):
                bound = int(bound * RATIO)
            by.setdefault(bound, []).append(n)
        self.classes = []
        for bound, members in sorted(by.items()):
            least = np.array([[(self.sets[n] * c).min() for n in members] for c in _ODD])
            order = np.argsort(least, axis=1, kind="stable")
            self.classes.append((bound, np.array(members)[order], np.take_along_axis(least, order, axis=1)))

        self.few = {w: (np.array(sorted(own), dtype=object)[:, 0].astype(np.uint64), np.array(sorted(own), dtype=object)[:, 1].astype(np.int64)) for w, own in few.items()}

    def _exactly(self, hashes: np.ndarray, owner: np.ndarray, firsts: np.ndarray, members: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) where a text has the first shingle of a short item."""
        at = np.flatnonzero(np.isin(hashes, firsts))
        lo, hi = (np.searchsorted(firsts, hashes[at], side=s) for s in ("left", "right"))
        return {(int(owner[i]), int(members[j])) for i, a, b in zip(at, lo, hi) for j in range(a, b)}

    def matches(self, texts: list[bytes], words: WordHash) -> Iterator[tuple[int, int, int]]:
        """(text's index, item's index, shared shingles) of each text that has LEVEL of an item's shingles."""
        split = [t.translate(_FOLD).split() for t in texts]
        flat, sizes = document_shingles(split, words)
        if not sizes.sum() or not self.sets:
            return
        start = np.cumsum(sizes) - sizes
        proposed: set[tuple[int, int]] = set()
        for w, (firsts, members) in self.few.items():
            if w == 5:
                proposed |= self._exactly(flat, np.repeat(np.arange(len(sizes)), sizes), firsts, members)
            else:  # such an item is its one run of words
                long = [i for i, x in enumerate(split) if len(x) >= w]
                runs = [shingles(words.of(split[i]), w) for i in long]
                if runs:
                    owner = np.repeat(long, [len(r) for r in runs])
                    yield from sorted((i, n, 1) for i, n in self._exactly(np.concatenate(runs), owner, firsts, members))
        grids = []
        for bound, members, least in self.classes:
            half = bound // 2
            count = -(-sizes // half)
            owner = np.repeat(np.arange(len(sizes)), count)
            at = start[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * half
            pairs = [np.flatnonzero(owner[step:] == owner[:-step]) for step in (1, 2)]
            grids.append((owner, at, pairs, members, least))
        for f, c in enumerate(_ODD):
            hashed = flat * c
            for owner, at, pairs, members, least in grids:
                low = np.minimum.reduceat(hashed, at)
                # windows of three half blocks of one document; its last ones are shorter
                window = low.copy()
                for step, same in zip((1, 2), pairs):
                    window[same] = np.minimum(window[same], low[same + step])
                # by their first 16 bits most windows are none
                first = np.zeros(1 << 16, dtype=bool)
                first[least[f] >> np.uint64(48)] = True
                maybe = np.flatnonzero(first[window >> np.uint64(48)])
                lo = np.searchsorted(least[f], window[maybe], side="left")
                for i, j in zip(maybe, lo):
                    while j < least.shape[1] and least[f, j] == window[i]:
                        proposed.add((int(owner[i]), int(members[f, j])))
                        j += 1
        last, own = -1, None
        for d, n in sorted(proposed):
            if d != last:
                last, own = d, distinct(flat[start[d] : start[d] + sizes[d]])
            s = self.sets[n]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            both = int((own[at] == s).sum())
            if both >= LEVEL * len(s):
                yield d, n, both


def _passes(benchmark: DataFrame) -> Iterator[Items]:
    """The items, at most about PASS of them at once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-rows.count() // PASS))
    for i in range(n):
        yield Items([(r.item_id, r.text) for r in (rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows).toLocalIterator()])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each contaminated document and item: doc_id, item_id, item_shingles, shared, containment."""
    schema = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, items = WordHash(), shared.value
            for b in (x for y in batches for x in blocks([y], most=BLOCK)):
                ids = b.column("doc_id").to_pylist()
                if found := list(items.matches(raw(b.column("text")), words)):
                    size = [len(items.sets[n]) for _, n, _ in found]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[d] for d, _, _ in found], pa.int64()), "item_id": pa.array([items.ids[n] for _, n, _ in found], pa.int64()), "item_shingles": pa.array(size, pa.int64()), "shared": pa.array([x for _, _, x in found], pa.int64()), "containment": [x / s for (_, _, x), s in zip(found, size)]})

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item; same columns."""
    text, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    for items in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = WordHash()
            for b in (x for y in batches for x in blocks([y], names[text], BLOCK)):
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[d for d, _, _ in shared.value.matches(raw(b.column(text)), words)]] = False
                yield b.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.toDF(*docs.columns)
