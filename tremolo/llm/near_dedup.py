"""Near-duplicate classes by fast similarity sketching (op 10).

Each document's set of five-word shingles gets a sketch of T coordinates by
rounds of hashed bin placement (Dahlgaard, Knudsen and Thorup, "Fast similarity
sketching", 2017): in round i every element falls into a bin and carries the
value i plus a fraction; a coordinate keeps the least value; a set is done when
all bins are full.  Rounds T to 2T-1 put every element into bin i-T, so that all
coordinates fill whatever the size.  Bands of ROWS coordinates then propose
links, which are verified on the full sets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import halves, hashed, id_filter, inside, without
from .common import WordHash, blocks, components, mix, raw, shingles, trim, written

#: Coordinates of a sketch, and coordinates of a band. At 0.75 a link shares no band with probability (1 - .75**5) ** 48 = 2e-6.
T, ROWS = 240, 5
BANDS = T // ROWS
BAND_SEED = np.uint64(0x51ED270B0929C96D)


def sketches(values: np.ndarray, sizes: np.ndarray, t: int = T) -> np.ndarray:
    """Sketch of each set; values: the sets' distinct hashes one after the other, sizes: how many each has (at least one)."""
    n = len(sizes)
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    empty = np.full(n, t)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    for i in range(2 * t):
        live = empty[owner] > 0
        if not live.all():
            values, owner = values[live], owner[live]
        if not len(values):
            break
        h = mix(values ^ np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        # the bin from the high half, the fraction from the low 48 bits, the round above them
        place = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if i < t else np.full(len(h), i - t, dtype=np.uint64)
        np.minimum.at(out, owner * t + place.astype(np.int64), (h & np.uint64(0xFFFFFFFFFFFF)) | np.uint64(i << 48))
        empty = (out.reshape(n, t) == np.iinfo(np.uint64).max).sum(1)
    return out.reshape(n, t)


def band_keys(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each sketch; the band's number is part of it."""
    n, t = s.shape
    s = s[:, : t // rows * rows].reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(1, t // rows + 1, dtype=np.uint64) * BAND_SEED, s.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
    return key


#: Bytes of text whose sets and sketches a task makes at once.
BLOCK = 2 << 20
#: A link: 100 * intersection >= LEVEL * union.
LEVEL = 75
#: Members, and their shingles, that a part of a bucket has about; a task compares two parts.
PART, PART_SHINGLES = 2000, 2_000_000
#: Pairs whose sketches agree in fewer coordinates than this share (the level less 5 standard deviations) are no links.
LEAST_AGREE = 0.75 - 5 * (0.75 * 0.25 / T) ** 0.5


def _sets(texts: list[bytes], words: WordHash) -> list[np.ndarray]:
    return [np.unique(shingles(words.of(t.lower().split()))) for t in texts]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set; null: empty set), bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in (x for y in batches for x in blocks([y], most=BLOCK)):
            sets = _sets(raw(b.column("text")), words)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            bands: list = [None] * len(sets)
            if len(full):
                for i, k in zip(full, band_keys(sketches(np.concatenate(sets), sizes[full])).astype(np.int64)):
                    bands[i] = k
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return _plain(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def candidate_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes), sketch (16 bits a coordinate) of the documents whose doc_id is a node of ids.

    A filter of the ids keeps other texts from being shuffled; what it lets through by
    mistake has no pair and does no harm. Too many ids for one filter are joined.
    """
    made = id_filter(ids)

    def wanted(b: pa.RecordBatch) -> pa.RecordBatch:
        shared, cells = made
        return b.filter(pa.array(inside(halves(b), np.frombuffer(shared.value, dtype=np.uint8), cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in (x for y in batches for x in blocks([wanted(y) if made else y], most=BLOCK)):
            sets = _sets(raw(b.column("text")), words)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            if len(full):
                short = mix(sketches(np.concatenate(sets), sizes[full])).astype("<u2")
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(full)), pa.array([sets[i].tobytes() for i in full], pa.binary()), pa.array([s.tobytes() for s in short], pa.binary())], names=["node", "shingles", "sketch"])

    own = _plain(docs).where("doc_id IS NOT NULL")
    rows = own.select("*", *hashed("doc_id")) if made else own.join(ids.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return rows.mapInArrow(run, "node long, shingles binary, sketch binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two full sets."""
    if 100 * min(len(a), len(b)) < LEVEL * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= LEVEL * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(x).to_pylist() for x in ("a", "c"))
            trim()
            yield b.select(["u", "v"]).filter(pa.array([linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(a, c)], pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("c")), "v")
    both = left.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    return both.select("u", "v", "a", "c").mapInArrow(run, "u long, v long")


def _compare(rows: list[tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]], part: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between members of one bucket that are in different classes so far; each one found merges its classes.

    rows: band number, node, class, part, bands, sketch, shingles. Pairs that meet in an
    earlier band too are left to that one.
    """
    rows.sort(key=lambda r: r[1])
    parent = {r[2]: r[2] for r in rows}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sketch, bands, parts = np.stack([r[5] for r in rows]), np.stack([r[4] for r in rows]), np.array([r[3] for r in rows])
    classes, band = np.array([r[2] for r in rows]), rows[0][0]
    sizes = np.array([len(r[6]) for r in rows])
    most = Counter(classes.tolist()).most_common(1)[0][0]
    found = []
    # the largest class is met from the other side of each pair
    for i in np.flatnonzero(classes != most):
        fits = (classes != classes[i]) & (100 * np.minimum(sizes, sizes[i]) >= LEVEL * np.maximum(sizes, sizes[i]))
        if part[0] != part[1]:
            fits &= parts != parts[i]
        fits &= (classes == most) | (np.arange(len(rows)) > i)
        at = np.flatnonzero(fits)
        agree = (sketch[at] == sketch[i]).mean(axis=1)
        at, agree = at[agree >= LEAST_AGREE], agree[agree >= LEAST_AGREE]
        first = (bands[at] == bands[i]).argmax(axis=1)
        at = at[first == band][np.argsort(-agree[first == band], kind="stable")]
        for j in at:
            x, y = find(rows[i][2]), find(rows[j][2])
            if x != y and linked(rows[i][6], rows[j][6]):
                parent[x] = y
                found.append((rows[i][1], rows[j][1]))
    return found


def crossing(active: DataFrame, sets: DataFrame, bands: DataFrame) -> DataFrame:
    """Links (u, v) between members of a bucket that star links have left in different classes.

    active: key, band, node, component, part, parts. A bucket of several parts is
    compared in cells of two parts each, so that a task holds about two parts at most.
    """
    cells = active.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "band", "node", "component", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    rows = cells.join(bands, "node").join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cell, held):
            links = _compare(held, cell[1:]) if len({r[2] for r in held}) > 1 else []
            if links:
                yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([c for _, c in links], pa.int64())})

        cell, held = None, []
        for b in batches:
            trim()
            for key, band, node, comp, part, p, q, keys, s, sk in zip(*(b.column(c).to_pylist() for c in ("key", "band", "node", "component", "part", "p", "q", "bands", "shingles", "sketch"))):
                if (key, p, q) != cell:
                    if held:
                        yield from flush(cell, held)
                    cell, held = (key, p, q), []
                held.append((band, node, comp, part, np.array(keys, dtype=np.int64), np.frombuffer(sk, dtype="<u2"), np.frombuffer(s, dtype=np.uint64)))
        if held:
            yield from flush(cell, held)

    n = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, n_equal (documents of the same set).

    1. Documents of equal sets become one node, their smallest doc_id.
    2. Bands put nodes into buckets; each bucket proposes links to its smallest
       node only (a star), which are verified on full sets.
    3. Buckets whose members are still in several classes are compared across
       classes, within the memory of a task: a pair is tested when the sketches
       agree in LEAST_AGREE of their coordinates, in the first band that it shares.
    4. Classes are the connected components of all verified links.

    Documents without words, or without a doc_id, are linked with nothing. Rows
    that share a doc_id count as one document: their classes are one. Empty tables
    give none; other columns are untouched.
    """
    rows = written(signatures(docs), "signatures")
    valid = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    # equal sets have equal bands: one of each, found before the shuffle where a task has several
    nodes = written(valid.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_equal"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "nodes")
    members = valid.select("doc_id", "set_key", "n_shingles").join(nodes.select("set_key", "node", "n_equal"), "set_key")
    keys = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    centres = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n"), F.sum("n_shingles").alias("size")).where("n > 1")
    full = written(keys.drop("n_shingles").join(centres, "key"), "buckets")
    pairs = written(full.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = written(candidate_sets(docs, ids), "sets")
    links = written(verified(pairs, sets), "links", rows=50)
    so_far = components(links, "stars")
    marked = full.join(so_far, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component"), "n", "size")
    mixed = marked.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("size") / PART_SHINGLES)).cast("int")
    active = marked.join(mixed, "key").select("key", "band", "node", "component", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    active = written(active, "active")
    bands = nodes.select("node", "bands").join(active.select("node").distinct(), "node", "left_semi")
    twins = members.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("u", "v")
    crossed = written(crossing(active, sets, bands), "crossed", rows=50)
    final = components(links.unionByName(crossed).unionByName(twins), "classes")
    named = members.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"), "n_equal")
    alone = rows.where("doc_id IS NULL OR set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_equal"))
    return named.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "n_equal")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those whose class has a smaller doc_id; same columns."""
    return without(docs, written(classes(docs).where("NOT kept").select(F.col("doc_id").alias("node")), "lost"))
