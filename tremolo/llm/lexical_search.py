"""Ranked lexical search, document at a time over sharded postings (op 12).

The index has one row for each shard (a block of at most SHARD_BYTES of text, or
one longer text): its documents in the order of doc_id, and for each term the
gaps between its documents and its counts, as bytes of variable length. A
query's lists in a shard are merged document at a time through a heap of their
heads. Lists whose highest contributions together stay below the worst of the
best `top` scores cannot bring a new document in by themselves, so they leave
the heap and are only asked for the candidates of the others (exact: a bound
that equals the worst score is still followed up). The best scores of a query
are kept in a bounded heap keyed by score, then doc_id, over all shards of a
task; the tasks' few rows meet in a ranked merge.

Corpus counts (documents, lengths, document frequencies) are sums over shards.
Queries are handled in blocks of at most QUERY_BYTES, the bound of what is
broadcast; every block is asked of every shard.

Null texts have no terms. A null doc_id comes after all others among equal
scores. Rows that repeat are documents, or queries, of their own: each is
counted, and each query row has its own ranks. Queries without terms, or whose
terms occur nowhere, have no rows. Very long texts are read whole and are shards
by themselves. Tables may be empty; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, lower_sql, raw, work_dir, written

#: Best documents of a query; bytes of text of a shard; bytes of query terms that are broadcast at once.
TOP, SHARD_BYTES, QUERY_BYTES = 20, BLOCK_BYTES, 16 << 20
#: Terms: runs of bytes that are no ASCII character but a digit or a letter.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NO_ID = 2**63


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())


# -- numbers as bytes of variable length -------------------------------------------


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low bits first, the high bit on all bytes of a number but its last; and how many bytes each number takes."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), dtype=np.int64)
    for b in range(1, 10):
        size += x >= np.uint64(1 << 7 * b)
    out, at = np.empty(int(size.sum()), dtype=np.uint8), np.cumsum(size) - size
    for b in range(int(size.max(initial=0))):
        own = size > b
        out[at[own] + b] = ((x[own] >> np.uint64(7 * b)) & np.uint64(127)) | ((size[own] > b + 1).astype(np.uint64) << np.uint64(7))
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.empty(0, dtype=np.int64)
    last = data < 128
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    within = np.arange(len(data)) - np.repeat(start, np.diff(np.concatenate([start, [len(data)]])))
    return np.add.reduceat((data & np.uint8(127)).astype(np.int64) << (7 * within), start)


# -- the index ---------------------------------------------------------------------

#: docs: doc_ids in order, then those without one (nameless). lengths: terms of each. names: terms, by line feeds. dfs: documents of each term. gaps, tfs: its postings; the sizes tell how many bytes each term has of them.
INDEX = "n long, total long, docs binary, nameless long, lengths binary, names binary, dfs binary, gap_sizes binary, gaps binary, tf_sizes binary, tfs binary"


def _shard(ids: list[int | None], texts: list[bytes]) -> dict:
    order = sorted(range(len(ids)), key=lambda i: _NO_ID if ids[i] is None else ids[i])
    split = [terms(texts[i]) for i in order]
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    own = np.fromiter((number[w] for words in split for w in words), dtype=np.int64, count=int(lengths.sum()))
    pairs, tf = np.unique(own * len(split) + np.repeat(np.arange(len(split)), lengths), return_counts=True)
    term, doc = np.divmod(pairs, max(1, len(split)))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    (gaps, gap_size), (counts, count_size) = pack(gap), pack(tf)
    each = lambda size: pack(np.add.reduceat(size, first) if len(first) else size)[0].tobytes()
    known = np.array([ids[i] for i in order if ids[i] is not None], dtype=np.int64)
    return {
        "n": int((lengths > 0).sum()),
        "total": int(lengths.sum()),
        "docs": known.tobytes(),
        "nameless": len(ids) - len(known),
        "lengths": pack(lengths)[0].tobytes(),
        "names": b"\n".join(number),
        "dfs": pack(np.bincount(term, minlength=len(number)))[0].tobytes(),
        "gap_sizes": each(gap_size),
        "gaps": gaps.tobytes(),
        "tf_sizes": each(count_size),
        "tfs": counts.tobytes(),
    }


def index(docs: DataFrame) -> DataFrame:
    """The shards of the documents, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            row = _shard(ids, texts)
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

        ids, texts, held = [], [], 0
        for b in (x for y in batches for x in blocks([y], most=SHARD_BYTES)):
            more = raw(b.column("text"))
            size = sum(map(len, more))
            if ids and held + size > SHARD_BYTES:
                yield flush()
                ids, texts, held = [], [], 0
            ids += b.column("doc_id").to_pylist()
            texts += more
            held += size
        if ids:
            yield flush()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(own.mapInArrow(run, INDEX), "postings", compression="zstd")


def _numbers(data: bytes) -> np.ndarray:
    return unpack(np.frombuffer(data, dtype=np.uint8))


def _stretch(data: bytes, sizes: bytes, pick: np.ndarray) -> np.ndarray:
    """The numbers of the picked terms, one term after the other."""
    size = _numbers(sizes)
    start, size = (np.cumsum(size) - size)[pick], size[pick]
    return unpack(np.frombuffer(data, dtype=np.uint8)[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())])


class Shard:
    """The wanted terms' postings of a row of the index, decoded at once."""

    def __init__(self, row: dict, wanted: dict[bytes, int], n: int, total: int):
        names = row["names"].split(b"\n") if row["names"] else []
        here = [(i, wanted[t]) for i, t in enumerate(names) if t in wanted]
        self.at = {t: k for k, (_, t) in enumerate(here)}
        if not here:
            return
        pick = np.array([i for i, _ in here], dtype=np.int64)
        count = _numbers(row["dfs"])[pick]
        self.ends = np.cumsum(count)
        self.first = self.ends - count
        gap, tf = _stretch(row["gaps"], row["gap_sizes"], pick), _stretch(row["tfs"], row["tf_sizes"], pick)
        run = np.cumsum(gap)
        self.docs = run - np.repeat((run - gap)[self.first], count)
        # 100 - 25 + 25 n N / L: what a document's length adds
        m = np.array([75 + 25 * x * n // total for x in _numbers(row["lengths"]).tolist()], dtype=np.int64)
        self.part = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs])
        self.most = np.maximum.reduceat(self.part, self.first)
        self.ids = np.frombuffer(row["docs"], dtype=np.int64).tolist() + [_NO_ID] * row["nameless"]

    def lists(self, query: list[tuple[int, int]]) -> list[tuple[int, list[int], list[int]]]:
        """Of each of the query's (term, weight) that the shard has: the highest contribution, the documents, the contributions; least first."""
        out = []
        for t, w in query:
            k = self.at.get(t)
            if k is not None and w:
                lo, hi = self.first[k], self.ends[k]
                out.append((int(self.most[k]) * w, self.docs[lo:hi].tolist(), (self.part[lo:hi] * w).tolist()))
        out.sort(key=lambda x: x[0])
        return out


def search_shard(shard: Shard, query: list[tuple[int, int]], best: list[tuple[int, int]], top: int) -> None:
    """Merges the query's lists document at a time into best, a heap of (score, -doc_id)."""
    lists = shard.lists(query)
    bound = [0]  # of all lists before each
    for most, _, _ in lists:
        bound.append(bound[-1] + most)
    ids, place = shard.ids, [0] * len(lists)
    worst = best[0][0] if len(best) == top else 1  # scores are above 0
    low = 0  # lists before it cannot reach the worst score together
    while low < len(lists) and bound[low + 1] < worst:
        low += 1
    heads = [(docs[0], i) for i, (_, docs, _) in enumerate(lists) if i >= low]
    heapify(heads)
    while heads:
        d, score = heads[0][0], 0
        while heads and heads[0][0] == d:
            i = heads[0][1]
            _, docs, parts = lists[i]
            at = place[i]
            score += parts[at]
            place[i] = at = at + 1
            if at < len(docs):
                heapreplace(heads, (docs[at], i))
            else:
                heappop(heads)
        for i in range(low - 1, -1, -1):
            if score + bound[i + 1] < worst:
                score = 0
                break
            _, docs, parts = lists[i]
            place[i] = at = bisect_left(docs, d, place[i])
            if at < len(docs) and docs[at] == d:
                score += parts[at]
        if score < worst:
            continue
        found = (score, -ids[d])
        if len(best) < top:
            heappush(best, found)
        elif found > best[0]:
            heapreplace(best, found)
        if len(best) == top and best[0][0] > worst:
            worst, before = best[0][0], low
            while low < len(lists) and bound[low + 1] < worst:
                low += 1
            if low > before:
                heads = [h for h in heads if h[1] >= low]
                heapify(heads)


# -- queries -----------------------------------------------------------------------


def query_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items as (item_id, counts of terms), in blocks of bounded size."""
    block, held = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        own = Counter(terms((r.text or "").encode()))
        if not own:
            continue
        size = sum(len(t) + 16 for t in own)
        if block and held + size > QUERY_BYTES:
            yield block
            block, held = [], 0
        block.append((r.item_id, own))
        held += size
    if block:
        yield block


def document_counts(shards: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """In how many documents each wanted term occurs."""
    shared = shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for names, dfs in zip(b.column("names").to_pylist(), b.column("dfs").to_pylist()):
                for t, n in zip(names.split(b"\n"), _numbers(dfs).tolist()):
                    if t in shared.value:
                        counts[shared.value[t]] += n
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.int64()), "df": pa.array(list(counts.values()), pa.int64())})

    # at most one row for each term of a block of queries, whose size is bounded
    return dict(tuple(r) for r in shards.select("names", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect())


def search(shards: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item, from an index()."""
    spark = shards.sparkSession
    n, total = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    path, asked = work_dir(spark, "found"), 0
    schema = "query long, item_id long, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in query_blocks(items):
        wanted = {t: i for i, t in enumerate(sorted({t for _, c in block for t in c}))}
        df = document_counts(shards, wanted)
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[i] + 1))) for t, i in wanted.items() if i in df}
        queries = [[(wanted[t], weight[t] * c) for t, c in counts.items() if t in weight] for _, counts in block]
        shared = spark.sparkContext.broadcast((wanted, queries, [i for i, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, asked=asked) -> Iterator[pa.RecordBatch]:
            wanted, queries, names = shared.value
            best: list[list[tuple[int, int]]] = [[] for _ in queries]
            for b in batches:
                for row in b.to_pylist():
                    shard = Shard(row, wanted, n, total)
                    if shard.at:
                        for q, query in enumerate(queries):
                            search_shard(shard, query, best[q], top)
            rows = [(asked + q, names[q], None if -d == _NO_ID else -d, s) for q, found in enumerate(best) for s, d in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["query", "item_id", "doc_id", "score"])

        shards.mapInArrow(run, schema).write.mode("append").parquet(path)
        asked += len(block)
        shared.unpersist()
    found = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def oracle_sql() -> str:
    """Scores of all documents that share a term with an item, ranked."""
    body = lambda c: f"regexp_extract_all({lower_sql(c)}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH d AS (SELECT doc_id, {body("text")} AS w FROM documents),
        c AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
        p AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
        t AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({body("text")}) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * c.n + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * t.n * c.n) // c.l))))::BIGINT AS score
              FROM i JOIN f USING (term) JOIN t USING (term), c GROUP BY item_id, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}"""
