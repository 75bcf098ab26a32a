"""Filter interaction audit by Walsh-Hadamard sums (op 13).

Every document has a mask of the filters that it fails. For each part the audit
aggregates one signed parity sum for each set S of filters (2^k sums of
(-1)^|S and mask|), for all documents, the good ones and the toxic ones. The
inverse transform gives the exact count of each mask, from which every order of
the filters is evaluated: what a step keeps and removes, what an earlier filter
had removed already, and how many fail it alone. A filter's Shapley value over
all k! orders is closed: a document that fails j filters is removed by each of
them in k!/j of the orders.

Whether a text is a copy is found without joining texts: rows are counted by
text, part, labels and mask (so that a hot text is a few rows for each task), and
only the counts learn the smallest doc_id of their text.

Null texts count as empty. A null source is the part ''. A null doc_id counts as
larger than all others, has no labels, and rows of equal doc_id are not copies of
each other. Of several labels for one doc_id the largest counts; null labels are
neither good nor toxic. Texts of any length are read whole. Tables may be empty;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, raw

#: Filters in the order of their bits, and their limits: words, percent of distinct words, percent of capitals, marks.
FILTERS, LEAST_WORDS, DISTINCT, CAPITALS, MARKS = "ABCDE", 50, 65, 5, b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NO_ID = 2**63 - 1


def _fails(text: bytes, points: int) -> int:
    words = text.split()
    n = len(words)
    return (
        (n < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT * n) << 1
        | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITALS * points) << 2
        | (len(text) != len(text.translate(None, MARKS))) << 3
    )


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of the filters A to D), text_key (SHA-256 of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in blocks([y])):
            texts = raw(b.column("text"))
            points = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "part": b.column("part"), "fails": pa.array(map(_fails, texts, points), pa.int32()), "text_key": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, fails int, text_key binary")


def masks(rows: DataFrame, labels: DataFrame, copy_bit: int = 4) -> DataFrame:
    """part, mask, n, good, toxic: counts of failures() rows by mask, copies of a smaller doc_id's text with the copy bit."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("is_good"), (F.max("toxic") == 1).alias("is_toxic"))
    counted = rows.groupBy("doc_id", "part", "fails", "text_key").agg(F.count("*").alias("n"))
    # rows without a doc_id are dealt by their texts and meet no label
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text_key"))
    named = counted.withColumns({"label_id": key, "named": F.col("doc_id").isNotNull()})
    own = own.select(F.col("doc_id").alias("label_id"), F.lit(True).alias("named"), "is_good", "is_toxic")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("is_good", "is_toxic")]
    both = named.join(own, ["label_id", "named"], "left").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "part", "fails", "text_key", "n", *flags)
    groups = both.groupBy("text_key", "part", "fails", "is_good", "is_toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    groups = groups.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("text_key")))
    firsts = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    split = F.array(F.struct(F.col("fails").alias("mask"), firsts.alias("n")), F.struct(F.col("fails").bitwiseOR(F.lit(1 << copy_bit)).alias("mask"), (F.col("n") - firsts).alias("n")))
    out = groups.select("part", "is_good", "is_toxic", F.explode(split).alias("x")).where("x.n > 0")
    return out.select("part", "x.mask", "x.n", F.when(F.col("is_good"), F.col("x.n")).otherwise(F.lit(0)).alias("good"), F.when(F.col("is_toxic"), F.col("x.n")).otherwise(F.lit(0)).alias("toxic"))


def parity_sums(counts: DataFrame, k: int) -> DataFrame:
    """part, n, good, toxic: arrays of the 2^k signed parity sums of each count."""

    def sums(c: str) -> Column:
        sign = lambda s: 1 - 2 * F.bit_count(F.col("mask").bitwiseAND(F.lit(s))).bitwiseAND(F.lit(1))
        return F.array(*[F.sum(sign(s) * F.col(c)) for s in range(1 << k)]).alias(c)

    return counts.groupBy("part").agg(sums("n"), sums("good"), sums("toxic"))


def inverted(sums: np.ndarray) -> np.ndarray:
    """The 2^k parity sums as exact counts by mask: k rounds of butterflies; the transform is its own inverse but for the factor 2^k."""
    x, h = sums.astype(np.int64), 1
    while h < len(x):
        pairs = x.reshape(-1, 2, h)
        x = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).reshape(-1)
        h *= 2
    return x // len(x)


def effects(sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the filters."""
    k = len(filters)
    mask = np.arange(1 << k)
    orders = list(permutations(range(k)))
    names, filter_at = ["".join(filters[f] for f in o) for o in orders], np.array(orders, dtype=np.int64)
    after = np.cumsum(1 << filter_at, axis=1)
    before = after - (1 << filter_at)
    kept_by = (mask[None, :] & mask[:, None]) == 0  # sets of filters against masks
    fails = (mask[None, :] >> np.arange(k)[:, None]) & 1
    share = np.array([factorial(k) // max(1, int(m).bit_count()) for m in mask])
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                cells = inverted(np.array(r["n"]))
                left, good, toxic = (kept_by @ x for x in (cells, inverted(np.array(r["good"])), inverted(np.array(r["toxic"]))))
                removed = left[before] - left[after]
                columns = {"kept": left[after], "removed": removed, "redundant": (fails @ cells)[filter_at] - removed, "unique_fails": cells[1 << filter_at], "good_lost": good[before] - good[after], "toxic_lost": toxic[before] - toxic[after], "shapley": (fails @ (cells * share))[filter_at]}
                yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]] * filter_at.size, pa.string()), "filter_order": pa.array([n for n in names for _ in range(k)], pa.string()), "step": pa.array(list(range(1, k + 1)) * len(names), pa.int32()), **{c: pa.array(v.ravel(), pa.int64()) for c, v in columns.items()}})

    return sums.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """effects() of the five filters on the documents, by source."""
    return effects(parity_sums(masks(failures(docs), labels), len(FILTERS)))


def oracle_sql() -> str:
    """The audit by removing documents step by step, without the transform."""
    word = r"[^\x20\x09-\x0D]+"
    letters = " UNION ALL ".join(f"SELECT '{f}' AS f, {1 << i} AS bit" for i, f in enumerate(FILTERS))
    fails = f"""CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT} * len(w) THEN 2 ELSE 0 END
               + CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > {CAPITALS} * length(body) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(body, '[{MARKS.decode()}]') THEN 8 ELSE 0 END"""
    return f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT d.part, {fails} + CASE WHEN min(d.doc_id) OVER (PARTITION BY body) < d.doc_id THEN 16 ELSE 0 END AS mask, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
        f AS ({letters}),
        o AS (SELECT [a, b, c, d, e] AS fs FROM (SELECT f AS a FROM f), (SELECT f AS b FROM f), (SELECT f AS c FROM f), (SELECT f AS d FROM f), (SELECT f AS e FROM f) WHERE len(list_distinct([a, b, c, d, e])) = 5),
        s AS (SELECT array_to_string(fs, '') AS filter_order, i AS step, (SELECT bit FROM f WHERE f.f = fs[i]) AS bit, (SELECT coalesce(sum(bit), 0)::BIGINT FROM f WHERE list_contains(fs[1:i - 1], f.f)) AS earlier FROM o, range(1, 6) r(i)),
        e AS (SELECT part, filter_order, step, bit,
                     sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM e"""
