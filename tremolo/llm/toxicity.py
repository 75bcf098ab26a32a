"""Toxicity scores from class-conditional Kneser-Ney models (op 8).

Each class (toxic, ordinary) has a model of the bytes of lower-cased words,
order ORDER with word boundaries: discounted counts of the class, interpolated
with backoff distributions of continuation counts that both classes share, order
by order down to single bytes, so that what neither class has seen tells nothing
and a rare expression is judged by the parts that it shares with known ones. Both
features of a text are differences of length-normalised log-likelihoods (bits a
byte): of the whole text, and of the expression in which they differ most; a
logistic curve, fitted on labelled texts that the counts have not seen, makes a
score of them (each training fold as scored by the counts of the others).

The models are fitted on the texts of at most MAX_TRAIN labelled ids (the ones
with the least hashes); scoring reads every text whole.

A very long text is scored whole, in one piece. A score of just 0.5 is toxic.
Null and empty texts have no words: both features are 0. Labels that are null
are left out; of several for one doc_id the largest counts. Without labels of
both classes every score is the smoothed share of toxic labels (0.5 without
any), capped below 0.5 when there is no toxic one. A null doc_id is scored and
not held out. Repeated rows are scored each. Other columns are untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import truediv

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import blocks, raw

#: Labelled ids that are fitted on at most; order of the models; discount; folds by crc32(doc_id): 0 is held out; the curve is fitted on each other one as scored by the counts of the rest.
MAX_TRAIN, ORDER, DISCOUNT, FOLDS = 20_000, 5, 0.75, 5
MEMO_WORDS = 150_000
_PAD, _END = b"\x01" * (ORDER - 1), b"\x02"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER-byte windows that end within each word or at its end, as integers, and the word that each belongs to."""
    text = np.frombuffer(b"".join(x for w in words for x in (_PAD, w, _END)), dtype=np.uint8)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + ORDER
    out = np.zeros(max(0, len(text) - ORDER + 1), dtype=np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(8)) | text[i : len(text) - ORDER + 1 + i]
    # a word's windows start at its pad; the last ORDER-1 starts before the next word's pad run over the boundary
    at = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)[: len(out)]
    own = np.repeat(np.arange(len(words)), sizes)[: len(out)]
    inside = at <= sizes[own] - ORDER
    return out[inside], own[inside]


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights=counts, minlength=len(keys))


def _totals(of: np.ndarray, counts: np.ndarray, among: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted(among, of), weights=counts, minlength=len(among))


def _lookup(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    found = table[at] == keys
    return found, np.where(found, values[at], 0.0)


def _continuation(grams: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probability of the last byte of each window by what all windows show of the shorter ones: discounted counts of the distinct bytes before them, order by order down to a uniform one."""
    tail = grams & np.uint64((1 << 8 * (order - 1)) - 1)
    tails, kinds = np.unique(tail, return_counts=True)
    if order == 2:  # single bytes
        p = (np.maximum(kinds - DISCOUNT, 0) + DISCOUNT * len(kinds) / 256) / kinds.sum()
    else:
        context = tails >> np.uint64(8)
        heads, n = _merge(context, kinds.astype(float))
        at = np.searchsorted(heads, context)
        p = (np.maximum(kinds - DISCOUNT, 0) + DISCOUNT * np.bincount(at)[at] * _continuation(tails, order - 1)) / n[at]
    return p[np.searchsorted(tails, tail)]


class Model:
    """Log ratios (toxic against ordinary) of windows seen in training and of the backoff weights of their contexts."""

    def __init__(self, seen: list[tuple[np.ndarray, np.ndarray]]):
        eight = np.uint64(8)
        self.grams = np.unique(np.concatenate([k for k, _ in seen]))
        self.contexts = np.unique(self.grams >> eight)
        shared = _continuation(self.grams, ORDER)
        at = np.searchsorted(self.contexts, self.grams >> eight)
        logs, weights = [], []
        for keys, counts in seen:
            total = _totals(keys >> eight, counts, self.contexts)
            kinds = _totals(keys >> eight, np.ones(len(keys)), self.contexts)
            gamma = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            c = np.zeros(len(self.grams))
            c[np.searchsorted(self.grams, keys)] = counts
            logs.append(np.log2(np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[at] + gamma[at] * shared))
            weights.append(np.log2(gamma))
        self.ratio, self.backoff = logs[1] - logs[0], weights[1] - weights[0]
        self.curve = np.zeros(3)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of each word, in bits."""
        g, own = grams(words)
        found, value = _lookup(g, self.grams, self.ratio)
        rest = ~found
        value[rest] = _lookup(g[rest] >> np.uint64(8), self.contexts, self.backoff)[1]
        return np.bincount(own, weights=value, minlength=len(words))

    def features(self, texts: list[bytes], memo: dict[bytes, float]) -> np.ndarray:
        """Mean ratio of a byte of each text, and of a byte of the word where it is largest."""
        split = [t.lower().split() for t in texts]
        fresh = list({w for ws in split for w in ws if w not in memo})
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
            fresh = list({w for ws in split for w in ws})
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            memo.update(zip(part, self.words(part).tolist()))
        out = np.zeros((len(texts), 2))
        for i, ws in enumerate(split):
            if ws:
                v = [memo[w] for w in ws]
                n = [len(w) + 1 for w in ws]
                out[i] = sum(v) / sum(n), max(map(truediv, v, n))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * features[:, 0] + self.curve[2] * features[:, 1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; the features are scaled for the ridge and scaled back."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    b = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (p - y) + ridge * b
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(b)), grad)
        b -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return b / np.concatenate([[1.0], scale])


def fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model | float:
    """The model, or without labels of both classes the one score of all texts."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 0)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` ids, so the side is bounded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"), fold().cast("int").alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen):
            for (part, y), c in seen.items():
                words = list(c)
                if words:
                    g, own = grams(words)
                    keys, n = _merge(g, np.fromiter(c.values(), dtype=float, count=len(words))[own])
                    yield pa.RecordBatch.from_pydict({"fold": pa.array([part], pa.int32()), "toxic": pa.array([y], pa.int32()), "keys": [keys.tobytes()], "counts": [n.tobytes()]})

        seen: dict[tuple[int, int], Counter] = {}
        for b in (x for y in batches for x in blocks([y])):
            for t, y, part in zip(raw(b.column("text")), b.column("toxic").to_pylist(), b.column("fold").to_pylist()):
                seen.setdefault((part, y), Counter()).update(t.lower().split())
            if sum(map(len, seen.values())) > 1_000_000:
                yield from flush(seen)
                seen = {}
        yield from flush(seen)

    none = (np.empty(0, dtype=np.uint64), np.empty(0))
    seen = {(part, y): none for part in range(1, FOLDS) for y in range(2)}
    for r in rows.mapInArrow(count, "fold int, toxic int, keys binary, counts binary").toLocalIterator():
        k, n = seen[r.fold, r.toxic]
        seen[r.fold, r.toxic] = _merge(np.concatenate([k, np.frombuffer(r["keys"], dtype=np.uint64)]), np.concatenate([n, np.frombuffer(r["counts"])]))

    def of(parts: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_merge(*(np.concatenate([seen[part, y][i] for part in parts]) for i in range(2))) for y in range(2)]

    every = of(list(range(1, FOLDS)))
    if not all(len(k) for k, _ in every):
        n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
        return (n["t"] + 1) / (n["n"] + 2) if n["t"] or not n["n"] else min(0.49, 1 / (n["n"] + 2))
    model = Model(every)
    without = {part: of([x for x in range(1, FOLDS) if x != part]) for part in range(1, FOLDS)}
    shared = docs.sparkSession.sparkContext.broadcast({part: Model(m) for part, m in without.items() if all(len(k) for k, _ in m)})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in blocks([y])):
            texts, parts = raw(b.column("text")), b.column("fold").to_pylist()
            for part, m in shared.value.items():
                own = [i for i, x in enumerate(parts) if x == part]
                f = m.features([texts[i] for i in own], {})
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(at), "toxic": b.column("toxic").take(at), "mean": f[:, 0], "top": f[:, 1]})

    # at most `most` rows, as rows of one doc_id count by their mean
    own = rows.mapInArrow(measure, "doc_id long, toxic int, mean double, top double").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.avg("mean").alias("mean"), F.avg("top").alias("top")).collect()
    y = np.array([r.toxic for r in own], dtype=float)
    if 0 < y.sum() < len(y):
        model.curve = _logistic(np.array([[r.mean, r.top] for r in own]), y)
    else:
        model.curve = np.array([-4.0, 1.0, 0.5])
    return model


def _with_score(docs: DataFrame, model: Model | float, name: str) -> DataFrame:
    """docs and a column of scores."""
    text = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    shared, names = docs.sparkSession.sparkContext.broadcast(model), [*plain.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        for b in (x for y in batches for x in blocks([y], f"c{text}")):
            s = np.full(b.num_rows, m) if isinstance(m, float) else m.score(m.features(raw(b.column(text)), memo))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=names)

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField(name, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = _with_score(own, fit(docs, labels), "score").select(F.col("c0").alias("doc_id"), "score")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, same columns; all rows if the labels do not have both classes, as nothing is learnt."""
    model = fit(docs, labels)
    if isinstance(model, float):
        return docs
    return _with_score(docs, model, "toxic_score").where("toxic_score < 0.5").drop("toxic_score").toDF(*docs.columns)
