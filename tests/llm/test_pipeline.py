"""The pipeline against its stages run by brute force, and its bookkeeping."""

import re
from collections import Counter

import corpus_pipeline
from data import frame
from test_operators import brute_classes, low, token_ids

from tremolo.llm import toxicity
from tremolo.llm.common import table

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.predicted for r in toxicity.report(docs, table(spark, SF, "labels")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not scores[r.doc_id]]
    keep = {}
    for i, t in rows:
        keep[low(t)] = max(keep.get(low(t), -1), i)
    rows = [(i, t) for i, t in rows if keep[low(t)] == i]
    first = {i for i, _, _, kept in brute_classes(rows) if kept}
    rows = [(i, t) for i, t in rows if i in first]
    sets = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))] for k in range(max(1, len(w) - 4)) if w}
    items = [sets(r.text) for r in table(spark, SF, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not any(q and len(q & s) >= 0.75 * len(q) for s in [sets(t)] for q in items)]
    got = corpus_pipeline.run(spark, SF).collect()
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(token_ids(t)) + 1 for i, t in rows}


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, clashing columns; and no rows at all."""
    odd = frame(spark)
    names = odd.columns
    docs, kept = odd, Counter((r.doc_id, r.text) for r in odd.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))  # a stage is given what has been written
        docs = spark.read.schema(odd.schema).parquet(str(tmp_path / name))
        now = Counter((r.doc_id, r.text) for r in docs.collect())
        assert docs.columns == names and now <= kept, name
        if name == "exact_dedup":
            best = {}
            for i, t in kept:
                best[low(t)] = max(best.get(low(t), -1), -1 if i is None else i)
            assert {low(t) for _, t in now} == set(best) and sum(now.values()) == len(best)
            assert all((-1 if i is None else i) == best[low(t)] for i, t in now)
        kept = now
    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sum(r.length for r in pieces) == sum(n * (len(token_ids(t)) + 1) for (_, t), n in kept.items())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
