"""Quantiles of stored sketches and exact ones, and sums kept while runs are appended."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.operators import aggregates, incremental, quantiles
from tremolo.sources import results


def test_exact_quantiles(spark, tmp_path):
    rng = random.Random(5)
    draw = {"one": lambda: 3.0, "whole": lambda: float(rng.randint(0, 5000)), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "normal": lambda: rng.gauss(0, 1), "tiny": lambda: rng.choice([0.0, 5e-324, 1e-323]), "ties": lambda: rng.choice([0.1, 0.2, 0.3])}
    rows = [(g, f()) for g, f in draw.items() for _ in range(300)] + [(None, 1.0), (None, 2.0), ("few", 7.0), ("none", None), ("none", math.nan), ("one", math.inf)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    for i, q in enumerate((0.0, 0.5, 0.95)):
        got = {r.g: r.p for r in quantiles.exact(df, "x", q, "g", name="p", path=str(tmp_path / f"q{i}")).collect()}
        want = {}
        for g in {r[0] for r in rows}:
            own = sorted(x for k, x in rows if k == g and x is not None and math.isfinite(x))
            if own:
                at = q * (len(own) - 1)
                low, high = own[math.floor(at)], own[math.ceil(at)]
                want[g] = low + (high - low) * (at - math.floor(at))
        assert got == pytest.approx(want, rel=1e-12, abs=0)


def test_exact_quantile_of_all_rows_and_of_none(spark):
    df = spark.range(1001).withColumnRenamed("id", "x")
    assert quantiles.exact(df, "x", 0.95).first()[0] == 950.0
    assert quantiles.exact(df.limit(0), "x", 0.5).first()[0] is None


def test_exact_quantiles_move_few_rows(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 200_003).cast("double").alias("x"))
    got = {r.g: r.quantile for r in quantiles.exact(df, "x", 0.95, "g").collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.95)).alias("p")).collect()}
    assert got == pytest.approx(want)


def test_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(1)
    parts = [rng.lognormal(size=40_000), rng.normal(size=40_000), np.arange(40_000.0)]
    stored = None
    for p in parts:
        new = quantiles.sketches(spark.createDataFrame([(0, float(v)) for v in p], "g int, x double"), "x", "g")
        stored = new if stored is None else quantiles.merged(stored, new, "g")
    every = np.sort(np.concatenate(parts))
    for q in (0.01, 0.5, 0.95, 0.99):
        value = quantiles.of_sketches(stored, q).first()["quantile"]
        assert abs(np.searchsorted(every, value) / len(every) - q) < 0.01


RUNS = "run string, source_row long, category string, level string, score double, sim double"


def batch(spark, rng, seeds, run="a"):
    maybe = lambda x: None if rng.random() < 0.1 else x
    return spark.createDataFrame([(run, s, maybe(rng.choice("xyz")), f"L{rng.randint(0, 5)}", maybe(round(rng.random(), 3)), maybe(round(rng.random(), 3))) for s in seeds for _ in range(4)], RUNS)


def rows_of(table):
    return sorted(map(tuple, table.collect()), key=str)


def test_kept_sums_equal_sums_anew(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "k")
    batches = [batch(spark, rng, range(0, 40)), batch(spark, rng, range(40, 60)), batch(spark, rng, range(60, 80), "b"), batch(spark, rng, [3, 41, 90])]
    for n, b in enumerate(batches):
        incremental.take(b, path, n, "category", "level")
        incremental.take(b, path, n, "category", "level")  # played again
        anew = incremental.sums(results.read(spark, path), "category", "level")
        kept = incremental.current(spark, path)
        assert rows_of(kept) == rows_of(anew.select(kept.columns))
    runs = results.read(spark, path).dropna(subset=["category", "level"])
    got = {(r.category, r.level): r for r in incremental.measures(incremental.current(spark, path)).collect()}
    for r in runs.groupBy("category", "level").agg(aggregates.r4(aggregates.accuracy()).alias("accuracy"), aggregates.r4(F.avg("score")).alias("magnitude"), aggregates.r4(aggregates.steadiness()).alias("steadiness")).collect():
        own = got[r.category, r.level]
        assert own.accuracy == r.accuracy and own.magnitude == pytest.approx(r.magnitude, abs=1.1e-4) and own.steadiness == pytest.approx(r.steadiness, abs=1.1e-4)
    for r in aggregates.fwe(runs, "category", "level").collect():
        assert got[r.category, r.level].fwe == pytest.approx(r.fwe, abs=2e-6)
    incremental_plan = incremental.current(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "source_row" not in incremental_plan  # the kept sums are read, not the runs


def test_a_batch_reads_the_buckets_of_its_own_seeds(spark, tmp_path):
    path, rng = str(tmp_path / "b"), random.Random(1)
    results.append(batch(spark, rng, range(200)), path, 0, 16)
    seeds = spark.createDataFrame([("a", 5), ("a", 6), ("z", 1)], "run string, source_row long")
    old = results.read(spark, path, within=seeds, before=1)
    assert sorted({r.source_row for r in old.collect()}) == [5, 6]
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_a_batch_that_replaces_nothing_moves_no_rows(spark, tmp_path):
    path, rng = str(tmp_path / "d"), random.Random(3)
    for number in range(3):
        results.append(batch(spark, rng, range(number * 50, number * 50 + 60)), path, number, 4)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    none = results.read(spark, path, within=spark.createDataFrame([("z", n) for n in range(40)], "run string, source_row long"))
    assert none.columns == results.read(spark, path).columns and none.count() == 0 and exchanges(none) == 0
    # seeds that are asked for twice, that are in two batches, and null ones
    some = spark.createDataFrame([("a", 5), ("a", 5), ("a", 55), ("b", 105), (None, 5), ("a", None), ("z", 1)], "run string, source_row long")
    asked = {tuple(x) for x in some.collect()}
    want = sorted((tuple(r) for r in results.read(spark, path).collect() if (r.run, r.source_row) in asked), key=str)
    got = results.read(spark, path, within=some)
    assert want and rows_of(got) == want


def test_killed_between_sums_and_runs(spark, tmp_path, monkeypatch):
    path, rng = str(tmp_path / "c"), random.Random(2)
    first, second = batch(spark, rng, range(5)), batch(spark, rng, range(3, 8))
    incremental.take(first, path, 0, "category")
    append = results.append

    def killed(*a, **b):
        raise RuntimeError("killed")

    monkeypatch.setattr(results, "append", killed)
    with pytest.raises(RuntimeError):
        incremental.take(second, path, 1, "category")
    monkeypatch.setattr(results, "append", append)
    incremental.take(second, path, 1, "category")
    kept = incremental.current(spark, path)
    assert rows_of(kept) == rows_of(incremental.sums(results.read(spark, path), "category").select(kept.columns))
