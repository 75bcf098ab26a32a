"""Level specifications as a table: the interval join against brute force, and the classifier against its expression."""

import random

import numpy as np
from pyspark.sql import functions as F

from tremolo.functions import levels as L
from tremolo.operators import specs as S


def test_interval_join_of_100_000_bands(spark):
    rng = np.random.default_rng(3)
    n = 100_000
    lo = rng.uniform(-1000, 1000, n)
    hi = lo + rng.choice([1e-9, 0.01, 0.5, 3.0, 40.0], n)
    bands = spark.createDataFrame([(int(i), "m", float(a), float(b)) for i, (a, b) in enumerate(zip(lo, hi))], "band long, metric string, lo double, hi double")
    values = np.concatenate([rng.uniform(-1010, 1010, 150), lo[:30], hi[:30]])
    rows = spark.createDataFrame([(i, "m", float(v)) for i, v in enumerate(values)], "row long, metric string, value double")
    joined = S.interval_join(rows, bands, ("metric",))
    got = {(r.row, r.band) for r in joined.select("row", "band").collect()}
    want = {(i, int(j)) for i, v in enumerate(values) for j in np.flatnonzero((lo <= v) & (v < hi))}
    assert got == want and len(got) == joined.count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_bands_and_values(spark):
    bands = spark.createDataFrame([("x", 0.0, 1.0), ("x", 0.5, None), ("x", 2.0, 2.0), ("x", 5.0, 4.0), ("x", -1e300, 1e300), ("x", 0.0, 5e-324), ("y", 0.0, 9.0), ("x", 1.0, 2.0)], "metric string, lo double, hi double")
    values = [("x", v) for v in (0.0, 0.5, 1.0, 2.0, 4.5, 1e308, -1e300, 1e300, 5e-324, None)] + [("z", 1.0), (None, 1.0)]
    got = S.interval_join(spark.createDataFrame(values, "metric string, value double"), bands, ("metric",)).collect()
    own = [tuple(r) for r in bands.collect()]
    want = [(m, v, lo, hi) for m, v in values for k, lo, hi in own if m == k and v is not None and lo <= v and (hi is None or v < hi)]
    assert sorted(map(str, ((r.metric, r.value, r.lo, r.hi) for r in got))) == sorted(map(str, want))
    assert S.interval_join(spark.createDataFrame(values, "metric string, value double"), bands.limit(0), ("metric",)).count() == 0


def test_classifier_is_the_expression(spark):
    rng = random.Random(6)
    specs = S.spec_table(spark)
    for family, metrics in (("IQ", ["cer", "wcr"]), ("F", ["ccr", "lcs"]), ("CL", ["ctx_cer"])):
        edges = {m: L.SPEC_EDGES[family][m] for m in metrics}
        draw = lambda m: rng.choice([rng.uniform(-0.1, 1.8), rng.choice(edges[m])])
        rows = [(i, *(draw(m) for m in metrics)) for i in range(300)]
        df = spark.createDataFrame(rows, "row long, " + ", ".join(f"{m} double" for m in metrics))
        want = {r.row: r.level for r in df.select("row", L.spec_level({m: F.col(m) for m in metrics}, family).alias("level")).collect()}
        long = df.select("row", F.lit(family).alias("family"), F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m))))).alias("metric", "value"))
        assert {r.row: r.level for r in S.classify(long, specs, "row").collect()} == want


def test_table_of_specifications(spark):
    rows = S.of_family(S.spec_table(spark), "IQ").collect()
    assert {r.metric for r in rows} == {"cer", "wcr", "sds"} and {r.level for r in rows} == {1, 2, 3, 4, 5}
    assert {r.metric: r.weight for r in rows} == L.SPEC_WEIGHTS["IQ"]
    assert not next(r for r in S.of_family(S.spec_table(spark), "SV").collect() if r.metric == "sim").higher_is_more
    assert S.linear_bands(1.1, 0.1) == L.CTX_BANDS
