"""Worked examples, golden tables, nulls and partition invariance."""

import math

import pytest
from pyspark.sql import functions as F

from tremolo.functions import difflib_udf as dl
from tremolo.functions import levels as L
from tremolo.functions import match as M
from tremolo.functions import text as T
from tremolo.operators import aggregates as A
from tremolo.operators import curation as C
from tremolo.operators import gates as G
from tremolo.operators import meta, scoring
from tremolo.operators import transforms as X
from tremolo.sources import registry, tables

DONUTS = ("Toula bought 3 dozen donuts that cost $68 per dozen. How much did she pay?", "Toula purchased three dozen doughnuts priced at $68 each dozen. What was her total cost?")
ANN = "Ann has 4 red pens and 2 caps. How many items?"
BURIED = f"Pens were cheap that day. {ANN} Perhaps consider 7 boxes."


def one(spark, *columns, o="", c=""):
    return spark.createDataFrame([(o, c)], "o string, c string").select(*columns).first()


def pair(spark, o, c, **metrics):
    r = one(spark, *(f("o", "c").alias(k) for k, f in metrics.items()), o=o, c=c)
    return {k: r[k] for k in metrics}


def test_magnitude_example(spark):
    r = one(spark, dl.difflib("o", "c").alias("d"), T.jaccard_tcr("o", "c").alias("j"), T.ccr("o", "c").alias("ccr"), T.ctx_cer("o", "c").alias("x"), o=DONUTS[0], c=DONUTS[1])
    assert (round(r.d.ratio, 4), round(1 - r.d.ratio, 4)) == (0.5802, 0.4198)
    assert (r.j, r.ccr, r.x) == (0.8333, 0.1892, 1.0)
    score = one(spark, L.magnitude(F.lit(0.5802), F.lit(0.4198), "KB").alias("s"))
    assert score.s == 0.4198


def test_buried_example(spark):
    got = pair(spark, ANN, BURIED, ctx_cer=T.ctx_cer, cdp=T.cdp, adi=T.adi, dc=T.dc, dnd=T.dnd, cc=T.cc, ces=T.ces, ihd=T.ihd)
    assert got == {"ctx_cer": 1.8182, "cdp": 0.25, "adi": 0.4546, "dc": 2, "dnd": 0.5, "cc": 1, "ces": 1, "ihd": 0}


@pytest.mark.parametrize("scores, want", [([], 0.5), ([0.2], 1.0), ([0.3, 0.3], 0.5), ([0.1, 0.3], 0.594361), ([0.0, 0.4], 1.0), ([0.1, 0.2, 0.3, 0.4], 0.53839), ([0.0, 0.0], 0.5)])
def test_failure_entropy(spark, scores, want):
    rows = [("L1", s, 0.0) for s in scores] + [("L1", 0.9, 1.0), ("L0", 0.0, 0.0), ("L2", None, 0.1), ("L2", 0.5, None)]
    df = spark.createDataFrame(rows, "level string, score double, sim double")
    assert A.fwe(df).first().fwe == pytest.approx(want, abs=1e-6)


def curve(spark, acc, edges=(0.0, 0.1, 0.2, 0.3, 0.4, 0.5), n0=10):
    df = spark.createDataFrame([("g", [None if a is None else float(a) for a in acc], list(edges), [n0] + [5] * 5)], "g string, acc array<double>, edges array<double>, counts array<long>")
    return meta.measures(df).first()


def test_meta_example(spark):
    r = curve(spark, [1, 0.9, 0.9, 0.6, 0.7, 0.5])
    assert (r.tau, r.sr_max, r.cp, r.ss_worst, r.ss_norm, r.cs, r.osc_rate) == (0.8, 2.0, 3.0, -3.0, 0.0, 0.4, 0.5)


def test_meta_gaps_and_fallback(spark):
    r = curve(spark, [0.5, None, 0.9, 0.6, None, 0.7], n0=1)
    assert (r.acc_base, r.tau, r.sr_max, r.cp) == (0.8, 0.64, 5.0, 0.0)
    r = curve(spark, [None] * 6, n0=0)
    assert (r.sr_max, r.cp, r.ss_worst, r.cs, r.osc_rate, r.cp_norm) == (0.0, None, 0.0, 0.0, 0.0, 1.0)
    assert meta.empty()["cp_norm"] == 0.0


@pytest.mark.parametrize("p, g, want", [("$1,200", "1200", 1.0), ("694 dollars", "694.5", 1.0), ("0", "0.0", 1.0), ("abc", "1", 0.0), ("1001.1", "1000", 0.0), (None, "1", 0.0)])
def test_numeric(spark, p, g, want):
    df = spark.createDataFrame([(p, g)], "p string, g string")
    assert df.select(M.numeric(F.col("p"), F.col("g")).alias("x")).first().x == want


def test_number_quirk_and_levels(spark):
    r = one(spark, T.numbers("o").alias("n"), *(L.tcr_level(F.lit(v), f).alias(f"x{i}") for i, (v, f) in enumerate([(0.0, "IQ"), (0.04, "IQ"), (0.05, "IQ"), (0.55, "IQ"), (0.02, "SV"), (0.96, "SV")])), o="2024 and 1,250.50")
    assert r.n == ["202", "4", "1250.50"]
    assert [r[f"x{i}"] for i in range(6)] == ["L1", "L1", "L2", "L4", "L1", "L5"]


def test_scorer_example(spark):
    rows = spark.createDataFrame([("Steadiness", "paraphrase", 0.85, 0.6), ("Steadiness", "noise", 0.92, 0.5)], "category string, family string, p_score double, fwe double")
    r = scoring.CategoryScorer("Steadiness", dict(scoring.BUSINESS_WEIGHTS["Steadiness"])).score(rows).first()
    assert (r.p_primary, r.p_harmonic) == (0.8792, 0.8778)
    scorer = scoring.CategoryScorer("Steadiness", {"a": 1.0, "b": 3.0})
    scorer.update("a", 0.75)
    assert sum(scorer.weights.values()) == pytest.approx(1)
    for bad in (lambda: scorer.update("a", -1), lambda: scorer.blend(2)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        scorer.update("zzz", 1)


def test_missing_sims(spark):
    df = C.clean(spark.createDataFrame([(1.0,), (None,), (0.75,), (float("nan"),)], "sim double"), "sim")
    r = df.limit(4).agg(A.r4(A.accuracy()).alias("a"), A.r4(A.accuracy(missing="drop")).alias("b")).first()
    assert (r.a, r.b) == (0.25, 0.5)


def test_multi_values(spark):
    df = spark.createDataFrame([("['A', 'b']", ["a", "b", "c"]), ("nan", []), ("x, y", ["x"]), (None, ["x"])], "p string, g array<string>")
    got = [r.s for r in df.select(M.set_jaccard(M.parse_multi(F.col("p")), F.col("g")).alias("s")).collect()]
    assert got == [0.6667, 0.0, 0.5, 0.0]


#: Published accuracies of one model by family, and where each collapses.
GOLDEN = {
    "CI": ([0.619, 0.691, 0.733, 0.647, 1.0], "L1"),
    "CIS": ([0.835, 0.5, 0.891, 0.64, 0.13], "L2"),
    "CL": ([0.893, 0.908, 0.699, 0.471, None], "L3"),
    "F": ([0.893, 0.845, 0.811, 0.8, 0.75], None),
    "IQ": ([0.873, 0.869, 0.914, 0.864, 0.844], None),
    "KB": ([0.0, 0.0, 0.0, 0.0, 0.27], "L1"),
    "SV": ([0.903, 0.88, 0.878, 0.847, 0.765], None),
}


def test_golden_collapse(spark):
    df = spark.createDataFrame([(f, *a) for f, (a, _) in GOLDEN.items()], "fam string, L1 double, L2 double, L3 double, L4 double, L5 double")
    got = {r.fam: r.cp for r in df.select("fam", A.collapse_point(F.lit(0.8 * 0.887)).alias("cp")).collect()}
    assert got == {f: cp for f, (_, cp) in GOLDEN.items()}


def test_empty_and_null_groups(spark):
    schema = "category string, dimension string, level string, score double, sim double, gate boolean, run_status string, test_type string, model string, source_row long, run_id long, latency_ms long"
    empty = spark.createDataFrame([], schema)
    assert A.fwe(empty, "category").count() == A.group_summary(empty, "category").count() == meta.by_group(empty, "category").count() == 0
    rows = spark.createDataFrame([(None, "d", "L1", 0.1, 1.0, True, "ok", None, "m", 1, 1, 1), ("c", "d", "-", 0.1, 1.0, True, "ok", None, "m", 1, 2, 1)], schema)
    assert [r.category for r in A.group_summary(rows, "category").collect()] == ["c"]
    assert meta.records(rows, 0.8).count() == 1


def test_gates(spark):
    ok = one(spark, G.context_gate("o", "c").alias("g"), G.conflict_gate("o", "c").alias("k"), G.noise_gate("o", "c").alias("n"), o=ANN, c=BURIED)
    assert ok.g.passed and ok.k.passed and ok.n.reason == "numbers changed"
    bad = one(spark, G.context_gate("o", "c").alias("g"), G.format_gate("o", "c").alias("f"), o=ANN, c="")
    assert bad.g.reason == bad.f.reason == "candidate is empty"
    rules = registry.enabled(["preserve_word_order", "no_extra_words", "max_length_ratio"])
    r = one(spark, G.structural("o", "c", rules).alias("s"), o="a b c", c="a x b c")
    assert r.s.failures == "no_extra_words"
    assert one(spark, dl.difflib("o", "c")["unchanged"].alias("u"), o="a, b", c="a - b").u is True


def test_transforms_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"Text {i}, with some words in a clause; and another one here.") for i in range(40)], "i long, o string")
    made = [X.apply_transform("o", v, 3).alias(v) for v in X.LEVELS]
    a = sorted(map(tuple, df.repartition(7).select("i", *made).collect()))
    assert a == sorted(map(tuple, df.coalesce(1).select("i", *made).collect()))
    first = a[0]
    assert sorted(first[3].replace(",", " ").replace(";", " ").split()) == sorted(df.first().o.replace(",", " ").replace(";", " ").split())


def test_intake(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text('question,tag_1,tag_2,answer\n"a ""quoted""\nquestion",x,y,12\nb,x,,7\nc,,,9\n', encoding="utf-8")
    got = tables.load(spark, ["question"], ["tag_1", "tag_2", "answer"], path=str(tmp_path / "seeds.csv"), row_mode="first_n", n=2)
    assert [(d.agent_key, d.type) for d in got.output_defs] == [("tags", "multi_categorical"), ("answer", "numeric")]
    assert sum(d.weight for d in got.output_defs) == pytest.approx(1)
    rows = got.df.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [0, 1] and rows[0].question == 'a "quoted"\nquestion'
    with pytest.raises(ValueError):
        tables.load(spark, ["nope"], ["answer"], path=str(tmp_path / "seeds.csv"))
    with pytest.raises(ValueError):
        tables.load(spark, ["question"], ["answer"], rows=[{"question": "q", "answer": "1"}], row_mode="indices", ids=[5])


def test_manifest_and_sinks(spark, tmp_path):
    run = str(tmp_path / "runs" / "m__d")
    tables.write_manifest(spark, run, a=1)
    assert tables.write_manifest(spark, run, b=2) == {"a": 1, "b": 2}
    assert tables.latest_run(spark, str(tmp_path)).endswith("m__d")
    df = spark.createDataFrame([("r", 1, 0.12345), ("r", 2, 0.5)], "run string, source_row long, sim double")
    tables.write_csv(df, f"{run}/eval.csv")
    back = tables.read_models(spark, str(tmp_path / "runs"), "d", ["m"]).orderBy("source_row").collect()
    assert [(r.model, r.model_order, r.sim) for r in back] == [("m", 1, "0.123"), ("m", 1, "0.5")]


def test_system_under_test(spark):
    from tremolo.operators.evaluate import ask

    plan = spark.createDataFrame([(1, "2"), (2, "3")], "source_row long, input string")
    assert sorted(r.raw_response for r in ask(plan, lambda q: q + "!").collect()) == ["2!", "3!"]

    def broken(q):
        if q == "2":
            raise RuntimeError("down")
        return q

    got = {r.input: r for r in ask(plan, broken, tries=3, pause=0.01).collect()}
    assert (got["2"].run_status, got["2"].raw_response, got["2"].tries) == ("error: down", None, 3)
    assert (got["3"].run_status, got["3"].raw_response, got["3"].tries) == ("ok", "3", 1)  # a failing row costs no other


def test_a_call_that_fails_twice():
    from tremolo.operators.evaluate import attempt

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "yes"

    out, status, ms, tries = attempt(flaky, pause=0.02)
    assert (out, status, tries) == ("yes", "ok", 3) and ms >= 60  # pauses of .02 and .04 s


def test_judge_records(spark):
    from tremolo.operators.generate import generated, judged

    def judge(o, c):
        if c == "x":
            raise RuntimeError("no answer")
        return '{"same_meaning": true, "confidence": 0.9, "explanation": "alike"}' if o == c else "No, they differ."

    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "x")], "o string, c string")
    got = {r.c: r for r in judged(pairs, judge, model="m", tries=2, pause=0.01).collect()}
    assert (got["a"].same_meaning, got["a"].confidence, got["a"].explanation, got["a"].error, got["a"].model) == (True, 0.9, "alike", None, "m")
    assert (got["b"].same_meaning, got["b"].confidence) == (False, 0.5) and got["b"].explanation.startswith("No")
    assert (got["x"].same_meaning, got["x"].verdict, got["x"].error, got["x"].tries) == (None, None, "error: no answer", 2)
    made = generated(pairs.select("o"), lambda row: row["o"] * 2).collect()
    assert [(r.c, r.status, r.tries) for r in made] == [("aa", "ok", 1)] * 3


def test_responses_by_position(spark):
    from tremolo.operators.evaluate import align

    tests = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b"), (40, "d")], "run_id long, input string")
    got = {r.run_id: r.raw_response for r in align(tests, ["ra", None, "rc"], "run_id").collect()}
    assert got == {10: "ra", 20: None, 30: "rc", 40: None}


@pytest.mark.parametrize("advisory", ["64k", "64m"])
def test_ranks_are_whole(spark, advisory):
    """Ranks are 0 to n - 1 in order, whatever the partitions; values repeat and some are null."""
    from tremolo.operators.bins import ranked

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, advisory)
    try:
        rows = spark.range(300_000).select(F.col("id").alias("key"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(5000))).alias("value"), F.repeat(F.lit("x"), 40).alias("more"))
        got = ranked(rows, "value", "key").select("rank", "value", "key")
        assert tuple(got.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()) == (300_000, 300_000, 0, 299_999)
        want = {k: i for i, (v, k) in enumerate(sorted(((-1 if r.value is None else r.value, r.key) for r in rows.select("value", "key").collect())))}
        assert all(want[r.key] == r["rank"] for r in got.where("rank % 997 = 0").collect())
    finally:
        spark.conf.set(key, before)


def test_streaming_rollup(spark, tmp_path):
    from tremolo.streaming import rollup

    rows = [(i % 90, f"2024-01-0{1 + i % 3} 00:00:00", "c", 0.5, i % 2.0) for i in range(100)]
    df = spark.createDataFrame(rows, "run_id long, ts string, category string, score double, sim double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = rollup.read_events(spark, str(tmp_path / "in"), "run_id long, ts timestamp, category string, score double, sim double")
    q = rollup.append(rollup.windowed_steadiness(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = {(r.start, r.n) for r in rollup.windowed_steadiness(df).collect()}
    got = {(r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got <= batch and sum(n for _, n in batch) == 90


def test_properties():
    assert math.isclose(sum(scoring.BUSINESS_WEIGHTS["Steadiness"].values()), 1)
    assert all(lo < hi for own in L.TCR_BANDS.values() for lo, hi in own)
