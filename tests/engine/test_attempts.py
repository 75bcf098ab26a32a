"""Attempts in rounds, strategies, and calls within a rate that are not made twice."""

import time

import pytest
from pyspark.sql import functions as F

from tremolo.operators import attempts as A
from tremolo.sources import results


def accepted_at(cell, limit):
    """When a cell's attempt is accepted: by its number, never for multiples of seven."""
    return None if cell % 7 == 0 else cell % 4 + 1 if cell % 4 < limit else None


def test_rounds_are_the_sequential_rule(spark, tmp_path):
    cells = spark.range(60).select(F.col("id").alias("cell"), F.lit(0.5).alias("base_temperature")).repartition(3)
    asked = spark.sparkContext.accumulator(0)

    def respond(frontier):
        def calls(batches):
            for b in batches:
                asked.add(len(b))
                yield b.assign(gate=(b["cell"] % 7 != 0), level_gate=(b["cell"] % 4 + 1 == b["attempt"]))

        return frontier.mapInPandas(calls, "cell long, base_temperature double, attempt int, temperature double, gate boolean, level_gate boolean")

    got = A.ask_until_accepted(cells, respond, str(tmp_path / "a"), attempts=3)
    want = []
    for cell in range(60):
        for n in range(1, 4):
            want.append((cell, n, round(0.5 + 0.1 * (n - 1), 2)))
            if accepted_at(cell, 3) == n:
                break
    assert sorted((r.cell, r.attempt, r.temperature) for r in got.collect()) == want
    assert asked.value == len(want)  # no call for an attempt that is not needed, none twice
    again = A.ask_until_accepted(cells, respond, str(tmp_path / "a"), attempts=3)
    assert again.count() == len(want) and asked.value == len(want)
    more = A.ask_until_accepted(cells, respond, str(tmp_path / "a"), attempts=4)
    fresh = sum(accepted_at(c, 3) is None for c in range(60))
    assert more.count() == len(want) + fresh and asked.value == len(want) + fresh


def test_a_round_that_fails_is_asked_again_alone(spark, tmp_path):
    cells = spark.range(10).withColumnRenamed("id", "cell")
    seen = []

    def respond(frontier, fail=False):
        n = frontier.first()["attempt"]
        seen.append(n)
        if fail and n == 2:
            raise RuntimeError("killed")
        return frontier.withColumns({"gate": F.lit(True), "level_gate": F.col("cell") < n})

    with pytest.raises(RuntimeError):
        A.ask_until_accepted(cells, lambda f: respond(f, True), str(tmp_path / "b"), attempts=3)
    got = A.ask_until_accepted(cells, respond, str(tmp_path / "b"), attempts=3)
    assert seen == [1, 2, 2, 3] and got.count() == 10 + 9 + 8


def test_null_gates_are_no_acceptance(spark, tmp_path):
    cells = spark.createDataFrame([(1,), (None,)], "cell long")
    got = A.ask_until_accepted(cells, lambda f: f.withColumns({"gate": F.lit(None).cast("boolean"), "level_gate": F.lit(True)}), str(tmp_path / "c"), attempts=2)
    assert got.count() == 4
    assert A.ask_until_accepted(cells.limit(0), lambda f: f.withColumns({"gate": F.lit(True), "level_gate": F.lit(True)}), str(tmp_path / "d")).count() == 0


FIELDS = [("a", "one"), ("b", "two words")]


@pytest.mark.parametrize(
    "strategy, reply, ok, fields, c",
    [
        ("append", " more\n", True, ["one", "two words\nmore"], "one two words\nmore"),
        ("append", "None", False, ["one", "two words"], "one two words"),
        ("wrap", "around", True, ["one", "around"], "one around"),
        ("wrap", None, False, ["one", "two words"], "one two words"),
        ("source", "richer", True, ["one", "richer"], "one richer"),
        ("task", "List it", True, ["List it\n\nSource:\none", "two words"], "[A] List it\n\nSource:\none\n[B] two words"),
        ("decision", "Rule 1: x?", True, ["", "Rule 1: x?"], "Rule 1: x?"),
        ("decision", "  ", False, ["one", "two words"], "one two words"),
        ("measure", "ignored", True, ["one", "two words"], "one two words"),
        ("delimited", "x [FIELD_1] p\nq [FIELD_2]\n", True, ["p\nq", "two words"], "p\nq two words"),
        ("delimited", "[FIELD_2] s [FIELD_1] r", True, ["r", "s"], "r s"),
        ("delimited", None, False, ["one", "two words"], "one two words"),
        ("json", '{"field_2": " s ", "other": "x"}', True, ["one", "s"], "one s"),
        ("json", " no json ", True, ["no json", "no json"], "no json"),
        ("json", None, False, ["one", "two words"], "one two words"),
    ],
)
def test_strategies(spark, strategy, reply, ok, fields, c):
    df = spark.createDataFrame([(FIELDS, reply)], "f array<struct<name:string,value:string>>, r string")
    r = df.select(A.payload(strategy, F.col("f"), F.col("r")).alias("p")).first().p
    assert (r.ok, [x.value for x in r.fields], r.c) == (ok, fields, c)


def test_per_field_and_prompts(spark):
    df = spark.createDataFrame([(FIELDS, ["none", " new "])], "f array<struct<name:string,value:string>>, r array<string>")
    r = df.select(A.payload("per_field", F.col("f"), F.col("r")).alias("p"), A.filled(F.lit("Do {text} in {n} words"), F.lit("briefly"), text=A.text_of(F.col("f")), n=F.lit(3)).alias("q")).first()
    assert [x.value for x in r.p.fields] == ["one", "new"] and r.q == "Do one two words in 3 words\nStyle guidance: briefly"
    with pytest.raises(ValueError):
        A.payload("other", F.col("f"), F.col("r"))
    bare = spark.createDataFrame([("x ", None, "nan")], "a string, b string, c string").select(A.fields_of(a=F.col("a"), b=F.col("b"), c=F.col("c")).alias("f")).first()
    assert [tuple(x) for x in bare.f] == [("a", "x")]


def test_calls_are_paced_and_written_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"q{i}") for i in range(12)] + [(None, None)], "`odd``name` long, input string")
    calls = spark.sparkContext.accumulator(0)

    def system(row):
        calls.add(1)
        return f"reply to {row['input']} {row['call_id'][:4]}"

    began = time.time()
    ask = lambda: A.paced(df, system, ("reply", "status", "ms", "tries"), str(tmp_path / "p"), per_minute=1200, parallel=2, blocks=2, tries=2, pause=0.0)
    got = ask().collect()
    assert len(got) == 13 and calls.value == 13 and {r.status for r in got} == {"ok"} and len({r.call_id for r in got}) == 13
    # 13 calls at 1200 a minute take 0.65 s but for the first of each task
    assert time.time() - began > (13 - 2 * 2) * 60 / 1200 * 0.5
    assert sorted(map(str, ask().collect())) == sorted(map(str, got)) and calls.value == 13


def test_what_was_written_is_not_asked_again_after_a_loss(spark, tmp_path):
    df = spark.range(40).withColumnRenamed("id", "n")
    path, calls = str(tmp_path / "l"), spark.sparkContext.accumulator(0)
    down = tmp_path / "down"
    down.touch()

    def system(row):
        if down.exists() and row["n"] % 3 == 0:
            import os

            os._exit(1)  # the worker is lost in the middle of a block
        calls.add(1)
        return str(row["n"])

    ask = lambda: A.paced(df, system, ("reply", "status", "ms", "tries"), path, per_minute=1e9, parallel=1, blocks=20)
    with pytest.raises(Exception):
        ask().collect()
    kept = [e["batch"] for e in results.ledger(spark, path)]
    rows = sum(spark.read.parquet(f"{path}/batches/{b:012d}").count() for b in kept)
    down.unlink()
    calls_before = calls.value
    assert sorted(int(r.reply) for r in ask().collect()) == list(range(40))
    assert calls.value - calls_before == 40 - rows  # only blocks without an entry
