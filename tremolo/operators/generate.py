"""Candidate frames for text generation: what to ask a generator, and how its replies become attempts.

The generator itself is a plug-in that is asked row by row, with retries; everything around it is declared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import temperature
from ..functions.text import goal_type, numbers, units
from .evaluate import each_call, parse_verdict


def core(text) -> Column:
    """STRUCT<numbers, units, goal_type> of a question, what a variant must keep."""
    return F.struct(F.array_sort(F.array_distinct(numbers(text))).alias("numbers"), F.array_sort(units(text)).alias("units"), goal_type(text).alias("goal_type"))


def anchors(c: Column, claims: Column | None = None) -> Column:
    """A prompt block that lists the anchors of a core; empty parts are left out."""
    none = F.lit(None).cast("string")
    lines = [
        F.lit("SEMANTIC ANCHORS (must be preserved exactly):"),
        F.when(F.size(c["numbers"]) > 0, F.concat(F.lit("- Numbers: "), F.array_join(c["numbers"], ", "))).otherwise(none),
        F.when(F.size(c["units"]) > 0, F.concat(F.lit("- Units: "), F.array_join(c["units"], ", "))).otherwise(none),
        F.when(c["goal_type"] != "find_unknown", F.concat(F.lit("- Goal: "), c["goal_type"])).otherwise(none),
    ]
    if claims is not None:
        lines.append(F.when(F.size(claims) > 0, F.concat(F.lit("- Key facts:\n"), F.array_join(F.transform(claims, lambda x: F.concat(F.lit("  * "), x)), "\n"))).otherwise(none))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def validity(expected: Column, system: Column) -> Column:
    """A prompt block that tells the system's task and the expected response; empty without both."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    parts = F.concat_ws("\n", F.concat(F.lit("SYSTEM UNDER TEST: "), filled(system)), F.concat(F.lit("EXPECTED RESPONSE: "), filled(expected)))
    return F.when(parts == "", "").otherwise(F.concat(parts, F.lit("\n")))


def candidates(seeds: DataFrame, specs: DataFrame, attempts: int = 2) -> DataFrame:
    """A row for each seed, family, level and attempt. specs: the registry's few dozen rows; the core is found once a seed."""
    asked = specs.select("category", "family", F.col("level").alias("target_level"), F.col("temperature").alias("base"))
    # the specs are a fixed table of 35 rows
    rows = seeds.withColumn("core", core("question")).join(F.broadcast(asked))
    return rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts)))).withColumn("temperature", temperature(F.col("base"), F.col("attempt"))).drop("base")


def generated(plan: DataFrame, generator: Callable[[dict], str], **how) -> DataFrame:
    """The plan with a generated text c for each row, its status, milliseconds and tries. how: tries, pause, most of evaluate.attempt()."""
    flat = plan.withColumn("core", F.to_json("core")) if "core" in plan.columns else plan
    return each_call(flat, generator, ("c", "status", "latency_ms", "tries"), **how)


def judged(pairs: DataFrame, judge: Callable[[str, str], str], model: str = "", **how) -> DataFrame:
    """Pairs (o, c) with a judge's record: same_meaning, confidence, explanation, model, latency_ms, tries, error, and the raw verdict.

    A call that fails in all its tries has no verdict: same_meaning is null and error tells why.
    """
    asked = each_call(pairs, lambda row: judge(row["o"], row["c"]), ("verdict", "_status", "latency_ms", "tries"), **how)
    ok, parsed = F.col("_status") == "ok", parse_verdict(F.col("verdict"))
    return asked.select(*pairs.columns, "verdict", *(F.when(ok, parsed[f]).alias(f) for f in ("same_meaning", "confidence", "explanation")), F.lit(model).alias("model"), "latency_ms", "tries", F.when(~ok, F.col("_status")).alias("error"))
