"""Scores of responses against ground truth, routed by output type and category."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import match as M
from ..functions.difflib_udf import ratio
from ..functions.text import cosine, mean4, r4
from ..sources.registry import kb_levels
from ..sources.tables import Intake, OutputDef
from .joins import with_criteria, with_intake

#: Words of a decision, and what a mention of one is worth without a judge.
DECISION_WORDS = r"(?i)\b(approve|reject|select|choose|rank|route|assign|recommend|eligible|accept|deny)"
DECISION_FALLBACK = 0.25


def truth(d: OutputDef) -> Column:
    """Ground truth of an output: trimmed text, or the distinct telling values of its columns."""
    if d.type == "multi_categorical":
        values = F.array(*(F.lower(F.trim(F.col(c).cast("string"))) for c in d.gt_cols))
        return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & ~v.isin(M.NULL_LIKE)))
    return F.trim(F.coalesce(F.col(d.gt_cols[0]).cast("string"), F.lit("")))


def text_similarity(pred: Column, gt: Column, vectors: tuple[Column, Column] | None = None) -> Column:
    """Of vectors if given, else of matching blocks; 0 if one is blank."""
    p, g = (F.trim(F.coalesce(x.cast("string"), F.lit(""))) for x in (pred, gt))
    value = r4(cosine(*vectors)) if vectors else r4(ratio(p, g))
    return F.when((p == "") | (g == ""), F.lit(0.0)).otherwise(value)


def output_sim(pred: Column, gt: Column, kind: str, vectors: tuple[Column, Column] | None = None) -> Column:
    if kind == "categorical":
        return M.exact(pred.cast("string"), gt)
    if kind == "multi_categorical":
        return M.set_jaccard(M.parse_multi(pred.cast("string")), gt)
    if kind == "text":
        return text_similarity(pred, gt, vectors)
    if kind == "numeric":
        return M.numeric(pred, gt)
    raise ValueError(f"unknown output type {kind!r}")


def evaluate(responses: DataFrame, intake: Intake) -> DataFrame:
    """responses (source_row, run_status, pred MAP) with gt_<key>, sim_<key> and sim_outputs; failed runs have no sims."""
    rows = with_intake(responses, intake.df.withColumnRenamed("row_id", "source_row"))
    ok = F.coalesce(F.col("run_status"), F.lit("ok")) == "ok"
    keys = [d.agent_key for d in intake.output_defs]
    gts = {f"gt_{d.agent_key}": truth(d) for d in intake.output_defs}
    rows = rows.withColumns(gts)
    rows = rows.withColumns({f"sim_{d.agent_key}": F.when(ok, output_sim(F.try_element_at("pred", F.lit(d.agent_key)), F.col(f"gt_{d.agent_key}"), d.type)) for d in intake.output_defs})
    total = M.weighted({k: F.col(f"sim_{k}") for k in keys}, {d.agent_key: d.weight for d in intake.output_defs})
    return rows.select(*responses.columns, *gts, *(f"sim_{k}" for k in keys), total.alias("sim_outputs"))


def evaluate_kb(responses: DataFrame, response: str = "response", level: str = "level") -> DataFrame:
    """Compliance with the expected behaviour of the level: an injected judge's score (judge_score) if there, else patterns."""
    table = kb_levels(responses.sparkSession).withColumnRenamed("level", level)
    rows = with_criteria(responses, table, level, defaults={"expected_behavior": ""})
    pattern = M.behaviour(F.col(response), F.col("expected_behavior"))
    if "judge_score" in responses.columns:
        judged = F.col("judge_score").isNotNull()
        return rows.withColumns({"sim_outputs": F.coalesce(M.snap(F.col("judge_score"), "kb"), pattern), "judge_method": F.when(judged, "llm").otherwise("pattern")})
    return rows.withColumns({"sim_outputs": pattern, "judge_method": F.lit("pattern")})


def route(category: Column, standard: Column, kb: Column, decision: Column) -> Column:
    """The score that a row's category asks for."""
    return F.when(category == "Knowledge Boundary", kb).when(category == "Decision Complexity", decision).otherwise(standard)


def decision_fallback(response: Column) -> Column:
    return F.when(F.rlike(F.coalesce(response, F.lit("")), F.lit(DECISION_WORDS)), DECISION_FALLBACK).otherwise(0.0)


def parse_verdict(raw: Column) -> Column:
    """STRUCT<same_meaning, confidence, explanation> of a judge's reply: JSON, else the JSON inside it, else a keyword, else no at 0.5."""
    text = F.coalesce(raw, F.lit(""))
    schema = "same_meaning boolean, confidence double, explanation string"
    whole = F.from_json(text, schema)
    inner = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
    low = F.lower(text)
    plain = F.rlike(low, F.lit(r"\b(?:true|yes)\b")) & ~F.rlike(low, F.lit(r"\b(?:false|no|not)\b"))
    same = F.coalesce(whole["same_meaning"], inner["same_meaning"], plain)
    return F.struct(same.alias("same_meaning"), F.coalesce(whole["confidence"], inner["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(whole["explanation"], inner["explanation"], F.substring(text, 1, 200)).alias("explanation"))


def claims_verdict(claims: DataFrame, *by: str) -> DataFrame:
    """Mean entailment and largest contradiction of the claims of a text."""
    return claims.groupBy(*by).agg(F.coalesce(mean4("entailment"), F.lit(1.0)).alias("entailment"), r4(F.coalesce(F.max("contradiction"), F.lit(0.0))).alias("contradiction"))


def run_plan(seeds: DataFrame, tests: DataFrame, rounds: int = 3) -> DataFrame:
    """Rows to ask a system: each seed `rounds` times unchanged, and every admitted test. seeds: source_row, question."""
    base = seeds.select("source_row", F.lit("Temporal Consistency").alias("category"), F.lit("L0").alias("level"), F.col("question").alias("input"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    return base.unionByName(tests.where("gate").select("source_row", "category", "level", F.col("c").alias("input"), F.lit(1).alias("round")))


def attempt(call: Callable[[], object], tries: int = 6, pause: float = 2.0, most: float = 60.0) -> tuple[object, str, int, int]:
    """Result, status ("ok" or "error: ..."), milliseconds and tries of a call; pauses between tries double up to `most` seconds."""
    import time

    began = time.time()
    for n in range(1, tries + 1):
        try:
            return call(), "ok", int(1000 * (time.time() - began)), n
        except Exception as e:
            status = f"error: {e}"
            if n < tries:
                time.sleep(min(most, pause * 2 ** (n - 1)))
    return None, status, int(1000 * (time.time() - began)), tries


def each_call(df: DataFrame, call: Callable[[dict], object], names: tuple[str, ...], **how) -> DataFrame:
    """df with a call's reply for each row: text, status, milliseconds and tries, under the given names. A row that fails costs no other row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [attempt(lambda row=row: call(row), **how) for row in b.to_dict("records")]
            yield b.assign(**{n: pd.Series([g[i] for g in got], index=b.index, dtype=object if i < 2 else "int64") for i, n in enumerate(names)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, {names[0]} string, {names[1]} string, {names[2]} long, {names[3]} long")


def ask(plan: DataFrame, system: Callable[[str], str], **how) -> DataFrame:
    """Responses of a system under test to each row's input: adds raw_response, run_status, latency_ms, tries. how: tries, pause, most."""
    return each_call(plan, lambda row: system(row["input"]), ("raw_response", "run_status", "latency_ms", "tries"), **how)


def align(tests: DataFrame, responses: list[str | None] | DataFrame, order: str) -> DataFrame:
    """Tests with raw_response by position: the n-th response (of a list, or by column `at` from 0) is the n-th test's in the given order.

    Tests beyond the last response have none; responses beyond the last test are left out.
    """
    from .bins import ranked

    if not isinstance(responses, DataFrame):
        responses = tests.sparkSession.createDataFrame(list(enumerate(responses)), "at long, raw_response string")
    return ranked(tests, order, order, "at").join(responses.select("at", "raw_response"), "at", "left").drop("at")
