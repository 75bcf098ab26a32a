"""Scoring of predictions and executed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decision as D
from ..functions import match as M
from ..functions.difflib_udf import dealt
from ..operators import evaluate as E
from ..plans.bridge import PREDS, TURNS, preds, turns
from ..sources.tables import Intake, OutputDef
from .registry import query
from .texts import _q

P = f"WITH p AS ({PREDS})"


@query("sim01_exact", f"{P} SELECT source_row, CASE WHEN pred_lang IS NULL THEN 0 WHEN lower(trim(pred_lang)) = lower(trim(gt_lang)) THEN 1 ELSE 0 END::DOUBLE AS sim FROM p")
def exact(spark, sf_dir):
    return preds(spark, sf_dir).select("source_row", M.exact(F.col("pred_lang"), F.col("gt_lang")).alias("sim"))


_MULTI = """CASE WHEN lower(trim(pred_tags)) IN ('', 'nan', 'none', 'n/a', 'null') THEN [] ELSE list_distinct(list_filter(list_transform(string_split(regexp_replace(pred_tags, '[\\[\\]{}''"]', '', 'g'), ','), lambda v: lower(trim(v))), lambda v: v <> '')) END"""


@query("sim02_parse_multi", f"{P} SELECT source_row, array_to_string(list_sort({_MULTI}), ',') AS tags FROM p")
def parse_multi(spark, sf_dir):
    return preds(spark, sf_dir).select("source_row", F.array_join(F.array_sort(M.parse_multi(F.col("pred_tags"))), ",").alias("tags"))


_GT = "[lower(gt_lang), lower(gt_source)]"
_JAC = "round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 4)"


@query("sim03_jaccard", f"{P}, q AS (SELECT source_row, {_MULTI} AS a, {_GT} AS b FROM p) SELECT source_row, {_JAC} AS sim FROM q")
def jaccard(spark, sf_dir):
    gt = F.array_distinct(F.array(F.lower("gt_lang"), F.lower("gt_source")))
    return preds(spark, sf_dir).select("source_row", M.set_jaccard(M.parse_multi(F.col("pred_tags")), gt).alias("sim"))


@query("sim04_text")
def text(spark, sf_dir):
    return dealt(turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", E.text_similarity(F.col("c"), F.col("o")).alias("sim"))


_NUM = "TRY_CAST(nullif(translate(regexp_extract({x}, " + _q(M.FIRST_NUMBER) + "), '$, ', ''), '') AS DOUBLE)"


@query("sim05_numeric", f"{P}, q AS (SELECT source_row, {_NUM.format(x='pred_chars')} AS p, {_NUM.format(x='gt_chars')} AS g FROM p) SELECT source_row, CASE WHEN p IS NULL OR g IS NULL THEN 0 WHEN abs(g) > 1e-9 THEN (abs(p - g) / abs(g) < 0.001::DOUBLE)::INT ELSE (abs(p) < 1e-9)::INT END::DOUBLE AS sim FROM q")
def numeric(spark, sf_dir):
    return preds(spark, sf_dir).select("source_row", M.numeric(F.col("pred_chars"), F.col("gt_chars")).alias("sim"))


@query("sim06_parse_solution", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props->>'$.k' WHEN event_id % 3 = 1 THEN (event_id % 1000)::VARCHAR ELSE (event_id % 100000)::VARCHAR END AS answer FROM events")
def parse_solution(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    id_ = lambda n: (F.col("event_id") % n).cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('So {"answer": "'), k, F.lit('"} it is'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("1 + 2 = 3\n#### "), id_(1000))).otherwise(F.concat(F.lit("first 12 then "), id_(100000), F.lit(" apples")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", M.parse_solution(raw).alias("answer"))


#: Outputs of the standard evaluation over documents.
OUTPUTS = (
    OutputDef("output_1", ("gt_lang",), "lang", "categorical", 0.5),
    OutputDef("output_2", ("gt_chars",), "chars", "numeric", 0.3),
    OutputDef("output_3", ("gt_lang", "gt_source"), "tags", "multi_categorical", 0.2),
)
_OK = "run_status = 'ok'"
_S1 = f"CASE WHEN {_OK} THEN CASE WHEN pred_lang IS NULL THEN 0 WHEN lower(trim(pred_lang)) = lower(trim(gt_lang)) THEN 1 ELSE 0 END END"
_S2 = f"CASE WHEN {_OK} THEN CASE WHEN np IS NULL OR ng IS NULL THEN 0 WHEN abs(ng) > 1e-9 THEN (abs(np - ng) / abs(ng) < 0.001::DOUBLE)::INT ELSE (abs(np) < 1e-9)::INT END END"
_S3 = f"CASE WHEN {_OK} THEN {_JAC} END"


@query(
    "sim08_evaluate",
    f"""{P}, q AS (SELECT *, {_NUM.format(x="pred_chars")} AS np, {_NUM.format(x="gt_chars")} AS ng, {_MULTI} AS a, {_GT} AS b FROM p), e AS (SELECT source_row, ({_S1})::DOUBLE AS sim_lang, ({_S2})::DOUBLE AS sim_chars, ({_S3})::DOUBLE AS sim_tags FROM q)
    SELECT *, round((0.5::DOUBLE * sim_lang + 0.3::DOUBLE * sim_chars + 0.2::DOUBLE * sim_tags) / 1.0::DOUBLE, 4) AS sim_outputs FROM e""",
)
def evaluate(spark, sf_dir):
    """SIM-07, SIM-08, AGG-43: all outputs of each document, and their weighted mean."""
    rows = preds(spark, sf_dir)
    intake = Intake(rows.select(F.col("source_row").alias("row_id"), "gt_lang", "gt_chars", "gt_source"), ("text",), OUTPUTS)
    pred = F.create_map(F.lit("lang"), F.col("pred_lang"), F.lit("chars"), F.col("pred_chars"), F.lit("tags"), F.col("pred_tags"))
    return E.evaluate(rows.select("source_row", "run_status", pred.alias("pred")), intake).select("source_row", "sim_lang", "sim_chars", "sim_tags", "sim_outputs")


_BEHAVE = "CASE expected " + " ".join(f"WHEN '{k}' THEN regexp_matches(lower(coalesce(c, '')), {_q('|'.join(v))})::INT" for k, v in M.BEHAVIOURS.items()) + " ELSE 0 END"
_LEVEL = "concat('L', CAST(conv_id % 6 AS VARCHAR(20)))"
_SAYS = "concat(coalesce(c, ''), CASE WHEN conv_id % 4 = 0 THEN ' There is no evidence and more information needed: it cannot be.' ELSE '' END)"


@query("sim10_behaviour", f"WITH p AS ({TURNS}), q AS (SELECT conv_id, turn, {_SAYS} AS c, CASE conv_id % 6 WHEN 1 THEN 'request_info' WHEN 2 THEN 'no_evidence' WHEN 3 THEN 'not_yet_knowable' WHEN 4 THEN 'uncertain' WHEN 5 THEN 'reject_premise' ELSE '' END AS expected FROM p) SELECT conv_id, turn, ({_BEHAVE})::DOUBLE AS sim_outputs FROM q")
def behaviour(spark, sf_dir):
    """SIM-10, SIM-11, JOIN-03."""
    rows = turns(spark, sf_dir).withColumns({"level": F.concat(F.lit("L"), (F.col("conv_id") % 6).cast("string")), "response": F.concat(F.coalesce("c", F.lit("")), F.when(F.col("conv_id") % 4 == 0, " There is no evidence and more information needed: it cannot be.").otherwise(""))})
    return E.evaluate_kb(rows).select("conv_id", "turn", "sim_outputs")


@query("sim13_snap", "SELECT event_id, CASE WHEN x >= 0.875::DOUBLE THEN 1 WHEN x >= 0.5::DOUBLE THEN 0.75 WHEN x >= 0.125::DOUBLE THEN 0.25 ELSE 0 END::DOUBLE AS steadiness, CASE WHEN x >= 0.875::DOUBLE THEN 1 WHEN x >= 0.375::DOUBLE THEN 0.75 ELSE 0 END::DOUBLE AS kb FROM (SELECT event_id, CAST(props->>'$.k' AS DOUBLE) / 100 AS x FROM events)")
def snap(spark, sf_dir):
    x = F.get_json_object("props", "$.k").cast("double") / 100
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", M.snap(x, "steadiness").alias("steadiness"), M.snap(x, "kb").alias("kb"))


@query("sim09_route", f"{P} SELECT source_row, CASE source_row % 3 WHEN 0 THEN (source_row % 7) / 7::DOUBLE WHEN 1 THEN (CASE WHEN source_row % 2 = 0 THEN 0.25 ELSE 0 END) ELSE (CASE WHEN pred_lang IS NULL THEN 0 WHEN lower(trim(pred_lang)) = lower(trim(gt_lang)) THEN 1 ELSE 0 END) END::DOUBLE AS sim FROM p")
def route(spark, sf_dir):
    """SIM-09, SIM-12, JOIN-04: rows by category."""
    category = F.get(F.array(F.lit("Knowledge Boundary"), F.lit("Decision Complexity"), F.lit("Input Quality")), (F.col("source_row") % 3).cast("int"))
    said = F.concat(F.when(F.col("source_row") % 2 == 0, "We Approve of ").otherwise("Disapproval of "), F.coalesce("pred_lang", F.lit("it")))
    return preds(spark, sf_dir).select("source_row", E.route(category, M.exact(F.col("pred_lang"), F.col("gt_lang")), (F.col("source_row") % 7) / 7, E.decision_fallback(said)).alias("sim"))


@query(
    "jdg02_parse_verdict",
    """WITH e AS (SELECT event_id, event_id % 6 AS kind, CAST(props->>'$.k' AS INT) AS k, event_type AS said FROM events)
    SELECT event_id, CASE WHEN kind < 3 THEN k >= 50 ELSE kind = 3 END AS same_meaning, CASE WHEN kind < 2 THEN round(k / 100::DOUBLE, 2) ELSE 0.5 END::DOUBLE AS confidence,
        CASE kind WHEN 0 THEN 'x' WHEN 1 THEN 'x' WHEN 2 THEN '{"same_meaning": ' || (k >= 50) || '}' WHEN 3 THEN 'Yes, ' || said || ' it is' WHEN 4 THEN 'No, that is not true: ' || said ELSE '' END AS explanation FROM e""",
)
def parse_verdict(spark, sf_dir):
    """JSON whole, inside a text, and without its other fields; keywords for yes and no; nothing at all."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 6
    same = F.concat(F.lit('{"same_meaning": '), F.when(k.cast("int") >= 50, "true").otherwise("false"))
    whole = F.concat(same, F.lit(', "confidence": '), (k.cast("double") / 100).cast("string"), F.lit(', "explanation": "x"}'))
    raw = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("Verdict: "), whole, F.lit(" (end)"))).when(kind == 2, F.concat(same, F.lit("}"))).when(kind == 3, F.concat(F.lit("Yes, "), "event_type", F.lit(" it is"))).when(kind == 4, F.concat(F.lit("No, that is not true: "), "event_type"))
    v = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", E.parse_verdict(raw).alias("v"))
    return v.select("event_id", "v.same_meaning", F.round("v.confidence", 2).alias("confidence"), "v.explanation")


@query("jdg04_claims", "SELECT user_id, coalesce(round((sum(CASE WHEN event_id % 5 > 0 THEN value / 1000 END::DECIMAL(28, 12))::DOUBLE / count(CASE WHEN event_id % 5 > 0 THEN value END))::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE, 1) AS entailment, coalesce(round(max(CASE WHEN event_id % 3 > 0 THEN (500 - value) / 1000 END), 4), 0) AS contradiction FROM events GROUP BY user_id")
def claims(spark, sf_dir):
    entailment, contradiction = F.when(F.col("event_id") % 5 > 0, F.col("value") / 1000), F.when(F.col("event_id") % 3 > 0, (500 - F.col("value")) / 1000)
    return E.claims_verdict(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", entailment.alias("entailment"), contradiction.alias("contradiction")), "user_id")


_NUMBER = "regexp_matches(replace(trim(pred_chars), ',', ''), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$')"


@query(
    "exe04_exec_score",
    f"""{P}, e AS (SELECT source_row, CASE WHEN regexp_replace(coalesce(pred_lang, ''), '\\s+', '', 'g') <> '' THEN 1 ELSE 0 END::DOUBLE AS completion,
        CASE source_row % 5 WHEN 0 THEN coalesce(({_NUMBER})::INT, 0) WHEN 1 THEN (length(trim(coalesce(pred_chars, ''))) > 2)::INT WHEN 2 THEN (trim(coalesce(pred_chars, '')) <> '')::INT ELSE 0 END::DOUBLE AS compliant,
        round(((pred_lang IS NOT NULL)::INT + 1) / 2::DOUBLE, 4) AS completeness FROM p)
    SELECT *, round((0.3::DOUBLE * completion + 0.35::DOUBLE * compliant + 0.35::DOUBLE * completeness) / (0.3::DOUBLE + 0.35::DOUBLE + 0.35::DOUBLE), 4) AS score FROM e""",
)
def execution(spark, sf_dir):
    """EXE-01 to EXE-04: numbers, texts, labels, refusals and blanks."""
    of = lambda *values: F.get(F.array(*values), (F.col("source_row") % 5).cast("int"))
    own, kind = F.col("pred_chars"), of(*map(F.lit, ("numeric", "Short_Text", "categorical", "text", "categorical")))
    pred = of(own, own, own, F.lit("I'm sorry, but I cannot tell"), F.lit("  "))
    rows = preds(spark, sf_dir).select("source_row", D.completion("pred_lang").alias("completion"), D.schema_compliance(pred, kind).alias("compliant"), D.completeness(F.col("pred_lang").isNotNull().cast("int") + 1, F.lit(2)).alias("completeness"))
    return rows.select("*", D.exec_score(F.col("completion"), F.col("compliant"), F.col("completeness")).alias("score"))
