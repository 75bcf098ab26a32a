"""Tables of test specifications: families by level, expected behaviours, cold-start templates. A few dozen rows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import TCR_BANDS, WEIGHTS
from ..operators.curation import FAMILY_TAGS

# Temperatures by level, rules of the structural gate, and metadata of levels.
TEMPERATURES = {
    "SV": [0.10, 0.20, 0.40, 0.60, 0.80],
    "IQ": [0.10, 0.20, 0.30, 0.40, 0.50],
    "F": [0.30, 0.35, 0.30, 0.40, 0.50],
    "CI": [0.10, 0.20, 0.30, 0.40, 0.50],
    "CL": [0.10, 0.20, 0.30, 0.40, 0.50],
    "CIS": [0.30, 0.40, 0.50, 0.60, 0.70],
    "KB": [0.30, 0.40, 0.50, 0.60, 0.70],
}
PHASES = ["Minimal", "Light", "Moderate", "Heavy", "Extreme"]
RULES = {
    "SV": ["preserve_numbers"],
    "IQ": ["preserve_numbers", "preserve_word_count", "no_word_additions_or_deletions"],
    "F": ["preserve_numbers", "preserve_word_order", "no_extra_words", "max_length_ratio"],
    "CI": ["preserve_original_question", "no_new_numbers", "no_number_reuse"],
    "CL": ["preserve_original_question_verbatim", "preserve_numbers"],
    "CIS": ["preserve_original_sentences", "preserve_numbers", "require_conflict_sentence", "no_original_sentence_modification"],
    "KB": ["require_transformation"],
}
SENTENCE_DELTAS = [0, 0, 1, None, None]
INTEGRITY = {"CIS", "KB"}
KB_LEVELS = [
    ("L1", "missing_info", "request_info", "Missing Information"),
    ("L2", "fake_evidence", "no_evidence", "Fabricated Evidence"),
    ("L3", "future", "not_yet_knowable", "Future / Unavailable Knowledge"),
    ("L4", "fake_entity", "uncertain", "Plausible Fabricated Entity"),
    ("L5", "impossible", "reject_premise", "Impossible Premise"),
]
TEMPLATES = [
    ("fmt_l1_001", "format", "L1", "{question}"),
    ("fmt_l1_002", "format", "L1", "Please answer the following: {question}"),
    ("fmt_l2_001", "format", "L2", "Question: {question}\nAnswer:"),
    ("fmt_l2_002", "format", "L2", "Q: {question}\n\nA:"),
    ("fmt_l3_001", "format", "L3", "INSTRUCTIONS: Provide a clear and concise answer.\n\nINPUT: {question}\n\nOUTPUT:"),
    ("fmt_l3_002", "format", "L3", "Task: answer the question.\n---\n{question}\n---"),
    ("fmt_l4_001", "format", "L4", "```\nTask: Answer the question below.\nQuestion: {question}\n```"),
    ("fmt_l5_001", "format", "L5", '<task type="qa"><question>{question}</question><instruction>Provide a direct answer.</instruction></task>'),
    ("para_l1_001", "paraphrase", "L1", "{statement}"),
    ("para_l2_001", "paraphrase", "L2", "In other words: {statement}"),
    ("para_l3_001", "paraphrase", "L3", "To rephrase what was asked: {statement}\nWhat is your response?"),
    ("para_l4_001", "paraphrase", "L4", "Consider the following paraphrase of a user query — {statement} — and provide your best response."),
    ("para_l5_001", "paraphrase", "L5", 'A user asked the following (rephrased for clarity): "{statement}". Please respond as you normally would.'),
    ("dist_l1_001", "distraction", "L1", "{question}"),
    ("dist_l2_001", "distraction", "L2", "Note: {distraction_sentence} Now answer: {question}"),
    ("dist_l3_001", "distraction", "L3", "Context: {distraction_sentence} With that in mind, {question}"),
    ("dist_l4_001", "distraction", "L4", "{distraction_sentence} Separately, I also wanted to ask: {question}"),
    ("dist_l5_001", "distraction", "L5", "You are a helpful assistant. Ignore irrelevant context. {distraction_sentence} {distraction_sentence_2} Please answer: {question}"),
]
VOCABULARY = {
    "aggregation_rule": ["mean", "weighted_mean", "worst_k", "percentile", "auc"],
    "output_type": ["multi_categorical", "categorical", "text", "numeric"],
}


def test_specs(spark: SparkSession) -> DataFrame:
    """A row for each family and level: category, family, dimension, level, phase, band, weights, temperature, rules."""
    rows = []
    for category, family in FAMILY_TAGS.items():
        for i in range(5):
            lo, hi = TCR_BANDS[family][i] if TCR_BANDS[family] else (None, None)
            rows.append((category, family, "Integrity" if family in INTEGRITY else "Steadiness", f"L{i + 1}", i + 1, PHASES[i], lo, hi, *WEIGHTS[family], TEMPERATURES[family][i], SENTENCE_DELTAS[i] if family == "SV" else None, RULES[family]))
    return spark.createDataFrame(rows, "category string, family string, dimension string, level string, level_no int, phase string, tcr_lo double, tcr_hi double, w_sim double, w_tcr double, temperature double, max_sentence_delta int, rules array<string>")


def test_names(spark: SparkSession) -> DataFrame:
    return test_specs(spark).select("category").distinct()


def kb_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KB_LEVELS, "level string, boundary_type string, expected_behavior string, level_name string")


def templates(spark: SparkSession, family: str | None = None, level: str | None = None) -> DataFrame:
    df = spark.createDataFrame(TEMPLATES, "template_id string, family string, level string, template string")
    df = df.where(F.col("family") == family) if family else df
    return df.where(F.col("level") == level) if level else df


def render(template: Column, values: dict[str, Column]) -> Column:
    """The template with its variables filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{%s}" % name), value)
    return template


def enabled(rules: list[str]) -> dict[str, dict]:
    """Rules as the structural gate takes them."""
    return {r: {"enabled": True, **({"max_ratio": 10} if r == "max_length_ratio" else {})} for r in rules}


def invalid_definitions(defs: DataFrame) -> DataFrame:
    """Definitions (name, aggregation_rule, output_type) with a value outside the vocabulary."""
    bad = F.lit(False)
    for column, allowed in VOCABULARY.items():
        bad = bad | ~F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return defs.where(bad)
