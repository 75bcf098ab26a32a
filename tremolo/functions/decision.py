"""Complexity of decision tasks and quality of executed answers, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _t, anchored, any_of, let, r4

# Patterns, keyword lists, caps, bounds and weights of the scores.
RULES = [
    r"rule\s*\d+\s*[:.]",
    r"\brule\s+[A-Z]\s*[:.]",
    r"if\b.{5,80}?then\b",
    r"\bwhen\b.{5,60}?,",
    r"criteria\s*\d*\s*[:.]",
    r"condition\s*\d*\s*[:.]",
    r"requirement\s*\d*\s*[:.]",
    r"policy\s*\d*\s*[:.]",
    r"guideline\s*\d*\s*[:.]",
    r"must\b.{3,50}?(?:and|or|if)",
]
FACTORS = [
    "age", "income", "score", "credit", "rating", "tenure", "rank", "grade", "level", "tier", "category", "type", "status", "priority", "weight",
    "cost", "budget", "limit", "threshold", "deadline", "duration", "risk", "performance", "experience", "qualification", "seniority", "region",
    "department", "team", "role", "position", "salary", "revenue", "margin", "frequency", "volume", "quantity", "capacity", "availability",
]
VARIABLES = FACTORS + [
    "amount", "rate", "percentage", "ratio", "count", "size", "distance", "time", "date", "period", "range", "interval", "proportion", "share",
    "value", "metric", "index", "parameter", "factor", "criterion",
]
EXCEPTIONS = ["except", "unless", "however", "but if", "provided that", "in the case", "special case", "exception", "override", "waiver", "exempt", "not applicable", "regardless", "notwithstanding", "subject to", "only if", "unless otherwise"]
BRANCHES = ["if ", "else", "elif", "otherwise", "in that case", "when "]
TRADEOFFS = ["tradeoff", "trade-off", "trade off", "balance", "weigh", "competing", "priority", "prioritize", "vs.", "versus", "on the other hand", "however,", "at the expense", "consider both", "optimize", "maximize", "minimize", "prefer", "preferred over", "more important than", "outweighs"]
DECISIONS = [
    ("rank", ["rank", "ranking", "order", "ordered", "priority list", "sort"]),
    ("approve", ["approve", "approval", "reject", "eligible", "qualify", "accept"]),
    ("compare", ["compare", "which is better", "which option", "best option", "choose"]),
    ("combine", ["combine", "aggregate", "merge", "composite", "weighted", "total"]),
    ("route", ["route", "assign", "allocate", "direct", "escalate", "forward"]),
]
COUNTED = {
    "num_conditions": r"\b(?:if|when|where|provided|assuming|in\s+case)\b|\bgiven\s+that\b",
    "num_actions": r"\b(?:approve|reject|select|assign|route|rank|choose|decide|allocate|evaluate)\b",
    "num_constraints": r"\b(?:must|shall|required|limit|cap|maximum|minimum|cannot)\b|\bat\s+least\b|\bat\s+most\b|\bno\s+more\s+than\b",
    "logical_operators": r"\b(?:and|or|not|but|unless|however|whereas)\b|\bif\b.{1,30}\bthen\b|\beither\b.{1,30}\bor\b|\bneither\b.{1,30}\bnor\b",
    "decision_branches": r"\b(?:else|otherwise|alternatively|option|path|branch|case|scenario)\b|\b(?:elif)\b",
}
BOUNDS = {
    "num_conditions": (0, 10),
    "num_variables": (0, 12),
    "num_actions": (0, 8),
    "num_constraints": (0, 8),
    "dep_tree_depth": (1, 8),
    "sentence_length": (5, 40),
    "clause_count": (1, 15),
    "logical_operators": (0, 10),
    "decision_branches": (0, 8),
}
WEIGHTS = {
    "num_conditions": 0.15,
    "num_variables": 0.15,
    "num_actions": 0.10,
    "num_constraints": 0.10,
    "dep_tree_depth": 0.05,
    "sentence_length": 0.05,
    "clause_count": 0.05,
    "logical_operators": 0.10,
    "decision_branches": 0.15,
}
EXEC_WEIGHTS = {"completion": 0.30, "schema": 0.35, "completeness": 0.35}
REFUSAL = r"(?i)^(error|exception|traceback|internal server error|sorry.{0,20}(can.?t|unable|cannot)|i.?m sorry|as an ai)"


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _low(x) -> Column:
    return F.lower(_t(x))


def num_rules(x) -> Column:
    return F.least(F.lit(8), _sum(F.regexp_count(_t(x), F.lit(f"(?is){p}")) for p in RULES)).cast("long")


def _whole_words(x, what: list[str]) -> Column:
    # a word between two word bounds is a whole run of word characters, so one split finds them all
    return F.size(F.array_intersect(F.split(_low(x), r"(?U)\W+"), F.array(*map(F.lit, what)))).cast("long")


def num_factors(x) -> Column:
    return _whole_words(x, FACTORS)


def num_variables(x) -> Column:
    return _whole_words(x, VARIABLES)


def num_exceptions(x) -> Column:
    return let(_low(x), lambda t: _sum(F.contains(t, F.lit(w)).cast("int") for w in EXCEPTIONS).cast("long"))


def branch_depth(x) -> Column:
    return let(_low(x), lambda t: F.least(F.lit(4), _sum(F.contains(t, F.lit(w)).cast("int") for w in BRANCHES)).cast("long"))


def has_tradeoff(x) -> Column:
    return let(_low(x), lambda t: any_of(t, TRADEOFFS))


def decision_type(x) -> Column:
    def first(text: Column) -> Column:
        out = F.lit("unknown")
        for name, what in reversed(DECISIONS):
            out = F.when(any_of(text, what), F.lit(name)).otherwise(out)
        return out

    return let(_low(x), first)


def struct_score(x) -> Column:
    part = lambda n, most: F.least(F.lit(1.0), n / F.lit(float(most)))
    return r4(0.25 * part(num_rules(x), 8) + 0.25 * part(num_factors(x), 6) + 0.20 * part(num_exceptions(x), 4) + 0.20 * part(branch_depth(x), 4) + 0.10 * has_tradeoff(x).cast("double"))


def counted(x, feature: str) -> Column:
    return F.regexp_count(_t(x), F.lit(f"(?is){anchored(COUNTED[feature])}")).cast("long")


def sentence_length(x) -> Column:
    """Mean words of a sentence (ends at . ! ? or a line break), 5 for none; two places."""
    parts = F.filter(F.split(_t(x), r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != "")
    n = F.aggregate(F.transform(parts, lambda s: F.size(F.split(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")), " ")).cast("double")), F.lit(0.0), lambda a, b: a + b)
    return F.round(F.when(F.size(parts) == 0, F.lit(5.0)).otherwise(F.try_divide(n, F.size(parts).cast("double"))), 2)


def definition_features(x, depth: Column | None = None, clauses: Column | None = None) -> dict[str, Column]:
    """Raw values of the nine features. depth and clauses come from a parser; without one they are at their floor."""
    own = {
        "num_conditions": counted(x, "num_conditions"),
        "num_variables": num_variables(x),
        "num_actions": counted(x, "num_actions"),
        "num_constraints": counted(x, "num_constraints"),
        "dep_tree_depth": F.lit(1) if depth is None else depth,
        "sentence_length": sentence_length(x),
        "clause_count": F.lit(1) if clauses is None else clauses,
        "logical_operators": counted(x, "logical_operators"),
        "decision_branches": counted(x, "decision_branches"),
    }
    return {k: v.cast("double") for k, v in own.items()}


def normalised(raw: Column, feature: str) -> Column:
    lo, hi = BOUNDS[feature]
    return r4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - lo) / float(hi - lo))))


def definition_score(x, depth: Column | None = None, clauses: Column | None = None, places: int = 4) -> Column:
    """The weighted mean of the normalised features."""
    parts = [WEIGHTS[k] * normalised(v, k) for k, v in definition_features(x, depth, clauses).items()]
    return F.round(_sum(parts) / sum(WEIGHTS.values()), places)


def ranked_features(x, depth: Column | None = None, clauses: Column | None = None) -> Column:
    """Features by contribution, largest first; ties in the order of the list."""
    own = definition_features(x, depth, clauses)
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("feature"), r4(WEIGHTS[k] * normalised(v, k)).alias("contribution")) for i, (k, v) in enumerate(own.items())))
    order = lambda a, b: F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).otherwise(a["i"] - b["i"])
    return F.array_sort(rows, order)


def completion(pred) -> Column:
    return F.when(F.regexp_replace(_t(pred), r"(?U)\s+", "") != "", 1.0).otherwise(0.0)


def is_number(x: Column) -> Column:
    """Whether a text, commas aside, is a plain number."""
    return F.rlike(F.replace(F.trim(x), F.lit(","), F.lit("")), F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"))


def schema_compliance(pred, kind) -> Column:
    text, kind = F.trim(_t(pred)), F.lower(_t(kind))
    return (
        F.when((text == "") | F.rlike(text, F.lit(REFUSAL)), 0.0)
        .when(kind == "numeric", is_number(text).cast("double"))
        .when(kind.isin("text", "short_text", "long_text"), (F.length(text) > 2).cast("double"))
        .otherwise(1.0)
    )


def completeness(populated: Column, total: Column) -> Column:
    return r4(F.when(total <= 0, F.lit(1.0)).otherwise(F.try_divide(populated.cast("double"), total.cast("double"))))


def exec_score(complete: Column, schema: Column, filled: Column) -> Column:
    """Weighted mean of the parts that are not null."""
    parts = {"completion": complete, "schema": schema, "completeness": filled}
    top = _sum(F.coalesce(EXEC_WEIGHTS[k] * v, F.lit(0.0)) for k, v in parts.items())
    return r4(F.try_divide(top, _sum(F.when(v.isNotNull(), EXEC_WEIGHTS[k]).otherwise(0.0) for k, v in parts.items())))
