"""Validity gates: each gives STRUCT<passed, reason>, the reason being the first failing check.

Verdicts of models (entailment scores, judges) are columns of the input. No gate
needs a Python function but the last check of the format gate, see format_gate().
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import decision, levels
from ..functions import text as T

# Verbs, patterns and bands of the gates.
TASK_VERBS = "extract list identify find locate restate rewrite paraphrase rephrase summarize summarise condense compress combine compare synthesize synthesise relate describe explain abstract interpret provide give state".split()
DECISION_VERBS = "approve reject select assign choose recommend determine decide rank classify evaluate route escalate allocate eligible qualify accept deny grant prioritize compare".split()
RULE_PATTERN = r"(?is)rule\s*\d|if\b.{2,50}then\b|when\b.{2,50},|criteria|condition\s*\d|requirement|must\b"
STRUCT_BANDS = [(0.0, 0.16), (0.16, 0.32), (0.32, 0.52), (0.52, 0.76), (0.76, 1.01)]
#: Families whose meaning is left to the judge.
JUDGED_ONLY = {"distractor", "context", "conflict", "kb"}
#: Marks that a format candidate of level 1 may not add.
FORBIDDEN = {"L1": ["#", "-", ">", "*", "|", "`"]}


def verdict(*checks: tuple[Column, str]) -> Column:
    """The struct of checks (what must hold, reason if not), in order; an unknown check holds."""
    reason = F.lit("")
    for ok, why in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(True)), why).otherwise(reason)
    return T.let(reason, lambda r: F.struct((r == "").alias("passed"), r.alias("reason")))


def meaning(family: str, entailment: Column | None = None, contradiction: Column | None = None, judge: Column | None = None, least: float = 0.0, most: float = 1.0) -> list[tuple[Column, str]]:
    """Checks of injected verdicts; absent ones and judges' errors pass."""
    checks = []
    if contradiction is not None and family not in JUDGED_ONLY:
        checks.append((contradiction <= most, "contradiction"))
    if entailment is not None and family not in JUDGED_ONLY:
        checks.append((entailment >= least, "entailment"))
    if judge is not None:
        checks.append((judge, "judge"))
    return checks


def _filled(o, c) -> list[tuple[Column, str]]:
    filled = lambda x: F.rlike(T._t(x), F.lit(r"(?U)\S"))
    return [(filled(o), "original is empty"), (filled(c), "candidate is empty")]


def _same_bag(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def _within(a: Column, b: Column) -> Column:
    """Every element of a, as a multiset, is in b."""
    return T.excess(a, b) == 0


def _goal_kept(o, c) -> Column:
    return T.let(T.goal_type(o), lambda goal: (goal == "find_unknown") | (T.goal_type(c) == goal))


def format_gate(o, c, unchanged: Column | None = None, **verdicts) -> Column:
    """Words, numbers and their order are kept. `unchanged`: that no letter or digit is in a difflib edit (see difflib_udf)."""
    checks = [*_filled(o, c), (T.lexical_tokens(o) == T.lexical_tokens(c), "tokens changed"), (_same_bag(T.numbers(o), T.numbers(c)), "numbers changed")]
    if unchanged is not None:
        checks.append((unchanged, "alphanumeric character changed"))
    return verdict(*checks, *meaning("format", **verdicts))


def paraphrase_gate(o, c, most_added: int = 1, ratio: float = 1.3, **verdicts) -> Column:
    return verdict(
        *_filled(o, c),
        (_same_bag(T.numbers(o), T.numbers(c)), "numbers changed"),
        (T.word_count(c) <= ratio * T.word_count(o), "too long"),
        (F.abs(F.size(T.sentences(c)) - F.size(T.sentences(o))) <= most_added, "sentence count changed"),
        (_goal_kept(o, c), "goal changed"),
        *meaning("paraphrase", **verdicts),
    )


def distractor_gate(o, c, **verdicts) -> Column:
    return verdict(
        *_filled(o, c),
        (_within(T.numbers(o), T.numbers(c)), "numbers lost"),
        (_goal_kept(o, c), "goal changed"),
        (F.size(T.sentences(c)) > F.size(T.sentences(o)), "no sentence added"),
        *meaning("distractor", **verdicts),
    )


def noise_gate(o, c, **verdicts) -> Column:
    return verdict(*_filled(o, c), (_same_bag(T.numbers(o), T.numbers(c)), "numbers changed"), (F.size(T.letters(o)) == F.size(T.letters(c)), "word count changed"), *meaning("noise", **verdicts))


def conflict_gate(o, c, **verdicts) -> Column:
    return verdict(
        *_filled(o, c),
        (_within(T.numbers(o), T.numbers(c)), "numbers lost"),
        (_within(T.lexical_tokens(o), T.lexical_tokens(c)), "tokens lost"),
        (T.cc(o, c) >= 1, "no conflict added"),
        *meaning("conflict", **verdicts),
    )


def context_gate(o, c, **verdicts) -> Column:
    return verdict(
        *_filled(o, c),
        (_within(T.numbers(o), T.numbers(c)), "numbers lost"),
        (F.contains(T.squeeze(c), T.squeeze(o)), "original not verbatim"),
        (T.ctx_cer(o, c) > 1, "not longer"),
        *meaning("context", **verdicts),
    )


def task_gate(c, contradicts: Column | None = None) -> Column:
    """A restated task: long enough, with an action verb."""
    verbs = F.array(*(F.lit(v) for v in TASK_VERBS))
    return verdict((F.length(T._t(c)) >= 30, "too short"), (F.arrays_overlap(T.words(F.lower(T._t(c))), verbs), "no action verb"), *([(~contradicts, "contradiction")] if contradicts is not None else []))


def enrichment_gate(o, c, contradicts: Column | None = None) -> Column:
    return verdict((F.length(T._t(c)) > F.length(T._t(o)), "not longer"), *([(~contradicts, "contradiction")] if contradicts is not None else []))


def decision_gate(c) -> Column:
    verbs = F.array(*(F.lit(v) for v in DECISION_VERBS))
    return verdict((F.contains(T._t(c), F.lit("?")), "no question"), (F.rlike(T._t(c), F.lit(RULE_PATTERN)), "no rule"), (F.arrays_overlap(F.regexp_extract_all(F.lower(T._t(c)), F.lit("[a-z]+"), F.lit(0)), verbs), "no action verb"))


def _in_band(value: Column, level: Column) -> Column:
    def within(x: Column) -> Column:
        out = F.lit(False)
        for i, (lo, hi) in enumerate(STRUCT_BANDS):
            out = F.when(level == f"L{i + 1}", (x >= lo) & (x < hi)).otherwise(out)
        return out

    return T.let(value, within)


def decision_level_gate(c, level: Column) -> Column:
    return verdict((_in_band(decision.struct_score(c), level), "score outside the band"))


def definition_level_gate(c, level: Column) -> Column:
    return verdict((_in_band(decision.definition_score(c), level), "score outside the band"))


def structural(o, c, rules: dict[str, dict], primary: tuple[Column, Column] | None = None, added: Column | None = None, new_numbers: int | None = None) -> Column:
    """All failures of the enabled rules: STRUCT<passed, failures>.

    primary: original and candidate of the first field; added: the text that a
    distractor adds; new_numbers: how many numbers it should have.
    """
    on = lambda *names: any(rules.get(n, {}).get("enabled") for n in names)
    low = lambda x: F.lower(T._t(x))
    pure = lambda x: F.regexp_extract_all(low(x), F.lit(r"(?U)\w+"), F.lit(0))
    fails: list[Column] = []

    def rule(ok: Column, name: str) -> None:
        fails.append(F.when(~ok, F.lit(name)))

    if on("preserve_numbers"):
        rule(_within(T.money_numbers(o), T.money_numbers(c)), "preserve_numbers")
    if on("preserve_word_count", "no_word_additions_or_deletions"):
        rule(T.word_count(o) == T.word_count(c), "preserve_word_count")
    if on("same_sentence_count"):
        rule(F.size(T.raw_sentences(o)) == F.size(T.raw_sentences(c)), "same_sentence_count")
    if on("preserve_words_exact"):
        rule(T.words(low(o)) == T.words(low(c)), "preserve_words_exact")
    if on("preserve_word_order", "no_word_reordering"):
        a = pure(o)
        rule(F.aggregate(pure(c), F.lit(0), lambda i, w: F.when((i < F.size(a)) & (F.get(a, i) == w), i + 1).otherwise(i)) == F.size(a), "preserve_word_order")
    if on("no_extra_words"):
        rule(pure(o) == pure(c), "no_extra_words")
    if on("max_length_ratio"):
        rule(F.length(T._t(c)) / F.greatest(F.length(T._t(o)), F.lit(1)) <= rules["max_length_ratio"].get("max_ratio", 10), "max_length_ratio")
    if on("preserve_original_question"):
        rule(F.contains(low(c), F.trim(low(o))), "preserve_original_question")
    if on("preserve_original_question_verbatim"):
        a, b = primary or (T._t(o), T._t(c))
        rule(F.contains(b, F.trim(a)), "preserve_original_question_verbatim")
    if on("no_new_numbers") and added is not None and new_numbers == 0:
        rule(F.size(T.money_numbers(added)) == 0, "no_new_numbers")
    if on("no_number_reuse") and added is not None and (new_numbers or 0) > 0:
        rule(~F.arrays_overlap(T.money_numbers(added), T.money_numbers(o)), "no_number_reuse")
    failures = F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")
    return F.struct((F.size(failures) == 0).alias("passed"), F.array_join(failures, "; ").alias("failures"))


def changed(o, c) -> Column:
    """The gate before all others: the candidate is not the original."""
    return F.trim(T._t(o)) != F.trim(T._t(c))


def entails(label: Column, allowed: list[str]) -> Column:
    """Whether the first label that a model's reply names is an allowed one."""
    text = F.lower(F.trim(T._t(label)))
    found = text
    for name in ("contradiction", "neutral", "entailment"):
        found = F.when(F.contains(text, F.lit(name)), name).otherwise(found)
    return found.isin([a.lower() for a in allowed])


def forbidden(o, c, level: Column, family: Column) -> Column:
    """STRUCT<level, passed>: marks that the level forbids and the candidate adds make a format text of level 1 one of level 2, others fail."""
    added = F.lit(False)
    for name, marks in FORBIDDEN.items():
        some = [F.contains(T._t(c), F.lit(m)) & ~F.contains(T._t(o), F.lit(m)) for m in marks]
        new = some[0]
        for x in some[1:]:
            new = new | x
        added = F.when(level == name, new).otherwise(added)
    lifted = (family == "F") & (level == "L1") & added
    return F.struct(F.when(lifted, "L2").otherwise(level).alias("level"), (~added | lifted).alias("passed"))


def final(structural_ok: Column, entailment_ok: Column, meaning_ok: Column) -> Column:
    return F.coalesce(structural_ok, F.lit(False)) & F.coalesce(entailment_ok, F.lit(True)) & F.coalesce(meaning_ok, F.lit(True))


def paraphrase_delta(o, c, level: Column, deltas: dict[str, int], ratio: float = 1.3) -> Column:
    """Sentence delta allowed at the level, and length."""
    most = F.lit(99)
    for name, n in deltas.items():
        most = F.when(level == name, n).otherwise(most)
    return (F.abs(F.size(T.sentences(c)) - F.size(T.sentences(o))) <= most) & (T.word_count(c) <= ratio * T.word_count(o))


def classified(family: Column, tcr: Column, ces: Column, target: Column) -> Column:
    """The level that the text has: by conflict tier, by change rate, or the target itself."""
    return F.when(family == "CIS", levels.cut_level(levels.ces_norm(ces), levels.CES_CUTS)).when(family == "KB", target).otherwise(levels.tcr_level_of(tcr, family))
