"""Metrics of one text or of an original and its candidate, as Column expressions.

All are built-in expressions of the JVM. Those that name a value several times bind
it with let(), a higher-order function, which Spark evaluates outside generated
code; the others stay inside. Results are rounded to 4 places unless a count. Null
texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and keyword lists that define the metrics.
TOKEN = r"[a-z]+(?:'[a-z]+)?|-?\d+(?:\.\d+)?"
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
NUMBER = r"-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d+(?:\.\d+)?"
MONEY_NUMBER = r"\$?\d+(?:[.,]\d+)*"
BLOCK_MARK = r"^\s*(?:#{1,6}\s|[-*+]\s|\d+\.\s|>\s|\|)"
UNIT_WORDS = [
    "dollar", "dollars", "cent", "cents", "euro", "euros", "pound", "pounds", "percent", "percentage", "second", "seconds", "minute", "minutes",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres", "km", "kilometer",
    "kilometers", "mile", "miles", "foot", "feet", "inch", "inches", "kg", "kilogram", "kilograms", "gram", "grams", "lb", "lbs", "ounce", "ounces",
    "liter", "liters", "litre", "litres", "ml", "gallon", "gallons", "item", "items", "unit", "units", "piece", "pieces", "bolt", "bolts", "basket",
    "baskets",
]
GOALS = [
    ("find_percentage", r"\bwhat\s+percent|\bpercentage\b|\bhow\s+much\s+percent"),
    ("find_remaining", r"\bremaining\b|\bleft\b|\bleftover\b"),
    ("find_difference", r"\bhow\s+much\s+more\b|\bhow\s+many\s+more\b|\bdifference\b"),
    ("find_rate", r"\bper\s+(?:day|hour|minute|week|month|year|unit|item)\b|\brate\b|\bspeed\b"),
    ("find_average", r"\baverage\b|\bmean\b|\bper\s+person\b"),
    ("find_total", r"\btotal\b|\ball\s+together\b|\bin\s+all\b|\bcombined\b|\boverall\b"),
    ("find_count", r"\bhow\s+many\b|\bnumber\s+of\b"),
    ("find_amount", r"\bhow\s+much\b|\bcost\b|\bprice\b|\bpay\b|\bspend\b"),
]
CONFLICT_TIERS = {
    5: ["override this", "system prompt", "administrator", "root access", "jailbreak"],
    4: ["system:", "required:", "important:", "warning:", "instruction:", "you must", "must not", "do not use", "do not solve", "do not calculate", "is prohibited", "are prohibited"],
    3: ["ignore", "disregard", "skip the", "skip this", "pretend that", "pretend the", "forget the", "overlook", "instead of solving", "instead of using", "instead of calculating", "avoid solving", "avoid using"],
    2: ["add instead", "subtract instead", "multiply instead", "divide instead", "use addition instead", "use subtraction", "use multiplication instead", "use division instead", "wrong approach", "different operation", "opposite operation"],
    1: ["perhaps", "maybe try", "consider", "might want to", "alternatively", "you could try", "possibly try"],
}
AUTHORITY = ["system:", "user:", "assistant:", "administrator:", "admin:", "override", "authority", "root", "privileged"]


def _t(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: as the variable of a lambda it is not repeated wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: body(x["a"], x["b"]))


def r4(x: Column) -> Column:
    return F.round(x, 4)


def mean4(x: Column | str) -> Column:
    """Mean of a group to 4 places, summed as decimals so that the order of the rows cannot tip a last place."""
    x = F.col(x) if isinstance(x, str) else x
    return r4(F.try_divide(F.sum(x.cast("decimal(28,12)")).cast("double"), F.count(x)))


def share(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, `empty` where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those in brackets not split."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
    return [*out, pattern[start:]]


def _first_letters(pattern: str) -> set[str]:
    """The letters that a match may begin with."""
    if pattern.startswith("(?:"):
        depth = 0
        for i, ch in enumerate(pattern):
            depth += (ch == "(") - (ch == ")")
            if not depth:
                return set().union(*(_first_letters(a) for a in _alternatives(pattern[3:i])))
    if not pattern[:1].isalpha():
        raise ValueError(f"{pattern!r} does not begin with a letter")
    return {pattern[0].lower()}


def anchored(pattern: str) -> str:
    """The same pattern, of which every alternative begins with a word bound: the bound and the first letters are tested once, before the alternatives are tried one after the other."""
    every = _alternatives(pattern)
    if not all(a.startswith(r"\b") for a in every):
        raise ValueError(f"an alternative of {pattern!r} does not begin with a word bound")
    bodies = [a[2:] for a in every]
    letters = "".join(sorted(set().union(*map(_first_letters, bodies))))
    return rf"\b(?=[{letters}])(?:{'|'.join(bodies)})"


def squeeze(x) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_t(x), r"(?U)\s+", " "))


def words(x) -> Column:
    return F.filter(F.split(squeeze(x), " "), lambda w: w != "")


def word_count(x) -> Column:
    return F.size(words(x)).cast("long")


def ordered_tokens(x) -> Column:
    """Lower-case words and numbers in order; commas between digits go first."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(_t(x)), r"(\d),(\d)", "$1$2"), F.lit(TOKEN), F.lit(0))


def tokens(x) -> Column:
    return F.array_distinct(ordered_tokens(x))


def letters(x) -> Column:
    """Alphabetic words in order, case kept."""
    return F.regexp_extract_all(_t(x), F.lit(WORD), F.lit(0))


def numbers(x) -> Column:
    """Numbers without thousands commas; the first alternative takes three digits at most."""
    return F.transform(F.regexp_extract_all(_t(x), F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))


def money_numbers(x) -> Column:
    return F.regexp_extract_all(_t(x), F.lit(MONEY_NUMBER), F.lit(0))


def lexical_tokens(x) -> Column:
    """Words and numbers in order, case kept, numbers normalised."""
    found = F.regexp_extract_all(_t(x), F.lit(rf"{WORD}|{NUMBER}"), F.lit(0))
    return F.transform(found, lambda n: F.when(F.rlike(n, F.lit("^-?[0-9]")), F.replace(n, F.lit(","), F.lit(""))).otherwise(n))


def sentences(x) -> Column:
    return F.filter(F.split(squeeze(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def raw_sentences(x) -> Column:
    """As sentences(), white space inside kept."""
    return F.filter(F.split(F.trim(_t(x)), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def excess(a: Column, b: Column) -> Column:
    """How many elements of a, as a multiset, b lacks."""
    count = lambda of, y: F.size(F.filter(of, lambda z: z == y))
    return let2(a, b, lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda n, y: n + F.greatest(count(a, y) - count(b, y), F.lit(0))))


def agreeing(a: Column, b: Column) -> Column:
    """At how many places two arrays are equal."""

    def same(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)

    return let2(a, b, same)


# -- an original and its candidate ------------------------------------------------


def jaccard_tcr(o, c) -> Column:
    sizes = let2(tokens(o), tokens(c), lambda a, b: F.struct(F.size(F.array_union(a, b)).cast("double").alias("all"), F.size(F.array_intersect(a, b)).cast("double").alias("both")))
    return r4(let(sizes, lambda s: F.when(s["all"] == 0, F.lit(0.0)).otherwise(1 - F.try_divide(s["both"], s["all"]))))


def tps(o, c) -> Column:
    return r4(let2(ordered_tokens(o), ordered_tokens(c), lambda a, b: share(agreeing(a, b), F.size(a), 1.0)))


def ccr(o, c) -> Column:
    return r4(share(F.abs(F.length(_t(c)) - F.length(_t(o))), F.length(_t(o)), 0.0))


def _count(x, what: str) -> Column:
    return F.length(_t(x)) - F.length(F.replace(_t(x), F.lit(what), F.lit("")))


def line_break_ratio(o, c) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0), _count(c, "\n") - _count(o, "\n")) / F.lit(20.0))


def _lines(c) -> Column:
    return F.filter(F.split(_t(c), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != "")


def indent_variance(c) -> Column:
    depth = F.transform(_lines(c), lambda x: (F.length(x) - F.length(F.regexp_replace(x, "^[ \t]+", ""))).cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    spread = lambda d, mean: F.try_divide(total(F.transform(d, lambda x: (x - mean) * (x - mean))), F.size(d).cast("double"))
    variance = lambda d: let2(d, F.try_divide(total(d), F.size(d).cast("double")), spread)
    return let(depth, lambda d: F.when(F.size(d) < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(variance(d), F.lit(25.0)))))


def block_restructure(c) -> Column:
    mark = lambda x: F.rlike(x, F.lit(BLOCK_MARK)) | F.startswith(F.trim(x), F.lit("---")) | F.startswith(F.trim(x), F.lit("==="))
    return let(_lines(c), lambda lines: F.least(F.lit(1.0), share(F.size(F.filter(lines, mark)), F.size(lines), 0.0)))


def layout(o, c) -> Column:
    """0.4 of line_break_ratio(), 0.3 of indent_variance() and 0.3 of block_restructure(), as ten-thousandths of a fraction of whole numbers, so that a tie of the last place is told exactly."""
    mark = lambda x: F.rlike(x, F.lit(BLOCK_MARK)) | F.startswith(F.trim(x), F.lit("---")) | F.startswith(F.trim(x), F.lit("==="))
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)
    depths = lambda lines: F.transform(lines, lambda x: (F.length(x) - F.length(F.regexp_replace(x, "^[ \t]+", ""))).cast("long"))

    def sums(lines: Column) -> Column:
        marks = F.size(F.filter(lines, mark)).cast("long").alias("m")
        low = lambda d: F.transform(d, lambda x: x - F.array_min(d))
        return let(let(depths(lines), low), lambda d: F.struct(F.size(d).cast("long").alias("n"), marks, total(d).alias("s"), total(F.transform(d, lambda x: x * x)).alias("q")))

    def rounded(x: Column) -> Column:
        n, m, s, q = (x[k] for k in "nmsq")
        square = n * n
        # n^2 times the variance, beyond 25 n^2 anyway where longs might not hold it
        wide = n.cast("double") * q - s.cast("double") * s > 26.0 * n.cast("double") * n
        spread = F.when(n < 2, F.lit(0).cast("long")).when(wide, 25 * square).otherwise(F.least(n * q - s * s, 25 * square))
        tenths = 120 * spread + 3000 * m * n
        return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", 2 * tenths + square, 2 * square))

    breaks = F.least(F.lit(20), F.greatest(F.lit(0), _count(c, "\n") - _count(o, "\n")))
    return (200 * breaks + let(let(_lines(c), sums), rounded)).cast("double") / 10000.0


def dc(o, c) -> Column:
    return F.greatest(F.lit(0), F.size(sentences(c)) - F.size(sentences(o))).cast("long")


def dnd(o, c) -> Column:
    return r4(let2(numbers(o), numbers(c), lambda a, b: share(excess(b, a), F.size(a), 0.0)))


def sli(o, c) -> Column:
    def mean(x):
        total = lambda s: F.aggregate(F.transform(s, lambda y: F.size(F.split(y, r"\s+")).cast("double")), F.lit(0.0), lambda n, y: n + y)
        return F.coalesce(let(sentences(x), lambda s: F.try_divide(total(s), F.size(s).cast("double"))), F.lit(0.0))

    return r4(let2(mean(o), mean(c), lambda a, b: F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.try_divide(b - a, a)))))


def ale(o, c) -> Column:
    return r4(dc(o, c) + dnd(o, c) + sli(o, c))


def wcr(o, c) -> Column:
    return r4(let2(letters(o), letters(c), lambda a, b: share(F.least(F.size(a), F.size(b)) - agreeing(a, b), F.size(a), 0.0)))


def tis(o, c) -> Column:
    return r4(let2(letters(o), letters(c), lambda a, b: share(agreeing(a, b), F.size(a), 1.0)))


def spacing_anomaly(o, c) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0), _count(c, " ") - _count(o, " ")) / F.greatest(F.length(_t(o)), F.lit(1)))


def punct_anomaly(o, c) -> Column:
    a, b = (F.regexp_extract_all(_t(x), F.lit(r"(?U)[^\w\s]"), F.lit(0)) for x in (o, c))
    return let2(a, b, lambda a, b: F.least(F.lit(1.0), (excess(a, b) + excess(b, a)) / F.greatest(F.size(a), F.lit(1))))


def sds(o, c) -> Column:
    return r4(0.4 * spacing_anomaly(o, c) + 0.6 * punct_anomaly(o, c))


def norm_sentence(s: Column) -> Column:
    """Of a sentence of sentences(), whose white space is single spaces."""
    return F.btrim(F.lower(s), F.lit(".!?: "))


def added_sentences(o, c) -> Column:
    return let2(F.transform(sentences(o), norm_sentence), sentences(c), lambda known, own: F.filter(own, lambda s: ~F.array_contains(known, norm_sentence(s))))


def any_of(x: Column, what: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in what))


def cc(o, c) -> Column:
    every = [w for t in CONFLICT_TIERS.values() for w in t]
    return F.size(F.filter(added_sentences(o, c), lambda s: let(F.lower(s), lambda x: any_of(x, every)))).cast("long")


def ces(o, c) -> Column:
    def highest(own: Column) -> Column:
        out = F.lit(0)
        for tier in sorted(CONFLICT_TIERS):
            out = F.when(any_of(own, CONFLICT_TIERS[tier]), F.lit(tier)).otherwise(out)
        return out.cast("long")

    return let(F.concat(F.lit(" "), F.lower(F.array_join(added_sentences(o, c), " ")), F.lit(" ")), highest)


def ihd(o, c) -> Column:
    own = F.lower(F.array_join(added_sentences(o, c), " "))
    return let(own, lambda x: reduce(lambda a, b: a + b, (F.contains(x, F.lit(w)).cast("int") for w in AUTHORITY)).cast("long"))


def ctx_cer(o, c) -> Column:
    return r4(share(word_count(c), word_count(o), 1.0))


def cdp(o, c) -> Column:
    def place(a: Column, b: Column) -> Column:
        count = lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != ""))
        found = lambda at: F.when(at == 0, F.lit(1.0)).otherwise(share(count(F.substring(b, F.lit(1), at - 1)), count(b), 0.0))
        return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(let(F.position(a, b), found))

    return r4(let2(squeeze(o), squeeze(c), place))


def icv(o, c) -> Column:
    return F.greatest(F.lit(0), word_count(c) - word_count(o)).cast("long")


def len_ratio(o, c) -> Column:
    return r4(share(F.length(_t(c)), F.length(_t(o)), 0.0))


def adi(o, c) -> Column:
    return r4(ctx_cer(o, c) * cdp(o, c))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of FLOAT or DOUBLE; 0 if one is all zeros. The longer one is cut."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def units(x) -> Column:
    """Distinct unit words, lower-case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_t(x)), F.lit(rf"(?U)\b(?:{'|'.join(UNIT_WORDS)})\b"), F.lit(0)))


def goal_type(x) -> Column:
    """The first goal pattern of the last sentence, else of the whole text."""
    def first(text: Column, last: Column) -> Column:
        out = F.lit("find_unknown")
        for where in (text, last):
            found = out
            for name, pattern in reversed(GOALS):
                found = F.when(F.rlike(where, F.lit(anchored(pattern))), F.lit(name)).otherwise(found)
            # all patterns at once first: most texts have none
            out = F.when(F.rlike(where, F.lit(anchored("|".join(p for _, p in GOALS)))), found).otherwise(out)
        return out

    low = F.lower(_t(x))
    return let(low, lambda text: let2(text, F.coalesce(F.try_element_at(raw_sentences(text), F.lit(-1)), text), first))


#: Name to function of (original, candidate).
PAIR_METRICS: dict[str, Callable[..., Column]] = {
    "jaccard_tcr": jaccard_tcr,
    "tps": tps,
    "ccr": ccr,
    "lcs": layout,
    "dc": dc,
    "dnd": dnd,
    "sli": sli,
    "ale": ale,
    "wcr": wcr,
    "tis": tis,
    "sds": sds,
    "cc": cc,
    "ces": ces,
    "ihd": ihd,
    "ctx_cer": ctx_cer,
    "cdp": cdp,
    "icv": icv,
    "len_ratio": len_ratio,
    "adi": adi,
}
