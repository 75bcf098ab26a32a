"""Row selection, normalisation and small derivations over runs.

Runs have the columns source_row, category, dimension, model, level, score, sim,
gate, run_status, test_type. Missing numbers are NULL, never NaN: see clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_int
from ..functions.text import _t, squeeze

#: Categories and their family tags.
FAMILY_TAGS = {
    "Semantic Variation": "SV",
    "Input Quality": "IQ",
    "Structural/Format": "F",
    "Context Interference": "CI",
    "Context Load": "CL",
    "Conflict Instruction Stress": "CIS",
    "Knowledge Boundary": "KB",
}
CUTOFF = 0.80
BASELINE = "Temporal Consistency"
#: The same subject acquires something, for a price, and the text does not set it aside.
SAME_SUBJECT = r"(?i)\b(she|he|they|also)\b[^.]{0,45}\b(bought|paid|picked up|purchas|spent|acquir|got)\b"
SET_ASIDE = r"(?i)\b(if|imagine|instead|would not|does not apply|hypothetical|a friend|different (bakery|store|person)|yesterday|last week)\b"
PRICE = r"\$\s*\d"


def clean(df: DataFrame, *numbers: str) -> DataFrame:
    """NaN as NULL."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})


def admitted(runs: DataFrame) -> DataFrame:
    return runs.where("gate")


def without_measurements(runs: DataFrame) -> DataFrame:
    """Rows of no type stay."""
    return runs.where(~F.col("test_type").eqNullSafe("measurement"))


def is_baseline(category: str = "category", level: str = "level") -> Column:
    return (F.col(level) == "L0") | (F.col(category) == BASELINE)


def split_baseline(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stress rows, baseline rows)."""
    base = F.coalesce(is_baseline(), F.lit(False))
    return runs.where(~base), runs.where(base)


def correct(sim: Column, cutoff: float = CUTOFF) -> Column:
    """Whether a sim meets the cutoff; a missing one does not."""
    return F.coalesce(sim >= cutoff, F.lit(False))


def risk(score: Column, sim: Column) -> Column:
    return score * (1 - sim)


def family_tag(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tag in FAMILY_TAGS.items():
        out = F.when(category == name, tag).otherwise(out)
    return out


def select_rows(df: DataFrame, mode: str = "all", n: int | None = None, ids: list[int] | None = None, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Rows by mode: all, first_n (by key), random_n (by a hash of key and seed) or indices (values of key)."""
    if mode == "all":
        return df
    if mode == "first_n":
        return df.orderBy(key).limit(n) if n is not None else df
    if mode == "random_n":
        return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n) if n is not None else df
    if mode == "indices":
        if not ids:
            raise ValueError("row mode 'indices' needs ids")
        if min(ids) < 0:
            raise ValueError(f"ids below 0: {sorted(i for i in ids if i < 0)}")
        found = df.where(F.col(key).isin(ids))
        if (got := found.select(key).distinct().count()) < len(set(ids)):
            raise ValueError(f"{len(set(ids)) - got} of the ids are not in the table")
        return found
    raise ValueError(f"unknown row mode {mode!r}")


def joined_fields(*fields: str) -> Column:
    """The fields that say something, in order, joined by a space."""
    kept = F.filter(F.array(*(F.trim(F.col(f).cast("string")) for f in fields)), lambda x: x.isNotNull() & ~F.lower(x).isin("", "nan", "none"))
    return F.array_join(kept, " ")


def parse_field(text: Column, field: str, others: list[str], default: Column | None = None) -> Column:
    """What follows `[field]` up to the label of the next of the other fields; default if missing or blank."""
    label = F.lit(f"[{field}]")
    at = F.position(label, _t(text))
    rest = F.substring(_t(text), at + F.length(label), F.length(_t(text)))
    for other in others:
        stop = F.position(F.lit(f"[{other}]"), rest)
        rest = F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)
    value = F.when(at == 0, F.lit("")).otherwise(F.regexp_replace(rest, r"(?U)^\s+|\s+$", ""))
    return value if default is None else F.when(value == "", default).otherwise(value)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def prediction_text(preds: list[Column], raw: Column) -> Column:
    """All predictions that are filled, joined by a bar; else the raw response."""
    kept = F.array_compact(F.array(*(F.nullif(F.trim(p.cast("string")), F.lit("")) for p in preds)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " | ")).otherwise(F.coalesce(F.trim(raw), F.lit("")))


def ambiguous(original: Column, candidate: Column) -> Column:
    """Whether the text that a distractor adds has the same subject buy something at a price, without setting that aside."""
    plain = lambda x: squeeze(F.replace(_t(x), F.lit("[QUESTION]"), F.lit("")))
    added = F.replace(plain(candidate), plain(original), F.lit(""))
    has = lambda p: F.rlike(added, F.lit(p))
    return has(SAME_SUBJECT) & has(PRICE) & ~has(SET_ASIDE)


def drop_ambiguous(pairs: DataFrame, category: str = "Context Interference") -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows dropped) of pairs with category, o and c."""
    bad = F.coalesce((F.col("category") == category) & ambiguous(F.col("o"), F.col("c")), F.lit(False))
    return pairs.where(~bad), pairs.where(bad)


def until_accepted(attempts: DataFrame) -> DataFrame:
    """Attempts of each cell up to the first one that passes both gates."""
    from pyspark.sql import Window

    cell = Window.partitionBy("source_row", "category", "target_level")
    first = F.min(F.when(F.col("gate") & F.col("level_gate"), F.col("attempt"))).over(cell)
    return attempts.withColumn("_first", first).where("_first IS NULL OR attempt <= _first").drop("_first")


def undone(seeds: DataFrame, done: DataFrame, key: str = "source_row") -> DataFrame:
    """Seeds that have no result yet."""
    return seeds.join(done.select(key).distinct(), key, "left_anti")


def order_by_level(df: DataFrame, column: str = "level") -> DataFrame:
    return df.orderBy(level_int(F.col(column)), column)
