"""Lookups of runs in seeds, criteria and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_intake(responses: DataFrame, intake: DataFrame, key: str = "source_row") -> DataFrame:
    """Responses with their intake row; a missing or unknown key takes the first intake row."""
    fields = [c for c in intake.columns if c != key]
    first = intake.agg(*(F.min_by(c, key).alias(f"_{c}") for c in fields))
    found = responses.join(intake.withColumn("_hit", F.lit(True)), key, "left")
    # the first row is one row
    return found.join(F.broadcast(first)).select(*responses.columns, *(F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in fields))


def with_criteria(runs: DataFrame, criteria: DataFrame, *keys: str, defaults: dict) -> DataFrame:
    """Runs with the criteria of their keys (a registry table of a few dozen rows), defaults where there are none."""
    return runs.join(F.broadcast(criteria), list(keys), "left").fillna(defaults)


def inject(base: DataFrame, stress: DataFrame, by: str) -> DataFrame:
    """Stress rows, and the baseline rows once for each group."""
    groups = stress.select(by).where(F.col(by).isNotNull()).distinct()
    # groups are categories or dimensions: a handful
    return stress.where(F.col(by).isNotNull()).unionByName(base.drop(by).join(F.broadcast(groups)).select(*stress.columns))


def link_source(tests: DataFrame, source: DataFrame, mode: str, key: str = "row_id", text: str = "source_text") -> DataFrame:
    """Tests with their source text: by position, by a key, or by a key with all its chunks in order."""
    if mode in ("row_order", "key_column"):
        return tests.join(source.select(key, text), key, "left")
    if mode == "multi_chunk":
        whole = source.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", text))), lambda x: x[text]).alias("_parts"))
        return tests.join(whole.select(key, F.array_join("_parts", "\n").alias(text)), key, "left")
    raise ValueError(f"linking mode is row_order, key_column or multi_chunk, not {mode!r}")


def numbered(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Rows numbered from 0 in the order of a column, without gathering them in one task."""
    from .bins import ranked

    return ranked(df, order, order, name)


def level_ranges(value: Column, bands: list[tuple[int, float, float]]) -> Column:
    """Range join of a value with bands (level, low, high; may overlap): the lowest level whose band holds it.

    Bands are a few dozen settings, so they are an array in the expression and no join is needed.
    """
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in bands))
    return F.array_min(F.transform(F.filter(table, lambda b: (value >= b["lo"]) & (value < b["hi"])), lambda b: b["n"]))
