"""Matching-block similarity of two texts, which no built-in expression has: see matching_blocks for how it is found.

Two measures, each an Arrow call over batches of pairs: the ratio of the
lower-cased texts with the heuristic for popular characters; and without it the
edit count, and whether the edits leave letters and digits alone. Equal pairs are
settled without a search, pairs that repeat within an Arrow batch are searched
once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from . import matching_blocks


def searched(pairs: list[tuple[str, str]], of_equal, measure: Callable[[list], list]) -> list:
    """measure() of every pair; of_equal for pairs of equal texts."""
    known = {p: of_equal for p in pairs if p[0] == p[1]}
    fresh = list(dict.fromkeys(p for p in pairs if p[0] != p[1]))
    for lo, hi in matching_blocks.batches(fresh):
        known.update(zip(fresh[lo:hi], measure(fresh[lo:hi])))
    return [known[p] for p in pairs]


def _ratios(pairs: list[tuple[str, str]]) -> list[float]:
    return matching_blocks.ratios(pairs).tolist()


def _edits(pairs: list[tuple[str, str]]) -> list[tuple[int, bool]]:
    return list(zip(*(x.tolist() for x in matching_blocks.edits(pairs))))


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The ratio of the lower-cased texts."""
    for o, c in pairs:
        yield pd.Series(searched(list(zip(o.fillna(""), c.fillna(""))), 1.0, _ratios), dtype="float64")


@F.pandas_udf(StructType([StructField("edits", LongType()), StructField("unchanged", BooleanType())]))
def edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """STRUCT<edits, unchanged>: edited characters, and that no letter or digit is edited."""
    for o, c in pairs:
        yield pd.DataFrame(searched(list(zip(o.fillna(""), c.fillna(""))), (0, True), _edits), columns=["edits", "unchanged"])


def difflib(o, c) -> Column:
    """STRUCT<ratio, edits, unchanged>."""
    e = edits(o, c)
    return F.struct(ratio(o, c).alias("ratio"), e["edits"].alias("edits"), e["unchanged"].alias("unchanged"))


def dealt(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs in all shuffle partitions: they take long for their bytes, by which partitions would be merged."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def similarity(d: Column) -> Column:
    return F.round(d["ratio"], 4)


def change_rate(d: Column) -> Column:
    return F.round(1 - d["ratio"], 4)


def edit_rate(d: Column, o: Column) -> Column:
    """Edited characters for each of the original; may exceed 1."""
    n = F.length(F.coalesce(o, F.lit("")))
    return F.round(F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(d["edits"].cast("double"), n)), 4)
