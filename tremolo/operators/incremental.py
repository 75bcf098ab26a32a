"""Sums behind accuracy, magnitude, steadiness and failure entropy, kept by group while runs are appended and seeds replaced.

All of these measures are functions of a few sums, so a table of sums by group is
enough to give them, and a batch of runs changes it by its own sums: plus those
of its rows, minus those of the rows that it replaces (the latest ones of its
runs and seeds, found in their hash buckets). Sums are decimals, so that adding
and taking away in any order gives the same as summing anew. The runs are kept by
sources.results, the sums of every batch beside them under its number; a batch
that is played again finds its entry and changes nothing.

Null keys make no group. A missing sim counts as wrong, a missing score or sim
leaves a row out of steadiness and entropy, as in aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import r4
from ..sources import results
from .aggregates import entropy_of_sums

CUTOFF, EXACT = 0.8, "decimal(38,15)"
SUMS = ("n", "hits", "n_score", "score", "n_sim", "sim", "top", "bottom", "n_failed", "failed", "failed_log")


def sums(runs: DataFrame, *by: str, cutoff: float = CUTOFF) -> DataFrame:
    """The sums of each group."""
    score, sim = F.col("score"), F.col("sim")
    both = score.isNotNull() & sim.isNotNull()
    failed = both & (F.col("level") != "L0") & (sim < cutoff)
    exact = lambda x, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(x))), F.lit(0)).cast(EXACT)
    count = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast(EXACT)
    log = F.when(score > 0, score * F.ln(F.when(score > 0, score))).otherwise(0.0)
    own = {
        "n": count(F.lit(True)),
        "hits": count(F.coalesce(sim >= cutoff, F.lit(False))),
        "n_score": count(score.isNotNull()),
        "score": exact("_score"),
        "n_sim": count(sim.isNotNull()),
        "sim": exact("_sim"),
        "top": exact("_product", both),
        "bottom": exact("_score", both),
        "n_failed": count(F.coalesce(failed, F.lit(False))),
        "failed": exact("_score", failed),
        "failed_log": exact("_log", failed),
    }
    # a number becomes a decimal once, however many sums it goes into
    decimals = {"_score": score, "_sim": sim, "_product": sim * score, "_log": F.when(failed, log)}
    rows = runs.dropna(subset=list(by)).withColumns({k: v.cast("decimal(25,15)") for k, v in decimals.items()})
    return rows.groupBy(*by).agg(*(v.alias(k) for k, v in own.items()))


def _folder(path: str) -> str:
    return f"{path}/sums"


def take(batch: DataFrame, path: str, number: int, *by: str, cutoff: float = CUTOFF) -> None:
    """Appends a batch of runs (run, source_row, level, score, sim and the keys) and its change of the sums, each once."""
    spark = batch.sparkSession
    known = [e for e in results.ledger(spark, path) if e["batch"] < number or e.get("holds")]

    def change() -> DataFrame:
        new = sums(batch, *by, cutoff=cutoff)
        if not known:
            return new
        old = results.read(spark, path, before=number, within=batch.select(*results.KEYS))
        minus = sums(old.select(batch.columns), *by, cutoff=cutoff).select(*by, *((-F.col(k)).alias(k) for k in SUMS))
        return _added(new.unionByName(minus), by)

    # the change first: it is made of what was there before the batch
    results.once(spark, _folder(path), number, change)
    results.append(batch, path, number)


def _added(rows: DataFrame, by: tuple[str, ...] | list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(k).cast(EXACT).alias(k) for k in SUMS))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The sums of all batches: a few rows of each are read, and none of the runs."""
    out = None
    for e in results.ledger(spark, _folder(path)):
        own = results.once(spark, _folder(path), e["batch"], lambda: None)
        out = own if out is None else out.unionByName(own)
    return _added(out, [c for c in out.columns if c not in SUMS]).where("n > 0")


def measures(table: DataFrame) -> DataFrame:
    """n, accuracy, magnitude, steadiness and fwe of each group of sums."""
    x = lambda k: F.col(k).cast("double")
    mean = lambda k: F.try_divide(x(k), x(f"n_{k}"))
    steady: Column = F.coalesce(F.try_divide(x("top"), F.when(F.col("bottom") > 0, x("bottom"))), mean("sim"))
    keys = [c for c in table.columns if c not in SUMS]
    return table.select(*keys, F.col("n").cast("long").alias("n"), r4(F.try_divide(x("hits"), x("n"))).alias("accuracy"), r4(mean("score")).alias("magnitude"), r4(steady).alias("steadiness"), entropy_of_sums(F.col("n_failed").cast("long"), x("failed"), x("failed_log")).alias("fwe"))
