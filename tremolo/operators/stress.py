"""Stress tables: survival rate by count, collapse point and depth, steepest slope, by level, category or dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import r4
from .aggregates import LEVELS, baseline, cell_accuracy, group_summary, has_stress, level_cells, stress_keys
from .curation import admitted, without_measurements

GROUPS = {"level", "category", "dimension"}


def _curve(runs: DataFrame, threshold: float, alpha: float, *by: str) -> DataFrame:
    """Accuracy over present sims at each stress level, of the baseline (one for all groups), and tau."""
    hit = (F.col("sim") >= threshold).cast("double")
    cells = level_cells(runs, hit, *by)
    base = baseline(cells, F.coalesce(cell_accuracy("L0"), F.lit(alpha)).alias("acc_base"))
    own = cells.groupBy(*by).agg(*(cell_accuracy(v).alias(v) for v in LEVELS), *stress_keys(*by)).where(has_stress(*by) if by else F.lit(True))
    # the baseline is one row
    return own.join(F.broadcast(base)).withColumn("tau", r4(alpha * F.col("acc_base")))


def _survived(accs: list[Column]) -> Column:
    return sum((F.coalesce((a >= F.col("tau")).cast("long"), F.lit(0)) for a in accs[1:]), F.coalesce((accs[0] >= F.col("tau")).cast("long"), F.lit(0)))


def survival(runs: DataFrame, group_by: str = "overall", threshold: float = 0.80, alpha: float = 0.80) -> DataFrame:
    """A row for each group: acc_base, tau, whether each level survives, how many do and their percentage."""
    if group_by not in ("overall", "category", "dimension"):
        raise ValueError(f"group_by is overall, category or dimension, not {group_by!r}")
    by = () if group_by == "overall" else (group_by,)
    curve = _curve(without_measurements(admitted(runs)), threshold, alpha, *by)
    count = _survived([F.col(v) for v in LEVELS])
    return curve.select((F.col(group_by) if by else F.lit("overall")).alias("group"), r4(F.col("acc_base")).alias("acc_base"), "tau", *((F.col(v) >= F.col("tau")).alias(v) for v in LEVELS), count.alias("sr_count"), F.round(count * 20.0, 1).alias("sr_pct"))


def level_metrics(runs: DataFrame, group_by: str, threshold: float = 0.80, alpha: float = 0.80) -> DataFrame:
    """sr_count, sr_pct, collapse point, depth of the collapse and steepest slope of each group."""
    curve = _curve(without_measurements(admitted(runs)), threshold, alpha, group_by)
    accs = [r4(F.col(v)) for v in LEVELS]
    some = F.coalesce(*accs).isNotNull()
    names = F.array(*(F.struct(F.lit(i + 1).alias("i"), a.alias("a")) for i, a in enumerate(accs)))
    out = curve.withColumn("points", F.filter(names, lambda p: p["a"].isNotNull())).withColumn("all_points", names)
    failed = F.filter("points", lambda p: p["a"] < F.col("tau"))
    out = out.withColumn("first", F.get(failed, F.lit(0)))
    before = F.coalesce(F.get(F.col("all_points.a"), F.col("first.i") - 2), F.col("acc_base"))
    values = F.concat(F.array("acc_base"), F.col("points.a"))
    slopes = F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: b - a)
    count = _survived(accs)
    return out.where(some).select(
        group_by,
        count.alias("sr_count"),
        F.round(count * 20.0, 1).alias("sr_pct"),
        F.concat(F.lit("L"), F.col("first.i").cast("string")).alias("cp"),
        r4(F.coalesce(before - F.col("first.a"), F.lit(0.0))).alias("cd"),
        r4(F.array_min(slopes)).alias("ss"),
    )


def stress_metrics(runs: DataFrame, group_by: str, threshold: float | None = None, alpha: float = 0.80) -> DataFrame:
    """Summary of each group over admitted rows, with its level metrics if a threshold is given."""
    if group_by not in GROUPS:
        raise ValueError(f"group_by is one of {sorted(GROUPS)}, not {group_by!r}")
    own = without_measurements(admitted(runs))
    summary = group_summary(own, group_by)
    if threshold is None:
        return summary
    if group_by == "level":  # a level's own curve has one point
        accs = {v: F.when(F.col("level") == v, r4(F.col("acc"))) for v in LEVELS}
        hit = (F.col("sim") >= threshold).cast("double")
        base = own.where("level = 'L0'").agg(F.coalesce(F.avg(hit), F.lit(alpha)).alias("acc_base"))
        rows = own.dropna(subset=["level"]).groupBy("level").agg(F.avg(hit).alias("acc")).where("level <> 'L0'").join(F.broadcast(base)).withColumn("tau", r4(alpha * F.col("acc_base")))
        acc = F.coalesce(*accs.values())
        fails = acc < F.col("tau")
        table = rows.where(acc.isNotNull()).select("level", F.coalesce((acc >= F.col("tau")).cast("long"), F.lit(0)).alias("sr_count"), F.round(F.coalesce((acc >= F.col("tau")).cast("long"), F.lit(0)) * 20.0, 1).alias("sr_pct"), F.when(fails, F.col("level")).alias("cp"), r4(F.when(fails, F.col("acc_base") - acc).otherwise(0.0)).alias("cd"), r4(acc - F.col("acc_base")).alias("ss"))
    else:
        table = level_metrics(runs, group_by, threshold, alpha)
    return summary.join(table, group_by, "left")
