"""Accuracy, steadiness and failure entropy of runs, as mergeable aggregates.

Every measure is a ratio of sums over one pass, so partial aggregation applies
before the shuffle and any number of groupings come from one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import level_int
from ..functions.text import r4
from .curation import CUTOFF, correct

LEVELS = ["L1", "L2", "L3", "L4", "L5"]
COLLAPSE = 0.80
EPSILON = 1e-6


def accuracy(sim: str = "sim", cutoff: float = CUTOFF, missing: str = "incorrect") -> Column:
    """Share of sims at the cutoff or above; missing ones count as incorrect, or are dropped."""
    if missing not in ("incorrect", "drop"):
        raise ValueError(f"missing is 'incorrect' or 'drop', not {missing!r}")
    hit = correct(F.col(sim), cutoff) if missing == "incorrect" else F.col(sim) >= cutoff
    return F.avg(hit.cast("double"))


def steadiness(sim: str = "sim", score: str = "score") -> Column:
    """Mean sim weighted by magnitude over rows that have both; the plain mean if no weight is left."""
    both = F.col(sim).isNotNull() & F.col(score).isNotNull()
    top = F.sum(F.when(both, F.col(sim) * F.col(score)))
    bottom = F.sum(F.when(both, F.col(score)))
    return F.coalesce(F.try_divide(top, F.when(bottom > 0, bottom)), F.avg(sim))


def p_score(sim: str = "sim", score: str = "score", stress: Column | None = None) -> Column:
    """Steadiness over rows of a positive magnitude (and under stress); the plain mean of all rows if there are none."""
    own = (F.col(score) > 0) & F.col(sim).isNotNull()
    own = own & stress if stress is not None else own
    return r4(F.coalesce(F.try_divide(F.sum(F.when(own, F.col(sim) * F.col(score))), F.sum(F.when(own, F.col(score)))), F.avg(sim)))


def entropy_weight(failed: Column, score: Column) -> Column:
    """1 less half the normalised entropy of failed scores; 0.5 without failures or scores.

    In one pass: with T the sum and S the sum of s ln s, the entropy of s / T is ln T - S / T.
    """
    return entropy_of_sums(F.sum(failed.cast("long")), F.sum(F.when(failed, score)), F.sum(F.when(failed & (score > 0), score * F.ln(score))))


def entropy_of_sums(n: Column, total: Column, logs: Column) -> Column:
    """entropy_weight() of n failures with sum T and sum S of s ln s."""
    entropy = F.ln(F.when(total > 0, total)) - F.try_divide(F.coalesce(logs, F.lit(0.0)), F.when(total > 0, total))
    share = F.when(n > 1, entropy / F.ln(F.when(n > 1, n.cast("double")))).otherwise(0.0)
    return F.round(F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.5)).when(F.coalesce(total, F.lit(0.0)) <= 0, F.lit(0.5)).otherwise(1 - 0.5 * share), 6)


def fwe(runs: DataFrame, *by: str, threshold: float = CUTOFF) -> DataFrame:
    """Failure entropy of stress rows that have score and sim; 0.5 where a group has none."""
    valid = (F.col("level") != "L0") & F.col("score").isNotNull() & F.col("sim").isNotNull()
    own = F.coalesce(valid & (F.col("sim") < threshold), F.lit(False))
    return _keyed(runs, by).groupBy(*by).agg(entropy_weight(own, F.col("score")).alias("fwe"))


def _keyed(runs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Null keys make no group."""
    return runs.dropna(subset=list(by)) if by else runs


def level_cells(runs: DataFrame, hit: Column, *by: str) -> DataFrame:
    """Sums of hits and of rows with a hit or miss for each group and level.

    Groups' curves and the baseline of all groups both come from these few rows: neither
    filters on keys, so one scan and one exchange serve both.
    """
    return runs.groupBy(*by, "level").agg(F.sum(hit.cast("long")).alias("hits"), F.count(hit).alias("n"), F.count("*").alias("rows"))


def baseline(cells: DataFrame, value: Column) -> DataFrame:
    """One row. It names every column of the cells, so that both uses of them have the same plan up to the exchange."""
    return cells.agg(value, F.coalesce(F.sum("rows"), F.lit(0)).alias("_rows")).where("_rows >= 0").drop("_rows")


def cell_accuracy(level: str) -> Column:
    own = F.col("level") == level
    return F.try_divide(F.sum(F.when(own, F.col("hits"))).cast("double"), F.sum(F.when(own, F.col("n"))).cast("double"))


def stress_keys(*by: str) -> list[Column]:
    return [F.sum(F.when(F.col("level") != "L0", F.col("rows"))).alias("_stress"), *(F.count(k).alias(f"_{k}") for k in by)]


def has_stress(*by: str) -> Column:
    """Groups with stress rows and without null keys, told by aggregates, which are not pushed below the exchange."""
    out = F.col("_stress") > 0
    for k in by:
        out = out & (F.col(f"_{k}") > 0)
    return out


def level_accuracy(runs: DataFrame, *by: str, cutoff: float = CUTOFF) -> DataFrame:
    """A row for each group: accuracy at L1 to L5, at the baseline, tau and the collapse point."""
    hit = correct(F.col("sim"), cutoff)
    cells = level_cells(runs, hit, *by)
    base = baseline(cells, r4(cell_accuracy("L0")).alias("L0"))
    table = cells.groupBy(*by).agg(*(r4(cell_accuracy(v)).alias(v) for v in LEVELS), *stress_keys(*by)).where(has_stress(*by))
    # the baseline is one row
    return table.join(F.broadcast(base)).select(*by, "L0", *LEVELS, r4(COLLAPSE * F.col("L0")).alias("tau"), collapse_point(COLLAPSE * F.col("L0")).alias("cp"))


def collapse_point(tau: Column) -> Column:
    """The first level whose accuracy is below tau."""
    return F.coalesce(*(F.when(F.col(v) < tau, v) for v in LEVELS))


def steadiness_curve(runs: DataFrame, *by: str) -> DataFrame:
    """Steadiness of each group and level; at L0 the mean sim of the baseline."""
    stress = _keyed(runs.where("level <> 'L0'"), (*by, "level")).groupBy(*by, "level").agg(r4(steadiness()).alias("steadiness"))
    base = _keyed(runs.where("level = 'L0'"), by).groupBy(*by, "level").agg(r4(F.avg("sim")).alias("steadiness"))
    return base.unionByName(stress)


def cross_model(runs: DataFrame, models: list[str]) -> DataFrame:
    """Steadiness of each category and model, with a row of baselines; three places."""
    of = lambda m, x: F.round(x, 3).alias(m)
    only = lambda m: runs_if(F.col("model") == m)

    def runs_if(is_model: Column) -> Column:
        sim, score = F.when(is_model, F.col("sim")), F.when(is_model, F.col("score"))
        both = sim.isNotNull() & score.isNotNull()
        bottom = F.sum(F.when(both, score))
        return F.coalesce(F.try_divide(F.sum(F.when(both, sim * score)), F.when(bottom > 0, bottom)), F.avg(sim))

    stress = runs.where("level <> 'L0' AND category IS NOT NULL").groupBy("category").agg(*(of(m, only(m)) for m in models))
    base = runs.where("level = 'L0'").agg(*(of(m, F.avg(F.when(F.col("model") == m, F.col("sim")))) for m in models)).select(F.lit("Baseline").alias("category"), *models)
    return base.unionByName(stress)


def group_summary(runs: DataFrame, *by: str) -> DataFrame:
    """n, mean score, mean sim, mean risk and P of each group."""
    return _keyed(runs, by).groupBy(*by).agg(
        F.count("*").alias("n"),
        r4(F.avg("score")).alias("mean_score"),
        r4(F.avg("sim")).alias("mean_steadiness"),
        r4(F.avg(F.col("score") * (1 - F.col("sim")))).alias("mean_risk"),
        p_score().alias("p_score"),
    )


def summaries(runs: DataFrame) -> DataFrame:
    """group_summary() by level, category and dimension and over all, from one scan."""
    keys = ["level", "category", "dimension"]
    sets = runs.groupingSets([*([F.col(k)] for k in keys), []], *(F.col(k) for k in keys))
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), r4(F.avg("score")).alias("mean_score"), r4(F.avg("sim")).alias("mean_steadiness"), p_score(stress=F.lit(True)).alias("p_score"))
    scheme = F.when(F.col("g") == 3, "level").when(F.col("g") == 5, "category").when(F.col("g") == 6, "dimension").otherwise("all")
    return out.select(scheme.alias("scheme"), F.coalesce("level", "category", "dimension", F.lit("all")).alias("name"), "n", "mean_score", "mean_steadiness", "p_score")


def p_scores(runs: DataFrame, *by: str) -> DataFrame:
    """P of each group; groups without a sim are left out."""
    return _keyed(runs, by).groupBy(*by).agg(p_score(stress=F.col("level") != "L0").alias("p_score")).where("p_score IS NOT NULL")


def group_scores(runs: DataFrame, *by: str, threshold: float = CUTOFF) -> DataFrame:
    """n, mean sim, P and failure entropy of each group, from one scan."""
    stress = F.col("level") != "L0"
    failed = F.coalesce(stress & F.col("score").isNotNull() & F.col("sim").isNotNull() & (F.col("sim") < threshold), F.lit(False))
    return _keyed(runs, by).groupBy(*by).agg(F.count("*").alias("n"), r4(F.avg("sim")).alias("mean_sim"), p_score(stress=stress).alias("p_score"), entropy_weight(failed, F.col("score")).alias("fwe"))


def composite(groups: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Primary (mean) and harmonic composite of p_score weighted by fwe, over groups that have both."""
    both = groups.where("p_score IS NOT NULL AND fwe IS NOT NULL").agg(F.sum("fwe").alias("w"), F.sum(F.col("fwe") * F.col("p_score")).alias("wp"), F.sum(F.col("fwe") / (F.col("p_score") + epsilon)).alias("h"))
    w = F.when(F.col("w") > 0, F.col("w"))
    return both.select(r4(F.try_divide("wp", w)).alias("p_primary"), r4(F.try_divide(w, F.when(F.col("h") > 0, F.col("h")))).alias("p_harmonic"))


def level_summary(runs: DataFrame, threshold: float = CUTOFF) -> DataFrame:
    """n, mean sim and pass rate of each level."""
    return _keyed(runs, ("level",)).groupBy("level").agg(F.count("*").alias("n"), r4(F.avg("sim")).alias("mean_sim"), r4(accuracy(cutoff=threshold, missing="drop")).alias("pass_rate"))


def threshold(runs: DataFrame, strategy: str = "fixed", fixed: float = CUTOFF) -> DataFrame:
    """One row: the fixed threshold, or the mean sim at L0 if there is one."""
    if strategy not in ("fixed", "baseline"):
        raise ValueError(f"strategy is 'fixed' or 'baseline', not {strategy!r}")
    value = F.avg(F.when(F.col("level") == "L0", F.col("sim"))) if strategy == "baseline" else F.lit(None).cast("double")
    return runs.agg(F.coalesce(value, F.lit(fixed)).alias("threshold"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Of each level: rows, ok rows, mean and 95th percentile (interpolated) of the latency."""
    return _keyed(runs, ("level",)).groupBy("level").agg(
        F.count("*").alias("n"),
        F.sum((F.col("run_status") == "ok").cast("long")).alias("n_ok"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency"),
        F.round(F.percentile("latency_ms", F.lit(0.95)), 2).alias("p95_latency"),
    )


def admission(runs: DataFrame) -> DataFrame:
    """Gate pass rate and admitted tests of each category and level."""
    return runs.groupBy("category", "level").agg(F.count("*").alias("n"), F.sum(F.col("gate").cast("long")).alias("admitted"), r4(F.avg(F.col("gate").cast("double"))).alias("pass_rate"))


def mean_magnitude(runs: DataFrame) -> DataFrame:
    return runs.where("gate AND level <> 'L0'").groupBy("category").agg(r4(F.avg("score")).alias("mean_magnitude"))


def coverage(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("source_row").alias("seeds"))


def quadrants(runs: DataFrame, *by: str) -> DataFrame:
    """Means and sample deviations of score and sim, and the quadrant by the mean of the groups' mean scores and the cutoff."""
    own = runs.where("score IS NOT NULL AND sim IS NOT NULL").dropna(subset=list(by)).groupBy(*by).agg(
        F.avg("score").alias("mx"), F.avg("sim").alias("my"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sx"), F.coalesce(F.stddev_samp("sim"), F.lit(0.0)).alias("sy")
    )
    middle = own.agg(F.avg("mx").alias("mid"))
    strong, heavy = F.col("my") >= CUTOFF, F.col("mx") >= F.col("mid")
    label = F.when(strong & heavy, "robust").when(strong, "stable").when(heavy, "stressed").otherwise("fragile")
    # the middle is one row
    return own.join(F.broadcast(middle)).select(*by, r4(F.col("mx")).alias("mean_x"), r4(F.col("my")).alias("mean_y"), r4(F.col("sx")).alias("std_x"), r4(F.col("sy")).alias("std_y"), label.alias("quadrant"))


def by_rule(df: DataFrame, rule: str, value: str, *by: str, weight: str | None = None) -> DataFrame:
    """Aggregation rules of metric definitions: mean, weighted_mean, worst_k (mean of the three lowest), percentile, auc.

    worst_k ranks rows in a window, so no group is collected; auc is the area under the
    mean by level, by trapezoids.
    """
    if rule == "weighted_mean":
        return df.groupBy(*by).agg(r4(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))).alias(rule))
    if rule == "worst_k":
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
        return df.where(F.col(value).isNotNull()).withColumn("_rank", rank).where("_rank <= 3").groupBy(*by).agg(r4(F.avg(value)).alias(rule))
    if rule == "auc":
        points = df.groupBy(*by, level_int(F.col("level")).alias("_level")).agg(F.avg(value).alias("_y"))
        after = Window.partitionBy(*by).orderBy("_level")
        return points.withColumn("_area", (F.col("_y") + F.lead("_y").over(after)) / 2 * (F.lead("_level").over(after) - F.col("_level"))).groupBy(*by).agg(r4(F.sum("_area")).alias(rule))
    if rule in ("mean", "percentile"):
        return df.groupBy(*by).agg(r4(F.avg(value) if rule == "mean" else F.percentile(value, F.lit(0.95))).alias(rule))
    raise ValueError(f"unknown aggregation rule {rule!r}")
