"""Meta-metrics of an accuracy curve over K levels (robustness, slopes, oscillation).

Records are aggregated to K bins a group; the rest works on arrays of K numbers
in one row, without further shuffles. A level without runs is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_int
from ..functions.text import r4


@dataclass(frozen=True)
class MetaConfig:
    """Settings of the meta-metrics; the values are fixed ones."""

    k: int = 6
    fallback: float = 0.80
    alpha_tau: float = 0.80
    slope_floor: float = -1.0
    drop: float = 0.10
    gap: float = 0.30

    @property
    def top(self) -> int:
        return self.k - 1


def records(runs: DataFrame, threshold: float) -> DataFrame:
    """Runs with level_no, perturbation and match: failed runs and missing sims do not match, bad levels go."""
    match = (F.coalesce(F.col("run_status"), F.lit("ok")) == "ok") & F.coalesce(F.col("sim") >= threshold, F.lit(False))
    return runs.withColumns({"level_no": level_int(F.col("level")), "perturbation": F.coalesce("score", F.lit(0.0)), "match": match}).where("level_no >= 0")


def with_baseline(rows: DataFrame, *by: str) -> DataFrame:
    """(groups' own sums by level) and the baseline's sums, which every group shares; aggregated before they meet."""
    cell = [F.count("*").alias("n"), F.sum(F.col("match").cast("long")).alias("hits"), F.min("perturbation").alias("edge")]
    cells = rows.groupBy(*by, "level_no").agg(*cell, *(F.count(k).alias(f"_{k}") for k in by))
    at = F.col("level_no") == 0
    # names every column of the cells, so that both uses of them have one plan up to the exchange
    every = sum((F.sum(f"_{k}") for k in by), F.sum("edge"))
    base = cells.agg(F.sum(F.when(at, F.col("n"))).alias("n0"), F.sum(F.when(at, F.col("hits"))).alias("hits0"), F.coalesce(every, F.lit(0.0)).alias("_every")).where("_every > -1e300").drop("_every")
    mine = F.collect_list(F.when(~at, F.struct("level_no", "n", "hits", "edge")))
    # a group has at most as many cells as there are levels, and the baseline is one row
    own = cells.groupBy(*by).agg(mine.alias("cells"), *(F.max(f"_{k}").alias(f"_{k}") for k in by)).join(F.broadcast(base))
    keep = F.size("cells") > 0
    for k in by:
        keep = keep & (F.col(f"_{k}") > 0)
    shared = F.when(F.col("n0") > 0, F.array(F.struct(F.lit(0).alias("level_no"), F.col("n0").alias("n"), F.col("hits0").alias("hits"), F.lit(0.0).alias("edge"))))
    every = F.concat("cells", F.coalesce(shared, F.array().cast("array<struct<level_no:int,n:bigint,hits:bigint,edge:double>>")))
    return own.where(keep).select(*by, F.explode(every).alias("c")).select(*by, "c.level_no", "c.n", "c.hits", "c.edge")


def bins(cells: DataFrame, cfg: MetaConfig, *by: str) -> DataFrame:
    """Arrays acc, edges and counts of all K levels of each group."""
    at = lambda c, k: F.max(F.when(F.col("level_no") == k, F.col(c)))
    levels = range(cfg.k)
    acc = F.array(*(at("hits", k) / F.when(at("n", k) > 0, at("n", k)) for k in levels))
    edges = F.array(F.lit(0.0), *(at("edge", k) for k in levels if k))
    return cells.groupBy(*by).agg(acc.alias("acc"), edges.alias("edges"), F.array(*(F.coalesce(at("n", k), F.lit(0)) for k in levels)).alias("counts"))


def _steps(k: int) -> Column:
    return F.sequence(F.lit(0), F.lit(k - 2))


def measures(curves: DataFrame, cfg: MetaConfig = MetaConfig()) -> DataFrame:
    """All meta-metrics of groups with acc, edges and counts (and, if there, recgap and fm_norm)."""
    acc, edges = F.col("acc"), F.col("edges")
    keep = [c for c in curves.columns if c not in ("acc", "edges", "counts", "recgap", "fm_norm")]
    base = F.when((F.col("counts")[0] >= 2) & acc[0].isNotNull(), acc[0]).otherwise(cfg.fallback)
    out = curves.withColumn("acc_base", base).withColumn("tau_", cfg.alpha_tau * F.col("acc_base"))
    ks = F.sequence(F.lit(0), F.lit(cfg.k - 1))
    out = out.withColumns(
        {
            "sr_": F.coalesce(F.array_max(F.filter(ks, lambda k: F.get(acc, k) >= F.col("tau_"))), F.lit(0)),
            "cp_": F.array_min(F.filter(ks, lambda k: F.get(acc, k) < F.col("tau_"))),
            "slopes": F.filter(F.transform(_steps(cfg.k), lambda k: F.when(F.get(edges, k + 1) > F.get(edges, k), F.try_divide(F.get(acc, k + 1) - F.get(acc, k), F.get(edges, k + 1) - F.get(edges, k)))), lambda x: x.isNotNull()),
            "drops": F.filter(_steps(cfg.k), lambda k: F.get(acc, k) - F.get(acc, k + 1) > cfg.drop),
            "diffs": F.filter(F.transform(_steps(cfg.k), lambda k: F.get(acc, k + 1) - F.get(acc, k)), lambda x: x.isNotNull()),
        }
    )
    n = F.size("diffs")
    turns = F.aggregate(F.when(n < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))), F.lit(0), lambda s, i: s + F.coalesce((F.get("diffs", i) * F.get("diffs", i + 1) < 0).cast("int"), F.lit(0)))
    worst = F.coalesce(F.array_min("slopes"), F.lit(0.0))
    cs, osc = F.size("drops") / float(cfg.k - 1), turns / F.lit(float(cfg.k - 2))
    some = {c: F.col(c) if c in curves.columns else F.lit(None).cast("double") for c in ("recgap", "fm_norm")}
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return out.select(
        *keep,
        F.transform("acc", lambda a: F.round(a, 4)).alias("acc_curve"),
        F.transform("edges", lambda a: F.round(a, 4)).alias("level_edges"),
        F.transform("acc", lambda a: F.round(1 - a, 4)).alias("divergence"),
        r4(F.col("acc_base")).alias("acc_base"),
        r4(F.col("tau_")).alias("tau"),
        F.col("sr_").cast("double").alias("sr_max"),
        F.col("cp_").cast("double").alias("cp"),
        r4(worst).alias("ss_worst"),
        r4(cs).alias("cs"),
        r4(osc).alias("osc_rate"),
        r4(some["recgap"]).alias("recgap"),
        r4(some["fm_norm"]).alias("fm_norm"),
        r4(F.col("sr_") / float(cfg.top)).alias("sr_norm"),
        r4(F.coalesce(F.col("cp_") / float(cfg.top), F.lit(1.0))).alias("cp_norm"),
        r4(unit((worst - cfg.slope_floor) / -cfg.slope_floor)).alias("ss_norm"),
        r4(1 - cs).alias("cs_norm"),
        r4(1 - osc).alias("osc_norm"),
        r4(unit((some["recgap"] + cfg.gap) / (2 * cfg.gap))).alias("recgap_norm"),
    )


def phases(rows: DataFrame, *by: str) -> DataFrame:
    """Recovery gap (accuracy in recovery less before the collapse) and share of unflagged failures of each group."""
    hit = lambda p: F.avg(F.when(F.col("phase") == p, F.col("match").cast("double")))
    return rows.dropna(subset=list(by)).groupBy(*by).agg((hit("recovery") - hit("pre_collapse")).alias("recgap"), (1 - F.avg(F.col("false_signature").cast("double"))).alias("fm_norm"))


def by_group(runs: DataFrame, *by: str, threshold: float = 0.80, cfg: MetaConfig = MetaConfig()) -> DataFrame:
    """Meta-metrics of each group, the baseline shared by all."""
    return measures(bins(with_baseline(records(runs, threshold), *by), cfg, *by), cfg)


def overall(runs: DataFrame, threshold: float = 0.80, cfg: MetaConfig = MetaConfig()) -> DataFrame:
    rows = records(runs, threshold).withColumn("group", F.lit("overall"))
    cells = rows.groupBy("group", "level_no").agg(F.count("*").alias("n"), F.sum(F.col("match").cast("long")).alias("hits"), F.min("perturbation").alias("edge"))
    return measures(bins(cells, cfg, "group").join(F.broadcast(phases(rows, "group")), "group"), cfg)


def empty(cfg: MetaConfig = MetaConfig()) -> dict[str, float]:
    """What no records at all give."""
    return {"acc_base": cfg.fallback, "tau": round(cfg.alpha_tau * cfg.fallback, 4), "sr_max": 0.0, "cp": 0.0, "ss_worst": 0.0, "cs": 0.0, "osc_rate": 0.0, "sr_norm": 0.0, "cp_norm": 0.0, "ss_norm": 1.0, "cs_norm": 1.0, "osc_norm": 1.0}
