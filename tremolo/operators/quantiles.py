"""Quantiles of groups of any size: stored sketches that merge, and exact ones by counting.

A sketch (KLL, built into Spark) of k = 800 answers with a rank error below 1 %
at any size; a stored table of sketches takes new runs over by merging theirs,
so what was read before is not read again.

exact() needs no group in one buffer: each round asks a sketch of the range that
is still open for a rank for two values around it, counts what lies below,
between and above them, and goes on with the part that holds the rank, from its
least to its largest value, until these are equal. The counts are exact, a sketch
only proposes where to cut: mostly a few hundredths of the range are left, so ten
thousand million values take about six rounds whatever their distribution.
Sketches and counts are made before the shuffle; every round is written to the
shared folder.

Null, NaN and infinite values are left out; groups without others are absent (without
keys, the one row is null); null keys are a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import results
from .bins import work_folder

#: Size of the sketches; a range is cut at those of its PARTS quantiles that stand around the rank.
K, PARTS = 800, 100


def _values(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & (F.abs(x) < float("inf"))).select(*by, x.alias("_x"))


def sketches(df: DataFrame, value: str, *by: str, k: int = K) -> DataFrame:
    """A sketch of each group's values."""
    return _values(df, value, by).groupBy(*by).agg(F.kll_sketch_agg_double("_x", k).alias("sketch"))


def merged(stored: DataFrame, new: DataFrame, *by: str, k: int = K) -> DataFrame:
    """The sketches of both tables' rows together."""
    return stored.unionByName(new).groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def of_sketches(stored: DataFrame, q: float, name: str = "quantile") -> DataFrame:
    """The groups' quantiles: values whose rank is within the sketch's error of q."""
    return stored.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).drop("sketch")


def exact(df: DataFrame, value: str, q: float, *by: str, name: str = "quantile", path: str | None = None) -> DataFrame:
    """The groups' quantiles, interpolated between the two values at q (n - 1) as percentile() does."""
    path, names = path or work_folder(df.sparkSession, "quantiles"), [f"_k{i}" for i in range(len(by))]
    rows = _values(df, value, by).toDF(*names, "_x")
    at = F.lit(float(q)) * (F.col("_n") - 1)
    groups = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_n > 0")
    # a rank is that of the value below q or of the one above; both have a range of their own
    start = groups.select(*names, F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_rank"), at.alias("_at"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_count"))
    state = results.once(df.sparkSession, path, 0, lambda: start)
    same = [rows[n].eqNullSafe(F.col(f"s.{n}")) for n in names]
    key = [*names, "_lo", "_hi", "_below", "_count"]
    for n in range(1, 10_000):
        open_ = state.where("_lo < _hi")
        if open_.isEmpty():
            break
        ranges = open_.groupBy(*key).agg(F.min("_rank").alias("_first"))

        def inside(ranges: DataFrame, *more: str) -> DataFrame:
            # without groups these are one or two rows
            own = (ranges if names else F.broadcast(ranges)).alias("s")
            return rows.join(own, [*same, F.col("_x") >= F.col("_lo"), F.col("_x") <= F.col("_hi")]).select(*(F.col(f"s.{k}").alias(k) for k in names), "_lo", "_hi", "_below", "_count", *more, "_x")

        share = (F.col("_first") - F.col("_below")) / F.col("_count")
        values = F.kll_sketch_get_quantile_double("_sketch", F.array(*(F.lit(i / PARTS) for i in range(PARTS + 1))))
        value = lambda d: F.get("_values", F.greatest(F.lit(0), F.least(F.lit(PARTS), F.floor(share * PARTS) + d)).cast("int"))
        asked = inside(ranges, "_first").groupBy(*key, "_first").agg(F.kll_sketch_agg_double("_x", K).alias("_sketch")).withColumn("_values", values).select(*key, value(-1).alias("_a"), value(0).alias("_v"), value(2).alias("_b"))
        whole = (F.col("_a") <= F.col("_lo")) & (F.col("_b") >= F.col("_hi"))  # then one value is cut out
        cuts = asked.select(*key, F.when(whole, F.col("_v")).otherwise(F.col("_a")).alias("_a"), F.when(whole, F.col("_v")).otherwise(F.col("_b")).alias("_b"))
        cuts = results.once(df.sparkSession, f"{path}/cuts", n, lambda cuts=cuts: cuts)
        part = F.when(F.col("_x") < F.col("_a"), 0).when(F.col("_x") <= F.col("_b"), 1).otherwise(2)
        counts = inside(cuts, "_a", "_b").groupBy(*key, part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
        # at most three rows of each range
        up_to = F.sum("_c").over(Window.partitionBy(*key).orderBy("_part"))
        found = counts.withColumn("_end", F.col("_below") + up_to).withColumn("_start", F.col("_end") - F.col("_c")).alias("c")
        mine = [*(F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key), F.col("_rank") >= F.col("_start"), F.col("_rank") < F.col("_end")]
        narrower = open_.alias("o").join(found, mine).select(*(F.col(f"o.{k}").alias(k) for k in names), "_rank", "_at", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_start").alias("_below"), F.col("_c").alias("_count"))
        state = results.once(df.sparkSession, path, n, lambda narrower=narrower, done=state.where("_lo = _hi"): done.unionByName(narrower))
    lower, upper = F.min_by("_lo", "_rank"), F.max_by("_lo", "_rank")
    return state.groupBy(*names).agg((lower + (upper - lower) * (F.first("_at") - F.min("_rank"))).alias(name)).toDF(*by, name)
