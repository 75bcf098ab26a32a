"""Category scores: business and entropy weights of families, primary and harmonic composites."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import r4

#: Default weights of the families of each category, blend and guard.
BUSINESS_WEIGHTS = {"Steadiness": {"paraphrase": 0.20, "noise": 0.10, "format": 0.10, "distraction": 0.20, "conflict": 0.25, "context": 0.15}}
ALPHA, EPSILON = 0.6, 1e-6


def weight_table(spark: SparkSession, weights: dict[str, dict[str, float]] = BUSINESS_WEIGHTS) -> DataFrame:
    """category, family, weight."""
    return spark.createDataFrame([(c, f, float(w)) for c, own in weights.items() for f, w in own.items()], "category string, family string, weight double")


def normalise(df: DataFrame, weight: str, *by: str) -> DataFrame:
    """Weights that sum to 1 in each group; equal ones if their sum is not positive."""
    group = Window.partitionBy(*by)
    total = F.sum(weight).over(group)
    return df.withColumn(weight, F.when(total > 0, F.try_divide(F.col(weight), total)).otherwise(1.0 / F.count("*").over(group)))


def final_weights(business: DataFrame, entropy: DataFrame, alpha: float = ALPHA, by: str = "category") -> DataFrame:
    """Blend of two weight tables (category, family, weight); a family that one lacks has weight 0 there."""
    b, e = business.withColumnRenamed("weight", "w_business"), entropy.withColumnRenamed("weight", "w_fwe")
    both = b.join(e, [by, "family"], "full_outer").fillna(0.0, ["w_business", "w_fwe"])
    return normalise(both.withColumn("weight", alpha * F.col("w_business") + (1 - alpha) * F.col("w_fwe")), "weight", by)


def breakdown(results: DataFrame, weights: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Each family's weights and contribution. results: category, family, p_score, fwe (null: 1 - p_score, at least 0).

    Where a family has no business weight, or entropies sum to nothing, the business weights count alone.
    """
    known = normalise(weights, "weight", "category").withColumnRenamed("weight", "business")
    rows = results.join(known, ["category", "family"], "left")
    group = Window.partitionBy("category")
    rows = rows.withColumn("fwe", F.coalesce("fwe", F.greatest(F.lit(0.0), 1 - F.col("p_score"))))
    total = F.sum("fwe").over(group)
    alone = (total <= 0) | F.max(F.col("business").isNull()).over(group)
    rows = rows.withColumns({"fallback": alone, "w_business": F.coalesce("business", F.lit(0.0))})
    rows = rows.withColumn("w_fwe", F.when(F.col("fallback"), F.col("w_business")).otherwise(F.try_divide(F.col("fwe"), F.sum("fwe").over(group))))
    blend = F.when(F.col("fallback"), F.col("w_business")).otherwise(alpha * F.col("w_business") + (1 - alpha) * F.col("w_fwe"))
    rows = normalise(rows.withColumn("w_final", blend), "w_final", "category")
    return rows.select("category", "family", "p_score", "fwe", "fallback", F.round("w_business", 6).alias("w_business"), F.round("w_fwe", 6).alias("w_fwe"), F.round("w_final", 6).alias("w_final"), F.round(F.col("w_final") * F.col("p_score"), 6).alias("contribution"), F.col("w_final").alias("w_exact"))


def score(results: DataFrame, weights: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON) -> DataFrame:
    """Primary and harmonic score of each category."""
    own = breakdown(results, weights, alpha)
    return own.groupBy("category").agg(
        r4(F.sum(F.col("w_exact") * F.col("p_score"))).alias("p_primary"),
        r4(F.coalesce(F.try_divide(F.lit(1.0), F.sum(F.col("w_exact") / (F.col("p_score") + epsilon))), F.lit(0.0))).alias("p_harmonic"),
        F.max("fallback").alias("fallback"),
    )


@dataclass
class CategoryScorer:
    """Scores of one category with weights that can be changed."""

    category: str
    weights: dict[str, float] = field(default_factory=dict)
    alpha: float = ALPHA
    epsilon: float = EPSILON

    def __post_init__(self):
        self._scale()

    def _scale(self) -> None:
        total, n = sum(self.weights.values()), len(self.weights)
        self.weights = {k: w / total if total > 0 else 1 / n for k, w in self.weights.items()}

    def update(self, family: str, weight: float) -> None:
        if weight < 0:
            raise ValueError(f"a weight is at least 0, not {weight!r}")
        if family not in self.weights:
            raise KeyError(f"no family {family!r} in category {self.category!r}")
        self.weights[family] = weight
        self._scale()

    def blend(self, alpha: float) -> None:
        if not 0 <= alpha <= 1:
            raise ValueError(f"alpha is from 0 to 1, not {alpha!r}")
        self.alpha = alpha

    def score(self, results: DataFrame) -> DataFrame:
        return score(results.where(F.col("category") == self.category), weight_table(results.sparkSession, {self.category: self.weights}), self.alpha, self.epsilon)
