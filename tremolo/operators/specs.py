"""Level specifications as a table: bands of metrics, joined with values whatever the table's size.

A band [lo, hi) lies in at most two cells of the least power of two that is as
wide as it is, so a value finds all bands that hold it by looking up its cell of
every width that bands of its metric have: an equality join on (keys, width,
cell), refined by the bounds. Nothing is compared with all bands of a metric, and
nothing in the plan is a nested loop. Bands without an upper bound have a width
of their own and are found by lo alone.

Null values are in no band; empty bands (lo >= hi) hold none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels as L

#: The width of bands without an upper bound.
_OPEN = 10_000


def linear_bands(first: float, step: float, n: int = 5) -> list[tuple[float, float]]:
    """n bands of equal width, one behind the other."""
    return [(round(first + i * step, 10), round(first + (i + 1) * step, 10)) for i in range(n)]


def spec_table(spark: SparkSession) -> DataFrame:
    """family, metric, level, lo, hi, weight, higher_is_more, place: the specifications that the library comes with; place: of the metric in its family."""
    rows = []
    for family, weights in L.SPEC_WEIGHTS.items():
        edges = L.SPEC_EDGES.get(family, {})
        for place, metric in enumerate(dict.fromkeys([*edges, *weights])):
            own = edges.get(metric)
            for i in range(5):
                rows.append((family, metric, i + 1, own[i] if own else None, own[i + 1] if own else None, weights.get(metric), metric not in L.FALLING, place))
    return spark.createDataFrame(rows, "family string, metric string, level int, lo double, hi double, weight double, higher_is_more boolean, place int")


def of_family(specs: DataFrame, family: str) -> DataFrame:
    return specs.where(F.col("family") == family)


def _cell(x: Column, width: Column) -> Column:
    # a power of two divides exactly; beyond the range of longs cells are capped, which only makes them larger
    return F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), F.floor(x / F.pow(F.lit(2.0), width)).cast("double"))).cast("long")


def interval_join(values: DataFrame, bands: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """Every pair of a value and a band (lo, hi; hi null: open) of its keys that holds it; columns of both."""
    width = F.when(F.col("hi").isNull(), F.lit(_OPEN)).otherwise(F.ceil(F.log2(F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")))).cast("int"))
    sized = bands.where("hi IS NULL OR lo < hi").withColumn("_width", width)
    first = F.when(F.col("_width") == _OPEN, F.lit(0).cast("long")).otherwise(_cell(F.col("lo"), F.col("_width")))
    last = F.when(F.col("_width") == _OPEN, F.lit(0).cast("long")).otherwise(_cell(F.col("hi"), F.col("_width")))
    celled = sized.withColumn("_cell", F.explode(F.sequence(first, last)))
    # a few widths of each metric
    widths = sized.select(*keys, "_width").distinct().groupBy(*keys).agg(F.collect_set("_width").alias("_widths"))
    probes = values.where(F.col(value).isNotNull()).join(widths, list(keys)).withColumn("_width", F.explode("_widths")).drop("_widths")
    probes = probes.withColumn("_cell", F.when(F.col("_width") == _OPEN, F.lit(0).cast("long")).otherwise(_cell(F.col(value), F.col("_width"))))
    return probes.join(celled, [*keys, "_width", "_cell"]).where((F.col(value) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(value) < F.col("hi")))).drop("_width", "_cell")


def classify(values: DataFrame, specs: DataFrame, row: str) -> DataFrame:
    """row, family, level: the lowest level whose bands hold all metrics that the row has and the family has bands of; else the lowest one by the first such metric; else 1.

    values: row, family, metric, value.
    """
    banded = specs.where("lo IS NOT NULL")
    places = banded.groupBy("family", "metric").agg(F.min("place").alias("_place"))
    known = values.join(places, ["family", "metric"])
    asked = known.groupBy(row, "family").agg(F.count("*").alias("_metrics"), F.min("_place").alias("_first"))
    hits = interval_join(known.drop("_place"), banded.select("family", "metric", "level", "lo", "hi", "place"), ("family", "metric"))
    met = hits.groupBy(row, "family", "level").agg(F.countDistinct("metric").alias("_met"), F.min("place").alias("_place"))
    held = met.join(asked, [row, "family"])
    lowest = held.groupBy(row, "family").agg(F.min(F.when(F.col("_met") == F.col("_metrics"), F.col("level"))).alias("_all"), F.min(F.when(F.col("_place") == F.col("_first"), F.col("level"))).alias("_one"))
    every = values.select(row, "family").distinct()
    return every.join(lowest, [row, "family"], "left").select(row, "family", F.coalesce("_all", "_one", F.lit(1)).alias("level"))
