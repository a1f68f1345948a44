"""Exact order statistics of large groups, by counts: no group is sorted in one task.

Values are counted on a coarse scale that rises with them; the counts tell in which step each asked place lies, and only values
of those steps are counted one by one and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the coarse scale for each factor e.
STEPS = 64


def at_places(values: DataFrame, keys: list[str], column: str, places: dict[str, Column]) -> DataFrame:
    """(keys, n_, name ...): the value at each place (from 0, by an expression of the group's n_) of the sorted values; nulls are left out, NaN comes last."""
    value = F.col(column).cast("double")
    step = F.when(F.isnan(value), F.lit((1 << 62))).otherwise((F.signum(value) * F.floor(F.log1p(F.abs(value)) * STEPS)).cast("long"))
    rows = values.filter(value.isNotNull()).select(*keys, value.alias("value_"), step.alias("step_"))
    steps = rows.groupBy(*keys, "step_").agg(F.count(F.lit(1)).alias("c_"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("c_").over(whole.orderBy("step_").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("n_", F.sum("c_").over(whole)).withColumn("before_", upto - F.col("c_"))
    asked = F.array(*[F.struct(F.lit(name).alias("name_"), F.greatest(F.lit(0), F.least(F.col("n_") - 1, place)).cast("long").alias("place_")) for name, place in places.items()])
    steps = steps.select(*keys, "step_", "n_", "before_", "c_", F.inline(asked)).filter("place_ >= before_ AND place_ < before_ + c_")
    steps = steps.groupBy(*keys, "step_").agg(F.first("n_").alias("n_"), F.collect_list(F.struct("name_", (F.col("place_") - F.col("before_")).alias("at_"))).alias("asked_"))
    by = [*keys, "step_"]
    equal = rows.join(steps.select(*by), by).groupBy(*by, "value_").agg(F.count(F.lit(1)).alias("c_"))
    last = F.sum("c_").over(Window.partitionBy(*by).orderBy("value_").rowsBetween(Window.unboundedPreceding, 0))
    found = equal.withColumn("end_", last).join(steps, by).select(*keys, "n_", "value_", "c_", "end_", F.inline("asked_")).filter("at_ >= end_ - c_ AND at_ < end_")
    return found.groupBy(*keys).agg(F.first("n_").alias("n_"), *[F.max(F.when(F.col("name_") == name, F.col("value_"))).alias(name) for name in places])


def quantiles(values: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """(keys, name ...): each share's quantile with linear interpolation, as percentile()."""
    at = {name: (F.col("n_") - 1) * F.lit(share) for name, share in shares.items()}
    places = {f"{name}_{end}": f(x).cast("long") for name, x in at.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    found = at_places(values, keys, column, places)
    part = {name: x - F.floor(x) for name, x in at.items()}
    return found.select(*keys, *[(F.when(F.col(f"{n}_low") == F.col(f"{n}_high"), F.col(f"{n}_low")).otherwise((1 - p) * F.col(f"{n}_low") + p * F.col(f"{n}_high"))).alias(n) for n, p in part.items()])
