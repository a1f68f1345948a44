"""Baselines: seed statistics, outlier filter, learning and look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Settings


def first_windows(long: DataFrame, n: int) -> DataFrame:
    """The rows of each series' first n windows."""
    order = Window.partitionBy("stream_id", "feature").orderBy("wid")
    return long.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)


def seed_statistics(long: DataFrame, n: int) -> DataFrame:
    """(stream_id, feature, seed_mean, seed_var, seed_n) over the first n windows; the variance has a floor."""
    stats = first_windows(long, n).groupBy("stream_id", "feature").agg(F.avg("value").alias("seed_mean"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("seed_n"))
    floor = F.greatest(F.col("sd") * F.col("sd"), 0.05 * F.col("seed_mean") + 0.01, F.lit(0.1))
    return stats.select("stream_id", "feature", "seed_mean", floor.alias("seed_var"), "seed_n")


CONTEXT = ["stream_id", "feature", "hour", "dow"]
#: Steps of the coarse scale on which quartiles are first located, for each factor e.
STEPS = 64


def _coarse(value: Column) -> Column:
    """A step function that grows with the value (logarithms are monotone)."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * STEPS)).cast("long")


def iqr_bounds(long: DataFrame, least: int = 10) -> DataFrame:
    """(the context, low, high) of contexts with `least` observations: median +- 1.5 IQR by index quartiles (places n div 4,
    n div 2, 3n div 4 from 0); without bounds (nulls) under four.

    Counts on a coarse scale tell in which step each quartile lies; only values of those steps are ranked, by count of
    equal values, so a context with a third of all rows is ranked neither whole nor in one task.
    """
    values = long.select(*CONTEXT, F.col("value").cast("double").alias("value")).withColumn("step", _coarse(F.col("value")))
    steps = values.groupBy(*CONTEXT, "step").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*CONTEXT)
    upto = F.sum("c").over(whole.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("n", F.sum("c").over(whole)).withColumn("before", upto - F.col("c")).filter(F.col("n") >= least)
    places = F.array(*[F.struct(F.lit(k).alias("q"), F.floor(F.col("n") * k / 4).cast("long").alias("place")) for k in (1, 2, 3)])
    asked = steps.select(*CONTEXT, "step", "n", "before", "c", F.inline(places)).filter("place >= before AND place < before + c")
    asked = asked.groupBy(*CONTEXT, "step").agg(F.first("n").alias("n"), F.collect_list(F.struct("q", (F.col("place") - F.col("before")).alias("at"))).alias("asked"))
    equal = values.join(asked.select(*CONTEXT, "step"), [*CONTEXT, "step"]).groupBy(*CONTEXT, "step", "value").agg(F.count(F.lit(1)).alias("c"))
    last = F.sum("c").over(Window.partitionBy(*CONTEXT, "step").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = equal.withColumn("end", last).join(asked, [*CONTEXT, "step"]).select(*CONTEXT, "n", "value", "c", "end", F.inline("asked")).filter("at >= end - c AND at < end")
    q = lambda k: F.max(F.when(F.col("q") == k, F.col("value")))
    quartiles = found.groupBy(*CONTEXT).agg(F.first("n").alias("n"), q(1).alias("q1"), q(2).alias("q2"), q(3).alias("q3"))
    spread = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    bound = lambda x: F.when(F.col("n") >= 4, x)
    return quartiles.select(*CONTEXT, bound(F.col("q2") - spread).alias("low"), bound(F.col("q2") + spread).alias("high"))


def learned_contexts(long: DataFrame, least: int = 10) -> DataFrame:
    """(stream_id, feature, hour, dow, mean, variance, n) of contexts with enough observations, outliers left out."""
    kept = long.join(iqr_bounds(long, least), CONTEXT).filter("low IS NULL OR value BETWEEN low AND high")
    return kept.groupBy(*CONTEXT).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.count(F.lit(1)).alias("n"))


def learned_overall(contexts: DataFrame) -> DataFrame:
    """(stream_id, feature, mean, variance, n): contexts weigh alike."""
    return contexts.groupBy("stream_id", "feature").agg(F.avg("mean").alias("mean"), F.avg("variance").alias("variance"), F.sum("n").alias("n"))


def looked_up(long: DataFrame, contexts: DataFrame, overall: DataFrame, s: Settings) -> DataFrame:
    """long with the baseline of its context, else the overall one, else (0, 1), and the z-score against it."""
    c = contexts.select("stream_id", "feature", "hour", "dow", F.col("mean").alias("cm"), F.col("variance").alias("cv"))
    o = overall.select("stream_id", "feature", F.col("mean").alias("om"), F.col("variance").alias("ov"))
    out = long.join(c, ["stream_id", "feature", "hour", "dow"], "left").join(o, ["stream_id", "feature"], "left")
    out = out.withColumn("mean", F.coalesce("cm", "om", F.lit(0.0))).withColumn("variance", F.coalesce("cv", "ov", F.lit(1.0))).drop("cm", "cv", "om", "ov")
    return out.withColumn("z", (F.col("value") - F.col("mean")) / F.greatest(F.sqrt(F.greatest("variance", F.lit(0.0))), F.lit(s.epsilon)))


_ENTRY = "array<struct<hour:int,dow:int,mean:double,variance:double,n:bigint>>"


def serialized(contexts: DataFrame) -> DataFrame:
    """(stream_id, feature, baseline): the contexts as one JSON list."""
    entry = F.struct(F.col("hour").cast("int").alias("hour"), F.col("dow").cast("int").alias("dow"), "mean", "variance", "n")
    return contexts.groupBy("stream_id", "feature").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("baseline"))


def loaded(serial: DataFrame) -> DataFrame:
    """The contexts that serialized() wrote."""
    return serial.select("stream_id", "feature", F.inline(F.from_json("baseline", _ENTRY)))


def feature_ids(contexts: DataFrame) -> DataFrame:
    """(stream_id, feature, contexts): which features have a baseline, and for how many contexts."""
    return contexts.groupBy("stream_id", "feature").agg(F.count(F.lit(1)).alias("contexts"))


def without(contexts: DataFrame, features: list[str] | None = None) -> DataFrame:
    """contexts after a reset of these features, or of all."""
    return contexts.filter(~F.col("feature").isin(features)) if features is not None else contexts.limit(0)
