"""As-of join: the last row of a history at or before a time.

Both sides are put under one key and ordered by time.  A key's rows are cut into buckets of about `size` rows by time, so a hot key is spread over its
history; within a bucket the last history row is carried forward by a window, and what a bucket doesn't have it gets from the buckets before
it, as one carried row (a row a bucket is all that a key gathers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.storage import stored

#: Rows of a bucket, about.
SIZE = 1 << 16


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], size: int = SIZE, tie: Column | None = None) -> DataFrame:
    """left with `values` (and `time` as matched_<time>) of the last row of right with equal keys and a time not later; null where there is none.

    time is a number in both; rows without a time or key match nothing, as left rows they stay.  Of right rows of one time the one with the largest
    `tie` (a struct of the values unless given) counts.
    """
    tie = F.struct(*values) if tie is None else tie
    at = F.col(time).cast("double")
    whole = at.isNotNull() & ~F.isnan(at)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    hist = right.filter(whole).select(*keys, at.alias("at_"), F.struct(F.col(time).alias("t"), *values).alias("value_"), tie.alias("tie_"))
    hist = hist.groupBy(*keys, "at_").agg(F.max_by("value_", "tie_").alias("value_"))
    rows = left.select(*keys, at.alias("at_"), F.struct(*left.columns).alias("row_"))
    none = rows.filter(~whole)
    both = stored(rows.filter(whole).unionByName(hist, allowMissingColumns=True), "asof-rows")
    spans = both.groupBy(*keys).agg(F.min("at_").alias("low_"), F.max("at_").alias("high_"), F.ceil(F.count(F.lit(1)) / size).alias("n_"))
    # Buckets are even in time, then those that came out large are cut again by their own times.
    place = lambda low, high, n: F.when(F.col(high) > F.col(low), F.least(F.floor((F.col("at_") - F.col(low)) / (F.col(high) - F.col(low)) * F.col(n)), F.col(n) - 1)).otherwise(0)
    both = both.join(spans, keys).withColumn("a_", place("low_", "high_", "n_").cast("long")).drop("low_", "high_", "n_")
    inner = both.groupBy(*keys, "a_").agg(F.min("at_").alias("low_"), F.max("at_").alias("high_"), F.ceil(F.count(F.lit(1)) / size).alias("n_"))
    both = both.join(inner, [*keys, "a_"]).withColumn("b_", place("low_", "high_", "n_").cast("long")).drop("low_", "high_", "n_")
    by = [*keys, "a_", "b_"]
    per = both.groupBy(*by).agg(F.max_by("value_", F.when(F.col("value_").isNotNull(), F.col("at_"))).alias("last_"))
    before = Window.partitionBy(*keys).orderBy("a_", "b_").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*by, F.last("last_", ignorenulls=True).over(before).alias("value_")).filter("value_ IS NOT NULL")
    every = both.unionByName(carried, allowMissingColumns=True)
    # Carried rows have no time and come first; a history row comes before what it serves at the same time.
    order = Window.partitionBy(*by).orderBy(F.col("at_").asc_nulls_first(), F.col("value_").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("value_", F.last("value_", ignorenulls=True).over(order)).filter("row_ IS NOT NULL").select("row_", "value_")
    found = found.unionByName(none.select("row_", F.lit(None).cast(found.schema["value_"].dataType).alias("value_")))
    return found.select("row_.*", F.col("value_.t").alias(f"matched_{time}"), *[F.col(f"value_.{v}").alias(v) for v in values])
