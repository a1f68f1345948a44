"""Joins of points, or intervals, with a large table of ranges, by a binned index.

A range of length n is put at the level of the power of two that covers n, into the at most two bins of that level that it touches, so a table of ranges grows
at most twofold however long they are.  A point looks into one bin of each level that occurs (64 at most).  The join is an equality on
(level, bin), whose large bins Spark splits, and the ends are compared afterwards; nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(low: Column, high: Column) -> Column:
    """The least k with 2^k >= length."""
    return F.length(F.bin(F.greatest(high - low, F.lit(0)))).cast("int")


def indexed(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """ranges (whole numbers, both ends inside) with level_ and bin_, at most two rows each; ranges without an end or with high below low have none."""
    level = _level(F.col(low), F.col(high))
    rows = ranges.filter(F.col(low) <= F.col(high)).withColumn("level_", level)
    return rows.withColumn("bin_", F.explode(F.array_distinct(F.array(F.expr(f"shiftright({low}, level_)"), F.expr(f"shiftright({high}, level_)")))))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, keys: list[str] | None = None) -> DataFrame:
    """Each row of points with each range that holds it (low <= point <= high; equal keys)."""
    keys = keys or []
    index = indexed(ranges, low, high)
    levels = sorted(r[0] for r in index.select("level_").distinct().collect())  # 64 at most
    probes = points.filter(F.col(point).isNotNull()).withColumn("level_", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("bin_", F.expr(f"shiftright({point}, level_)"))
    found = probes.join(index, [*keys, "level_", "bin_"])
    return found.filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("level_", "bin_")


def overlap_join(left: DataFrame, ranges: DataFrame, begin: str, end: str, low: str, high: str, keys: list[str] | None = None) -> DataFrame:
    """Each interval of left with each range that it overlaps, once.

    At a range's level an interval probes every bin it touches if these are few, as it is not much longer than the ranges of that level; longer intervals are
    indexed in their turn, and the ranges' beginnings probe them: two intervals overlap if one begins inside the other.
    """
    keys = keys or []
    a = left.filter(F.col(begin) <= F.col(end))
    b = ranges.filter(F.col(low) <= F.col(high))
    # The interval begins within the range, or the range begins within the interval, after the interval's beginning.
    first = range_join(a, b, begin, low, high, keys)
    second = range_join(b, a, low, begin, end, keys).filter(F.col(low) > F.col(begin))
    return first.unionByName(second.select(*first.columns))


def ip_number(ip: Column | str) -> Column:
    """An IPv4 address as a number; null for anything else."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    part = lambda k: F.try_element_at(F.split(ip, "[.]"), F.lit(k)).try_cast("long")
    fine = F.size(F.split(ip, "[.]")) == 4
    for k in range(1, 5):
        fine = fine & part(k).between(0, 255)
    return F.when(fine, sum(part(k) * (1 << 8 * (4 - k)) for k in range(1, 5)))
