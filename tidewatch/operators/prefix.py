"""Scans of long series in parallel: a prefix over affine maps.

A step of the smoothed mean is m -> (1 - a) m + a x, one of its variance v -> (1 - a) v + a (x - m)^2 once the means are known, and one
of the leaky accumulator A -> A + excess or A -> decay * A once the deviations are.  All are s -> p s + q, and such maps compose to such
maps.  So a series is cut into blocks; each block composes its maps (one row a block), the rows of a series are followed from its start,
and each block scans with the state that enters it.  Three rounds, mean, variance and accumulator, give what one scan of the whole series
gives but for rounding (relative 1e-9 and better: the maps contract or add).  No task holds more than a block; what follows
a series holds a row a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import Settings
from tidewatch.storage import stored

#: Rows of a block, about.
BLOCK = 1 << 16


def compose(p: np.ndarray, q: np.ndarray) -> tuple[float, float]:
    """(P, Q) of all steps s -> p s + q, the first step first."""
    after = np.concatenate([np.cumprod(p[::-1])[::-1][1:], [1.0]])  # product of the steps that follow
    return float(after[0] * p[0]), float(after @ q)


def states(p: np.ndarray, q: np.ndarray, start: float) -> np.ndarray:
    """The state after each step."""
    out, s = np.empty(len(p)), start
    for i, (a, b) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        s = a * s + b
        out[i] = s
    return out


def cut(rows: DataFrame, keys: list[str], order: str, size: int = BLOCK) -> DataFrame:
    """rows with block_, a range of order; a series is cut evenly by it."""
    spans = rows.groupBy(*keys).agg(F.min(order).alias("low_"), (F.max(order) - F.min(order) + 1).alias("span_"), F.ceil(F.count(F.lit(1)) / size).alias("blocks_"))
    return rows.join(spans, keys).withColumn("block_", F.expr(f"({order} - low_) * blocks_ div span_")).drop("low_", "span_", "blocks_")


def _before(after: np.ndarray, start: float) -> np.ndarray:
    """The state that each step meets."""
    return np.concatenate([[start], after[:-1]])


class _Block:
    """One block's values in order, and its columns as far as they are known."""

    def __init__(self, pdf: pd.DataFrame, order: str, alpha: float):
        self.rows = pdf.sort_values(order)
        self.x, self.alpha = self.rows["x_"].to_numpy(float), alpha
        self.fade = np.full(len(self.x), 1 - alpha)

    def mean_map(self) -> tuple[float, float]:
        return compose(self.fade, self.alpha * self.x)

    def means(self) -> np.ndarray:
        return states(self.fade, self.alpha * self.x, float(self.rows["mean_"].iloc[0]))

    def variance_steps(self) -> np.ndarray:
        return self.alpha * (self.x - self.means()) ** 2

    def variances(self) -> np.ndarray:
        return states(self.fade, self.variance_steps(), float(self.rows["variance_"].iloc[0]))

    def before(self, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, variance, z) that each value meets, before it moves them."""
        mean, var = _before(self.means(), float(self.rows["mean_"].iloc[0])), _before(self.variances(), float(self.rows["variance_"].iloc[0]))
        return mean, var, (self.x - mean) / np.maximum(np.sqrt(np.maximum(var, 0.0)), epsilon)


def _leaky(z: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    over = np.abs(z) > s.tau_z
    return np.where(over, 1.0, s.decay), np.where(over, np.abs(z) - s.tau_z, 0.0)


def _maps(rows: DataFrame, keys: list[str], order: str, alpha: float, of: Callable[[_Block], tuple[float, float]]) -> DataFrame:
    """(keys, block_, p_, q_): the composed map of each block."""
    kinds = [*(rows.schema[k] for k in keys), T.StructField("block_", T.LongType()), T.StructField("p_", T.DoubleType()), T.StructField("q_", T.DoubleType())]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = of(_Block(pdf, order, alpha))
        return pdf.iloc[:1][[*keys, "block_"]].assign(p_=p, q_=q)

    return rows.groupBy(*keys, "block_").applyInPandas(run, T.StructType(kinds))


def _entering(maps: DataFrame, starts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, block_, name): the state that enters each block, from the series' start in column `name`."""
    kinds = [*(maps.schema[k] for k in keys), T.StructField("block_", T.LongType()), T.StructField(name, T.DoubleType())]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_")
        after = states(pdf["p_"].to_numpy(float), pdf["q_"].to_numpy(float), float(pdf[name].iloc[0]))
        return pdf[[*keys, "block_"]].assign(**{name: _before(after, float(pdf[name].iloc[0]))})

    return stored(maps.join(starts.select(*keys, name), keys).groupBy(*keys).applyInPandas(run, T.StructType(kinds)), "prefix-entering")


def _prepared(rows: DataFrame, keys: list[str], order: str, value: str, starts: DataFrame, alpha: float, size: int) -> DataFrame:
    """rows (keys, order, x_, block_) with the mean and variance that enter their block."""
    rows = stored(cut(rows.select(*keys, order, F.col(value).cast("double").alias("x_")), keys, order, size), "prefix-rows")
    by = [*keys, "block_"]
    rows = rows.join(_entering(_maps(rows, keys, order, alpha, lambda b: b.mean_map()), starts, keys, "mean_"), by)
    return rows.join(_entering(_maps(rows, keys, order, alpha, lambda b: compose(b.fade, b.variance_steps())), starts, keys, "variance_"), by)


def ewma(rows: DataFrame, keys: list[str], order: str, value: str, alpha: float, size: int = BLOCK) -> DataFrame:
    """(keys, order, value, mean, variance, z) after each value, as scan.ewma: z after the update, 0 for the first value and at spread 0.

    The first value is its series' start; order is a whole number that rises within a series.
    """
    starts = stored(rows.groupBy(*keys).agg(F.min_by(value, order).cast("double").alias("mean_"), F.lit(0.0).alias("variance_"), F.min(order).alias("first_")), "prefix-starts")
    ready = _prepared(rows, keys, order, value, starts, alpha, size).join(starts.select(*keys, "first_"), keys)
    kinds = [*(rows.schema[k] for k in [*keys, order]), *(T.StructField(n, T.DoubleType()) for n in (value, "mean", "variance", "z"))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _Block(pdf, order, alpha)
        mean, var = b.means(), b.variances()
        first = b.rows[order].to_numpy() == b.rows["first_"].to_numpy()
        mean, var = np.where(first, b.x, mean), np.where(first, 0.0, var)
        z = np.divide(b.x - mean, np.sqrt(var), out=np.zeros(len(mean)), where=(var > 0) & ~first)
        return b.rows[[*keys, order]].assign(**{value: b.x, "mean": mean, "variance": var, "z": z})

    return ready.groupBy(*keys, "block_").applyInPandas(run, T.StructType(kinds))


def deviations(rows: DataFrame, keys: list[str], order: str, value: str, starts: DataFrame, s: Settings, size: int = BLOCK) -> DataFrame:
    """(keys, order, value, mean, variance, z, accumulator, confirmed) as the detector's scan in one context: z before the update.

    starts: (keys, mean, variance) of each series' seed.
    """
    starts = starts.select(*keys, F.col("mean").alias("mean_"), F.col("variance").alias("variance_"), F.lit(0.0).alias("level_"))
    ready = stored(_prepared(rows, keys, order, value, starts, s.alpha, size), "prefix-ready")
    ready = ready.join(_entering(_maps(ready, keys, order, s.alpha, lambda b: compose(*_leaky(b.before(s.epsilon)[2], s))), starts, keys, "level_"), [*keys, "block_"])
    kinds = [*(rows.schema[k] for k in [*keys, order]), *(T.StructField(n, T.DoubleType()) for n in (value, "mean", "variance", "z", "accumulator")), T.StructField("confirmed", T.BooleanType())]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _Block(pdf, order, s.alpha)
        mean, var, z = b.before(s.epsilon)
        level = states(*_leaky(z, s), float(b.rows["level_"].iloc[0]))
        return b.rows[[*keys, order]].assign(**{value: b.x, "mean": mean, "variance": var, "z": z, "accumulator": level, "confirmed": level > s.theta})

    return ready.groupBy(*keys, "block_").applyInPandas(run, T.StructType(kinds))
