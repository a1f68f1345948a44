"""Ordered scans: per-key recursions over a series.

Two backends give the same numbers.  ``native`` folds an array of the key's values with SQL's aggregate(); it stays in the
JVM and suits short histories, as each step copies the list so far.  ``pandas`` runs one key in one
Python call (applyInPandas) in linear time, and is the default.  One key is one task; keys are a stream and a feature, and a
step is a window, so rows are few whatever the traffic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Settings


def fold(df: DataFrame, keys: list[str], order: str, fields: list[str], start: str, step: str) -> DataFrame:
    """Native scan.  start: SQL of the first state (a struct); step: SQL of the next state from `a.s` (state) and `x` (row, a
    struct of order and fields).  One row per input row: keys, order, fields and the state after it."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("rows"))
    kind = df.sparkSession.range(1).select(F.expr(start).alias("s")).schema["s"].dataType.simpleString()
    states = F.expr(f"""aggregate(rows,
        named_struct('s', {start}, 'out', cast(array() AS array<{kind}>)),
        (a, x) -> named_struct('s', {step}, 'out', concat(a.out, array({step}))),
        a -> a.out)""")
    return rows.select(*keys, "rows", states.alias("states")).select(*keys, F.explode(F.arrays_zip("rows", "states")).alias("z")).select(*keys, "z.rows.*", "z.states.*")


def ewma_native(df: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """ewma() as a fold: adds n, mean, variance and z after the update."""
    a, b = f"{alpha}D", f"(1 - {alpha}D)"
    mean = f"if(a.s.n = 0, x.{value}, {a} * x.{value} + {b} * a.s.mean)"
    var = f"if(a.s.n = 0, 0D, {a} * power(x.{value} - {mean}, 2D) + {b} * a.s.variance)"
    step = f"named_struct('n', a.s.n + 1L, 'mean', {mean}, 'variance', {var})"
    out = fold(df.withColumn(value, F.col(value).cast("double")), keys, order, [value], "named_struct('n', 0L, 'mean', 0D, 'variance', 0D)", step)
    sd = F.sqrt("variance")
    return out.withColumn("z", F.when((F.col("n") == 1) | (sd <= 0), 0.0).otherwise((F.col(value) - F.col("mean")) / sd))


def leaky_native(df: DataFrame, keys: list[str], order: str, z: str, s: Settings) -> DataFrame:
    """leaky() as a fold: adds accumulator and confirmed."""
    step = f"named_struct('accumulator', if(abs(x.{z}) > {s.tau_z}D, a.s.accumulator + (abs(x.{z}) - {s.tau_z}D), a.s.accumulator * {s.decay}D))"
    out = fold(df, keys, order, [z], "named_struct('accumulator', 0D)", step)
    return out.withColumn("confirmed", F.col("accumulator") > s.theta)


# -- recursions over (t, x): each takes the values in order and returns columns -------------------


def ewma(values: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, variance, z) after each value, z taken after the update; the first z and those at spread 0 are 0."""
    m = v = 0.0
    mean, var, z = np.empty(len(values)), np.empty(len(values)), np.zeros(len(values))
    for i, x in enumerate(values.tolist()):
        if i == 0:
            m, v = x, 0.0
        else:
            m = alpha * x + (1 - alpha) * m
            v = alpha * (x - m) ** 2 + (1 - alpha) * v
            sd = v**0.5
            z[i] = (x - m) / sd if sd > 0 else 0.0
        mean[i], var[i] = m, v
    return mean, var, z


def leaky(z: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(accumulator, confirmed): grows by the excess over tau_z without decay, decays otherwise."""
    a = 0.0
    acc = np.empty(len(z))
    for i, x in enumerate(np.abs(z).tolist()):
        a = a + (x - s.tau_z) if x > s.tau_z else a * s.decay
        acc[i] = a
    return acc, acc > s.theta


class Baseline:
    """Mean and variance per context with a global fallback; update and look-up of one feature."""

    def __init__(self, s: Settings, contexts: dict | None = None, overall: tuple[float, float, int] | None = None):
        self.s, self.contexts, self.overall = s, dict(contexts or {}), overall

    def get(self, context) -> tuple[float, float]:
        mean, var, n = self.contexts.get(context, (0.0, 1.0, 0))
        if n > 0:
            return mean, var
        if self.overall is not None and self.overall[2] > 0:
            return self.overall[0], self.overall[1]
        return 0.0, 1.0

    def z(self, x: float, context) -> float:
        mean, var = self.get(context)
        return (x - mean) / max(max(var, 0.0) ** 0.5, self.s.epsilon)

    def update(self, x: float, context) -> None:
        a = self.s.alpha
        mean, var, n = self.contexts.get(context, (0.0, 1.0, 0))
        if n == 0:
            mean, var = x, 0.0
        else:
            mean = a * x + (1 - a) * mean
            var = a * (x - mean) ** 2 + (1 - a) * var
        self.contexts[context] = (mean, var, n + 1)
        if self.overall is None:
            self.overall = (mean, var, 0)
        else:
            m, v, k = self.overall
            m = a * mean + (1 - a) * m
            self.overall = (m, a * var + (1 - a) * v, k + 1)


def seed_of(values: np.ndarray) -> tuple[float, float, int]:
    """(mean, variance with a floor, number) of a series' seed values."""
    mean, sd = float(values.mean()), float(values.std())
    return mean, max(sd * sd, 0.05 * mean + 0.01, 0.1), len(values)


def detect_scan(s: Settings, seed_windows: int = 0) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas by (stream_id, feature): columns wid, value, hour, dow, and seed_mean, seed_var, seed_n, unless the
    first seed_windows windows are the seed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("wid")
        if seed_windows:
            mean, var, n = seed_of(pdf["value"].to_numpy(float)[:seed_windows])
            pdf = pdf.iloc[seed_windows:].assign(seed_mean=mean, seed_var=var, seed_n=n)
        if not len(pdf):
            return pd.DataFrame(columns=DETECTED_COLUMNS)
        first = pdf.iloc[0]
        seeded = first["seed_n"] > 0
        stats = (float(first["seed_mean"]), float(first["seed_var"]), int(first["seed_n"])) if seeded else None
        base = Baseline(s, {(int(first["hour"]), int(first["dow"])): stats} if seeded else None, stats)
        n = len(pdf)
        mean, var, z = np.empty(n), np.empty(n), np.empty(n)
        for i, (x, h, d) in enumerate(zip(pdf["value"].tolist(), pdf["hour"].tolist(), pdf["dow"].tolist(), strict=True)):
            mean[i], var[i] = base.get((h, d))
            z[i] = base.z(x, (h, d))
            base.update(x, (h, d))
        acc, sure = leaky(z, s)
        return pd.DataFrame({"stream_id": pdf["stream_id"], "wid": pdf["wid"], "feature": pdf["feature"], "ord": pdf["ord"], "value": pdf["value"], "mean": mean, "variance": var, "z": z, "accumulator": acc, "confirmed": sure})

    return run


DETECTED_COLUMNS = ["stream_id", "wid", "feature", "ord", "value", "mean", "variance", "z", "accumulator", "confirmed"]
DETECTED = "stream_id string, wid long, feature string, ord int, value double, mean double, variance double, z double, accumulator double, confirmed boolean"


def resumed_scan(s: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas by (stream_id, feature): rows marked `seed` update the baseline first, then the others are scanned."""
    detect = detect_scan(s)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, context = Baseline(s), (12, 0)
        for x in pdf[pdf["seed"]].sort_values("wid")["value"].tolist():
            base.update(x, context)
        mean, var, n = base.contexts.get(context, (0.0, 1.0, 0))
        rows = pdf[~pdf["seed"]]
        return detect(rows.assign(hour=12, dow=0, seed_mean=mean, seed_var=var, seed_n=n)) if len(rows) else pd.DataFrame(columns=DETECTED_COLUMNS)

    return run


def cooldown(times: np.ndarray, alert: np.ndarray, s: Settings) -> np.ndarray:
    """Which alerts count: those more than `cooldown` after the last that counted."""
    last, out = -200.0 * s.dt / 5.0, np.zeros(len(times), bool)
    for i, (t, on) in enumerate(zip(times.tolist(), alert.tolist(), strict=True)):
        if on and t - last > s.cooldown:
            out[i], last = True, t
    return out


def by_key(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(function, schema)
