"""The whole detector as one plan: flows to features, deviations, rules, score, response.

What several steps read is written once: sources, windows, deviations, rule events and scores, all but the first with a row a window or
series.  Flows themselves are read three times (see features).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import FEATURES, Settings
from tidewatch.operators import baseline, correlate, features, mitigate, prefix, rules, scan
from tidewatch.storage import stored, together


@dataclass
class Tables:
    """What is gathered from flows: sources of windows, and windows."""

    sources: DataFrame
    windows: DataFrame


@dataclass
class Detection:
    """The intermediate tables of one run."""

    tables: Tables
    detected: DataFrame
    rules: DataFrame
    scored: DataFrame

    @property
    def features(self) -> DataFrame:
        return self.tables.windows


def tables(flows: DataFrame, s: Settings) -> Tables:
    sources, values = together(flows.sparkSession, lambda: stored(features.source_rows(flows, s), "sources"), lambda: stored(features.value_statistics(flows), "values"))
    return Tables(sources, stored(features.window_rows(sources, values, s), "windows"))


def deviations(found: DataFrame, s: Settings, seed_windows: int, block_rows: int | None = None) -> DataFrame:
    """The state scan of every series after its seed windows, in the fixed context (12, 0).

    A series is one task, or with block_rows (and seed windows) a task for each so many of its windows: for streams of very many windows."""
    rows = features.long_form(found)
    if not block_rows or not seed_windows:
        return rows.withColumn("hour", F.lit(12)).withColumn("dow", F.lit(0)).groupBy("stream_id", "feature").applyInPandas(scan.detect_scan(s, seed_windows), scan.DETECTED)
    rows = stored(rows, "series")
    key = ["stream_id", "feature"]
    cuts = baseline.first_windows(rows, seed_windows).groupBy(*key).agg(F.max("wid").alias("cut_"))
    starts = stored(baseline.seed_statistics(rows, seed_windows).select(*key, F.col("seed_mean").alias("mean"), F.col("seed_var").alias("variance")), "series-starts")
    live = stored(rows.join(cuts, key).filter("wid > cut_").drop("cut_"), "series-live")
    place = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(FEATURES) for x in (name, k)]), F.col("feature"))
    return prefix.deviations(live, key, "wid", "value", starts, s, block_rows).withColumn("ord", place).select(*scan.DETECTED_COLUMNS)


def detect(got: Tables, s: Settings, seed_windows: int = 120) -> Detection:
    """One run over gathered tables; other settings of scans, weights or tiers need no other tables."""
    order = Window.partitionBy("stream_id").orderBy("wid")
    live = got.windows.select(*features.KEYS, F.row_number().over(order).alias("k")).filter(F.col("k") > seed_windows).drop("k")
    detected, fired = together(live.sparkSession, lambda: stored(deviations(got.windows, s, seed_windows), "detected"), lambda: stored(rules.rule_events(got.windows, s).join(live, features.KEYS, "left_semi"), "rules"))
    scored = stored(correlate.scores(correlate.event_log(correlate.anomaly_events(detected), fired), live, s), "scored")
    return Detection(got, detected, fired, scored)


def run(flows: DataFrame, s: Settings, seed_windows: int = 120) -> Detection:
    return detect(tables(flows, s), s, seed_windows)


def results(flows: DataFrame, s: Settings, seed_windows: int = 120) -> DataFrame:
    """One nested row a window: score, tier, events, top anomaly, text, sources, features."""
    return correlate.step_results(run(flows, s, seed_windows), s)
