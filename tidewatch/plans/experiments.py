"""Experiments: attack runs, ablation grid, false positives of quiet hours, evaluation over labelled files."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators import correlate, evaluate, features, mitigate, rules, scan, simulate
from tidewatch.plans import detector
from tidewatch.storage import stored

ATTACK_START = 30.0


def run_rows(scored: DataFrame, s: Settings, attack_start: float = ATTACK_START) -> DataFrame:
    """(stream_id, scenario_id, rep, detected, latency, peak_score, duration, outcome counts): a row a run `scenario-rep`."""
    rows = scored.filter("wid >= 0")
    first = mitigate.first_detection(rows, attack_start, s).select("stream_id", "latency", "peak_score")
    counts = evaluate.outcome_counts(rows, F.col("wid") * F.lit(s.dt) >= attack_start, s.tier1).select("stream_id", F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"), F.col("tn").alias("true_negatives"))
    out = first.join(counts, "stream_id").withColumn("duration", (F.col("true_positives") + F.col("false_positives") + F.col("false_negatives") + F.col("true_negatives")) * s.dt)
    return out.withColumns({"scenario_id": F.substring_index("stream_id", "-", 1), "rep": F.substring_index("stream_id", "-", -1).cast("int"), "detected": F.col("latency").isNotNull()})


def configurations(s: Settings) -> dict[str, Settings]:
    """The ablations.  NoEWMA and Single are switches that nothing reads in the compared method: they equal Full."""
    # The confirmation level without accumulation.
    return {"Full": s, "NoEWMA": s, "NoLeaky": replace(s, theta=0.001), "NoWeight": replace(s, weights=dict.fromkeys(s.weights, 1 / len(s.weights))), "Single": s}


def ablation_runs(flows: DataFrame, s: Settings, seed_windows: int = 120) -> DataFrame:
    """run_rows of every configuration, with config.  Flows are gathered once; equal configurations run once."""
    got = detector.tables(flows, s)
    named: dict[str, list[str]] = {}
    settings = configurations(s)
    for name, own in settings.items():
        named.setdefault(repr(own), []).append(name)
    parts = [stored(run_rows(detector.detect(got, settings[names[0]], seed_windows).scored, s), "ablation").withColumn("config", F.explode(F.array(*map(F.lit, names)))) for names in named.values()]
    return reduce(DataFrame.unionByName, parts)


def false_positives(spark: SparkSession, s: Settings, windows: int = 8640, seed_windows: int = 120) -> DataFrame:
    """(stream_id, windows, alerts, fp_count): alerts of legitimate hours, and those that count after the cool-down."""
    scored = detector.run(simulate.quiet(spark, windows, s.dt, seed_windows=seed_windows), s, seed_windows).scored
    counted = mitigate.counted_alerts(scored, s)
    return counted.groupBy("stream_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("score") >= s.tier1).alias("alerts"), F.count_if("counted").alias("fp_count"))


def evaluate_files(flows: DataFrame, s: Settings, seed_windows: int = 120) -> DataFrame:
    """(stream_id, tp, fp, fn, tn, precision, recall, f1, latency_seconds, windows): a row a file, then macro means (null stream).

    flows: labelled flows, a stream a file (status 200 is benign, 0 an attack).  Baselines are updated over the first
    seed_windows windows' benign flows; then all windows are steps, timed by their number.
    """
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("wid"))
    benign = stored(features.features(flows.filter("response_status = 200"), s).withColumn("k", number).filter(F.col("k") <= seed_windows).drop("k"), "benign-windows")
    truth = flows.groupBy(*features.KEYS).agg(F.bool_or(F.col("response_status") == 0).alias("attack"))
    windows = stored(features.windows(flows, s).join(truth, features.KEYS).withColumn("k", number.cast("long")).drop("wid").withColumnRenamed("k", "wid"), "file-windows")
    series = features.long_form(benign).withColumn("seed", F.lit(True)).unionByName(features.long_form(windows).withColumn("seed", F.lit(False)))
    detected = stored(series.groupBy("stream_id", "feature").applyInPandas(scan.resumed_scan(s), scan.DETECTED), "file-detected")
    spine = windows.select(*features.KEYS)
    scored = correlate.scores(correlate.event_log(correlate.anomaly_events(detected), rules.rule_events(windows, s)), spine, s).join(windows.select(*features.KEYS, "attack"), features.KEYS)
    counts = evaluate.outcome_counts(stored(scored, "file-scores"), F.col("attack"), s.tier1)
    rates = evaluate.confusion(*map(F.col, ("tp", "fp", "fn", "tn")))
    per = counts.select("stream_id", "tp", "fp", "fn", "tn", *[rates[k].alias(k) for k in ("precision", "recall", "f1")], ((F.col("first_wid") - F.col("attack_wid")) * F.lit(s.dt)).alias("latency_seconds"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("windows"))
    means = ("precision", "recall", "f1", "latency_seconds")
    return per.unionByName(per.agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "windows")]).withColumn("stream_id", F.lit(None).cast("string")))
