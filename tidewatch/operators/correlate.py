"""Correlation of events over a sliding window, and the per-window result."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import FEATURES, Settings
from tidewatch.functions.scalars import action_text, tier_of
from tidewatch.operators import mitigate
from tidewatch.operators.features import KEYS

if TYPE_CHECKING:
    from tidewatch.plans.detector import Detection


def weight_table(spark, s: Settings) -> DataFrame:
    return spark.createDataFrame(list(s.weights.items()), "feature_id string, weight double")


def weighted(events: DataFrame, s: Settings) -> DataFrame:
    """events (feature_id, confidence) with their weight; one without an entry has the default.  The table of weights is the settings'."""
    w = weight_table(events.sparkSession, s)
    return events.join(F.broadcast(w), "feature_id", "left").withColumn("weight", F.coalesce("weight", F.lit(s.default_weight)))


def anomaly_events(detected: DataFrame) -> DataFrame:
    """(stream_id, wid, feature_id, ord, confidence) of confirmed deviations."""
    return detected.filter("confirmed").select(*KEYS, F.col("feature").alias("feature_id"), "ord", F.least(F.abs("z") / 5.0, F.lit(1.0)).alias("confidence"))


def matched(ids: tuple[str, ...], first: dict[str, Column]) -> Column:
    """How many of a template's ids first appear in its order.

    An automaton over the ids in order of their first appearance, as a fold: the state is (place of the last id matched, number), a step matches the next
    id if it first appears later.  An id that appears too early can't be matched later, as only first appearances count.
    """
    at = F.array(*[F.struct(first[i]["wid"].alias("wid"), first[i]["ord"].cast("int").alias("ord"), first[i].isNotNull().alias("there")) for i in ids])
    begin = F.struct(F.lit(None).cast("long").alias("wid"), F.lit(None).cast("int").alias("ord"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(state: Column, x: Column) -> Column:
        later = state["on"] & x["there"] & (state["wid"].isNull() | (x["wid"] > state["wid"]) | ((x["wid"] == state["wid"]) & (x["ord"] > state["ord"])))
        return F.struct(x["wid"].alias("wid"), x["ord"].alias("ord"), (state["n"] + later.cast("int")).alias("n"), later.alias("on"))

    return F.aggregate(at, begin, step, lambda state: state["n"])


def scores(events: DataFrame, spine: DataFrame, s: Settings) -> DataFrame:
    """(stream_id, wid, score, boosted, tier): capped weighted sum of the events of the last `window` seconds, both ends
    included, plus the boost where any template's ids first appear in order, as many as it asks for.  Events become one row a window before the range frame.
    """
    t = F.col("wid") * F.lit(round(s.dt * 1000))  # milliseconds: range frames want whole numbers
    ids = sorted({i for template, _ in s.templates for i in template})
    per = weighted(events, s).groupBy(*KEYS).agg(
        F.sum(F.col("weight") * F.col("confidence")).alias("sum_w"),
        *[F.min(F.when(F.col("feature_id") == name, F.struct(F.col("wid"), F.col("ord")))).alias(f"at{k}") for k, name in enumerate(ids)],
    )
    frame = Window.partitionBy("stream_id").orderBy(t).rangeBetween(-round(s.window * 1000), 0)
    out = spine.select(*KEYS).distinct().join(per, KEYS, "left")
    # Sums are rounded where the order of addition can't reach, so that a score on the edge of a tier doesn't depend on partitions.
    out = out.withColumns({"raw": F.least(F.round(F.coalesce(F.sum("sum_w").over(frame), F.lit(0.0)), 12), F.lit(1.0))} | {f"first{k}": F.min(f"at{k}").over(frame) for k in range(len(ids))})
    first = {name: F.col(f"first{k}") for k, name in enumerate(ids)}
    ordered = F.lit(False)
    for template, least in s.templates:
        ordered = ordered | (matched(template, first) >= least)
    out = out.withColumn("boosted", ordered).withColumn("score", F.when(F.col("boosted"), F.least(F.col("raw") + s.boost, F.lit(1.0))).otherwise(F.col("raw")))
    return out.select(*KEYS, "score", "boosted", tier_of("score", s).alias("tier"))


def top_anomaly(detected: DataFrame, rules: DataFrame) -> DataFrame:
    """(stream_id, wid, top_anomaly): the first rule event, else the feature with the largest positive accumulator
    (to 6 decimals; the first in order on a tie, as features that are multiples of each other tie but for rounding)."""
    best = detected.filter("accumulator > 0").groupBy(*KEYS).agg(F.max_by("feature", F.struct(F.round("accumulator", 6), -F.col("ord"))).alias("feature_"))
    rule = rules.groupBy(*KEYS).agg(F.min_by("feature_id", "ord").alias("rule_"))
    return best.join(rule, KEYS, "full").select(*KEYS, F.coalesce("rule_", "feature_").alias("top_anomaly"))


def affected_sources(sources: DataFrame, most: int = 100) -> DataFrame:
    """(stream_id, wid, n_sources, sources): the number of distinct sources and the first `most` by name, from one row a window and source."""
    order = Window.partitionBy(*KEYS).orderBy("src_ip")
    by = sources.select(*KEYS, "src_ip")
    first = by.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    n = by.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_sources"))
    return n.join(first.groupBy(*KEYS).agg(F.array_sort(F.collect_list("src_ip")).alias("sources")), KEYS)


def step_results(run: Detection, s: Settings) -> DataFrame:
    """The detector's result of every window as one nested row."""
    bare = lambda listed, *fields: F.transform(F.array_sort(listed), lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    detected = run.detected.withColumn("best_", F.when(F.col("accumulator") > 0, F.struct(F.round("accumulator", 6), -F.col("ord"))))
    sure = F.struct("ord", F.col("feature").alias("feature_id"), F.col("z").alias("z_score"), F.least(F.abs("z") / 5.0, F.lit(1.0)).alias("confidence"), "accumulator")
    anomalies = bare(F.collect_list(F.when(F.col("confirmed"), sure)), "feature_id", "z_score", "confidence", "accumulator")
    events = detected.groupBy(*KEYS).agg(anomalies.alias("anomalies"), F.max_by("feature", "best_").alias("feature_"))
    fired = run.rules.groupBy(*KEYS).agg(bare(F.collect_list(F.struct("ord", "feature_id", "confidence")), "feature_id", "confidence").alias("heuristics"))
    tiers = mitigate.respond(run.scored, s).select(*KEYS, "score", "current_tier")
    windows = run.tables.windows.select(*KEYS, "n_sources", F.struct(*FEATURES).alias("features"))
    sources = affected_sources(run.tables.sources).select(*KEYS, "sources")
    out = tiers.join(events, KEYS).join(windows, KEYS).join(fired, KEYS, "left").join(sources, KEYS, "left")
    none = F.array().cast(fired.schema["heuristics"].dataType)
    heuristics = F.coalesce("heuristics", none)
    return out.select(
        *KEYS,
        F.row_number().over(Window.partitionBy("stream_id").orderBy("wid")).alias("step"),
        (F.col("wid") * F.lit(s.dt)).alias("sim_time"),
        F.round("score", 6).alias("score"),
        F.col("current_tier").alias("tier"),
        "anomalies",
        heuristics.alias("heuristics"),
        F.coalesce(F.get(heuristics, F.lit(0))["feature_id"], F.col("feature_")).alias("top_anomaly"),
        action_text("score", "n_sources", s).alias("action_description"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("affected_sources"),
        "features",
    )


def recent_events(events: DataFrame, now: float, s: Settings) -> DataFrame:
    """The events that count at time `now`: those of the last `window` seconds."""
    t = F.col("wid") * F.lit(s.dt)
    return events.filter((t >= now - s.window) & (t <= now))


def event_log(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Feature and rule events in their order within a window."""
    return reduce(DataFrame.unionByName, [events, rules])
