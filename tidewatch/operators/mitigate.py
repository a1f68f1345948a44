"""Graduated response: the mitigation state machine, the latched tier and the alert cool-down, all on event time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators.scan import by_key, cooldown


class Responder:
    """Tier with hysteresis for one stream."""

    def __init__(self, s: Settings):
        self.s, self.tier = s, 0
        self.since1: float | None = None
        self.calm3: float | None = None
        self.calm: float | None = None

    def _held(self, name: str, on: bool, now: float, seconds: float) -> bool:
        """A timer that runs while `on`; true once it has run longer than asked."""
        started = getattr(self, name)
        if not on:
            setattr(self, name, None)
            return False
        if started is None:
            setattr(self, name, now)
            return False
        return now - started > seconds

    def step(self, now: float, score: float) -> int:
        s = self.s
        if self.tier == 1 and self.since1 is not None and now - self.since1 > s.hold1:
            self.tier = 2
        if self._held("calm3", self.tier == 3 and score < s.release3, now, s.hold3):
            self.tier, self.calm3 = 0, None
        if self._held("calm", score < s.alert, now, s.hold_all):
            self.tier, self.since1, self.calm = 0, None, None
        asked = 3 if score >= s.tier3 else 2 if score >= s.tier2 else 1 if score >= s.tier1 else 0
        if asked == 1 and self.since1 is None:
            self.since1 = now
        self.tier = max(self.tier, asked)
        return self.tier


def _respond(s: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        machine = Responder(s)
        tiers = [machine.step(t, x) for t, x in zip(pdf["t"].tolist(), pdf["score"].tolist(), strict=True)]
        return pd.DataFrame({"stream_id": pdf["stream_id"], "wid": pdf["wid"], "score": pdf["score"], "current_tier": tiers})

    return run


def respond(scored: DataFrame, s: Settings) -> DataFrame:
    """(stream_id, wid, score, current_tier) from rows (stream_id, wid, score)."""
    rows = scored.select("stream_id", "wid", "score", (F.col("wid") * F.lit(s.dt)).alias("t"))
    return by_key(rows, ["stream_id"], _respond(s), "stream_id string, wid long, score double, current_tier int")


def counted_alerts(scored: DataFrame, s: Settings) -> DataFrame:
    """(stream_id, wid, score, counted): alerts that count after the cool-down."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("wid")
        on = cooldown(pdf["wid"].to_numpy(float) * s.dt, pdf["score"].to_numpy() >= s.tier1, s)
        return pd.DataFrame({"stream_id": pdf["stream_id"], "wid": pdf["wid"], "score": pdf["score"], "counted": on})

    return by_key(scored.select("stream_id", "wid", "score"), ["stream_id"], run, "stream_id string, wid long, score double, counted boolean")


def latched_tier(scored: DataFrame, s: Settings) -> DataFrame:
    """(stream_id, wid, score, tier): the older engine's latch, where a score in [release3, tier1) keeps the tier.

    That is the highest tier asked for since the last score below release3."""
    order = Window.partitionBy("stream_id").orderBy("wid")
    low = F.sum((F.col("score") < s.release3).cast("int")).over(order)
    asked = F.when(F.col("score") >= s.tier3, 3).when(F.col("score") >= s.tier2, 2).when(F.col("score") >= s.tier1, 1).otherwise(0)
    rows = scored.select("stream_id", "wid", "score", low.alias("low_"), asked.alias("asked_"))
    return rows.select("stream_id", "wid", "score", F.max("asked_").over(Window.partitionBy("stream_id", "low_").orderBy("wid")).alias("tier"))


def first_detection(scored: DataFrame, attack_start: float, s: Settings) -> DataFrame:
    """(stream_id, detected_at, latency): the first window from attack_start on at tier 1 or more."""
    t = F.col("wid") * F.lit(s.dt)
    hit = F.min(F.when((t >= attack_start) & (F.col("score") >= s.tier1), t))
    return scored.groupBy("stream_id").agg(hit.alias("detected_at"), (hit - attack_start).alias("latency"), F.max("score").alias("peak_score"), F.min(F.when(t >= attack_start, F.col("score"))).alias("min_attack_score"))
