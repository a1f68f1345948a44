"""Protocol rules: per window, which events fire (each with confidence 1).

Rules read a table of a row a window (features.windows), which the features share.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import RULES, Settings
from tidewatch.operators.features import KEYS


def _exhausted(s: Settings) -> Column:
    return (F.col("max_source") > s.incomplete_per_source) | (F.col("max_subnet") > s.incomplete_per_subnet)


def _slow(s: Settings) -> Column:
    return (F.col("n_tiny") >= s.slow_tiny) | (F.col("n_slow") > s.slow_many)


def _homogeneous(s: Settings) -> Column:
    return (F.col("n_flows") >= s.agents_least_flows) & (F.col("n_agents") / F.col("n_flows") < s.agents_diversity)


def _burst(s: Settings) -> Column:
    return F.col("max_sources") > s.burst_sources


def _synchronised(s: Settings) -> Column:
    # Rounded where the order of additions can't reach.
    return ~_burst(s) & (F.col("n_sources") >= s.timing_sources) & (F.round("cv", 12) > s.timing_cv)


def connection_exhaustion(windows: DataFrame, s: Settings) -> DataFrame:
    """incomplete_handshake_spike: a source with too many incomplete flows, or else a /24."""
    return windows.select(*KEYS, "max_source", "max_subnet", _exhausted(s).alias("fired"))


def slow_requests(windows: DataFrame, s: Settings) -> DataFrame:
    """session_duration_anomaly: tiny long flows, or else many slow ones."""
    return windows.select(*KEYS, "n_tiny", "n_slow", _slow(s).alias("fired"))


def agent_homogeneity(windows: DataFrame, s: Settings) -> DataFrame:
    """user_agent_homogeneity: many flows, few agents (an empty one doesn't count)."""
    return windows.select(*KEYS, "n_flows", "n_agents", _homogeneous(s).alias("fired"))


def distributed(windows: DataFrame, s: Settings) -> DataFrame:
    """(burst, synchronised): many fresh sources in one /16; else high dispersion of requests over many sources."""
    return windows.select(*KEYS, "max_sources", "n_sources", "cv", _burst(s).alias("burst"), _synchronised(s).alias("synchronised"))


def _rate_scan(s: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("wid")
        r, out = s.rate_start, []
        for stream, wid, mean, records in zip(pdf["stream_id"], pdf["wid"], pdf["mean_rate"], pdf["records"], strict=True):
            limit = s.rate_multiplier * r
            over = next((x["rate"] for x in records if x["rate"] > limit), None)
            out.append((stream, wid, r, over is not None))
            r = s.rate_smoothing * (mean if over is None else over) + (1 - s.rate_smoothing) * r
        return pd.DataFrame(out, columns=["stream_id", "wid", "rate_baseline", "fired"])

    return run


def request_spike(windows: DataFrame, s: Settings) -> DataFrame:
    """per_source_request_spike: a source above rate_multiplier times a smoothed rate, which the offender moves."""
    rows = windows.select(*KEYS, "mean_rate", "records")
    return rows.groupBy("stream_id").applyInPandas(_rate_scan(s), "stream_id string, wid long, rate_baseline double, fired boolean")


def rule_events(windows: DataFrame, s: Settings) -> DataFrame:
    """(stream_id, wid, feature_id, ord, confidence) of all rules; ord follows the features' 0 to 17."""
    spike = request_spike(windows, s).select(*KEYS, F.col("fired").alias("spike"))
    # The agents rule isn't reached once a source spiked.
    fired = (_exhausted(s), _slow(s), F.col("spike"), _homogeneous(s) & ~F.col("spike"), _burst(s), _synchronised(s))
    entries = F.array(*[F.struct(F.lit(n).alias("feature_id"), F.lit(18 + k).alias("ord"), on.alias("on_")) for k, (n, on) in enumerate(zip(RULES, fired, strict=True))])
    return windows.join(spike, KEYS).select(*KEYS, F.inline(entries)).filter("on_").select(*KEYS, "feature_id", "ord", F.lit(1.0).alias("confidence"))
