"""The eighteen features of an observation window.

Flows have columns stream_id, wid and the flow record.  They are read three times, each time for an aggregate whose
partial results are merged after the shuffle, so a window under attack, or one source that sends a third of all flows, is no
hot task: the windows' latest ends; sums by source; counts by value (country, payload size, agent).  Windows are then
aggregates of sources and values, and give features and rules alike.  The latest ends are joined to flows: sent to every task
while they are few, else by a join in which a window's flows are dealt over SALTS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import FEATURES, Settings
from tidewatch.functions.scalars import duration, is_tcp, subnet
from tidewatch.storage import stored

KEYS = ["stream_id", "wid"]
#: A table of a row a window is sent to every task up to this many rows (some tens of MB).
SENT_WINDOWS = 500_000
SALTS = 16


def _bits(n: Column, clogc: Column) -> Column:
    """Shannon entropy (bits) from the total n and the sum of c log2 c."""
    return F.greatest(F.lit(0.0), F.log2(n) - clogc / n)


def entropy(df: DataFrame, keys: list[str], value: Column, name: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) of the non-null values of each group."""
    c = df.select(*keys, value.alias("value_")).filter("value_ IS NOT NULL").groupBy(*keys, "value_").agg(F.count(F.lit(1)).alias("c_"))
    return c.groupBy(*keys).agg(_bits(F.sum("c_"), F.sum(F.col("c_") * F.log2("c_"))).alias(name))


def with_now(flows: DataFrame) -> DataFrame:
    """flows with now: the window's latest end."""
    now = stored(flows.groupBy(*KEYS).agg(F.max("last_time").alias("now")), "windows-now")
    if now.count() <= SENT_WINDOWS:
        return flows.join(F.broadcast(now), KEYS)
    salted = now.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return flows.withColumn("salt_", F.pmod(F.hash("src_ip", "flow_seq"), F.lit(SALTS))).join(salted, [*KEYS, "salt_"]).drop("salt_")


def source_rows(flows: DataFrame, s: Settings) -> DataFrame:
    """Per window and source, the sums from which windows are made (plain sums of numbers keep the aggregate's code short)."""
    f = with_now(flows).withColumn("dur", duration())
    live = F.col("last_time") >= F.col("now") - s.window
    one = lambda condition: condition.cast("int")
    summed = {
        "requests": F.col("request_count"),
        "n_new": one(F.col("start_time") >= F.col("now") - s.dt),
        "n_live": one(live),
        "live_time": F.when(live, F.col("dur")).otherwise(0.0),
        "live_square": F.when(live, F.col("dur") * F.col("dur")).otherwise(0.0),
        "n_complete": one(F.col("handshake_complete")),
        "complete_time": F.when(F.col("handshake_complete"), F.col("dur")).otherwise(0.0),
        "n_violations": one(F.col("protocol_violation")),
        "n_errors": one(F.col("response_status") >= 400),
        "n_tcp": one(is_tcp("proto")),
        "n_tiny": one((F.col("dur") > s.slow_tiny_seconds) & (F.col("bytes_sent") < s.slow_tiny_bytes)),
        "n_slow": one((F.col("dur") > s.slow_many_seconds) & (F.col("bytes_sent") < s.slow_many_bytes)),
    }
    rows = f.select(*KEYS, "src_ip", "flow_seq", "start_time", "now", "dur", *[c.alias(n) for n, c in summed.items()])
    return rows.groupBy(*KEYS, "src_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("now").alias("now"),
        F.min("flow_seq").alias("first_seq"),
        F.max("start_time").alias("latest_start"),
        F.greatest(F.max("dur"), F.lit(s.dt)).alias("longest"),
        *[F.sum(n).alias(n) for n in summed],
    )


def source_totals(flows: DataFrame) -> DataFrame:
    """Per window, statistics over its sources' request sums."""
    return _totals_of(flows.groupBy(*KEYS, "src_ip").agg(F.sum("request_count").alias("requests")))


def _over_sources() -> list[Column]:
    r = F.col("requests").cast("double")
    return [F.count(F.lit(1)).alias("n_sources"), F.var_pop(r).alias("request_variance"), F.stddev_pop(r).alias("request_std"), F.avg(r).alias("request_mean")]


def _totals_of(sources: DataFrame) -> DataFrame:
    return sources.groupBy(*KEYS).agg(*_over_sources())


def variation(std: str, mean: str, s: Settings) -> Column:
    """Coefficient of variation with a guarded denominator."""
    return F.col(std) / F.greatest(F.col(mean), F.lit(s.epsilon))


def window_totals(sources: DataFrame, s: Settings) -> DataFrame:
    """Per window, what one aggregate of its sources gives."""
    n, live = F.sum("n"), F.sum("n_live")
    mean = F.when(live > 0, F.sum("live_time") / live).otherwise(0.0)
    square = F.when(live > 0, F.sum("live_square") / live).otherwise(0.0)
    complete = F.sum("n_complete")
    return sources.groupBy(*KEYS).agg(
        n.alias("n_flows"),
        (F.sum("n_new") / s.dt).alias("new_connection_rate"),
        live.alias("n_live"),
        mean.alias("mean_connection_duration"),
        F.greatest(square - mean * mean, F.lit(0.0)).alias("variance_connection_duration"),
        (complete / n).alias("handshake_completion_ratio"),
        (F.sum("requests") / s.dt).alias("request_rate"),
        F.sum("requests").alias("requests"),
        (1 - F.sum("n_violations") / n).alias("protocol_compliance_score"),
        F.sum("n_errors").alias("n_errors"),
        F.when(complete > 0, F.sum("complete_time") / complete).otherwise(0.0).alias("response_latency_mean"),
        (F.sum("n_tcp") / n).alias("protocol_frequency_ratio"),
        F.sum("n_tiny").alias("n_tiny"),
        F.sum("n_slow").alias("n_slow"),
        F.max(F.col("n") - F.col("n_complete")).alias("max_source"),
        *_over_sources(),
    )


def value_statistics(flows: DataFrame) -> DataFrame:
    """Per window, the entropies of countries and payload sizes and the number of agents: one pass, a row a flow and kind."""
    kinds = (("geo", F.nullif(F.col("country_code"), F.lit(""))), ("payload", F.col("bytes_sent").cast("string")), ("agent", F.nullif(F.col("user_agent"), F.lit(""))))
    rows = flows.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds])))
    c = rows.filter("value IS NOT NULL").groupBy(*KEYS, "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    h = lambda kind: _bits(of(kind, F.col("c")), of(kind, F.col("c") * F.log2("c"))).alias(kind)
    return c.groupBy(*KEYS).agg(h("geo"), h("payload"), F.count_if(F.col("kind") == "agent").alias("n_agents"))


def net_maxima(sources: DataFrame, s: Settings) -> DataFrame:
    """Per window, the most incomplete flows of a /24 and the most fresh sources of a /16, in one pass over sources."""
    fresh = (F.col("latest_start") >= F.col("now") - s.burst_window).cast("long")
    kinds = (("max_subnet", subnet("src_ip", 3), F.col("n") - F.col("n_complete")), ("max_sources", subnet("src_ip", 2), fresh))
    rows = sources.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), net.alias("net"), n.alias("n")) for k, net, n in kinds])))
    by = rows.groupBy(*KEYS, "kind", "net").agg(F.sum("n").alias("n"))
    return by.groupBy(*KEYS).agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k, _, _ in kinds])


def rate_records(sources: DataFrame, s: Settings) -> DataFrame:
    """Per window, its record rates: the sources, by first arrival, whose rate exceeds all before.

    Whatever the threshold, the first source above it is one of these; so the state scan gets a short array a
    window, not its sources.  A record of the window is a record of any part of it: sources are dealt over SALTS, and
    only the parts' records meet.
    """
    rows = sources.select(*KEYS, "src_ip", "first_seq", (F.col("requests") / F.col("longest")).alias("rate"), F.pmod(F.hash("src_ip"), F.lit(SALTS)).alias("salt_"))
    for part in ([*KEYS, "salt_"], KEYS):
        before = Window.partitionBy(*part).orderBy("first_seq", "src_ip").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("best_", F.max("rate").over(before)).filter("best_ IS NULL OR rate > best_").drop("best_")
    return rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("first_seq", "rate"))).alias("records"))


def window_rows(sources: DataFrame, values: DataFrame, s: Settings) -> DataFrame:
    """(stream_id, wid, n_flows, the 18 features, what the rules look at); windows without flows have no row.

    All joined tables have one row a window and keep the partitions of their aggregation; what a reader doesn't select isn't
    computed."""
    out = window_totals(sources, s).join(values, KEYS, "left").join(net_maxima(sources, s), KEYS, "left").join(rate_records(sources, s), KEYS, "left")
    order = Window.partitionBy("stream_id").orderBy("wid")
    out = out.withColumn("geographic_entropy", F.coalesce("geo", F.lit(0.0)))
    return out.select(
        *KEYS,
        "n_flows",
        "new_connection_rate",
        (F.col("n_live") / F.greatest("n_sources", F.lit(1))).alias("concurrent_connection_count"),
        "mean_connection_duration",
        "variance_connection_duration",
        "handshake_completion_ratio",
        "request_rate",
        F.col("request_variance").alias("inter_request_timing_variance"),
        "protocol_compliance_score",
        F.col("request_rate").alias("total_request_rate"),
        F.col("n_sources").cast("double").alias("unique_source_count"),
        "geographic_entropy",
        (F.col("n_errors") / F.greatest("requests", F.lit(1))).alias("backend_error_rate"),
        "response_latency_mean",
        (F.col("n_sources") * 60.0 / s.dt).alias("source_diversity_per_minute"),
        F.abs(F.col("geographic_entropy") - F.lag("geographic_entropy", 1, 0.0).over(order)).alias("geo_distribution_shift_rate"),
        F.when(F.col("n_sources") < 2, 0.0).otherwise(F.least(variation("request_std", "request_mean", s), F.lit(1.0))).alias("cross_source_timing_correlation"),
        "protocol_frequency_ratio",
        F.coalesce("payload", F.lit(0.0)).alias("payload_entropy_proxy"),
        "n_sources",
        "n_tiny",
        "n_slow",
        F.coalesce("n_agents", F.lit(0)).alias("n_agents"),
        "max_source",
        "max_subnet",
        "max_sources",
        variation("request_std", "request_mean", s).alias("cv"),
        (F.col("requests") / F.greatest("n_sources", F.lit(1)) / s.dt).alias("mean_rate"),
        "records",
    )


def windows(flows: DataFrame, s: Settings) -> DataFrame:
    """window_rows of flows."""
    return window_rows(source_rows(flows, s), value_statistics(flows), s)


def features(flows: DataFrame, s: Settings) -> DataFrame:
    """(stream_id, wid, n_flows, the 18 features)."""
    return windows(flows, s).select(*KEYS, "n_flows", *FEATURES)


def spine(found: DataFrame) -> DataFrame:
    """(stream_id, wid): every window from a stream's first to its last."""
    ends = found.groupBy("stream_id").agg(F.min("wid").alias("a"), F.max("wid").alias("z"))
    return ends.select("stream_id", F.explode(F.sequence("a", "z")).alias("wid"))


def on_spine(found: DataFrame, spine: DataFrame) -> DataFrame:
    """Features on every window of the spine (stream_id, wid); all zero where no flow came."""
    joined = spine.join(found, KEYS, "left")
    return joined.select(*KEYS, *[F.coalesce(F.col(c), F.lit(0).cast(found.schema[c].dataType)).alias(c) for c in found.columns if c not in KEYS])


def long_form(found: DataFrame) -> DataFrame:
    """(stream_id, wid, feature, ord, value): a row a feature; ord is its place in FEATURES."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("ord"), F.col(f).cast("double").alias("value")) for i, f in enumerate(FEATURES)])
    return found.select(*KEYS, F.inline(entries))
