"""Registry of the engine's queries and their SQL twins.

A query takes (spark, sf_dir).  Doubles are rounded alike on both sides.  SEED windows of each series seed its baseline.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import FEATURES, Settings
from tidewatch.functions import scalars
from tidewatch.operators import asof, baseline, capture, correlate, evaluate, features, mitigate, packets, prefix, ranges, rules, scan, simulate
from tidewatch.plans import detector, experiments, twins
from tidewatch.plans.twins import FLOWS, LONG, ORDER_FLOWS, RULE_EVENTS, SHIFT, build, rounded
from tidewatch.sources import telemetry
from tidewatch.sources.adapters import event_flows, micros, order_flows, table
from tidewatch.storage import shared_folder, stored
from tidewatch.streaming import detector as online

#: Hourly windows; thresholds fit the sparse event table, where a source sends a few requests an hour (a start rate of about one in
#: half an hour) and windows hold some tens of flows: on it every rule fires in some windows and not in others.
S = Settings().scaled(3600.0, incomplete_per_source=4, incomplete_per_subnet=12, slow_tiny=2, slow_many=4, rate_start=0.0005, agents_least_flows=20, burst_sources=10, timing_sources=8, timing_cv=0.5, tau_z=2.0, theta=2.0)
#: Monthly windows over order lines.
O = Settings().scaled(2_592_000.0)
SEED = 48
KEYS = ["stream_id", "wid"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _round(df: DataFrame, *names: str, digits: int = 6, shift: float = 0.0) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double") + F.lit(shift * 10.0**-digits), digits) for n in names})


BASE = build(FLOWS)
FEATS = (FLOWS, twins.features(S))
DET = (*FEATS, LONG, twins.seed(SEED), twins.detected(S, SEED))
RULES_SQL = (*FEATS, twins.rules(S), twins.spikes(S), RULE_EVENTS)
FULL = (*DET, twins.rules(S), twins.spikes(S), RULE_EVENTS, twins.weights(S), "live AS MATERIALIZED (SELECT DISTINCT stream_id, wid FROM det)", "all_events AS MATERIALIZED (SELECT stream_id, wid, feature AS feature_id, ord, least(abs(z) / 5.0::DOUBLE, 1) AS confidence FROM det WHERE accumulator > %s UNION ALL SELECT e.* FROM rule_events e JOIN live USING (stream_id, wid))" % S.theta)
#: A score series of its own for the state machines: a slow wave with jitter, exact in both engines.
WAVE = "wave AS (SELECT stream_id, wid, least(abs((wid % 80) - 40) / 40.0::DOUBLE + (n % 5) / 50.0::DOUBLE, 1) AS score FROM (SELECT stream_id, wid, count(*) AS n FROM flows GROUP BY ALL))"


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return event_flows(spark, d)


def _feats(spark: SparkSession, d: str) -> DataFrame:
    return features.features(_flows(spark, d), S)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return features.windows(_flows(spark, d), S)


def _fired(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_events(stored(_windows(spark, d), "windows"), S)


def _long(spark: SparkSession, d: str) -> DataFrame:
    return features.long_form(_feats(spark, d))


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return detector.deviations(_feats(spark, d), S, SEED)


def _wave(spark: SparkSession, d: str) -> DataFrame:
    by = _flows(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return by.select(*KEYS, F.least(F.abs(F.col("wid") % 80 - 40) / 40.0 + F.col("n") % 5 / 50.0, F.lit(1.0)).alias("score"))


# -- features ---------------------------------------------------------------------------------------


@_query("features_window", build(*FEATS) + f"SELECT stream_id, wid, n_flows, {rounded(FEATURES, 4, SHIFT)} FROM feats")
def _(spark, d):
    return _round(_feats(spark, d), *FEATURES, digits=4, shift=SHIFT)


@_query("features_orders", build(ORDER_FLOWS, twins.features(O)) + f"SELECT stream_id, wid, n_flows, {rounded(FEATURES, 4, SHIFT)} FROM feats")
def _(spark, d):
    return _round(features.features(order_flows(spark, d), O), *FEATURES, digits=4, shift=SHIFT)


@_query("feature_entropy", BASE + "SELECT stream_id, wid, round(-sum(c / n * log2(c / n)) + 0, 6) AS entropy FROM (SELECT stream_id, wid, c, sum(c) OVER (PARTITION BY stream_id, wid) AS n FROM (SELECT stream_id, wid, country_code, count(*) AS c FROM flows GROUP BY ALL)) GROUP BY ALL")
def _(spark, d):
    return _round(features.entropy(_flows(spark, d), KEYS, F.col("country_code")), "entropy")


@_query("feature_spine_zero_fill", build(*FEATS, "spine AS (SELECT stream_id, unnest(range(a, z + 1)) AS wid FROM (SELECT stream_id, min(wid) AS a, max(wid) AS z FROM feats GROUP BY ALL))") + f"SELECT s.stream_id, s.wid, coalesce(n_flows, 0) AS n_flows, {', '.join(f'round(CAST(coalesce({f}, 0) AS DOUBLE) + {SHIFT * 1e-4!r}::DOUBLE, 4) AS {f}' for f in FEATURES)} FROM spine s LEFT JOIN feats USING (stream_id, wid)")
def _(spark, d):
    found = stored(_feats(spark, d), "features")
    return _round(features.on_spine(found, features.spine(found)), *FEATURES, digits=4, shift=SHIFT)


@_query("geo_shift_lag", build(*FEATS) + f"SELECT stream_id, wid, {rounded(['geographic_entropy', 'geo_distribution_shift_rate'], 6, SHIFT)} FROM feats")
def _(spark, d):
    return _round(_feats(spark, d).select(*KEYS, "geographic_entropy", "geo_distribution_shift_rate"), "geographic_entropy", "geo_distribution_shift_rate", shift=SHIFT)


@_query("feature_long_form", build(*FEATS, LONG) + f"SELECT stream_id, wid, feature, CAST(ord AS INTEGER) AS ord, {rounded(['value'], 4, SHIFT)} FROM long")
def _(spark, d):
    return _round(_long(spark, d), "value", digits=4, shift=SHIFT)


# -- rules ------------------------------------------------------------------------------------------


@_query("rule_connection_exhaustion", build(*FEATS, twins.rules(S)) + "SELECT * FROM exhausted")
def _(spark, d):
    return rules.connection_exhaustion(_windows(spark, d), S)


@_query("rule_slowloris", build(*FEATS, twins.rules(S)) + "SELECT * FROM slow")
def _(spark, d):
    return rules.slow_requests(_windows(spark, d), S)


@_query("rule_ua_homogeneity", build(*FEATS, twins.rules(S)) + "SELECT * FROM agents")
def _(spark, d):
    return rules.agent_homogeneity(_windows(spark, d), S)


@_query("rule_distributed", build(*FEATS, twins.rules(S)) + "SELECT stream_id, wid, max_sources, n_sources, round(cv, 6) AS cv, burst, synchronised FROM many")
def _(spark, d):
    return _round(rules.distributed(_windows(spark, d), S), "cv")


@_query("rule_http_flood_state", build(*FEATS, twins.spikes(S), recursive=True) + "SELECT stream_id, wid, round(rate_baseline, 9) AS rate_baseline, fired FROM spike")
def _(spark, d):
    return _round(rules.request_spike(_windows(spark, d), S), "rate_baseline", digits=9)


@_query("rule_events", build(*RULES_SQL, recursive=True) + "SELECT stream_id, wid, feature_id, CAST(ord AS INTEGER) AS ord, confidence FROM rule_events")
def _(spark, d):
    return _fired(spark, d)


# -- baselines and scans ------------------------------------------------------------------------------


@_query("baseline_seed_stats", build(*FEATS, LONG, twins.seed(SEED)) + f"SELECT stream_id, feature, {rounded(['seed_mean', 'seed_sd'], 3, SHIFT)}, seed_n FROM (SELECT *, sqrt(seed_var) AS seed_sd FROM seed)")
def _(spark, d):
    return _round(baseline.seed_statistics(_long(spark, d), SEED).withColumn("seed_sd", F.sqrt("seed_var")), "seed_mean", "seed_sd", digits=3, shift=SHIFT).drop("seed_var")


_HOURLY = "obs AS MATERIALIZED (SELECT 'all' AS stream_id, event_type AS feature, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, event_id, value FROM events)"
_CONTEXTS = """ranked_obs AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY stream_id, feature, hour, dow) AS n FROM obs WINDOW w AS (PARTITION BY stream_id, feature, hour, dow ORDER BY value)),
quart AS (SELECT stream_id, feature, hour, dow, n, max(CASE WHEN rn = n // 4 + 1 THEN value END) AS q1, max(CASE WHEN rn = n // 2 + 1 THEN value END) AS q2, max(CASE WHEN rn = (3 * n) // 4 + 1 THEN value END) AS q3 FROM ranked_obs WHERE n >= 5 GROUP BY ALL),
contexts AS MATERIALIZED (SELECT stream_id, feature, hour, dow, avg(value) AS mean, var_pop(value) AS variance, count(*) AS n FROM obs JOIN quart USING (stream_id, feature, hour, dow) WHERE value BETWEEN q2 - 1.5 * (q3 - q1) AND q2 + 1.5 * (q3 - q1) GROUP BY ALL),
overall AS (SELECT stream_id, feature, avg(mean) AS mean, avg(variance) AS variance, sum(n) AS n FROM contexts GROUP BY ALL)"""


def _observations(spark, d) -> DataFrame:
    hour, dow = scalars.context("ts")
    return table(spark, d, "events").select(F.lit("all").alias("stream_id"), F.col("event_type").alias("feature"), hour.alias("hour"), dow.alias("dow"), "event_id", "value")


@_query("baseline_iqr_context", build(_HOURLY, _CONTEXTS) + f"SELECT stream_id, feature, hour, dow, {rounded(['mean', 'sd'], 4, SHIFT)}, n FROM (SELECT *, sqrt(variance) AS sd FROM contexts)")
def _(spark, d):
    return _round(baseline.learned_contexts(_observations(spark, d), 5).withColumn("sd", F.sqrt("variance")), "mean", "sd", digits=4, shift=SHIFT).drop("variance")


@_query("baseline_global", build(_HOURLY, _CONTEXTS) + f"SELECT stream_id, feature, {rounded(['mean', 'sd'], 4, SHIFT)}, CAST(n AS BIGINT) AS n FROM (SELECT *, sqrt(variance) AS sd FROM overall)")
def _(spark, d):
    return _round(baseline.learned_overall(baseline.learned_contexts(_observations(spark, d), 5)).withColumn("sd", F.sqrt("variance")), "mean", "sd", digits=4, shift=SHIFT).drop("variance")


@_query("baseline_fallback_join", build(_HOURLY, _CONTEXTS) + "SELECT event_id, round(coalesce(c.mean, o.mean, 0), 6) AS mean, round((value - coalesce(c.mean, o.mean, 0)) / greatest(sqrt(greatest(coalesce(c.variance, o.variance, 1), 0)), 1e-9), 6) AS z FROM obs LEFT JOIN contexts c USING (stream_id, feature, hour, dow) LEFT JOIN overall o USING (stream_id, feature)")
def _(spark, d):
    rows = _observations(spark, d)
    contexts = baseline.learned_contexts(rows, 5)
    return _round(baseline.looked_up(rows, contexts, baseline.learned_overall(contexts), S), "mean", "z").select("event_id", "mean", "z")


_DAILY = "daily AS (SELECT event_type AS key, epoch_us(ts) // 86400000000 AS t, CAST(sum(value) AS DOUBLE) AS x FROM events GROUP BY ALL), dr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS rn FROM daily)"


def _daily(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.floor(micros() / 86_400_000_000).cast("long").alias("t"), "value").groupBy("key", "t").agg(F.sum("value").alias("x"))


@_query("ewma_post_zscore", build(_DAILY, "e AS (SELECT key, t, rn, x, x AS mean, 0.0::DOUBLE AS variance, 0.0::DOUBLE AS z FROM dr WHERE rn = 1 UNION ALL SELECT key, t, rn, x, mean, variance, CASE WHEN variance > 0 THEN (x - mean) / sqrt(variance) ELSE 0 END FROM (SELECT key, t, rn, x, mean, 0.3::DOUBLE * power(x - mean, 2) + 0.7::DOUBLE * pv AS variance FROM (SELECT d.key, d.t, d.rn, d.x, 0.3::DOUBLE * d.x + 0.7::DOUBLE * e.mean AS mean, e.variance AS pv FROM e JOIN dr d ON d.key = e.key AND d.rn = e.rn + 1)))", recursive=True) + f"SELECT key, t, {rounded(['x', 'mean', 'variance', 'z'], 4)} FROM e")
def _(spark, d):
    return _round(scan.ewma_native(_daily(spark, d), ["key"], "t", "x", 0.3), "x", "mean", "variance", "z", digits=4).drop("n")


@_query("ewma_zscore", build(*DET, recursive=True) + f"SELECT stream_id, wid, feature, {rounded(['value', 'mean', 'sd'], 3, SHIFT)}, {rounded(['z'], 4, SHIFT)} FROM (SELECT *, sqrt(variance) AS sd FROM det)")
def _(spark, d):
    out = _round(_detected(spark, d).withColumn("sd", F.sqrt("variance")), "value", "mean", "sd", digits=3, shift=SHIFT)
    return _round(out, "z", digits=4, shift=SHIFT).drop("ord", "accumulator", "confirmed", "variance")


@_query("leaky_accumulator", build(*DET, recursive=True) + f"SELECT stream_id, wid, feature, round(accumulator, 3) AS accumulator, accumulator > {S.theta} AS confirmed FROM det")
def _(spark, d):
    return _round(_detected(spark, d).select(*KEYS, "feature", "accumulator", "confirmed"), "accumulator", digits=3)


@_query("leaky_native", build(_DAILY, "zs AS MATERIALIZED (SELECT key, t, rn, (x - avg(x) OVER (PARTITION BY key)) / stddev_pop(x) OVER (PARTITION BY key) AS z FROM dr), l AS (SELECT key, t, rn, z, CASE WHEN abs(z) > 1 THEN abs(z) - 1 ELSE 0 END AS a FROM zs WHERE rn = 1 UNION ALL SELECT q.key, q.t, q.rn, q.z, CASE WHEN abs(q.z) > 1 THEN l.a + (abs(q.z) - 1) ELSE l.a * 0.8::DOUBLE END FROM l JOIN zs q ON q.key = l.key AND q.rn = l.rn + 1)", recursive=True) + "SELECT key, t, round(a, 5) AS accumulator, a > 1.5 AS confirmed FROM l")
def _(spark, d):
    w = Window.partitionBy("key")
    z = _daily(spark, d).withColumn("z", (F.col("x") - F.avg("x").over(w)) / F.stddev_pop("x").over(w))
    return _round(scan.leaky_native(z, ["key"], "t", "z", Settings(tau_z=1.0, theta=1.5)), "accumulator", digits=5).drop("z")


# -- correlation ----------------------------------------------------------------------------------------


@_query("anomaly_events", build(*DET, recursive=True) + f"SELECT stream_id, wid, feature AS feature_id, CAST(ord AS INTEGER) AS ord, round(least(abs(z) / 5.0::DOUBLE, 1), 5) AS confidence FROM det WHERE accumulator > {S.theta}")
def _(spark, d):
    return _round(correlate.anomaly_events(_detected(spark, d)), "confidence", digits=5)


@_query("weights_left_join", build(*RULES_SQL, twins.weights(S), recursive=True) + f"SELECT stream_id, wid, feature_id, coalesce(weight, {S.default_weight}::DOUBLE) AS weight FROM (SELECT stream_id, wid, CASE WHEN ord = 19 THEN 'unlisted' ELSE feature_id END AS feature_id FROM rule_events) LEFT JOIN weights USING (feature_id)")
def _(spark, d):
    e = _fired(spark, d).withColumn("feature_id", F.when(F.col("ord") == 19, "unlisted").otherwise(F.col("feature_id")))
    return correlate.weighted(e, S).select(*KEYS, "feature_id", "weight")


@_query("correlation_score", build(*FULL, twins.scored(S, "all_events"), recursive=True) + f"SELECT stream_id, wid, round(score, 5) AS score, boosted, {twins.tier('score', S)} AS tier FROM scored JOIN live USING (stream_id, wid)")
def _(spark, d):
    return _round(detector.run(_flows(spark, d), S, SEED).scored, "score", digits=5)


@_query("template_boost", build(*RULES_SQL, twins.weights(S), twins.scored(S, "rule_events"), recursive=True) + "SELECT stream_id, wid, round(score, 6) AS score, boosted FROM scored")
def _(spark, d):
    windows = stored(_windows(spark, d), "windows")
    return _round(correlate.scores(rules.rule_events(windows, S), windows.select(*KEYS), S), "score").drop("tier")


@_query("tier_case", build(FLOWS, WAVE) + f"SELECT stream_id, wid, round(score, 6) AS score, {twins.tier('score', S)} AS tier FROM wave")
def _(spark, d):
    return _round(_wave(spark, d).withColumn("tier", scalars.tier_of("score", S)), "score")


@_query("action_text", build(FLOWS, WAVE) + "SELECT stream_id, wid, CASE WHEN score < 0.5 THEN 'Monitoring' WHEN score < 0.7 THEN 'ALERT: Score ' || printf('%.3f', score) || ' - manual review recommended' WHEN score < 0.85 THEN 'TIER-1: Rate limiting ' || n || ' sources to 2x baseline' WHEN score < 0.9 THEN 'TIER-2: Aggressive limiting + challenges for ' || n || ' sources' ELSE 'TIER-3: BLOCKING ' || n || ' top sources (5-min expiry)' END AS action FROM wave JOIN (SELECT stream_id, wid, count(DISTINCT src_ip) AS n FROM flows GROUP BY ALL) USING (stream_id, wid)")
def _(spark, d):
    n = features.source_totals(_flows(spark, d)).select(*KEYS, "n_sources")
    return _wave(spark, d).join(n, KEYS).select(*KEYS, scalars.action_text("score", "n_sources", S).alias("action"))


@_query("top_anomaly", build(*FULL, recursive=True) + "SELECT stream_id, wid, coalesce(r.f, a.f) AS top_anomaly FROM (SELECT stream_id, wid, arg_max(feature, round(accumulator, 6) * 1e6 - ord * 1e-3) AS f FROM det WHERE accumulator > 0 GROUP BY ALL) a FULL JOIN (SELECT stream_id, wid, arg_min(feature_id, ord) AS f FROM rule_events JOIN live USING (stream_id, wid) GROUP BY ALL) r USING (stream_id, wid)")
def _(spark, d):
    found = detector.run(_flows(spark, d), S, SEED)
    return correlate.top_anomaly(found.detected, found.rules)


@_query("affected_sources", BASE + "SELECT stream_id, wid, count(*) AS n_sources, array_to_string(list(src_ip ORDER BY src_ip)[1:100], ',') AS sources FROM (SELECT DISTINCT stream_id, wid, src_ip FROM flows) GROUP BY ALL")
def _(spark, d):
    return correlate.affected_sources(_flows(spark, d).select(*KEYS, "src_ip").distinct()).withColumn("sources", F.concat_ws(",", "sources"))


STEPS = (*FULL, twins.scored(S, "all_events"), "scored_live AS MATERIALIZED (SELECT scored.* FROM scored JOIN live USING (stream_id, wid))")
_LATCH = "latch_line AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY wid) AS rn FROM %s), latch AS (SELECT stream_id, wid, rn, score, CASE WHEN score >= 0.9 THEN 3 WHEN score >= 0.85 THEN 2 WHEN score >= 0.7 THEN 1 ELSE 0 END AS tier FROM latch_line WHERE rn = 1 UNION ALL SELECT l.stream_id, l.wid, l.rn, l.score, CASE WHEN l.score >= 0.9 THEN 3 WHEN l.score >= 0.85 THEN greatest(tier, 2) WHEN l.score >= 0.7 THEN greatest(tier, 1) WHEN l.score < 0.6 THEN 0 ELSE tier END FROM latch c JOIN latch_line l ON l.stream_id = c.stream_id AND l.rn = c.rn + 1)"
_ACTION = "CASE WHEN score < 0.5 THEN 'Monitoring' WHEN score < 0.7 THEN 'ALERT: Score ' || printf('%.3f', score) || ' - manual review recommended' WHEN score < 0.85 THEN 'TIER-1: Rate limiting ' || n || ' sources to 2x baseline' WHEN score < 0.9 THEN 'TIER-2: Aggressive limiting + challenges for ' || n || ' sources' ELSE 'TIER-3: BLOCKING ' || n || ' top sources (5-min expiry)' END"
_SURE = f"FILTER (accumulator > {S.theta})"
_FOUND = f"found AS (SELECT stream_id, wid, string_agg(feature, ',' ORDER BY ord) {_SURE} AS anomalies, sum(abs(z)) {_SURE} AS z, sum(least(abs(z) / 5.0::DOUBLE, 1)) {_SURE} AS c, sum(accumulator) {_SURE} AS a, arg_max(feature, round(accumulator, 6) * 1e6 - ord * 1e-3) FILTER (accumulator > 0) AS f FROM det GROUP BY ALL)"
_HITS = "hits AS (SELECT stream_id, wid, string_agg(feature_id, ',' ORDER BY ord) AS heuristics, arg_min(feature_id, ord) AS f FROM rule_events GROUP BY ALL)"
_SENDERS = "senders AS (SELECT stream_id, wid, count(*) AS n, array_to_string(list(src_ip ORDER BY src_ip)[1:100], ',') AS sources FROM (SELECT DISTINCT stream_id, wid, src_ip FROM flows) GROUP BY ALL)"


@_query("detection_steps", build(*STEPS, twins.machine(S, "scored_live"), _FOUND, _HITS, _SENDERS, recursive=True) + f"SELECT stream_id, wid, CAST(rn AS INTEGER) AS step, wid * {S.dt}::DOUBLE AS sim_time, round(score, 6) AS score, CAST(tier AS INTEGER) AS tier, coalesce(anomalies, '') AS anomalies, round(coalesce(z, 0), 2) AS z_total, round(coalesce(c, 0), 4) AS confidence_total, round(coalesce(a, 0), 2) AS accumulator_total, coalesce(heuristics, '') AS heuristics, coalesce(hits.f, found.f) AS top_anomaly, {_ACTION} AS action_description, sources AS affected_sources, round(request_rate + {SHIFT * 1e-4!r}::DOUBLE, 4) AS request_rate FROM fsm JOIN found USING (stream_id, wid) LEFT JOIN hits USING (stream_id, wid) JOIN senders USING (stream_id, wid) JOIN feats USING (stream_id, wid)")
def _(spark, d):
    steps = detector.results(_flows(spark, d), S, SEED)
    named = lambda c: F.concat_ws(",", F.transform(c, lambda e: e["feature_id"]))
    total = lambda f, digits: F.round(F.aggregate("anomalies", F.lit(0.0), lambda a, e: a + F.abs(e[f])), digits)
    out = steps.select(
        *KEYS, "step", "sim_time", "score", "tier", named("anomalies").alias("anomalies"), total("z_score", 2).alias("z_total"), total("confidence", 4).alias("confidence_total"), total("accumulator", 2).alias("accumulator_total"),
        named("heuristics").alias("heuristics"), "top_anomaly", "action_description", F.concat_ws(",", "affected_sources").alias("affected_sources"), F.col("features.request_rate").alias("request_rate"),
    )
    return _round(out, "request_rate", digits=4, shift=SHIFT)


@_query("stream_detection", build(*STEPS, twins.machine(S, "scored_live"), recursive=True) + "SELECT stream_id, wid, round(score, 5) AS score, CAST(tier AS INTEGER) AS tier FROM fsm WHERE wid < (SELECT max(wid) FROM feats)")
def _(spark, d):
    """The streaming detector over flows that come in three parts, one a micro-batch; every window but the last closes.

    A part, a third of the time, is a file for each core, so that what reads it and what it becomes is spread as widely."""
    folder, files = f"{shared_folder(spark)}/tidewatch/stream-{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism
    flows = _flows(spark, d).drop("wid")
    first, last = flows.agg(F.min("start_time"), F.max("start_time")).first()
    third = F.least(F.floor((F.col("start_time") - first) / ((last - first) / 3 or 1.0)), F.lit(2)) if first is not None else F.lit(0)
    for k in range(3):
        flows.filter(third == k).repartition(files, "flow_seq").write.mode("append").parquet(f"{folder}/in")
    flows = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    for q in online.start(flows, folder, S, f"{folder}/check", late=0.0, seed_windows=SEED, availableNow=True):
        q.awaitTermination()
    found = online.latest(spark.read.parquet(f"{folder}/results"))
    return _round(found.select(*KEYS, "score", F.col("current_tier").alias("tier")), "score", digits=5)


#: Patterns of two to six ids.
TEMPLATES = (
    (("incomplete_handshake_spike", "distributed_connection_burst"), 2),
    (("user_agent_homogeneity", "session_duration_anomaly", "incomplete_handshake_spike", "per_source_request_spike"), 3),
    (("session_duration_anomaly", "incomplete_handshake_spike", "synchronized_request_timing", "user_agent_homogeneity", "per_source_request_spike", "distributed_connection_burst"), 5),
)


def _prefix_sql(ids) -> str:
    """Length of the longest beginning of ids whose first appearances rise, as SQL over f_<id>."""
    chain, out = "true", []
    for k, i in enumerate(ids):
        chain = f"f_{i} IS NOT NULL" if k == 0 else f"{chain} AND f_{i} > f_{ids[k - 1]}"
        out.append(f"CASE WHEN coalesce({chain}, false) THEN 1 ELSE 0 END")
    return " + ".join(out)


_IDS = sorted({i for ids, _ in TEMPLATES for i in ids})
_FIRSTS = ", ".join(f"min(p.wid * 100 + p.ord) FILTER (p.feature_id = '{i}') AS f_{i}" for i in _IDS)


@_query("template_list", build(*RULES_SQL, f"firsts AS (SELECT s.stream_id, s.wid, {_FIRSTS} FROM (SELECT DISTINCT stream_id, wid FROM feats) s LEFT JOIN rule_events p ON p.stream_id = s.stream_id AND p.wid * {S.dt} BETWEEN s.wid * {S.dt} - {S.window} AND s.wid * {S.dt} GROUP BY ALL)", recursive=True) + "SELECT stream_id, wid, " + " OR ".join(f"{_prefix_sql(ids)} >= {least}" for ids, least in TEMPLATES) + " AS boosted FROM firsts")
def _(spark, d):
    windows = stored(_windows(spark, d), "windows")
    return correlate.scores(rules.rule_events(windows, S), windows.select(*KEYS), replace(S, templates=TEMPLATES)).select(*KEYS, "boosted")


# -- response ---------------------------------------------------------------------------------------------


@_query("mitigation_fsm", build(FLOWS, WAVE, twins.machine(S, "wave"), recursive=True) + "SELECT stream_id, wid, round(score, 6) AS score, CAST(tier AS INTEGER) AS current_tier FROM fsm")
def _(spark, d):
    return _round(mitigate.respond(_wave(spark, d), S), "score")


@_query("alert_cooldown", build(FLOWS, WAVE, f"line AS MATERIALIZED (SELECT *, wid * {S.dt}::DOUBLE AS t, row_number() OVER (PARTITION BY stream_id ORDER BY wid) AS rn FROM wave), c AS (SELECT stream_id, wid, rn, score, score >= {S.tier1} AND t + {200 * S.dt / 5}::DOUBLE > {S.cooldown} AS counted, CASE WHEN score >= {S.tier1} AND t + {200 * S.dt / 5}::DOUBLE > {S.cooldown} THEN t ELSE -{200 * S.dt / 5}::DOUBLE END AS last FROM line WHERE rn = 1 UNION ALL SELECT l.stream_id, l.wid, l.rn, l.score, l.score >= {S.tier1} AND l.t - last > {S.cooldown}, CASE WHEN l.score >= {S.tier1} AND l.t - last > {S.cooldown} THEN l.t ELSE last END FROM c JOIN line l ON l.stream_id = c.stream_id AND l.rn = c.rn + 1)", recursive=True) + "SELECT stream_id, wid, round(score, 6) AS score, counted FROM c")
def _(spark, d):
    return _round(mitigate.counted_alerts(_wave(spark, d), S), "score")


@_query("legacy_tier_latch", build(FLOWS, WAVE, "line AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY wid) AS rn FROM wave), c AS (SELECT stream_id, wid, rn, score, CASE WHEN score >= 0.9 THEN 3 WHEN score >= 0.85 THEN 2 WHEN score >= 0.7 THEN 1 ELSE 0 END AS tier FROM line WHERE rn = 1 UNION ALL SELECT l.stream_id, l.wid, l.rn, l.score, CASE WHEN l.score >= 0.9 THEN 3 WHEN l.score >= 0.85 THEN greatest(tier, 2) WHEN l.score >= 0.7 THEN greatest(tier, 1) WHEN l.score < 0.6 THEN 0 ELSE tier END FROM c JOIN line l ON l.stream_id = c.stream_id AND l.rn = c.rn + 1)", recursive=True) + "SELECT stream_id, wid, round(score, 6) AS score, CAST(tier AS INTEGER) AS tier FROM c")
def _(spark, d):
    return _round(mitigate.latched_tier(_wave(spark, d), S), "score")


@_query("first_detection", build(FLOWS, WAVE) + f"SELECT stream_id, min(wid * {S.dt}::DOUBLE) FILTER (wid * {S.dt} >= 1.705e9 AND score >= 0.7) AS detected_at, min(wid * {S.dt}::DOUBLE) FILTER (wid * {S.dt} >= 1.705e9 AND score >= 0.7) - 1.705e9::DOUBLE AS latency, round(max(score), 6) AS peak_score, round(min(score) FILTER (wid * {S.dt} >= 1.705e9), 6) AS min_attack_score FROM wave GROUP BY ALL")
def _(spark, d):
    return _round(mitigate.first_detection(_wave(spark, d), 1.705e9, S), "peak_score", "min_attack_score")


# -- joins ------------------------------------------------------------------------------------------------


_RANGES = "ranges AS (SELECT * FROM (VALUES (1, 9, 'US'), (10, 49, 'CN'), (50, 99, 'EU'), (100, 149, 'RU'), (150, 199, 'IN')) r(low, high, country))"


@_query("ip_country_range_join", build("ips AS (SELECT event_id, (event_id * 37 % 256) || '.0.0.1' AS ip FROM events)", _RANGES) + "SELECT event_id, ip, coalesce(country, 'OTHER') AS by_range, coalesce(country, 'OTHER') AS by_case FROM ips LEFT JOIN ranges ON CAST(split_part(ip, '.', 1) AS INTEGER) BETWEEN low AND high")
def _(spark, d):
    ips = table(spark, d, "events").select("event_id", F.concat((F.col("event_id") * 37 % 256).cast("string"), F.lit(".0.0.1")).alias("ip"))
    # Five constant rows.
    ranges = F.broadcast(spark.createDataFrame([(1, 9, "US"), (10, 49, "CN"), (50, 99, "EU"), (100, 149, "RU"), (150, 199, "IN")], "low int, high int, country string"))
    out = ips.withColumn("octet", F.substring_index("ip", ".", 1).cast("int")).join(ranges, F.col("octet").between(F.col("low"), F.col("high")), "left")
    return out.select("event_id", "ip", F.coalesce("country", F.lit("OTHER")).alias("by_range"), scalars.country_of("ip").alias("by_case"))


@_query("benign_semi_anti", BASE + "SELECT 'attacked' AS kind, count(*) AS n FROM flows WHERE (stream_id, wid) IN (SELECT (stream_id, wid) FROM flows WHERE response_status <> 200) UNION ALL SELECT 'benign', count(*) FROM flows WHERE (stream_id, wid) NOT IN (SELECT (stream_id, wid) FROM flows WHERE response_status <> 200)")
def _(spark, d):
    flows = _flows(spark, d)
    attacked = flows.filter("response_status <> 200").select(*KEYS).distinct()
    count = lambda how, kind: flows.join(attacked, KEYS, how).groupBy().agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("left_semi", "attacked").unionByName(count("left_anti", "benign"))


@_query("flow_window_overlap", BASE + "SELECT w AS wid, count(*) AS n, round(sum(bytes_sent), 2) AS bytes FROM (SELECT unnest(range(CAST(floor(start_time / 60) AS BIGINT), CAST(floor(last_time / 60) AS BIGINT) + 1)) AS w, bytes_sent FROM flows) GROUP BY ALL")
def _(spark, d):
    return _round(packets.overlapping_windows(_flows(spark, d), 60.0).groupBy("wid").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_sent").alias("bytes")), "bytes", digits=2)


@_query("alerts_with_sources", build(FLOWS, WAVE) + "SELECT DISTINCT stream_id, wid, src_ip FROM wave JOIN flows USING (stream_id, wid) WHERE score >= 0.9")
def _(spark, d):
    hot = _wave(spark, d).filter("score >= 0.9").select(*KEYS)
    return _flows(spark, d).select(*KEYS, "src_ip").join(hot, KEYS).distinct()


@_query("traffic_union", BASE + "SELECT wid, kind, count(*) AS n FROM (SELECT wid, 'legit' AS kind FROM flows WHERE handshake_complete UNION ALL SELECT wid, 'attack' FROM flows WHERE NOT handshake_complete) GROUP BY ALL")
def _(spark, d):
    flows = _flows(spark, d)
    both = flows.filter("handshake_complete").select("wid", F.lit("legit").alias("kind")).unionByName(flows.filter("NOT handshake_complete").select("wid", F.lit("attack").alias("kind")))
    return both.groupBy("wid", "kind").agg(F.count(F.lit(1)).alias("n"))


# -- packets ----------------------------------------------------------------------------------------------


_PACKETS = "packets AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, '10.0.0.' || (user_id % 40) AS src_ip, 1000 + user_id % 3 AS sport, [2, 18, 16, 24, 1, 3, 6, 4][CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 + 1] AS f, CAST(floor(value) + 40 AS BIGINT) AS length FROM events)"


def _packets(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (micros() / 1e6).alias("ts"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")).alias("src_ip"), F.lit("10.0.0.250").alias("dst_ip"),
        (F.lit(1000) + F.col("user_id") % 3).cast("int").alias("sport"), F.lit(80).alias("dport"), F.lit(6).alias("proto_num"),
        F.element_at(F.array(*map(F.lit, (2, 18, 16, 24, 1, 3, 6, 4))), k % 8 + 1).alias("tcp_flags"), (F.floor("value") + 40).cast("long").alias("length"),
    )


@_query("packets_to_flows", build(_PACKETS) + "SELECT src_ip, CAST(sport AS INTEGER) AS sport, min(ts) AS start_time, max(ts) AS last_time, CAST(sum(length) AS BIGINT) AS bytes_sent, count(*) AS packets, coalesce(max(seq) FILTER (f & 16 <> 0) >= greatest(min(seq) FILTER (f & 2 <> 0 AND f & 16 = 0), CASE WHEN min(seq) FILTER (f & 2 <> 0 AND f & 16 = 0) IS NOT NULL THEN min(seq) FILTER (f & 2 <> 0 AND f & 16 <> 0) END) AND min(seq) FILTER (f & 2 <> 0 AND f & 16 = 0) IS NOT NULL AND min(seq) FILTER (f & 2 <> 0 AND f & 16 <> 0) IS NOT NULL, false) AS handshake_complete, bool_or(f & 2 <> 0 AND (f & 1 <> 0 OR f & 4 <> 0)) AS protocol_violation, greatest(1, count(*) // 3) AS request_count FROM packets GROUP BY src_ip, sport")
def _(spark, d):
    out = packets.to_flows(_packets(spark, d))
    return out.select("src_ip", "sport", "start_time", "last_time", "bytes_sent", "packets", "handshake_complete", "protocol_violation", "request_count")


@_query("packet_idle_flows", build(_PACKETS) + "SELECT src_ip, CAST(sport AS INTEGER) AS sport, g AS part, min(ts) AS start_time, max(ts) AS last_time, count(*) AS packets FROM (SELECT *, CAST(sum(b) OVER (PARTITION BY src_ip, sport ORDER BY ts, seq) AS BIGINT) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY src_ip, sport ORDER BY ts, seq) > 36000 THEN 1 ELSE 0 END AS b FROM packets)) GROUP BY ALL")
def _(spark, d):
    return packets.to_flows(packets.split_idle(_packets(spark, d), 36_000.0), extra=["part"]).select("src_ip", "sport", "part", "start_time", "last_time", "packets")


#: Each user group's event values as one long series, scanned in blocks of a few hundred rows.
_SERIES = "line AS MATERIALIZED (SELECT user_id % 3 AS key, event_id, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS rn FROM events)"
SERIES_BLOCK = 400


def _series(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 3).alias("key"), "event_id", "value")


@_query(
    "ewma_prefix_scan",
    build(
        _SERIES,
        f"""r AS (SELECT key, event_id, rn, value, value AS mean, 0.0::DOUBLE AS variance FROM line WHERE rn = 1
  UNION ALL SELECT key, event_id, rn, value, m, {S.alpha} * power(value - m, 2) + {1 - S.alpha} * variance FROM (SELECT l.*, {S.alpha} * l.value + {1 - S.alpha} * r.mean AS m, r.variance FROM r JOIN line l ON l.key = r.key AND l.rn = r.rn + 1))""",
        recursive=True,
    )
    + f"SELECT key, event_id, {rounded(['value', 'mean', 'variance'], 5)}, round(CASE WHEN rn = 1 OR variance <= 0 THEN 0 ELSE (value - mean) / sqrt(variance) END, 5) AS z FROM r",
)
def _(spark, d):
    return _round(prefix.ewma(_series(spark, d), ["key"], "event_id", "value", S.alpha, SERIES_BLOCK), "value", "mean", "variance", "z", digits=5)


@_query(
    "deviation_prefix_scan",
    build(
        _SERIES,
        "begin AS (SELECT key, avg(value) AS mean, var_pop(value) AS variance FROM line WHERE rn <= 50 GROUP BY key)",
        f"""r AS (SELECT l.key, event_id, rn, value, b.mean, b.variance, 0.0::DOUBLE AS before FROM line l JOIN begin b USING (key) WHERE rn = 1
  UNION ALL SELECT l.key, l.event_id, l.rn, l.value, p.m, {S.alpha} * power(p.value - p.m, 2) + {1 - S.alpha} * p.variance, CASE WHEN p.dev > {S.tau_z} THEN p.before + (p.dev - {S.tau_z}) ELSE p.before * {S.decay} END
  FROM (SELECT *, {S.alpha} * value + {1 - S.alpha} * mean AS m, abs(value - mean) / greatest(sqrt(greatest(variance, 0)), {S.epsilon}) AS dev FROM r) p JOIN line l ON l.key = p.key AND l.rn = p.rn + 1)""",
        recursive=True,
    )
    + f"SELECT key, event_id, round(z, 5) AS z, round(a, 5) AS accumulator, a > {S.theta} AS confirmed FROM (SELECT key, event_id, z, CASE WHEN abs(z) > {S.tau_z} THEN before + (abs(z) - {S.tau_z}) ELSE before * {S.decay} END AS a FROM (SELECT *, (value - mean) / greatest(sqrt(greatest(variance, 0)), {S.epsilon}) AS z FROM r))",
)
def _(spark, d):
    """The detector's scan of each series, seeded by its first fifty values."""
    rows = stored(_series(spark, d), "series")
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("event_id"))).filter("rn <= 50")
    starts = stored(first.groupBy("key").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance")), "series-starts")
    out = prefix.deviations(rows, ["key"], "event_id", "value", starts, S, SERIES_BLOCK)
    return _round(out.select("key", "event_id", "z", "accumulator", "confirmed"), "z", "accumulator", digits=5)


_SNAPSHOTS = "snaps AS (SELECT user_id % 4 AS feature, epoch_us(ts) AS t, avg(value) AS mean, count(*) AS n FROM events WHERE event_id % 20 = 3 GROUP BY ALL)"


@_query("baseline_asof", build(_SNAPSHOTS) + "SELECT e.event_id, e.user_id % 4 AS feature, s.t AS matched_t, round(s.mean, 6) AS mean, s.n AS n, round(e.value - s.mean, 6) AS off FROM (SELECT *, epoch_us(ts) AS t FROM events) e ASOF LEFT JOIN snaps s ON e.user_id % 4 = s.feature AND e.t >= s.t")
def _(spark, d):
    """Each value against the newest baseline snapshot of its feature at that time."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("feature"), micros().alias("t"), "value")
    snaps = e.filter("event_id % 20 = 3").groupBy("feature", "t").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    out = asof.asof_join(e, snaps, ["feature"], "t", ["mean", "n"])
    return _round(out.select("event_id", "feature", "matched_t", "mean", "n", (F.col("value") - F.col("mean")).alias("off")), "mean", "off")


#: Address ranges of customers: long and short, some inside others.
_RANGES = "ranges AS (SELECT c_custkey AS range_id, 167772160 + c_custkey * 7919 % 262144 AS low, 167772160 + c_custkey * 7919 % 262144 + CASE WHEN c_custkey % 50 = 0 THEN 20000 ELSE c_custkey % 60 END AS high FROM customer)"


def _ranges(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("range_id"))
    low = F.lit(167772160) + F.col("range_id") * 7919 % 262144
    return c.select("range_id", low.alias("low"), (low + F.when(F.col("range_id") % 50 == 0, 20000).otherwise(F.col("range_id") % 60)).alias("high"))


@_query("ip_range_table", build(FLOWS, _RANGES, "ips AS (SELECT *, list_reduce([CAST(x AS BIGINT) for x in string_split(src_ip, '.')], lambda a, b: a * 256 + b) AS ip FROM flows)") + "SELECT range_id, count(*) AS flows, CAST(sum(bytes_sent) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS sources FROM ips JOIN ranges ON ip BETWEEN low AND high GROUP BY ALL")
def _(spark, d):
    """Flows of each address range, from a table of ranges as large as it may be."""
    by = _flows(spark, d).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_sent").alias("b")).withColumn("ip", ranges.ip_number("src_ip"))
    found = ranges.range_join(by, _ranges(spark, d), "ip", "low", "high")
    return found.groupBy("range_id").agg(F.sum("n").alias("flows"), F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("sources"))


@_query("flow_range_overlap", "WITH a AS (SELECT event_id, user_id % 20 AS k, epoch_us(ts) AS b, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e FROM events), r AS (SELECT event_id AS range_id, user_id % 20 AS k, epoch_us(ts) AS low, epoch_us(ts) + CASE WHEN event_id % 97 = 0 THEN 40000000000 ELSE 600000000 END AS high FROM events WHERE event_id % 7 = 0) SELECT range_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM a JOIN r ON a.k = r.k AND b <= high AND e >= low GROUP BY ALL")
def _(spark, d):
    """Intervals of flows that overlap watched intervals of their group."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("k"), micros().alias("b"), "value")
    a = e.select("event_id", "k", "b", (F.col("b") + F.floor(F.col("value") * 60000000)).alias("e"))
    watched = e.filter("event_id % 7 = 0").select(F.col("event_id").alias("range_id"), "k", F.col("b").alias("low"), (F.col("b") + F.when(F.col("event_id") % 97 == 0, 40000000000).otherwise(600000000)).alias("high"))
    return ranges.overlap_join(a, watched, "b", "e", "low", "high", ["k"]).groupBy("range_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


#: Windows of six hours over packets of three streams, some of which come late, forgotten after ten idle hours.
CAPTURE_DT, CAPTURE_IDLE = 21_600.0, 36_000.0
_CAPTURED = "cap AS MATERIALIZED (SELECT 's' || event_id % 3 AS stream_id, seq, ts + event_id * 7919 % 11 * 600 AS ts, src_ip, sport, f, length FROM (SELECT seq AS event_id, * FROM packets))"
_CAPTURE_CHAIN = f"""chain AS (SELECT stream_id, 0 AS wid, min(seq) AS start_seq, min_by(ts, seq) AS start_ts FROM cap GROUP BY stream_id
  UNION ALL SELECT stream_id, wid + 1, min(seq), min_by(ts, seq) FROM (SELECT c.stream_id, c.wid, p.seq, p.ts FROM chain c JOIN cap p ON p.stream_id = c.stream_id AND p.seq > c.start_seq AND p.ts - c.start_ts >= {CAPTURE_DT}) GROUP BY stream_id, wid),
wins AS MATERIALIZED (SELECT *, lead(start_seq) OVER w AS end_seq, lead(start_ts) OVER w AS end_ts FROM chain WINDOW w AS (PARTITION BY stream_id ORDER BY wid))"""


def _captured(spark, d) -> DataFrame:
    p = _packets(spark, d)
    return p.withColumns({"stream_id": F.concat(F.lit("s"), (F.col("seq") % 3).cast("string")), "ts": F.col("ts") + F.col("seq") * 7919 % 11 * 600})


@_query("capture_windows", build(_PACKETS, _CAPTURED, _CAPTURE_CHAIN, recursive=True) + "SELECT stream_id, CAST(wid AS BIGINT) AS wid, start_seq, start_ts, end_seq, end_ts FROM wins")
def _(spark, d):
    return capture.windows(stored(capture.blocked(_captured(spark, d)), "captured"), CAPTURE_DT).drop("block")


# Flows of a key part at the first packet after which it was forgotten; a window's flows by all packets up to its end.
@_query(
    "capture_window_flows",
    build(
        _PACKETS,
        _CAPTURED,
        _CAPTURE_CHAIN,
        "inwin AS MATERIALIZED (SELECT c.*, w.wid, w.start_ts FROM cap c JOIN wins w ON w.stream_id = c.stream_id AND (c.seq > w.start_seq OR w.wid = 0) AND c.seq <= coalesce(w.end_seq, 9000000000000000000))",
        f"parted AS MATERIALIZED (SELECT *, sum(b) OVER (PARTITION BY stream_id, src_ip, sport ORDER BY seq) AS part FROM (SELECT *, CASE WHEN wid > 0 AND max(ts) OVER (PARTITION BY stream_id, src_ip, sport ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < start_ts - {CAPTURE_IDLE} THEN 1 ELSE 0 END AS b FROM inwin))",
        "ends AS (SELECT stream_id, max(wid) AS final, max(start_ts) AS final_ts FROM wins GROUP BY ALL)",
        "lastpart AS (SELECT stream_id, src_ip, sport, max(part) AS part FROM parted GROUP BY ALL)",
        "upto AS (SELECT p.stream_id, p.src_ip, p.sport, p.part, w.wid, any_value(w.start_ts) AS start_ts, any_value(w.end_ts) AS end_ts, min(p.seq) AS flow_seq, min_by(p.ts, p.seq) AS start_time, max(p.ts) AS last_time, sum(length) AS bytes_sent, count(*) AS packets, max(p.seq) FILTER (f & 16 <> 0) >= greatest(min(p.seq) FILTER (f & 18 = 2), CASE WHEN count(*) FILTER (f & 18 = 2) > 0 THEN min(p.seq) FILTER (f & 18 = 18) END) AND count(*) FILTER (f & 18 = 18) > 0 AS done, bool_or(f & 2 <> 0 AND f & 5 <> 0) AS bad, max(p.wid) AS latest FROM parted p JOIN wins w ON w.stream_id = p.stream_id AND p.seq <= coalesce(w.end_seq, 9000000000000000000) GROUP BY p.stream_id, p.src_ip, p.sport, p.part, w.wid)",
    )
    .replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT stream_id, CAST(wid AS BIGINT) AS wid, flow_seq, src_ip, CAST(sport AS INTEGER) AS sport, start_time, last_time, CAST(bytes_sent AS BIGINT) AS bytes_sent, packets, coalesce(done, false) AS handshake_complete, greatest(1, packets // 3) AS request_count, bad AS protocol_violation FROM upto JOIN ends USING (stream_id) LEFT JOIN lastpart l USING (stream_id, src_ip, sport, part) WHERE CASE WHEN wid < final THEN start_time < end_ts AND last_time >= start_ts ELSE l.part IS NOT NULL AND (latest = final OR last_time >= final_ts - {CAPTURE_IDLE}) END",
)
def _(spark, d):
    return capture.flows(stored(_captured(spark, d), "captured"), CAPTURE_DT, CAPTURE_IDLE).drop("dst_ip", "dport", "proto_num", "proto", "bytes_recv", "user_agent", "country_code", "response_status")


# -- evaluation ---------------------------------------------------------------------------------------------


_RUNS = "runs AS MATERIALIZED (SELECT event_type AS scenario_id, user_id, max(value) > 60 AS detected, CASE WHEN max(value) > 60 THEN min(value) END AS latency, least(max(value) / 150.0::DOUBLE, 1) AS peak_score, count(*) * 3600.0::DOUBLE AS duration, count(*) FILTER (value > 40) AS true_positives, count(*) FILTER (k < 10) AS false_positives, count(*) FILTER (k BETWEEN 10 AND 14) AS false_negatives, count(*) FILTER (k > 50) AS true_negatives FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type, user_id)"


def _runs(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("scenario_id"), "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("scenario_id", "user_id").agg(
        (F.max("value") > 60).alias("detected"), F.when(F.max("value") > 60, F.min("value")).alias("latency"), F.least(F.max("value") / 150.0, F.lit(1.0)).alias("peak_score"), (F.count(F.lit(1)) * 3600.0).alias("duration"),
        F.count_if(F.col("value") > 40).alias("true_positives"), F.count_if(F.col("k") < 10).alias("false_positives"), F.count_if(F.col("k").between(10, 14)).alias("false_negatives"), F.count_if(F.col("k") > 50).alias("true_negatives"),
    )


_METRIC = "count(*) AS runs, round(avg(CASE WHEN detected THEN 1.0::DOUBLE ELSE 0 END), 6) AS detection_rate, round(avg(latency), 6) AS mean_latency, round(avg(peak_score), 6) AS mean_peak, sum(true_positives) AS tp, sum(false_positives) AS fp, sum(false_negatives) AS fn, sum(true_negatives) AS tn, sum(duration) AS duration"


@_query("metrics_rollup", build(_RUNS, f"m AS (SELECT scenario_id, {_METRIC} FROM runs GROUP BY ROLLUP (scenario_id))", "r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM m)") + "SELECT scenario_id, runs, detection_rate, mean_latency, mean_peak, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(rc AS DOUBLE), 6) AS recall, round(CAST(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS DOUBLE), 6) AS specificity, round(CAST(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS DOUBLE), 6) AS f1, round(CASE WHEN duration > 0 THEN fp / (duration / 3600) * 12 ELSE 0 END, 6) AS fp_per_12h FROM r")
def _(spark, d):
    return _round(evaluate.metrics(_runs(spark, d)), "detection_rate", "mean_latency", "mean_peak", "precision", "recall", "specificity", "f1", "fp_per_12h")


@_query("confusion_metrics", build(_RUNS) + "SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(sp, 6) AS specificity FROM (SELECT sum(true_positives) / (sum(true_positives) + sum(false_positives)) AS p, sum(true_positives) / (sum(true_positives) + sum(false_negatives)) AS r, sum(true_negatives) / (sum(true_negatives) + sum(false_positives)) AS sp FROM runs)")
def _(spark, d):
    return _round(evaluate.metrics(_runs(spark, d), None), "precision", "recall", "f1", "specificity").select("precision", "recall", "f1", "specificity")


@_query("latency_percentiles", build(_RUNS) + "SELECT scenario_id, round(avg(latency), 6) AS mean, round(stddev_pop(latency), 6) AS std, round(min(latency), 6) AS min, round(max(latency), 6) AS max, round(quantile_cont(latency, 0.5), 6) AS median, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99 FROM runs WHERE latency IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return _round(evaluate.latency_stats(_runs(spark, d), ["scenario_id"]), "mean", "std", "min", "max", "median", "p95", "p99")


_ROC = "pts AS (SELECT k / 100.0::DOUBLE AS threshold, count(*) FILTER (detected AND peak_score >= k / 100.0::DOUBLE) / nullif(count(*) FILTER (detected), 0) AS tpr, count(*) FILTER (NOT detected AND peak_score >= k / 100.0::DOUBLE) / nullif(count(*) FILTER (NOT detected), 0) AS fpr FROM runs, range(50, 100) t(k) GROUP BY k)"


@_query("roc_points", build(_RUNS, _ROC) + "SELECT threshold, round(coalesce(tpr, 0), 6) AS tpr, round(coalesce(fpr, 0), 6) AS fpr FROM pts")
def _(spark, d):
    return _round(evaluate.roc_points(_runs(spark, d)), "tpr", "fpr")


@_query("auc_trapezoid", build(_RUNS, _ROC) + "SELECT round(greatest(0, least(1, s)), 6) AS auc_in_order, round(least(1, abs(s)), 6) AS auc_absolute FROM (SELECT coalesce(sum(a), 0) AS s FROM (SELECT (coalesce(fpr, 0) - lag(coalesce(fpr, 0)) OVER (ORDER BY threshold)) * (coalesce(tpr, 0) + lag(coalesce(tpr, 0)) OVER (ORDER BY threshold)) / 2 AS a FROM pts))")
def _(spark, d):
    return _round(evaluate.auc(evaluate.roc_points(_runs(spark, d))), "auc_in_order", "auc_absolute")


@_query("mitigation_effectiveness", build(_RUNS) + "SELECT round(greatest(0, least(1, (a - b) / a)) * 100, 6) AS effectiveness FROM (SELECT avg(peak_score) FILTER (user_id % 2 = 0) AS a, avg(peak_score * 0.8) FILTER (user_id % 2 = 1) AS b FROM runs)")
def _(spark, d):
    r = _runs(spark, d).select((F.col("user_id") % 2 == 1).alias("mitigated"), F.when(F.col("user_id") % 2 == 1, F.col("peak_score") * 0.8).otherwise(F.col("peak_score")).alias("peak_score"))
    return _round(evaluate.effectiveness(r), "effectiveness")


_BY_CONFIG = "['Full', 'NoLeaky', 'NoWeight'][CAST(user_id % 3 AS INTEGER) + 1]"
_CONFIG_ROC = _ROC.replace("SELECT k / 100", f"SELECT {_BY_CONFIG} AS config, k / 100", 1).replace("GROUP BY k", f"GROUP BY {_BY_CONFIG}, k")


@_query("ablation_deltas", build(_RUNS, _CONFIG_ROC, f"by_ AS (SELECT {_BY_CONFIG} AS config, avg(CASE WHEN detected THEN 1.0::DOUBLE ELSE 0 END) AS dr, 2 * sum(true_positives) / (2 * sum(true_positives) + sum(false_positives) + sum(false_negatives)) AS f1 FROM runs GROUP BY ALL)", "area AS (SELECT config, greatest(0, least(1, coalesce(sum(a), 0))) AS auc FROM (SELECT config, (coalesce(fpr, 0) - lag(coalesce(fpr, 0)) OVER w) * (coalesce(tpr, 0) + lag(coalesce(tpr, 0)) OVER w) / 2 AS a FROM pts WINDOW w AS (PARTITION BY config ORDER BY threshold)) GROUP BY config)") + "SELECT a.config, round(a.dr, 6) AS detection_rate, round(a.dr - b.dr, 6) AS delta_dr, round(a.f1, 6) AS f1, round(a.f1 - b.f1, 6) AS delta_f1, round(auc, 6) AS auc FROM by_ a JOIN area USING (config), by_ b WHERE b.config = 'Full'")
def _(spark, d):
    """The table's arithmetic, over runs that bear a configuration's label; ablation_grid runs the configurations."""
    r = _runs(spark, d).withColumn("config", F.element_at(F.array(F.lit("Full"), F.lit("NoLeaky"), F.lit("NoWeight")), (F.col("user_id") % 3 + 1).cast("int")))
    return _round(evaluate.ablation(r), "detection_rate", "delta_dr", "f1", "delta_f1", "auc")


@_query("ablation_grid")
def _(spark, d):
    return _round(evaluate.ablation(experiments.ablation_runs(simulate.scenario_grid(spark), Settings())), "detection_rate", "delta_dr", "f1", "delta_f1", "auc")


@_query("false_positives_12h")
def _(spark, d):
    return experiments.false_positives(spark, Settings())


@_query("report_table", build(_RUNS, "g AS (SELECT scenario_id, count(*) AS reps, count(*) FILTER (detected) AS tp, coalesce(avg(latency) FILTER (detected), 0) AS l, avg(false_positives) AS f, avg(peak_score) AS p, CAST(floor(avg(false_positives) * count(*)) AS BIGINT) AS fp FROM runs GROUP BY ALL)", "h AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, tp / reps AS rc, greatest(reps - fp, 0) AS tn FROM g)") + "SELECT scenario_id, reps, round(tp / reps, 6) AS detection_rate, round(l, 6) AS mean_latency, round(f, 6) AS fp_per_run, round(p, 6) AS mean_peak, round(CAST(pr AS DOUBLE), 6) AS precision, round(CAST(rc AS DOUBLE), 6) AS recall, round(CAST(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS DOUBLE), 6) AS f1, round(CAST(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS DOUBLE), 6) AS specificity FROM h")
def _(spark, d):
    return _round(evaluate.report(_runs(spark, d)), "detection_rate", "mean_latency", "fp_per_run", "mean_peak", "precision", "recall", "f1", "specificity")


@_query("static_threshold", build(*FEATS, "b AS (SELECT stream_id, quantile_cont(request_rate, 0.5) AS b FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY wid) AS k FROM feats) WHERE k <= 20 GROUP BY ALL)") + "SELECT stream_id, wid, round(s, 6) AS score, s >= 0.7 AS alert FROM (SELECT stream_id, wid, least(greatest(request_rate / greatest(b, 0.1) / 10, total_request_rate / greatest(100 * b, 0.1) / 2), 1) AS s FROM feats JOIN b USING (stream_id))")
def _(spark, d):
    return _round(evaluate.static_threshold(_feats(spark, d)), "score")


@_query("signature_rules", build(*FEATS) + "SELECT stream_id, wid, greatest(CASE WHEN concurrent_connection_count > 100 THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN handshake_completion_ratio < 0.1 THEN 0.9::DOUBLE ELSE 0 END, CASE WHEN mean_connection_duration > 60 THEN 0.7::DOUBLE ELSE 0 END, CASE WHEN request_rate > 500 THEN 0.85::DOUBLE ELSE 0 END) AS score, CAST(concurrent_connection_count > 100 AS INTEGER) + CAST(handshake_completion_ratio < 0.1 AS INTEGER) + CAST(mean_connection_duration > 60 AS INTEGER) + CAST(request_rate > 500 AS INTEGER) AS matches, concurrent_connection_count > 100 OR handshake_completion_ratio < 0.1 OR mean_connection_duration > 60 OR request_rate > 500 AS alert FROM feats")
def _(spark, d):
    return evaluate.signatures(_feats(spark, d))


_ATTACK = f"wid % 60 BETWEEN 20 AND 22"


@_query("outcome_counts", build(FLOWS, WAVE) + f"SELECT stream_id, count(*) FILTER (score >= 0.7 AND {_ATTACK}) AS tp, count(*) FILTER (score >= 0.7 AND NOT {_ATTACK}) AS fp, count(*) FILTER (score < 0.7 AND {_ATTACK}) AS fn, count(*) FILTER (score < 0.7 AND NOT {_ATTACK}) AS tn, min(wid) FILTER (score >= 0.7 AND {_ATTACK}) AS first_wid, min(wid) FILTER ({_ATTACK}) AS attack_wid FROM wave GROUP BY ALL")
def _(spark, d):
    return evaluate.outcome_counts(_wave(spark, d), F.expr(_ATTACK))


@_query("per_file_macro", build(FLOWS, WAVE, f"o AS (SELECT stream_id, count(*) FILTER (score >= 0.7 AND {_ATTACK}) AS tp, count(*) FILTER (score >= 0.7 AND NOT {_ATTACK}) AS fp, count(*) FILTER (score < 0.7 AND {_ATTACK}) AS fn, count(*) FILTER (score < 0.7 AND NOT {_ATTACK}) AS tn, min(wid) FILTER (score >= 0.7 AND {_ATTACK}) - min(wid) FILTER ({_ATTACK}) AS l FROM wave GROUP BY ALL), q AS (SELECT stream_id, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS s, l FROM o)") + "SELECT stream_id, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(s), 6) AS specificity, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(l), 6) AS latency_windows FROM q GROUP BY ROLLUP (stream_id)")
def _(spark, d):
    return _round(evaluate.macro(evaluate.outcome_counts(_wave(spark, d), F.expr(_ATTACK))), "precision", "recall", "specificity", "f1", "latency_windows")


#: Files of labelled flows: the injected bursts are attacks (status 0), all else is benign.
_LABELLED = FLOWS.replace("flows AS", "labelled AS", 1)
_LABEL = "labels_ AS MATERIALIZED (SELECT * REPLACE (CASE WHEN %s THEN 0 ELSE 200 END AS response_status) FROM labelled)" % _ATTACK
_BENIGN = f"benign AS MATERIALIZED (WITH flows AS (SELECT * FROM labels_ WHERE response_status = 200), {twins.features(S)} SELECT * FROM feats)"
_NUMBERED = "flows AS MATERIALIZED (SELECT * REPLACE (dense_rank() OVER (PARTITION BY stream_id ORDER BY wid) AS wid) FROM labels_)"
_EASED = f"""learnt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, feature ORDER BY wid) AS rn FROM ({" UNION ALL ".join(f"SELECT stream_id, wid, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM benign" for f in FEATURES)})),
easing AS (SELECT stream_id, feature, rn, value AS m, 0.0::DOUBLE AS v FROM learnt WHERE rn = 1
  UNION ALL SELECT e.stream_id, e.feature, l.rn, {S.alpha} * l.value + {1 - S.alpha} * e.m, {S.alpha} * power(l.value - ({S.alpha} * l.value + {1 - S.alpha} * e.m), 2) + {1 - S.alpha} * e.v FROM easing e JOIN learnt l ON l.stream_id = e.stream_id AND l.feature = e.feature AND l.rn = e.rn + 1 AND l.rn <= {SEED}),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, feature ORDER BY wid) AS rn FROM long),
seed AS MATERIALIZED (SELECT stream_id, feature, arg_max(m, rn) AS seed_mean, arg_max(v, rn) AS seed_var FROM easing GROUP BY ALL)"""
_JUDGED = """truth AS (SELECT stream_id, wid, bool_or(response_status = 0) AS attack FROM flows GROUP BY ALL),
judged AS (SELECT stream_id, count(*) FILTER (score >= 0.7 AND attack) AS tp, count(*) FILTER (score >= 0.7 AND NOT attack) AS fp, count(*) FILTER (score < 0.7 AND attack) AS fn, count(*) FILTER (score < 0.7 AND NOT attack) AS tn,
  min(wid) FILTER (score >= 0.7 AND attack) - min(wid) FILTER (attack) AS late FROM scored JOIN truth USING (stream_id, wid) GROUP BY ALL),
rated AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM judged),
per_file AS (SELECT stream_id, tp, fp, fn, tn, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, late * %s::DOUBLE AS late FROM rated)""" % S.dt


@_query(
    "labelled_files",
    build(_LABELLED, _LABEL, _BENIGN, _NUMBERED, twins.features(S), LONG, _EASED, twins.detected(S, 0), twins.rules(S), twins.spikes(S), RULE_EVENTS, twins.weights(S), "all_events AS MATERIALIZED (SELECT stream_id, wid, feature AS feature_id, ord, least(abs(z) / 5.0::DOUBLE, 1) AS confidence FROM det WHERE accumulator > %s UNION ALL SELECT * FROM rule_events)" % S.theta, twins.scored(S, "all_events"), _JUDGED, recursive=True)
    + "SELECT stream_id, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, late AS latency_seconds, tp + fp + fn + tn AS windows FROM per_file UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), CAST(sum(tn) AS BIGINT), round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), avg(late), CAST(sum(tp + fp + fn + tn) AS BIGINT) FROM per_file",
)
def _(spark, d):
    """Evaluation over labelled files: baselines from each file's first benign windows, then every window is a step."""
    flows = _flows(spark, d).withColumn("response_status", F.when(F.expr(_ATTACK), 0).otherwise(200))
    return _round(experiments.evaluate_files(flows, S, SEED), "precision", "recall", "f1")


_COPIES = " + ".join(f"(u > {c!r}::DOUBLE)::INTEGER" for c in evaluate.POISSON)


@_query("bootstrap_ci", build(_RUNS, "drawn AS (SELECT scenario_id, peak_score AS x, b, md5('42:' || scenario_id || ':' || user_id || ':' || b) AS h FROM runs, range(2500) t(b))", f"means AS (SELECT scenario_id, r, sum(m * x) / nullif(sum(m), 0) AS mean FROM (SELECT scenario_id, x, r, {_COPIES} AS m FROM (SELECT scenario_id, x, b * 4 + j AS r, CAST('0x' || substr(h, CAST(8 * j + 1 AS BIGINT), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM drawn, range(4) s(j))) GROUP BY ALL)") + "SELECT scenario_id, round(CASE WHEN n < 2 THEN x ELSE low END, 6) AS low, round(CASE WHEN n < 2 THEN x ELSE high END, 6) AS high, rounds FROM (SELECT scenario_id, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, count(*) AS rounds FROM means GROUP BY ALL) JOIN (SELECT scenario_id, count(*) AS n, min(peak_score) AS x FROM runs GROUP BY ALL) USING (scenario_id)")
def _(spark, d):
    return _round(evaluate.bootstrap(_runs(spark, d), "peak_score", ["scenario_id"], ["scenario_id", "user_id"], rounds=10_000), "low", "high")


@_query("bootstrap_exact")
def _(spark, d):
    """Intervals of rounds that draw exactly as many runs as there are."""
    return evaluate.bootstrap_exact(_runs(spark, d), "peak_score", ["scenario_id"], ["scenario_id", "user_id"])


@_query("random_forest")
def _(spark, d):
    cases = stored(_feats(spark, d).withColumn("label", F.expr(_ATTACK)).withColumn("case", F.col("wid")), "cases")
    return evaluate.forest(cases, list(FEATURES), trees=100, depth=10)


_GRID = "grid AS (SELECT id || '-' || rep AS stream_id, id, wid, wid * 5 AS t FROM (VALUES ('http_flood', 120), ('slowloris', 180), ('connection_flood', 96), ('low_rate_distributed', 240), ('synchronized_burst', 144)) s(id, windows), range(3) r(rep), range(-120, windows) w(wid))"
_ATTACKERS = "CASE WHEN t < 30 THEN 0 WHEN id = 'http_flood' THEN CASE WHEN t < 40 THEN 30 ELSE 100 END WHEN id = 'slowloris' THEN least((t - 30) // 5 * 10 + 20, 200) WHEN id = 'low_rate_distributed' THEN 500 WHEN id = 'synchronized_burst' AND t % 30 >= 5 THEN 0 ELSE 100 END"


@_query("simulate_scenarios", build(_GRID) + f"SELECT stream_id, wid, CASE WHEN wid >= 0 THEN CASE WHEN t % 300 < 30 THEN 100 ELSE 50 END END AS legitimate, CAST({_ATTACKERS} AS BIGINT) AS attack, CAST({_ATTACKERS} AS BIGINT) AS attack_sources, true AS enough FROM grid")
def _(spark, d):
    by = simulate.scenario_grid(spark).groupBy("stream_id", "wid").agg(F.count_if(F.col("kind") == "legitimate").alias("n"), F.count_if(F.col("kind") == "attack").alias("attack"), F.countDistinct(F.when(F.col("kind") == "attack", F.col("src_ip"))).alias("attack_sources"))
    return by.select("stream_id", "wid", F.when(F.col("wid") >= 0, F.col("n")).cast("int").alias("legitimate"), "attack", "attack_sources", (F.col("n") >= 10).alias("enough"))


@_query("simulated_detection")
def _(spark, d):
    s = Settings()
    runs = experiments.run_rows(detector.run(simulate.scenario_grid(spark), s).scored, s)
    return _round(runs.select("stream_id", "detected", "latency", "peak_score", "true_positives", "false_positives", "false_negatives", "true_negatives"), "peak_score")


# -- telemetry ------------------------------------------------------------------------------------------------


@_query("telemetry_recent_scores", build(FLOWS, WAVE) + f"SELECT wid * {S.dt}::DOUBLE AS ts, round(score, 6) AS score FROM wave WHERE wid * {S.dt} > 1.705e9 ORDER BY ts, score")
def _(spark, d):
    return telemetry.recent_scores(_round(_wave(spark, d), "score").withColumn("ts", F.col("wid") * S.dt), 1.705e9)


@_query("telemetry_event_count", "SELECT count(*) AS n FROM events WHERE epoch_us(ts) / 1e6 > 1.705e9")
def _(spark, d):
    return telemetry.event_count(table(spark, d, "events").select((micros() / 1e6).alias("ts")), 1.705e9)


@_query("typed_result_line", build(*STEPS, _LATCH % "scored_live", "worst AS (SELECT stream_id, wid, arg_max(ord, round(accumulator, 6) * 1e6 - ord * 1e-3) AS ord FROM det GROUP BY ALL)", recursive=True) + f"SELECT stream_id, wid, strftime(make_timestamp(CAST(wid * {S.dt} * 1e6 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS at, feature, round(z, 3) AS z_score, round(accumulator, 3) AS accumulator, round(score, 3) AS correlation_score, CAST(tier AS INTEGER) AS mitigation_tier FROM det JOIN worst USING (stream_id, wid, ord) JOIN latch USING (stream_id, wid)")
def _(spark, d):
    found = detector.run(_flows(spark, d), S, SEED)
    lines = telemetry.result_lines(found.detected, found.scored, mitigate.latched_tier(found.scored, S), S.dt)
    of = lambda name, kind: F.get_json_object("line", f"$.{name}").cast(kind)
    return lines.select(*KEYS, of("timestamp", "string").alias("at"), of("feature", "string").alias("feature"), *[of(n, "double").alias(n) for n in ("z_score", "accumulator", "correlation_score")], of("mitigation_tier", "int").alias("mitigation_tier"))


@_query("scalar_functions", "SELECT event_id, coalesce(TRY_CAST(v AS DOUBLE), 0) AS safe_double, CAST(trunc(coalesce(TRY_CAST(v AS DOUBLE), 0)) AS BIGINT) AS safe_long, CASE WHEN p = 6 THEN 'TCP' WHEN p = 17 THEN 'UDP' ELSE 'OTHER' END AS proto, event_id // 5 AS window_id, greatest(1, event_id // 3) AS requests, hour(ts) AS hour, isodow(ts) - 1 AS dow, least(abs(event_id % 21 - 10) / 5.0::DOUBLE, 1) AS confidence FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE (event_id % 1000 / 8.0::DOUBLE) || '' END AS v, [6, 17, 1][CAST(event_id % 3 AS INTEGER) + 1] AS p FROM events)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, "x").otherwise((F.col("event_id") % 1000 / 8.0).cast("string")).alias("v"), F.element_at(F.array(F.lit(6), F.lit(17), F.lit(1)), (F.col("event_id") % 3 + 1).cast("int")).alias("p"))
    hour, dow = scalars.context("ts")
    return e.select("event_id", scalars.safe_double("v").alias("safe_double"), scalars.safe_long("v").alias("safe_long"), scalars.protocol_name("p").alias("proto"), scalars.window_id("event_id", 5.0).alias("window_id"), scalars.requests_of("event_id").alias("requests"), hour.cast("long").alias("hour"), dow.cast("long").alias("dow"), scalars.confidence(F.col("event_id") % 21 - 10).alias("confidence"))


@_query("subnet_counts", BASE + "SELECT stream_id, wid, count(DISTINCT regexp_extract(src_ip, '^[^.]*[.][^.]*[.][^.]*')) AS nets24, count(DISTINCT regexp_extract(src_ip, '^[^.]*[.][^.]*')) AS nets16 FROM flows GROUP BY ALL")
def _(spark, d):
    f = _flows(spark, d).select(*KEYS, scalars.subnet("src_ip", 3).alias("a"), scalars.subnet("src_ip", 2).alias("b"))
    return f.groupBy(*KEYS).agg(F.countDistinct("a").alias("nets24"), F.countDistinct("b").alias("nets16"))


@_query("default_fill", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '0.0.0.0' ELSE '10.0.0.1' END AS src_ip, '0.0.0.0' AS dst_ip, CASE WHEN event_id % 5 = 0 THEN 80 ELSE 443 END AS dport, 'TCP' AS proto, true AS handshake_complete, 'unknown' AS user_agent, 200 AS response_status FROM events")
def _(spark, d):
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, "10.0.0.1").alias("src_ip"), F.when(F.col("event_id") % 5 != 0, 443).alias("dport"))
    out = raw.select("event_id", *scalars.filled(["src_ip", "dport"]))
    return out.select("event_id", "src_ip", "dst_ip", "dport", "proto", "handshake_complete", "user_agent", "response_status")


@_query("scenario_table", "SELECT * FROM (VALUES ('http_flood', 600.0::DOUBLE, 30.0::DOUBLE), ('slowloris', 900.0, 30.0), ('connection_flood', 480.0, 30.0), ('low_rate_distributed', 1200.0, 30.0), ('synchronized_burst', 720.0, 30.0)) s(id, duration, attack_start)")
def _(spark, d):
    return simulate.scenario_table(spark).select("id", "duration", "attack_start")


@_query("runs_with_scenarios", build(_RUNS, "sc AS (SELECT * FROM (VALUES ('click', 1), ('view', 2), ('error', 3)) s(scenario_id, weight))") + "SELECT scenario_id, weight, count(*) AS runs FROM runs LEFT JOIN sc USING (scenario_id) GROUP BY ALL")
def _(spark, d):
    # Three constant rows.
    sc = F.broadcast(spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "scenario_id string, weight int"))
    return _runs(spark, d).join(sc, "scenario_id", "left").groupBy("scenario_id", "weight").agg(F.count(F.lit(1)).alias("runs"))


@_query("baseline_serialized", build(_HOURLY, _CONTEXTS) + f"SELECT stream_id, feature, hour, dow, {rounded(['mean', 'sd'], 4, SHIFT)}, n FROM (SELECT *, sqrt(variance) AS sd FROM contexts)")
def _(spark, d):
    """Contexts written as JSON and loaded again."""
    loaded = baseline.loaded(baseline.serialized(baseline.learned_contexts(_observations(spark, d), 5)))
    return _round(loaded.withColumn("sd", F.sqrt("variance")), "mean", "sd", digits=4, shift=SHIFT).drop("variance")


@_query("baseline_features", build(_HOURLY, _CONTEXTS) + "SELECT stream_id, feature, count(*) AS contexts FROM contexts GROUP BY ALL")
def _(spark, d):
    return baseline.feature_ids(baseline.learned_contexts(_observations(spark, d), 5))


_WEEKLY = """r AS (
  SELECT key, t, rn, x, dow, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance, MAP {dow: {'m': x, 'v': 0.0::DOUBLE}} AS seen, x AS om, 0.0::DOUBLE AS ov, 0 AS os FROM line WHERE rn = 1
  UNION ALL
  SELECT key, t, rn, x, dow, mean, variance, map_concat(seen, MAP {dow: {'m': nm, 'v': nv}}), 0.3::DOUBLE * nm + 0.7::DOUBLE * om, 0.3::DOUBLE * nv + 0.7::DOUBLE * ov, os + 1 FROM (
    SELECT *, CASE WHEN c IS NULL THEN 0 ELSE 0.3::DOUBLE * power(x - nm, 2) + 0.7::DOUBLE * c.v END AS nv, CASE WHEN c IS NOT NULL THEN c.m WHEN os > 0 THEN om ELSE 0 END AS mean, CASE WHEN c IS NOT NULL THEN c.v WHEN os > 0 THEN ov ELSE 1 END AS variance FROM (
      SELECT *, CASE WHEN c IS NULL THEN x ELSE 0.3::DOUBLE * x + 0.7::DOUBLE * c.m END AS nm FROM (
        SELECT l.key, l.t, l.rn, l.x, l.dow, r.seen, r.om, r.ov, r.os, r.seen[l.dow] AS c FROM r JOIN line l ON l.key = r.key AND l.rn = r.rn + 1))))"""


@_query("baseline_context_scan", build(_DAILY, "line AS MATERIALIZED (SELECT *, CAST((t + 3) % 7 AS INTEGER) AS dow FROM dr)", _WEEKLY, recursive=True) + f"SELECT key, t, dow, {rounded(['x', 'mean', 'sd'], 4)}, CASE WHEN variance > 1 THEN round((x - mean) / sqrt(variance), 4) END AS z FROM (SELECT *, sqrt(variance) AS sd FROM r)")
def _(spark, d):
    """The scan over days in seven contexts, with its fall-backs."""
    rows = _daily(spark, d).select(F.lit("all").alias("stream_id"), F.col("key").alias("feature"), F.lit(0).alias("ord"), F.col("t").alias("wid"), F.col("x").alias("value"), F.lit(0).alias("hour"), ((F.col("t") + 3) % 7).cast("int").alias("dow"), F.lit(0.0).alias("seed_mean"), F.lit(0.0).alias("seed_var"), F.lit(0).alias("seed_n"))
    out = rows.groupBy("stream_id", "feature").applyInPandas(scan.detect_scan(S), scan.DETECTED)
    out = out.select(F.col("feature").alias("key"), F.col("wid").alias("t"), ((F.col("wid") + 3) % 7).cast("int").alias("dow"), F.col("value").alias("x"), "mean", F.sqrt("variance").alias("sd"), F.when(F.col("variance") > 1, F.col("z")).alias("z"))
    return _round(out, "x", "mean", "sd", "z", digits=4)
