"""SQL of the shared intermediate tables, for the twins of the queries."""

from __future__ import annotations

from tidewatch.config import FEATURES, TEMPLATE, Settings
from tidewatch.sources.adapters import COPIES, COUNTRIES, CYCLE, HOURS, STREAMS

FLOWS = f"""flows AS MATERIALIZED (
  SELECT 's' || (user_id % {STREAMS}) AS stream_id, wid, event_id * 100 + c AS flow_seq,
    '10.' || (user_id % 4) || '.' || (user_id // 254) || '.' || ((user_id + c % 3 * 17) % 254 + 1) AS src_ip,
    '10.0.0.' || (k % 4) AS dst_ip, 1024 + k AS sport, CASE WHEN k % 10 = 0 THEN 'UDP' ELSE 'TCP' END AS proto,
    us / 1e6 AS start_time, us / 1e6 + value AS last_time, CAST(floor(value * 10) AS BIGINT) AS bytes_sent,
    CAST(floor(value * 30) AS BIGINT) AS bytes_recv, event_id % 7 + 1 AS packets, (event_type <> 'error' AND c = 0) AS handshake_complete,
    event_id % 5 + 1 AS request_count, (event_type = 'error' AND value > 100) AS protocol_violation, event_type AS user_agent,
    [{", ".join(f"'{c}'" for c in COUNTRIES)}][k % 20 + 1] AS country_code, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS response_status
  FROM (SELECT *, unnest(range(CASE WHEN wid % {CYCLE} BETWEEN {HOURS[0]} AND {HOURS[1]} THEN {COPIES} ELSE 1 END)) AS c
        FROM (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS wid, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
)"""

ORDER_FLOWS = """flows AS MATERIALIZED (
  SELECT c_mktsegment AS stream_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS wid, l_orderkey * 8 + l_linenumber AS flow_seq,
    '10.1.' || (l_suppkey // 254) || '.' || (l_suppkey % 254) AS src_ip, n_name AS country_code, 'TCP' AS proto,
    epoch_us(l_shipdate) / 1e6 AS start_time, epoch_us(l_shipdate) / 1e6 + l_quantity AS last_time,
    CAST(floor(l_extendedprice) AS BIGINT) AS bytes_sent, l_returnflag <> 'R' AS handshake_complete, CAST(l_quantity AS BIGINT) AS request_count,
    l_linestatus = 'F' AS protocol_violation, l_returnflag AS user_agent, CASE WHEN l_returnflag = 'R' THEN 500 ELSE 200 END AS response_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def features(s: Settings) -> str:
    """CTEs now_, totals, bysrc, srcs, geo, payload, feats over flows."""
    return f"""now_ AS (SELECT stream_id, wid, max(last_time) AS now FROM flows GROUP BY ALL),
totals AS (
  SELECT stream_id, wid, count(*) AS n_flows, count(*) FILTER (start_time >= now - {s.dt}) / {s.dt} AS new_rate,
    count(*) FILTER (last_time >= now - {s.window}) AS n_live,
    coalesce(avg(greatest(last_time - start_time, 0)) FILTER (last_time >= now - {s.window}), 0) AS mean_dur,
    coalesce(var_pop(greatest(last_time - start_time, 0)) FILTER (last_time >= now - {s.window}), 0) AS var_dur,
    avg(CASE WHEN handshake_complete THEN 1.0::DOUBLE ELSE 0 END) AS hs, sum(request_count) AS requests, 1 - avg(CASE WHEN protocol_violation THEN 1.0::DOUBLE ELSE 0 END) AS comp,
    count(*) FILTER (response_status >= 400) AS n_err, coalesce(avg(greatest(last_time - start_time, 0)) FILTER (handshake_complete), 0) AS lat,
    count(*) FILTER (upper(proto) = 'TCP') / count(*) AS tcp
  FROM flows JOIN now_ USING (stream_id, wid) GROUP BY stream_id, wid),
bysrc AS (SELECT stream_id, wid, src_ip, CAST(sum(request_count) AS DOUBLE) AS r FROM flows GROUP BY ALL),
srcs AS (SELECT stream_id, wid, count(*) AS n_sources, var_pop(r) AS rv, stddev_pop(r) AS rs, avg(r) AS rm FROM bysrc GROUP BY ALL),
geo AS (SELECT stream_id, wid, -sum(c / n * log2(c / n)) AS h FROM (SELECT stream_id, wid, c, sum(c) OVER (PARTITION BY stream_id, wid) AS n FROM (SELECT stream_id, wid, country_code, count(*) AS c FROM flows WHERE country_code <> '' GROUP BY ALL)) GROUP BY ALL),
payload AS (SELECT stream_id, wid, -sum(c / n * log2(c / n)) AS h FROM (SELECT stream_id, wid, c, sum(c) OVER (PARTITION BY stream_id, wid) AS n FROM (SELECT stream_id, wid, bytes_sent, count(*) AS c FROM flows GROUP BY ALL)) GROUP BY ALL),
feats AS MATERIALIZED (
  SELECT t.stream_id, t.wid, n_flows, new_rate AS new_connection_rate, n_live / greatest(n_sources, 1) AS concurrent_connection_count, mean_dur AS mean_connection_duration,
    var_dur AS variance_connection_duration, hs AS handshake_completion_ratio, requests / {s.dt} AS request_rate, rv AS inter_request_timing_variance,
    comp AS protocol_compliance_score, requests / {s.dt} AS total_request_rate, CAST(n_sources AS DOUBLE) AS unique_source_count, greatest(coalesce(g.h, 0), 0) AS geographic_entropy,
    n_err / greatest(requests, 1) AS backend_error_rate, lat AS response_latency_mean, n_sources * 60.0::DOUBLE / {s.dt} AS source_diversity_per_minute,
    abs(greatest(coalesce(g.h, 0), 0) - lag(greatest(coalesce(g.h, 0), 0), 1, 0) OVER (PARTITION BY t.stream_id ORDER BY t.wid)) AS geo_distribution_shift_rate,
    CASE WHEN n_sources < 2 THEN 0 ELSE least(rs / greatest(rm, {s.epsilon}), 1) END AS cross_source_timing_correlation, tcp AS protocol_frequency_ratio, greatest(coalesce(p.h, 0), 0) AS payload_entropy_proxy
  FROM totals t JOIN srcs USING (stream_id, wid) LEFT JOIN geo g USING (stream_id, wid) LEFT JOIN payload p USING (stream_id, wid))"""


#: Added before rounding, in units of the last digit, where exact halves are common: both engines then round them alike.
SHIFT = 0.0123


def rounded(names, digits: int = 6, shift: float = 0.0) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE) + {shift * 10.0**-digits!r}::DOUBLE, {digits}) AS {n}" for n in names)


LONG = "long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT stream_id, wid, '{f}' AS feature, {i} AS ord, CAST({f} AS DOUBLE) AS value FROM feats" for i, f in enumerate(FEATURES)) + ")"


def seed(n: int) -> str:
    return f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, feature ORDER BY wid) AS rn FROM long),
seed AS MATERIALIZED (SELECT stream_id, feature, avg(value) AS seed_mean, greatest(stddev_pop(value) * stddev_pop(value), 0.05 * avg(value) + 0.01, 0.1) AS seed_var, count(*) AS seed_n FROM ranked WHERE rn <= {n} GROUP BY ALL)"""


def detected(s: Settings, n: int) -> str:
    """CTE det: the state scan after n seed windows, as a recursion over row numbers."""
    z = f"(value - mean) / greatest(sqrt(greatest(variance, 0)), {s.epsilon})"
    m = f"({s.alpha} * value + (1 - {s.alpha}::DOUBLE) * mean)"
    grow = lambda prev: f"CASE WHEN abs({z}) > {s.tau_z} THEN {prev} + (abs({z}) - {s.tau_z}) ELSE {prev} * {s.decay} END"
    cols = lambda prev: f"stream_id, feature, ord, wid, rn, value, mean, variance, {z} AS z, {grow(prev)} AS accumulator, {m} AS next_mean, {s.alpha} * power(value - {m}, 2) + (1 - {s.alpha}::DOUBLE) * variance AS next_variance"
    return f"""det AS (
  SELECT {cols("0.0::DOUBLE")} FROM (SELECT r.*, seed_mean AS mean, seed_var AS variance FROM ranked r JOIN seed USING (stream_id, feature) WHERE rn = {n} + 1)
  UNION ALL
  SELECT {cols("prev")} FROM (SELECT r.stream_id, r.feature, r.ord, r.wid, r.rn, r.value, d.next_mean AS mean, d.next_variance AS variance, d.accumulator AS prev
    FROM det d JOIN ranked r ON r.stream_id = d.stream_id AND r.feature = d.feature AND r.rn = d.rn + 1))"""


def weights(s: Settings) -> str:
    return "weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in s.weights.items()) + ") w(feature_id, weight))"


def rules(s: Settings) -> str:
    """CTEs of the rules without state: exhausted, slow, agents, many."""
    return f"""exhausted AS (SELECT stream_id, wid, max_source, max_subnet, max_source > {s.incomplete_per_source} OR max_subnet > {s.incomplete_per_subnet} AS fired FROM
  (SELECT stream_id, wid, max(n) AS max_source FROM (SELECT stream_id, wid, src_ip, count(*) FILTER (NOT handshake_complete) AS n FROM flows GROUP BY ALL) GROUP BY ALL)
  JOIN (SELECT stream_id, wid, max(n) AS max_subnet FROM (SELECT stream_id, wid, regexp_extract(src_ip, '^[^.]*[.][^.]*[.][^.]*') AS net, count(*) FILTER (NOT handshake_complete) AS n FROM flows GROUP BY ALL) GROUP BY ALL) USING (stream_id, wid)),
slow AS (SELECT *, n_tiny >= {s.slow_tiny} OR n_slow > {s.slow_many} AS fired FROM (SELECT stream_id, wid,
  count(*) FILTER (last_time - start_time > {s.slow_tiny_seconds} AND bytes_sent < {s.slow_tiny_bytes}) AS n_tiny,
  count(*) FILTER (last_time - start_time > {s.slow_many_seconds} AND bytes_sent < {s.slow_many_bytes}) AS n_slow FROM flows GROUP BY ALL)),
agents AS (SELECT *, n_flows >= {s.agents_least_flows} AND n_agents / n_flows < {s.agents_diversity} AS fired FROM (SELECT stream_id, wid, count(*) AS n_flows, count(DISTINCT nullif(user_agent, '')) AS n_agents FROM flows GROUP BY ALL)),
nets AS (SELECT stream_id, wid, max(n) AS max_sources FROM (SELECT stream_id, wid, regexp_extract(src_ip, '^[^.]*[.][^.]*') AS net, count(DISTINCT src_ip) AS n FROM flows JOIN now_ USING (stream_id, wid) WHERE start_time >= now - {s.burst_window} GROUP BY ALL) GROUP BY ALL),
many AS (SELECT stream_id, wid, coalesce(max_sources, 0) AS max_sources, n_sources, rs / greatest(rm, {s.epsilon}) AS cv, coalesce(max_sources > {s.burst_sources}, false) AS burst,
  NOT coalesce(max_sources > {s.burst_sources}, false) AND n_sources >= {s.timing_sources} AND round(rs / greatest(rm, {s.epsilon}), 12) > {s.timing_cv} AS synchronised FROM srcs LEFT JOIN nets USING (stream_id, wid))"""


def spikes(s: Settings) -> str:
    """CTEs records, steps and spike: the smoothed-rate rule as a recursion."""
    over = f"list_filter(recs, lambda x: x.rate > {s.rate_multiplier} * r)"
    nxt = f"{s.rate_smoothing} * coalesce(({over})[1].rate, mean_rate) + (1 - {s.rate_smoothing}::DOUBLE) * r"
    return f"""rates AS (SELECT stream_id, wid, src_ip, sum(request_count) / greatest(max(greatest(last_time - start_time, {s.dt})), {s.dt}) AS rate, min(flow_seq) AS first_seq, sum(request_count) AS requests FROM flows GROUP BY ALL),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY wid) AS rn FROM (SELECT stream_id, wid, sum(requests) / count(*) / {s.dt} AS mean_rate, list({{'rate': rate}} ORDER BY first_seq) AS recs FROM rates GROUP BY ALL)),
spike AS (SELECT stream_id, wid, rn, r AS rate_baseline, len({over}) > 0 AS fired, {nxt} AS next_r FROM (SELECT *, {s.rate_start}::DOUBLE AS r FROM steps WHERE rn = 1)
  UNION ALL SELECT stream_id, wid, rn, r, len({over}) > 0, {nxt} FROM (SELECT t.*, p.next_r AS r FROM spike p JOIN steps t ON t.stream_id = p.stream_id AND t.rn = p.rn + 1))"""


RULE_EVENTS = """rule_events AS MATERIALIZED (
  SELECT stream_id, wid, 'incomplete_handshake_spike' AS feature_id, 18 AS ord, 1.0::DOUBLE AS confidence FROM exhausted WHERE fired
  UNION ALL SELECT stream_id, wid, 'session_duration_anomaly', 19, 1.0 FROM slow WHERE fired
  UNION ALL SELECT stream_id, wid, 'per_source_request_spike', 20, 1.0 FROM spike WHERE fired
  UNION ALL SELECT a.stream_id, a.wid, 'user_agent_homogeneity', 21, 1.0 FROM agents a JOIN spike p ON a.stream_id = p.stream_id AND a.wid = p.wid WHERE a.fired AND NOT p.fired
  UNION ALL SELECT stream_id, wid, 'distributed_connection_burst', 22, 1.0 FROM many WHERE burst
  UNION ALL SELECT stream_id, wid, 'synchronized_request_timing', 23, 1.0 FROM many WHERE synchronised)"""


def scored(s: Settings, events: str) -> str:
    """CTE scored over a table of events and the spine of feats."""
    firsts = ", ".join(f"min(CASE WHEN feature_id = '{n}' THEN wid * 100 + ord END) AS at{k}" for k, n in enumerate(TEMPLATE[:3]))
    frame = f"(PARTITION BY stream_id ORDER BY t RANGE BETWEEN {s.window} PRECEDING AND CURRENT ROW)"
    return f"""per AS (SELECT stream_id, wid, sum(coalesce(weight, {s.default_weight}) * confidence) AS sum_w, {firsts} FROM {events} LEFT JOIN weights USING (feature_id) GROUP BY stream_id, wid),
framed AS (SELECT stream_id, wid, least(round(coalesce(sum(sum_w) OVER {frame}, 0), 12), 1) AS raw, min(at0) OVER {frame} AS f0, min(at1) OVER {frame} AS f1, min(at2) OVER {frame} AS f2
  FROM (SELECT stream_id, wid, wid * {s.dt}::DOUBLE AS t, sum_w, at0, at1, at2 FROM (SELECT DISTINCT stream_id, wid FROM feats) LEFT JOIN per USING (stream_id, wid))),
scored AS MATERIALIZED (SELECT stream_id, wid, coalesce(f0 < f1 AND f1 < f2, false) AS boosted, CASE WHEN coalesce(f0 < f1 AND f1 < f2, false) THEN least(raw + {s.boost}, 1) ELSE raw END AS score FROM framed)"""


def tier(score: str, s: Settings) -> str:
    return f"CASE WHEN {score} >= {s.tier3} THEN 3 WHEN {score} >= {s.tier2} THEN 2 WHEN {score} >= {s.tier1} THEN 1 WHEN {score} >= {s.alert} THEN 0 ELSE -1 END"


def machine(s: Settings, scored: str) -> str:
    """CTEs line and fsm: the mitigation state machine as a recursion."""
    step = f"""SELECT stream_id, wid, rn, score, greatest(t3, asked) AS tier, CASE WHEN asked = 1 AND s1 IS NULL THEN now ELSE s1 END AS since1, c3 AS calm3, c AS calm FROM (
    SELECT *, CASE WHEN fired THEN NULL ELSE since1 END AS s1, CASE WHEN fired THEN 0 ELSE t2 END AS t3, CASE WHEN NOT low OR fired THEN NULL ELSE coalesce(calm, now) END AS c FROM (
    SELECT *, CASE WHEN fired3 THEN 0 ELSE t1 END AS t2, CASE WHEN NOT low3 OR fired3 THEN NULL ELSE coalesce(calm3, now) END AS c3, score < {s.alert} AS low, coalesce(score < {s.alert} AND now - calm > {s.hold_all}, false) AS fired FROM (
    SELECT *, t1 = 3 AND score < {s.release3} AS low3, coalesce(t1 = 3 AND score < {s.release3} AND now - calm3 > {s.hold3}, false) AS fired3, CASE WHEN score >= {s.tier3} THEN 3 WHEN score >= {s.tier2} THEN 2 WHEN score >= {s.tier1} THEN 1 ELSE 0 END AS asked FROM (
    SELECT *, CASE WHEN tier = 1 AND since1 IS NOT NULL AND now - since1 > {s.hold1} THEN 2 ELSE tier END AS t1 FROM ({{source}})))))"""
    first = "SELECT stream_id, wid, rn, score, now, 0 AS tier, NULL::DOUBLE AS since1, NULL::DOUBLE AS calm3, NULL::DOUBLE AS calm FROM line WHERE rn = 1"
    later = "SELECT l.stream_id, l.wid, l.rn, l.score, l.now, f.tier, f.since1, f.calm3, f.calm FROM fsm f JOIN line l ON l.stream_id = f.stream_id AND l.rn = f.rn + 1"
    return f"""line AS MATERIALIZED (SELECT stream_id, wid, score, wid * {s.dt}::DOUBLE AS now, row_number() OVER (PARTITION BY stream_id ORDER BY wid) AS rn FROM {scored}),
fsm AS ({step.format(source=first)} UNION ALL {step.format(source=later)})"""


def build(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
