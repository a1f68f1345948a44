"""Features, rules and correlation on small literal frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import FEATURES, Settings
from tidewatch.functions import scalars
from tidewatch.operators import baseline, correlate, features, rules
from tidewatch.schema import DEFAULTS, FLOW_COLUMNS, FLOW_FIELDS

S = Settings()
TYPES = {n: t.simpleString() for n, t, _ in FLOW_FIELDS}


def flows(spark, rows, stream="s", wid=0):
    full = [(stream, wid, k, *({**DEFAULTS, **r}[c] for c in FLOW_COLUMNS)) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "stream_id string, wid long, flow_seq long, " + ", ".join(f"{c} {TYPES[c]}" for c in FLOW_COLUMNS))


def test_single_flow_has_all_features(spark):
    row = features.features(flows(spark, [{"start_time": 1.0, "last_time": 2.0}]), S).first()
    assert all(row[f] is not None for f in FEATURES)
    assert row["handshake_completion_ratio"] == 1 and row["mean_connection_duration"] == 1


def test_empty_window_is_zero(spark):
    spine = spark.createDataFrame([("s", 0), ("s", 1)], "stream_id string, wid long")
    out = features.on_spine(features.features(flows(spark, [{}]), S), spine).filter("wid = 1").first()
    assert all(out[f] == 0 for f in FEATURES)


def test_entropy(spark):
    rows = [{"country_code": c} for c in ("US", "US", "GB", "FR", "DE", "DE", "DE", "")]
    h = features.entropy(flows(spark, rows), ["wid"], F.nullif(F.col("country_code"), F.lit(""))).first()["entropy"]
    assert h == pytest.approx(1.8423709931771086)


def windows(spark, rows, **where):
    return features.windows(flows(spark, rows, **where), S)


def fired(df):
    return df.first()["fired"]


@pytest.mark.parametrize(("n", "on"), [(100, False), (101, True)])
def test_incomplete_per_source(spark, n, on):
    assert fired(rules.connection_exhaustion(windows(spark, [{"src_ip": "1.2.3.4", "handshake_complete": False}] * n), S)) is on


@pytest.mark.parametrize(("n", "on"), [(500, False), (501, True)])
def test_incomplete_per_subnet(spark, n, on):
    rows = [{"src_ip": f"1.2.3.{k % 250}", "handshake_complete": False} for k in range(n)]
    assert fired(rules.connection_exhaustion(windows(spark, rows), S)) is on


@pytest.mark.parametrize(("n", "last", "size", "on"), [(9, 6.0, 50, False), (10, 6.0, 50, True), (20, 11.0, 1000, False), (21, 11.0, 1000, True)])
def test_slow(spark, n, last, size, on):
    assert fired(rules.slow_requests(windows(spark, [{"last_time": last, "bytes_sent": size}] * n), S)) is on


@pytest.mark.parametrize(("n", "agents", "on"), [(99, 1, False), (100, 10, False), (100, 9, True)])
def test_agents(spark, n, agents, on):
    rows = [{"user_agent": f"a{k % agents}"} for k in range(n)]
    assert fired(rules.agent_homogeneity(windows(spark, rows), S)) is on


@pytest.mark.parametrize(("n", "on"), [(50, False), (51, True)])
def test_distributed(spark, n, on):
    assert rules.distributed(windows(spark, [{"src_ip": f"10.0.{k}.1"} for k in range(n)]), S).first()["burst"] is on


@pytest.mark.parametrize(("n", "on"), [(99, False), (100, True)])
def test_synchronised(spark, n, on):
    rows = [{"src_ip": f"{k}.{k}.0.1", "request_count": 100 if k % 10 == 0 else 1} for k in range(n)]
    row = rules.distributed(windows(spark, rows), S).first()
    assert row["burst"] is False and row["synchronised"] is on


def test_benign_grid_is_quiet(spark):
    rows = [{"src_ip": f"10.0.{k // 10}.{k % 10}", "user_agent": f"a{k}"} for k in range(50)]
    assert rules.rule_events(windows(spark, rows), S).count() == 0


def test_request_spike_moves_with_the_offender(spark):
    heavy = flows(spark, [{"src_ip": "a", "request_count": 10_000}], wid=0).unionByName(flows(spark, [{"src_ip": "a", "request_count": 2_600}], wid=1))
    out = rules.request_spike(features.windows(heavy, S), S).orderBy("wid").collect()
    assert [r["fired"] for r in out] == [True, False]  # 2000 > 500, then 520 against 10 * (0.1 * 2000 + 0.9 * 50)
    assert out[1]["rate_baseline"] == pytest.approx(245)


def score_of(spark, events, at=(0,)):
    e = spark.createDataFrame([("s", w, f, o, c) for w, f, o, c in events], "stream_id string, wid long, feature_id string, ord int, confidence double")
    spine = spark.createDataFrame([("s", w) for w in at], "stream_id string, wid long")
    return correlate.scores(e, spine, S).orderBy("wid").collect()


def test_score_one_burst(spark):
    assert score_of(spark, [(0, "distributed_connection_burst", 22, 0.8)])[0]["score"] == pytest.approx(0.4)


def test_score_unknown_and_cap(spark):
    assert score_of(spark, [(0, "other", 1, 1.0)])[0]["score"] == pytest.approx(0.05)
    assert score_of(spark, [(0, "distributed_connection_burst", 22, 1.0)] * 10)[0]["score"] == 1.0


def test_window_includes_its_start(spark):
    out = score_of(spark, [(0, "distributed_connection_burst", 22, 1.0)], at=(0, 12, 13))
    assert [round(r["score"], 6) for r in out] == [0.5, 0.5, 0.0]


def test_template_boost(spark):
    steps = [(0, "distributed_connection_burst", 22, 0.5), (1, "per_source_request_spike", 20, 0.5), (2, "incomplete_handshake_spike", 18, 0.5)]
    out = score_of(spark, steps, at=(0, 1, 2))
    assert [r["boosted"] for r in out] == [False, False, True]
    assert out[2]["score"] == pytest.approx(0.25 + 0.1 + 0.175 + 0.2)


def test_same_step_is_not_ordered(spark):
    steps = [(0, "distributed_connection_burst", 22, 1.0), (0, "per_source_request_spike", 20, 1.0), (0, "incomplete_handshake_spike", 18, 1.0)]
    assert score_of(spark, steps)[0]["boosted"] is False


def kept_by_iqr(values):
    if len(values) < 4:
        return values
    v, n = sorted(values), len(values)
    spread = 1.5 * (v[3 * n // 4] - v[n // 4])
    return [x for x in values if v[n // 2] - spread <= x <= v[n // 2] + spread]


def test_iqr(spark):
    rng = np.random.default_rng(4)
    many = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 100.0], [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 4.0, 50.0], [5.0] * 40 + [9.0], [-7.5, -1e6, 0.0, 0.0, 3.0, 1e9], *[rng.normal(k, 10.0**k, 20 + k).tolist() for k in range(6)], [7.0, 8.0]]
    rows = [("s", "f", k, 0, x) for k, xs in enumerate(many) for x in xs]
    df = spark.createDataFrame(rows, "stream_id string, feature string, hour int, dow int, value double").repartition(3)
    got = {r["hour"]: r for r in baseline.learned_contexts(df, 3).collect()}
    assert sorted(got) == list(range(len(many) - 1))
    for k, r in got.items():
        kept = kept_by_iqr(many[k])
        assert r["n"] == len(kept) and r["mean"] == pytest.approx(np.mean(kept)) and r["variance"] == pytest.approx(np.var(kept), rel=1e-9, abs=1e-9)


def test_baselines_written_and_loaded(spark):
    rows = [("s", "f", 1, 2, 1.5, 0.25, 12), ("s", "f", 3, 4, -2.0, 0.0, 10), ("s", "g", 1, 2, 1e-9, 1e9, 11)]
    df = spark.createDataFrame(rows, "stream_id string, feature string, hour int, dow int, mean double, variance double, n long")
    assert sorted(baseline.loaded(baseline.serialized(df)).collect()) == sorted(df.collect())
    assert {(r["feature"], r["contexts"]) for r in baseline.feature_ids(df).collect()} == {("f", 2), ("g", 1)}
    assert baseline.without(df, ["f"]).count() == 1 and baseline.without(df).count() == 0


def test_salted_windows_and_records(spark, monkeypatch):
    """Windows too many to send join by salt; records are those of a plain scan, in one window of rising rates too."""
    rows = [{"src_ip": f"10.{k % 9}.0.{k}", "request_count": (k * 37) % 101, "last_time": k * 0.01} for k in range(150)] + [{"src_ip": f"11.0.0.{k}", "request_count": 200 + k} for k in range(20)]
    df = flows(spark, rows)
    a = features.windows(df, S).first().asDict(recursive=True)
    monkeypatch.setattr(features, "SENT_WINDOWS", 0)
    b = features.windows(df, S).first().asDict(recursive=True)
    assert b.pop("records") == a["records"] and b == pytest.approx({k: v for k, v in a.items() if k != "records"})
    best, want = -1, []
    for k, r in enumerate(rows):
        rate = r["request_count"] / S.dt
        if rate > best:
            best, want = rate, [*want, (k, rate)]
    assert [(r["first_seq"], r["rate"]) for r in a["records"]] == want


def test_spine(spark):
    found = spark.createDataFrame([("s", 3), ("s", 6), ("t", 1)], "stream_id string, wid long")
    assert sorted(map(tuple, features.spine(found).collect())) == [("s", 3), ("s", 4), ("s", 5), ("s", 6), ("t", 1)]


def test_recent_events(spark):
    e = spark.createDataFrame([(w,) for w in range(30)], "wid long")
    assert [r[0] for r in correlate.recent_events(e, 100.0, S).collect()] == list(range(8, 21))


def test_the_flows_are_read_three_times(spark, sf):
    """Everything else reads tables of a row a window, source or series."""
    from tidewatch.plans import catalog

    df = catalog.queries()["detection_steps"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert plan.count("FileScan") <= 12 and "events.parquet" not in plan


def test_scalars(spark):
    df = spark.createDataFrame([("12.9",), ("nan",), ("inf",), ("x",), (None,), (" 7 ",)], "v string")
    assert [r[0] for r in df.select(scalars.safe_long("v")).collect()] == [12, 0, 0, 0, 0, 7]
    t = spark.createDataFrame([("03/07/2017 10:00:00",), ("2017-07-03 10:00:00",), ("03-07-2017 10:00:00",), ("12/25/2017 1:02:03",), ("1499076000.5",), ("never",), (None,)], "v string")
    assert [r[0] for r in t.select(scalars.parse_time("v")).collect()] == [1499076000.0, 1499076000.0, 1499076000.0, 1514163723.0, 1499076000.5, 0.0, 0.0]


def test_order_and_partitions_do_not_matter(spark):
    rows = [{"src_ip": f"10.{k % 7}.0.{k}", "request_count": k % 5, "last_time": k * 0.1, "bytes_sent": k % 9} for k in range(200)]
    a = flows(spark, rows)
    one = features.features(a, S).first()
    two = features.features(a.orderBy(F.rand(3)).repartition(7), S).first()
    for f in FEATURES:
        assert one[f] == pytest.approx(two[f])
