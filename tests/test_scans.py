"""Recursions against hand-computed values and a plain restatement."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators import mitigate, scan

S = Settings()


def test_ewma_first_value_has_no_deviation():
    assert scan.ewma(np.array([100.0]), 0.3)[2][0] == 0


def test_ewma_mean():
    assert scan.ewma(np.array([100.0, 200.0]), 0.3)[0][1] == pytest.approx(130)


def test_ewma_after_update_is_bounded():
    z = scan.ewma(np.array([0.0, 0.0, 1e6, 5.0, -3e5]), 0.3)[2]
    assert np.abs(z).max() <= 1 / np.sqrt(0.3) + 1e-9


@pytest.mark.parametrize(("z", "acc", "sure"), [([2], 0.0, False), ([6], 3.0, False), ([8, 8], 10.0, True), ([3], 0.0, False), ([8], 5.0, False), ([-8, 8], 10.0, True)])
def test_leaky(z, acc, sure):
    a, c = scan.leaky(np.array(z, float), S)
    assert a[-1] == pytest.approx(acc) and c[-1] == sure


def test_leaky_decays():
    assert scan.leaky(np.array([6.0, 1.0]), Settings(decay=0.5))[0][-1] == pytest.approx(1.5)


def test_baseline_fallbacks():
    b = scan.Baseline(S)
    assert b.get((12, 0)) == (0.0, 1.0)
    b.update(10.0, (12, 0))
    assert b.get((12, 0)) == (10.0, 0.0)
    assert b.get((1, 1)) == (0.0, 1.0)  # the overall baseline counts from the second update on
    b.update(20.0, (12, 0))
    assert b.get((1, 1)) == b.overall[:2]


def test_cooldown_counts_from_the_last_counted():
    t = np.array([0, 60, 120, 121, 242], float)
    assert scan.cooldown(t, np.ones(5, bool), S).tolist() == [True, False, False, True, True]


def tiers(pairs):
    m = mitigate.Responder(S)
    return [m.step(t, x) for t, x in pairs]


@pytest.mark.parametrize(("score", "tier"), [(0.3, 0), (0.55, 0), (0.75, 1), (0.88, 2), (0.95, 3)])
def test_tiers(score, tier):
    assert tiers([(0, score)]) == [tier]


def test_tier1_held():
    assert tiers([(0, 0.75), (60, 0.75)])[-1] == 1
    assert tiers([(0, 0.75), (61, 0.75)])[-1] == 2


def test_release_from_tier3():
    assert tiers([(0, 0.95), (10, 0.55), (130, 0.55)])[-1] == 3
    assert tiers([(0, 0.95), (10, 0.55), (131, 0.55)])[-1] == 0


def test_release_of_all():
    assert tiers([(0, 0.86), (10, 0.4), (310, 0.4)])[-1] == 2
    assert tiers([(0, 0.86), (10, 0.4), (311, 0.4)])[-1] == 0


def test_latched_with_lower_score():
    assert tiers([(0, 0.95), (5, 0.3)]) == [3, 3]


series = st.lists(st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None)
@given(st.lists(series, min_size=1, max_size=3))
def test_native_and_array_scans_agree(spark, many):
    rows = [(f"k{k}", t, x) for k, xs in enumerate(many) for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "key string, t long, x double").repartition(3)
    got = scan.ewma_native(df, ["key"], "t", "x", 0.3).toPandas().sort_values(["key", "t"])
    leak = scan.leaky_native(df, ["key"], "t", "x", S).toPandas().sort_values(["key", "t"])
    for k, xs in enumerate(many):
        mean, var, z = scan.ewma(np.array(xs), 0.3)
        one = got[got["key"] == f"k{k}"]
        np.testing.assert_allclose(one["mean"], mean, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(one["variance"], var, rtol=1e-7, atol=1e-7)
        np.testing.assert_allclose(leak[leak["key"] == f"k{k}"]["accumulator"], scan.leaky(np.array(xs), S)[0], rtol=1e-9, atol=1e-9)


def test_detect_scan_uses_the_state_before_the_update():
    pdf = pd.DataFrame({"stream_id": "s", "wid": [2, 1], "feature": "f", "ord": 0, "value": [10.0, 10.0], "hour": 12, "dow": 0, "seed_mean": 0.0, "seed_var": 4.0, "seed_n": 5})
    out = scan.detect_scan(S)(pdf)
    assert out["z"].tolist()[0] == pytest.approx(5.0)
    assert out["mean"].tolist()[1] == pytest.approx(3.0)


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_prefix_scans_equal_serial_scans(spark, size):
    from tidewatch.operators import prefix

    rng, data = np.random.default_rng(5), {}
    for key, n in (("a", 1), ("b", 500), ("c", 137)):
        x = rng.normal(10, 2, n) + np.where(np.arange(n) % 50 > 44, 30, 0)
        data[key] = (np.cumsum(rng.integers(1, 9, n)), x)
    data["d"] = (np.arange(60), np.full(60, 3.5))
    rows = spark.createDataFrame([(k, int(t), float(x)) for k, (ts, xs) in data.items() for t, x in zip(ts, xs, strict=True)], "key string, t long, x double").repartition(3)
    s = Settings(tau_z=2.0, theta=2.0)
    got = prefix.ewma(rows, ["key"], "t", "x", s.alpha, size).orderBy("key", "t").toPandas()
    starts = spark.createDataFrame([(k, 9.0, 4.0) for k in data], "key string, mean double, variance double")
    scanned = prefix.deviations(rows, ["key"], "t", "x", starts, s, size).orderBy("key", "t").toPandas()
    for key, (ts, x) in data.items():
        mean, var, z = scan.ewma(x, s.alpha)
        own = got[got["key"] == key]
        assert own["t"].tolist() == ts.tolist()
        np.testing.assert_allclose(own["mean"], mean, rtol=1e-9)
        np.testing.assert_allclose(own["variance"], var, rtol=1e-9, atol=1e-12)
        if key != "d":
            np.testing.assert_allclose(own["z"], z, rtol=1e-9, atol=1e-9)
        base, want = scan.Baseline(s, {0: (9.0, 4.0, 1)}), []
        for v in x.tolist():
            want.append(base.z(v, 0))
            base.update(v, 0)
        acc, sure = scan.leaky(np.array(want), s)
        own = scanned[scanned["key"] == key]
        if key != "d":
            np.testing.assert_allclose(own["z"], want, rtol=1e-9, atol=1e-9)
            np.testing.assert_allclose(own["accumulator"], acc, rtol=1e-9, atol=1e-9)
            assert own["confirmed"].tolist() == sure.tolist()


def test_a_long_stream_is_scanned_by_all_tasks(spark):
    from tidewatch.operators import prefix

    rows = spark.range(1_000_000).select(F.lit("one").alias("key"), F.col("id").alias("t"), (F.col("id") * 7919 % 1009 / 10.0).alias("x"))
    out = prefix.ewma(rows, ["key"], "t", "x", 0.3, 1 << 16).toPandas().sort_values("t")
    mean, var, z = scan.ewma(np.arange(1_000_000) * 7919 % 1009 / 10.0, 0.3)
    np.testing.assert_allclose(out["mean"], mean, rtol=1e-9)
    np.testing.assert_allclose(out["z"], z, rtol=1e-9, atol=1e-9)
    assert prefix.cut(rows, ["key"], "t", 1 << 16).select("block_").distinct().count() == 16


def test_detector_scans_long_streams_in_blocks(spark, sf):
    from tidewatch.operators import features
    from tidewatch.plans import catalog, detector
    from tidewatch.storage import stored

    found = stored(features.features(catalog._flows(spark, sf), catalog.S), "features")
    want = detector.deviations(found, catalog.S, 48).orderBy("stream_id", "feature", "wid").toPandas()
    got = detector.deviations(found, catalog.S, 48, block_rows=50).orderBy("stream_id", "feature", "wid").toPandas()
    assert list(got.columns) == list(want.columns) and len(want) > 1000
    for name in ("stream_id", "wid", "feature", "ord"):
        assert got[name].tolist() == want[name].tolist()
    np.testing.assert_allclose(got["variance"], want["variance"], rtol=1e-9, atol=1e-9)
    near = np.abs(want["variance"]) > 1e-6  # a spread of nothing but rounding has no deviation to speak of
    np.testing.assert_allclose(got["z"][near], want["z"][near], rtol=1e-6, atol=1e-6)
