"""Streams give what the batch scans give."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators import features, mitigate, scan
from tidewatch.streaming import live

S = Settings()


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.table(name)


def test_scan_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(10, 1, 30)
    x[20:] += 30
    for k in range(3):
        part = [("s", "f", w, float(x[w])) for w in range(10 * k, 10 * k + 10)]
        spark.createDataFrame(part, "stream_id string, feature string, wid long, value double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    src = spark.readStream.schema("stream_id string, feature string, wid long, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = run(spark, live.scan_stream(src, S), "scanned", tmp_path).toPandas().sort_values("wid")
    base, z = scan.Baseline(S), []
    for v in x:
        z.append(base.z(v, 0))
        base.update(v, 0)
    acc, sure = scan.leaky(np.array(z), S)
    assert got["wid"].tolist() == list(range(30))
    np.testing.assert_allclose(got["z"], z, rtol=1e-6)
    np.testing.assert_allclose(got["accumulator"], acc, rtol=1e-6)
    assert got["confirmed"].tolist() == sure.tolist()


def test_respond_stream(spark, tmp_path):
    scores = [0.95] * 2 + [0.3] * 30
    rows = [("s", w, x) for w, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "stream_id string, wid long, score double")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    got = run(spark, live.respond_stream(src, S), "responded", tmp_path).toPandas().sort_values("wid")
    want = mitigate.respond(df, S).toPandas().sort_values("wid")
    assert got["current_tier"].tolist() == want["current_tier"].tolist() and want["current_tier"].iloc[-1] == 0


def test_window_features_stream(spark, tmp_path):
    rows = [("s", float(t), float(t) + 1, 2, True, 200, "TCP", f"ip{t % 3}") for t in range(0, 40)]
    schema = "stream_id string, start_time double, last_time double, request_count long, handshake_complete boolean, response_status int, proto string, src_ip string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = run(spark, live.window_features(live.read_flow_stream(spark, str(tmp_path / "in"), schema), S, "0 seconds"), "windows", tmp_path).orderBy("wid").collect()
    assert len(out) >= 6 and out[0]["n_flows"] == 5 and out[0]["request_rate"] == pytest.approx(2.0) and out[0]["unique_source_count"] == 3


def test_live_flows_stream(spark, tmp_path):
    rows = [(float(t), "a", "b", 1, 2, 6, 10) for t in (0.0, 0.5, 0.9, 30.0, 90.0)]
    schema = "ts double, src_ip string, dst_ip string, sport int, dport int, proto_num int, length long"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = run(spark, live.live_flows(src, late="0 seconds"), "sessions", tmp_path).orderBy("start_time").collect()
    assert [(r["start_time"], r["packets"]) for r in out][:2] == [(0.0, 3), (30.0, 1)]


def test_all_features_of_closed_windows_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"s{k % 2}", k, f"10.0.{int(a)}.1", "TCP", float(t), float(t) + float(x), int(b), True, 1 + k % 4, False, f"a{k % 3}", "US" if k % 3 else "DE", 200, "d", 1, 80, 5, 3) for k, (t, x, a, b) in enumerate(zip(np.sort(rng.uniform(0, 60, 300)), rng.uniform(0, 9, 300), rng.integers(0, 20, 300), rng.integers(0, 50, 300), strict=True))]
    schema = "stream_id string, flow_seq long, src_ip string, proto string, start_time double, last_time double, bytes_sent long, handshake_complete boolean, request_count long, protocol_violation boolean, user_agent string, country_code string, response_status int, dst_ip string, sport int, dport int, bytes_recv long, packets long"
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * (k + 1)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    live.features_query(src, str(tmp_path / "out"), S, str(tmp_path / "check"), late=5.0, availableNow=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/features")).drop("batch").toPandas().sort_values(["stream_id", "wid"]).reset_index(drop=True)
    batch = spark.createDataFrame(rows, schema).withColumn("wid", F.floor(F.col("start_time") / 5).cast("long"))
    want = features.features(batch, S).toPandas().sort_values(["stream_id", "wid"])
    want = want[want["wid"] <= got["wid"].max()].reset_index(drop=True)
    assert got["wid"].max() >= 9 and list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_flush_stream(spark, tmp_path):
    a, b = ("a", 1, "b", 2, 6), ("c", 1, "b", 2, 6)
    rows = [(t, *a, f, 10) for t, f in ((10.0, 2), (10.1, 18), (10.2, 16), (13.0, 24), (16.0, 24))] + [(10.5, *b, 1, 7)]
    schema = "ts double, src_ip string, sport int, dst_ip string, dport int, proto_num int, tcp_flags int, length long"
    for k, part in enumerate((rows, [(30.0, "x", 1, "y", 2, 6, 2, 1)], [(200.0, "x", 1, "y", 2, 6, 2, 1)], [(210.0, "x", 1, "y", 2, 6, 2, 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = run(spark, live.flush_stream(src, late="1 seconds"), "flushed", tmp_path).toPandas().sort_values(["src_ip", "flushed_at"])
    mine = got[got["src_ip"] == "a"]
    assert mine["packets"].tolist()[0] == 5 and mine["flushed_at"].tolist()[0] == 16.0  # five seconds of packets
    assert mine["handshake_complete"].all() and not mine["protocol_violation"].any() and len(mine) == 2
    other = got[got["src_ip"] == "c"]
    assert len(other) == 1 and other["protocol_violation"].all() and not other["handshake_complete"].any()  # FIN before a handshake; idle


FLOWS = "stream_id string, flow_seq long, src_ip string, proto string, start_time double, last_time double, bytes_sent long, handshake_complete boolean, request_count long, protocol_violation boolean, user_agent string, country_code string, response_status int, dst_ip string, sport int, dport int, bytes_recv long, packets long"


def attacked(seed, until=500):
    """Flows of two streams in order of time; every so often a flood from few sources."""
    rng, rows = np.random.default_rng(seed), []
    for k, t in enumerate(np.sort(rng.uniform(0, until, 4 * until))):
        hot = t % 120 > 85
        rows.append((f"s{k % 2}", k, f"10.0.{int(rng.integers(3 if hot else 60))}.{k % 4}", "TCP", float(t), float(t + rng.uniform(0, 9)), int(rng.integers(0, 50)), bool(not hot or k % 3), int(1 + k % 4 + (40 if hot else 0)), bool(hot and k % 5 == 0), f"a{k % (1 if hot else 30)}", "US" if k % 3 else "DE", 200, "d", 1, 80, 5, 3))
    return rows


LIVE = Settings(tau_z=1.0, theta=1.0, rate_start=1.0, incomplete_per_source=3, agents_least_flows=5, agents_diversity=0.5, burst_sources=1, timing_sources=2, timing_cv=0.2, hold1=15.0, hold3=10.0, hold_all=20.0)


def batch_results(spark, rows, s, seeds):
    from tidewatch.operators import correlate
    from tidewatch.plans import detector

    flows = spark.createDataFrame(rows, FLOWS).withColumn("wid", F.floor(F.col("start_time") / s.dt).cast("long"))
    found = detector.run(flows, s, seeds)
    tiers = mitigate.respond(found.scored, s).join(found.scored.select("stream_id", "wid", "boosted"), ["stream_id", "wid"]).join(correlate.top_anomaly(found.detected, found.rules), ["stream_id", "wid"], "left")
    return {(r["stream_id"], r["wid"]): (round(r["score"], 9), r["boosted"], r["current_tier"], r["top_anomaly"]) for r in tiers.collect()}


@pytest.mark.parametrize("shuffled", [False, True])
def test_detector_stream_equals_the_batch_whatever_the_order(spark, tmp_path, shuffled):
    from tidewatch.streaming import detector as online

    rows = attacked(3)
    parts = [rows[k : k + 500] for k in range(0, len(rows), 500)]
    if shuffled:  # every tenth flow comes a part late, some two
        parts = [[r for r in p if r[1] % 10] for p in parts[:-1]] + parts[-1:]
        for k in range(len(parts) - 1):
            parts[min(k + 1 + k % 2, len(parts) - 1)] += [r for r in rows[500 * k : 500 * (k + 1)] if r[1] % 10 == 0]
    folder, check = str(tmp_path / "out"), str(tmp_path / "check")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, FLOWS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        # Each start is a restart: all queries stop and go on from their checkpoints.
        src = spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        for q in online.start(src, folder, LIVE, check, late=5.0, seed_windows=12, availableNow=True):
            q.awaitTermination(300)
    got = spark.read.parquet(f"{folder}/results")
    assert got.filter("too_late").count() == 0
    mine = {(r["stream_id"], r["wid"]): (round(r["score"], 9), r["boosted"], r["current_tier"], r["top_anomaly"]) for r in online.latest(got).collect()}
    want = {k: v for k, v in batch_results(spark, rows, LIVE, 12).items() if k[1] <= max(w for _, w in mine)}
    assert mine == want and len(mine) > 150
    assert len({v[2] for v in mine.values()}) > 1
    assert (got.count() > len(mine)) == shuffled


@pytest.mark.parametrize("seeds", [0, 30])
def test_online_detector_with_contexts_equals_the_scan(seeds):
    from datetime import UTC, datetime

    from tidewatch.config import FEATURES
    from tidewatch.streaming.detector import Online

    s, rng = Settings().scaled(3600.0), np.random.default_rng(4)
    x = rng.normal(10, 1, (600, len(FEATURES)))
    x[400:] += 5
    x[:, FEATURES.index("geo_distribution_shift_rate")] = np.abs(np.diff(x[:, FEATURES.index("geographic_entropy")], prepend=0.0))
    live_one, levels = Online(s, seeds, calendar=True), []
    for wid in range(600):
        live_one = Online.of_json(live_one.to_json(), s, seeds, True)  # as it is kept between batches
        live_one.step({"wid": wid, "features": x[wid].tolist(), "rates": [1.0], "mean_rate": 1.0, "fired": [False] * 6})
        levels.append(live_one.level.copy())
    times = [datetime.fromtimestamp(w * 3600, UTC) for w in range(600)]
    for k, name in enumerate(FEATURES):
        rows = pd.DataFrame({"stream_id": "s", "feature": name, "ord": k, "wid": range(600), "value": x[:, k], "hour": [t.hour for t in times], "dow": [t.weekday() for t in times], "seed_mean": 0.0, "seed_var": 0.0, "seed_n": 0})
        want = scan.detect_scan(s, seeds)(rows)
        np.testing.assert_allclose([v[k] for v in levels[seeds:]], want["accumulator"], rtol=1e-12, atol=1e-12)


def test_rows_older_than_the_replay_are_told(spark, tmp_path):
    from tidewatch.streaming import detector as online

    rows = attacked(8, 200)
    early = [r for r in rows if r[1] in (5, 6)]
    for part in ([r for r in rows if r[1] not in (5, 6)], early):
        spark.createDataFrame(part, FLOWS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        src = spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        for q in online.start(src, str(tmp_path / "out"), LIVE, str(tmp_path / "check"), late=5.0, seed_windows=5, replay=10, availableNow=True):
            q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out/results"))
    assert {(r["stream_id"], r["wid"]) for r in got.filter("too_late").collect()} == {(r[0], int(r[4] // 5)) for r in early}


def test_snapshots_of_live_flows_equal_a_plain_loop(spark, tmp_path):
    from tidewatch.streaming.snapshots import snapshot_stream, updated

    rng, rows, t = np.random.default_rng(3), [], 1000.0
    for seq in range(400):
        t += float(rng.choice([0.05, 0.3, 1.0, 4.0, 30.0], p=[0.4, 0.3, 0.2, 0.08, 0.02]))
        rows.append((round(t - float(rng.choice([0, 0, 1.5])), 3), seq, f"10.0.0.{rng.integers(4)}", int(rng.integers(3)), "10.9.9.9", 80, 6, int(rng.choice([2, 18, 16, 1, 3, 24])), int(rng.integers(1500))))
    end = t + 300
    schema = "ts double, seq long, src_ip string, sport int, dst_ip string, dport int, proto_num int, tcp_flags int, length long"
    for k, part in enumerate([*(rows[j : j + 100] for j in range(0, 400, 100)), [(end, 1000, "x", 1, "y", 2, 6, 2, 1)], [(end + 60, 1001, "x", 1, "y", 2, 6, 2, 1)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        snapshot_stream(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(200)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("src_ip <> 'x'").collect()}
    want, table, rest = set(), {}, sorted(rows)
    for tick in range(int(rows[0][0] // 5), int(end // 5)):
        while rest and rest[0][0] < tick * 5:
            ts, _, src, sport, dst, dport, proto, flags, length = rest.pop(0)
            table[src, sport, dst, dport, proto] = updated(table.get((src, sport, dst, dport, proto)), ts, flags, length)
        table = {k: v for k, v in table.items() if tick * 5 - v[1] <= 60}
        want |= {(tick, *k, *v[:6], max(1, v[3] // 3)) for k, v in table.items()}
    assert got == want and len(want) > 300


def test_two_flow_streams_in_one_session(spark, tmp_path):
    from tidewatch.schema import FLOW, FLOW_COLUMNS

    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        assert live.read_flow_stream(spark, str(tmp_path / name)).columns == [*FLOW_COLUMNS, "stream_id"]
    assert FLOW.names == FLOW_COLUMNS


def test_stream_detection_spreads_each_batch(spark, sf):
    """A micro-batch comes in a file for each core, and its flows are staged by as many tasks."""
    import glob

    from tidewatch.plans import catalog
    from tidewatch.storage import shared_folder

    top = shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{top}/tidewatch/stream-*"))
    catalog.queries()["stream_detection"](spark, sf)
    (folder,) = set(glob.glob(f"{top}/tidewatch/stream-*")) - before
    cores = spark.sparkContext.defaultParallelism
    assert len(glob.glob(f"{folder}/in/*.parquet")) == 3 * cores
    for batch in range(3):
        assert len(glob.glob(f"{folder}/flows/slot=*/batch={batch}/*.parquet")) >= cores
    assert not glob.glob(f"{folder}/flows/slot=*/batch=3")
