import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators import evaluate, mitigate, packets, simulate
from tidewatch.plans import detector, experiments
from tidewatch.sources import files, telemetry


def test_csv(spark, tmp_path):
    head = " Source IP, Destination IP, Source Port, Destination Port, Protocol, Timestamp, Flow Duration, Total Fwd Packets, Total Backward Packets,Total Length of Fwd Packets, Total Length of Bwd Packets, Flow Packets/s,Flow Bytes/s, Label"
    body = ["172.16.0.1,10.0.0.1,1000,80,6,03/07/2017 10:00:00,2000000,9,3,100,50,1.5,2, benign ", "5.5.5.5,10.0.0.1,x,80,17,garbage,NaN,,,-5,,,,DDoS"]
    (tmp_path / "a.csv").write_text("\n".join([head, *body]))
    one, two = files.read_csv_flows(spark, str(tmp_path / "a.csv")).orderBy("flow_seq").collect()
    assert (one["proto"], one["start_time"], one["last_time"], one["packets"], one["request_count"], one["handshake_complete"], one["response_status"], one["country_code"]) == ("TCP", 1499076000.0, 1499076002.0, 12, 3, True, 200, "IN")
    assert (two["proto"], two["sport"], two["start_time"], two["bytes_sent"], two["packets"], two["request_count"], two["response_status"], two["country_code"]) == ("UDP", 0, 0.0, 0, 1, 1, 0, "US")
    assert one["stream_id"] == "a.csv" and one["wid"] == 299815200


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"flows": x}])
def test_json(spark, tmp_path, wrap):
    (tmp_path / "f.json").write_text(json.dumps(wrap([{"src_ip": "1.1.1.1", "start_time": 7.0}, {"dport": 443}])))
    rows = files.read_flows(spark, str(tmp_path / "f.json")).orderBy("flow_seq").collect()
    assert [r["wid"] for r in rows] == [1, 0] and rows[0]["dport"] == 80 and rows[1]["dport"] == 443 and rows[1]["handshake_complete"] is True


def test_json_of_another_shape(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        files.read_json_flows(spark, str(tmp_path / "f.json"))


def capture(rows):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for t, src, dst, sport, dport, flags in rows:
        ip = bytes([0x45, 0]) + b"\0" * 7 + bytes([6]) + b"\0\0" + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
        tcp = struct.pack("!HHIIBB", sport, dport, 0, 0, 0x50, flags) + b"\0" * 6
        frame = b"\0" * 12 + b"\x08\x00" + ip + tcp
        out += struct.pack("<IIII", int(t), int(round((t % 1) * 1e6)), len(frame), len(frame)) + frame
    return out


def test_capture(spark, tmp_path):
    a, b = ("1.1.1.1", "2.2.2.2", 5, 80), ("2.2.2.2", "1.1.1.1", 80, 5)
    (tmp_path / "x.pcap").write_bytes(capture([(0.0, *a, 0x02), (0.1, *b, 0x12), (0.2, *a, 0x10), (1.0, *a, 0x03), (100.0, *a, 0x10)]))
    p = files.read_packets(spark, str(tmp_path / "x.pcap"))
    assert p.count() == 5
    flow = {(r["src_ip"], r["part"]): r for r in packets.to_flows(packets.split_idle(p), extra=["part"]).collect()}
    assert flow[("1.1.1.1", 0)]["handshake_complete"] is False  # SYN-ACK comes on the other direction's key
    assert flow[("1.1.1.1", 0)]["protocol_violation"] is True and flow[("2.2.2.2", 0)]["protocol_violation"] is False
    assert flow[("1.1.1.1", 1)]["packets"] == 1  # after an idle minute
    assert {r["src_ip"]: r["early"] for r in packets.early_fin(p).collect()} == {"1.1.1.1": True, "2.2.2.2": False}
    assert files.read_flows(spark, str(tmp_path / "x.pcap")).select("wid").distinct().count() == 2


def test_handshake_on_one_key(spark):
    rows = [(k, float(k), "a", "b", 1, 2, 6, f, 10) for k, f in enumerate((0x02, 0x12, 0x10))]
    p = spark.createDataFrame(rows, "seq long, ts double, src_ip string, dst_ip string, sport int, dport int, proto_num int, tcp_flags int, length long")
    assert packets.to_flows(p).first()["handshake_complete"] is True


def test_telemetry(spark, tmp_path):
    s = spark.createDataFrame([(10.0, 0.5), (90000.0, 0.7)], "ts double, score double")
    telemetry.append(s, str(tmp_path), "scores")
    assert [r["score"] for r in telemetry.recent_scores(telemetry.read(spark, str(tmp_path), "scores"), 50.0).collect()] == [0.7]


def test_telemetry_stream(spark, tmp_path):
    spark.createDataFrame([(10.0, 0.5), (20.0, 0.6)], "ts double, score double").coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):  # a restarted query adds nothing
        src = spark.readStream.schema("ts double, score double").json(str(tmp_path / "in"))
        telemetry.append_stream(src, str(tmp_path / "out"), "scores", str(tmp_path / "check"), availableNow=True).awaitTermination()
    telemetry.append(spark.createDataFrame([(30.0, 0.9)], "ts double, score double"), str(tmp_path / "out"), "scores")
    assert sorted(r["score"] for r in telemetry.read(spark, str(tmp_path / "out"), "scores").collect()) == [0.5, 0.6, 0.9]


def test_results_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", [0.1, 0.2])], "scenario string, score_series array<double>")
    telemetry.write_results(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).collect()[0].asDict() == {"scenario": "a", "n_scores": 2}


def test_settings(tmp_path):
    (tmp_path / "feature_weights.yaml").write_text("distributed_connection_burst: 0.6\n")
    (tmp_path / "detection_params.yaml").write_text("ewma_alpha: 0.25\nzscore_threshold: 2\nmitigation_deescalation_time: 90\nother: x\n")
    s = files.settings_of(str(tmp_path))
    assert (s.alpha, s.tau_z, s.hold3, s.theta, s.weights) == (0.25, 2.0, 90.0, 5.0, {"distributed_connection_burst": 0.6})
    assert files.read_settings(str(tmp_path / "none.yaml")) == {} and files.settings_of(str(tmp_path / "none")) == Settings()


def test_csv_streams_keep_their_folders(spark, tmp_path):
    head = "Source IP,Timestamp,Protocol,Label"
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text(f"{head}\n1.1.1.1,2017-07-03 10:00:00,6,BENIGN\n")
    assert {r["stream_id"] for r in files.read_csv_flows(spark, str(tmp_path / "*")).select("stream_id").collect()} == {"a/x.csv", "b/x.csv"}


def test_labelled_files(spark, tmp_path):
    """Quiet windows, then a flood of one source: the attack is found, and the quiet windows aren't alerts."""
    head = "Source IP,Destination IP,Source Port,Destination Port,Protocol,Timestamp,Flow Duration,Total Fwd Packets,Total Backward Packets,Total Length of Fwd Packets,Total Length of Bwd Packets,Flow Packets/s,Label"
    lines = [head]
    for w in range(45):
        for k in range(12):
            lines.append(f"10.0.{k}.{(w * 7 + k) % 9 + 1},10.9.9.9,{1000 + k},80,6,{1499076000 + 5 * w + k % 4},{1000000 * (k % 3)},{9 + (w + k) % 5},3,{300 + 10 * ((w + k) % 4)},50,1.5,BENIGN")
        if w >= 30:
            lines += [f"172.16.0.{k % 200},10.9.9.9,{k},80,17,{1499076000 + 5 * w},0,3000,0,0,0,0,Flood" for k in range(300)]
    (tmp_path / "one.csv").write_text("\n".join(lines))
    rows = experiments.evaluate_files(files.read_csv_flows(spark, str(tmp_path / "one.csv")), Settings(), 30).collect()
    one, mean = sorted(rows, key=lambda r: r["stream_id"] is None)
    assert one["stream_id"] == "one.csv" and one["windows"] == 45 and one["tp"] + one["fn"] == 15
    assert one["tp"] >= 10 and one["precision"] >= 0.75 and one["latency_seconds"] <= 25 and mean["f1"] == pytest.approx(one["f1"])


def test_ablation_and_quiet_hours(spark):
    s = Settings()
    made = experiments.configurations(s)
    assert made["NoLeaky"].theta == 0.001 and set(made["NoWeight"].weights.values()) == {0.125} and made["Full"] == made["Single"] == s
    runs = experiments.ablation_runs(simulate.scenario_grid(spark, reps=1, seed_windows=15, most_windows=12), s, 15)
    assert runs.count() == 25
    rates = {r["config"]: r for r in evaluate.ablation(runs).collect()}
    assert set(rates) == set(made) and rates["Full"]["delta_dr"] == 0 and rates["NoLeaky"]["detection_rate"] >= rates["Full"]["detection_rate"]
    row = experiments.false_positives(spark, s, windows=40, seed_windows=20).first()
    assert row["windows"] == 40 and row["fp_count"] <= row["alerts"]


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, 200)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("b", 0, 3.5)], "g string, id long, v double")
    got = {r["g"]: r for r in evaluate.bootstrap(df, "v", ["g"], ["g", "id"], rounds=2000).collect()}
    again = {r["g"]: r for r in evaluate.bootstrap(df.repartition(5), "v", ["g"], ["g", "id"], rounds=2000).collect()}
    assert (got["b"]["low"], got["b"]["high"]) == (3.5, 3.5) and got["a"]["rounds"] == 2000
    half = 1.96 * x.std() / np.sqrt(200)
    assert got["a"]["low"] == pytest.approx(x.mean() - half, abs=0.06) and got["a"]["high"] == pytest.approx(x.mean() + half, abs=0.06)
    assert again["a"]["low"] == pytest.approx(got["a"]["low"]) and again["a"]["high"] == pytest.approx(got["a"]["high"])


def test_bootstrap_adds_up_in_tasks(spark):
    """The hash of every key and round, by hashlib: short and long keys, a null part; no row a value and round."""
    import hashlib

    keys = ["a", "b" * 20, "c" * 45, "d" * 46, "e" * 47, "f" * 48, "g" * 49, "h" * 60, "é" * 61, "i" * 130, None]
    data = [("x" if k % 3 else "y", keys[k % len(keys)], k, k / 7) for k in range(300)]
    df = spark.createDataFrame(data, "g string, k string, n long, v double")
    rounds, want = 450, {}
    for g, k, n, v in data:
        text = ":".join(p for p in ("42", k, str(n)) if p is not None)
        for r in range(rounds):
            h = hashlib.md5(f"{text}:{r // 4}".encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8]
            m = sum(int(h, 16) / 2**32 > c for c in evaluate.POISSON)
            got = want.setdefault((g, r), [0, 0.0, 0])
            want[g, r] = [got[0] + m, got[1] + m * v, got[2] + 1]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(evaluate, "HASHED_AT_ONCE", 64)
        m.setattr(evaluate, "GROUPS_AT_ONCE", 1)
        for _ in range(2):
            sums = evaluate.poisson_sums(df, "v", ["g"], ["k", "n"], rounds)
            rows, found = sums.collect(), {}
            for r in rows:
                got = found.setdefault((r["g"], r["round_"]), [0, 0.0, 0])
                found[r["g"], r["round_"]] = [got[0] + r["draws"], got[1] + r["total"], got[2] + r["n_"]]
            assert set(found) == set(want) and all(found[k] == pytest.approx(want[k], rel=1e-12) for k in want)
            m.undo()
    assert len(rows) <= 2 * rounds * sums.rdd.getNumPartitions() < len(data) * rounds



def test_forest_tells_classes_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(k, bool(k % 3 == 0), float(rng.normal(4 if k % 3 == 0 else 0)), float(rng.normal())) for k in range(300)]
    out = evaluate.forest(spark.createDataFrame(rows, "case long, label boolean, a double, b double"), ["a", "b"], trees=20, depth=5).toPandas()
    assert len(out) == 300 and out["score"].between(0, 1).all()
    rest = out[out["case"] > 210]
    assert rest[rest["label"]]["score"].mean() > 0.7 > 0.4 > rest[~rest["label"]]["score"].mean()


def test_report_lines(spark):
    table = spark.createDataFrame([("a", 0.5, 3), (None, None, 4)], "scenario_id string, x double, n long")
    assert sorted(r["line"] for r in evaluate.report_lines(table).collect()) == sorted(["a".ljust(25) + " " + "0.5000".rjust(14) + " " + "3.0000".rjust(14), "all".ljust(25) + " " + "N/A".rjust(14) + " " + "4.0000".rjust(14)])


def test_live_violations(spark):
    rows = [(k, float(k), *key, 6, f, 10) for k, (key, f) in enumerate(((("a", "b", 1, 2), 2), (("a", "b", 1, 2), 1), (("c", "b", 1, 2), 16)))]
    p = spark.createDataFrame(rows, "seq long, ts double, src_ip string, dst_ip string, sport int, dport int, proto_num int, tcp_flags int, length long")
    assert {r["src_ip"]: r["protocol_violation"] for r in packets.to_live_flows(p).collect()} == {"a": True, "c": False}


def test_simulated_attacks_are_found(spark):
    s = Settings()
    traffic = simulate.scenario_grid(spark, reps=1, seed_windows=30, most_windows=40)
    again = simulate.scenario_grid(spark, reps=1, seed_windows=30, most_windows=40)
    assert traffic.agg(F.sum(F.xxhash64(*traffic.columns) % 1000)).first() == again.repartition(3).agg(F.sum(F.xxhash64(*again.columns) % 1000)).first()
    found = mitigate.first_detection(detector.run(traffic, s, 30).scored, 30.0, s).collect()
    assert len(found) == 5 and sum(r["latency"] is not None for r in found) >= 4


def test_unknown_attack(spark):
    steps = spark.createDataFrame([("s", 0, 40.0)], "stream_id string, wid long, t double")
    assert simulate.attack(steps, "none") is None


def test_metrics_guards(spark):
    runs = spark.createDataFrame([("a", False, None, 0.1, 0.0, 0, 0, 0, 0)], "scenario_id string, detected boolean, latency double, peak_score double, duration double, true_positives long, false_positives long, false_negatives long, true_negatives long")
    row = evaluate.metrics(runs).filter("scenario_id IS NULL").first()
    assert (row["detection_rate"], row["precision"], row["f1"], row["fp_per_12h"]) == (0, 0, 0, 0)


def test_signature_scores(spark):
    cols = "stream_id string, wid long, concurrent_connection_count double, handshake_completion_ratio double, mean_connection_duration double, request_rate double"
    df = spark.createDataFrame([("s", 0, 101.0, 0.05, 61.0, 501.0), ("s", 1, 100.0, 0.1, 60.0, 500.0)], cols)
    assert [(r["score"], r["matches"], r["alert"]) for r in evaluate.signatures(df).orderBy("wid").collect()] == [(0.9, 4, True), (0.0, 0, False)]


def test_simulation_queries_run_the_whole_grid(spark, sf):
    from tidewatch.plans import catalog

    spans = catalog.queries()["simulate_scenarios"](spark, sf).groupBy("stream_id").agg({"wid": "min", "*": "count"}).collect()
    want = {f"{name}-{rep}": 120 + int(length / 5) for name, length, _ in simulate.SCENARIOS for rep in range(3)}
    assert {r["stream_id"]: r["count(1)"] for r in spans} == want and {r["min(wid)"] for r in spans} == {-120}
    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simulate, "scenario_grid", lambda spark, **cut: seen.update(cut))
        m.setattr(detector, "run", lambda flows, s, seed_windows=120: seen.update(seed_windows=seed_windows) or detector.Detection(*[spark.createDataFrame([], "stream_id string, wid long, score double")] * 4))
        catalog.queries()["simulated_detection"](spark, sf)
    assert seen == {"seed_windows": 120}


def test_comparisons_run_at_full_size(spark, sf):
    from tidewatch.plans import catalog

    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(evaluate, "bootstrap", lambda *a, rounds=0: seen.update(rounds=rounds) or spark.createDataFrame([("x", 0.0, 1.0)], "scenario_id string, low double, high double"))
        m.setattr(evaluate, "forest", lambda *a, trees=100, depth=10: seen.update(trees=trees, depth=depth))
        catalog.queries()["bootstrap_ci"](spark, sf)
        catalog.queries()["random_forest"](spark, sf)
    assert seen == {"rounds": 10_000, "trees": 100, "depth": 10}


def test_telemetry_is_compacted_and_dropped_by_day(spark, tmp_path):
    folder, day = str(tmp_path / "t"), 86_400.0
    frame = lambda rows: spark.createDataFrame(rows, "ts double, score double").coalesce(1)
    read = lambda: sorted((r["ts"], r["score"]) for r in telemetry.read(spark, folder, "scores").collect())
    assert read() == [] and telemetry.compact(spark, folder, "scores") == 0
    rows = []
    for k in range(12):
        part = [(day * (k % 3) + k, k / 10), (day * (k % 3) + k, k / 10)]  # repeated rows stay
        rows += part
        telemetry._write(frame(part), "scores", f"{folder}/scores/batch=stream7-{k}", "overwrite")
    telemetry.append(frame([(5.0, 0.5)]), folder, "scores")
    before = telemetry.read(spark, folder, "scores")  # a reader that began earlier
    assert telemetry.compact(spark, folder, "scores") == 13
    rows.append((5.0, 0.5))
    assert read() == sorted(rows)
    telemetry._write(frame(rows[22:24]), "scores", f"{folder}/scores/batch=stream7-11", "overwrite")  # runs again after a failure
    telemetry.append(frame([(6.0, 0.6)]), folder, "scores")
    rows.append((6.0, 0.6))
    assert read() == sorted(rows)
    _, said = telemetry._manifest(spark, folder, "scores")
    files_a_day = [len(list(d.glob("*.parquet"))) for d in (tmp_path / "t/scores" / said["compacted"][0]).glob("day=*")]
    assert files_a_day == [1, 1, 1] and before.schema == telemetry.read(spark, folder, "scores").schema
    assert telemetry.compact(spark, folder, "scores", most=1) == 1  # merges the first compacted folder too
    assert read() == sorted(rows) and len(telemetry._manifest(spark, folder, "scores")[1]["compacted"]) == 1
    telemetry.retain(spark, folder, "scores", "1970-01-02")
    rows = [r for r in rows if r[0] >= day]
    assert read() == sorted(rows)
    telemetry.clean(spark, folder, "scores")
    assert read() == sorted(rows)
    assert not list((tmp_path / "t/scores").glob("batch=stream*")) and not list((tmp_path / "t/scores").glob("batch=*/day=1970-01-01"))
    number, said = telemetry._manifest(spark, folder, "scores")
    with pytest.raises(RuntimeError, match="was first"):
        telemetry._publish(spark, folder, "scores", number, said)


def test_exact_bootstrap_draws_as_many_as_there_are(spark):
    rng = np.random.default_rng(2)
    rows = [(g, k, float(x)) for g, n in (("a", 1), ("b", 300), ("c", 41)) for k, x in enumerate(rng.normal(5, 2, n))]
    df = spark.createDataFrame([*rows, ("b", 999, None)], "g string, k int, x double")
    for size in (32, 1 << 15):
        sums = evaluate.bootstrap_sums(df, "x", ["g"], ["k"], 200, size=size).collect()
        assert len(sums) == 600 and {(r["g"], r["draws"]) for r in sums} == {("a", 1), ("b", 300), ("c", 41)}
        assert {r["round"] for r in sums} == set(range(200))
    again = evaluate.bootstrap_sums(df.repartition(5), "x", ["g"], ["k"], 200, size=32).collect()
    first = evaluate.bootstrap_sums(df, "x", ["g"], ["k"], 200, size=32).collect()
    key = lambda r: (r["g"], r["round"])
    np.testing.assert_allclose([r["total"] for r in sorted(again, key=key)], [r["total"] for r in sorted(first, key=key)])
    got = {r["g"]: r for r in evaluate.bootstrap_exact(df, "x", ["g"], ["k"], rounds=3000, size=64).collect()}
    for g in ("a", "b", "c"):
        x = np.array([v for a, _, v in rows if a == g])
        means = np.random.default_rng(9).choice(x, (3000, len(x))).mean(axis=1)
        assert abs(got[g]["low"] - np.percentile(means, 2.5)) < 0.1 * x.std() + 1e-9 and abs(got[g]["high"] - np.percentile(means, 97.5)) < 0.1 * x.std() + 1e-9


def test_counted_quantiles_equal_sorted_ones(spark):
    from tidewatch.operators.quantiles import quantiles

    rng = np.random.default_rng(6)
    data = {"a": rng.normal(0, 50, 500), "b": np.array([3.0]), "c": np.repeat([1.5, -2.0, 1e9], 70), "d": np.array([-1.0, 1.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)], "g string, x double")
    shares = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r["g"]: r for r in quantiles(df, ["g"], "x", shares).collect()}
    for g, x in data.items():
        np.testing.assert_allclose([got[g][n] for n in shares], [np.quantile(x, p) for p in shares.values()], rtol=1e-12)


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_asof_join_equals_a_plain_look_up(spark, size):
    from tidewatch.operators.asof import asof_join

    rng = np.random.default_rng(7)
    hist = [(int(g), float(t), float(v)) for g, t, v in zip(rng.integers(3, size=120), rng.integers(0, 200, 120), rng.normal(size=120), strict=True)]
    left = [(k, int(g), float(t)) for k, (g, t) in enumerate(zip(rng.integers(4, size=150), rng.integers(-5, 220, 150), strict=True))] + [(900, None, 5.0), (901, 1, None), (902, 0, 7.0), (902, 0, 7.0)]
    got = asof_join(spark.createDataFrame(left, "id int, g int, t double").withColumn("value_", F.lit("clash")), spark.createDataFrame([*hist, (None, 1.0, 1.0), (1, None, 1.0)], "g int, t double, v double"), ["g"], "t", ["v"], size).collect()
    assert len(got) == len(left)
    for r in got:
        own = [(t, v) for g, t, v in hist if g == r["g"] and r["t"] is not None and t <= r["t"]]
        assert (r["matched_t"], r["v"]) == (max(own) if own else (None, None))


def test_range_joins_equal_comparing_all(spark):
    from tidewatch.operators import ranges

    rng = np.random.default_rng(8)
    table = [(k, int(a), int(a + (n if k % 9 else 5000))) for k, (a, n) in enumerate(zip(rng.integers(-3000, 9000, 200), rng.integers(0, 60, 200), strict=True))] + [(500, 10, 5), (501, None, 3)]
    points = [(k, int(x)) for k, x in enumerate(rng.integers(-3500, 10000, 300))] + [(900, None)]
    r = spark.createDataFrame(table, "r int, low long, high long")
    got = ranges.range_join(spark.createDataFrame(points, "p int, x long"), r, "x", "low", "high").select("p", "r").collect()
    good = [t for t in table if t[1] is not None and t[1] <= t[2]]
    assert sorted(map(tuple, got)) == sorted((p, k) for p, x in points if x is not None for k, a, b in good if a <= x <= b)
    spans = [(k, x, x + int(n)) for (k, x), n in zip(points[:-1], rng.integers(0, 700, 300), strict=True)]
    both = ranges.overlap_join(spark.createDataFrame(spans, "p int, b long, e long"), r, "b", "e", "low", "high").select("p", "r").collect()
    assert sorted(map(tuple, both)) == sorted((p, k) for p, b, e in spans for k, low, high in good if b <= high and e >= low)
    assert ranges.range_join(spark.createDataFrame(points, "p int, x long"), r.limit(0), "x", "low", "high").count() == 0
    ips = [row[0] for row in spark.createDataFrame([("10.0.0.1",), ("1.2.3",), ("a.b.c.d",), (None,), ("1.2.3.256",)], "ip string").select(ranges.ip_number("ip")).collect()]
    assert ips == [167772161, None, None, None, None]


def test_a_large_table_of_ranges_needs_no_nested_loop(spark):
    from tidewatch.operators import ranges

    r = spark.range(1_000_000).select(F.col("id").alias("r"), (F.col("id") * 17).alias("low"), (F.col("id") * 17 + F.when(F.col("id") % 1000 == 0, 5000).otherwise(20)).alias("high"))
    points = spark.range(50_000).select((F.col("id") * 331).alias("x"))
    found = ranges.range_join(points, r, "x", "low", "high")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    x = np.arange(50_000) * 331
    k = np.arange(1_000_000)
    low, high = k * 17, k * 17 + np.where(k % 1000 == 0, 5000, 20)
    assert found.count() == int((np.searchsorted(low, x, "right") - np.searchsorted(np.sort(high), x, "left")).sum())


def test_streams_of_files_with_odd_names(spark, tmp_path):
    odd = tmp_path / "it's + 100%"
    odd.mkdir()
    head, row = "Source IP,Timestamp,Label", "1.1.1.1,03/07/2017 10:00:00,BENIGN"
    for name in ("a b.csv", "c+d.csv"):
        (odd / name).write_text(f"{head}\n{row}\n")
    assert {r["stream_id"] for r in files.read_csv_flows(spark, str(odd)).collect()} == {"a b.csv", "c+d.csv"}
    (tmp_path / "j").mkdir()
    for name in ("x.json", "y.json"):
        (tmp_path / "j" / name).write_text('[{"src_ip": "1.1.1.1"}, {"src_ip": "2.2.2.2"}]')
    rows = files.read_json_flows(spark, str(tmp_path / "j")).collect()
    assert len({(r["stream_id"], r["flow_seq"]) for r in rows}) == 4 and {r["stream_id"] for r in rows} == {"x.json", "y.json"}
