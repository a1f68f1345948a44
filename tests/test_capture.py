"""Capture source against plain parsing; capture windows and flows against a plain loop."""

import random
import socket
import struct

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import capture as windows
from tidewatch.sources import capture, files

SCHEMA = "stream_id string, seq long, ts double, src_ip string, dst_ip string, sport int, dport int, proto_num int, tcp_flags int, length long"


def frame(src, dst, sport, dport, proto=6, flag=2, payload=b"", vlan=False, kind=0x0800, ethernet=True):
    tcp = struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 80, flag, 0, 0, 0) if proto == 6 else b"\0" * 8
    ip = struct.pack("!BBHHHBBH", 69, 0, 20 + len(tcp) + len(payload), 0, 0, 64, proto, 0) + socket.inet_aton(src) + socket.inet_aton(dst) + tcp + payload
    return (b"\0" * 12 + (struct.pack("!HH", 0x8100, 5) if vlan else b"") + struct.pack("!H", kind) if ethernet else b"") + ip


def frames(n, seed=0, nested=b""):
    """(time, frame, packet or None): some not IPv4, some with a tag, some that carry bytes of another capture."""
    rng, out, t = random.Random(seed), [], 1_700_000_000.0
    for k in range(n):
        t += rng.choice([0, 0.25, 0.5, 2, -0.25])
        src, dst, sp, dp, proto, flag = f"10.0.{rng.randrange(3)}.{rng.randrange(250)}", "10.9.9.9", rng.randrange(1, 65536), 80, rng.choice([6, 6, 6, 17]), rng.randrange(64)
        data = rng.choice([b"", rng.randbytes(rng.randrange(900)), nested[: rng.randrange(1300)]])
        kind = 0x0800 if k % 17 else 0x86DD
        out.append((t, frame(src, dst, sp, dp, proto, flag, data, k % 5 == 0, kind), (src, dst, sp if proto == 6 else 0, dp if proto == 6 else 0, proto, flag if proto == 6 else 0) if k % 17 else None))
    return out


def classic(rows, order="<", nano=False):
    unit = 10**9 if nano else 10**6
    out = [struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for t, data, _ in rows:
        out.append(struct.pack(order + "IIII", int(t), round((t - int(t)) * unit), len(data), len(data)) + data)
    return out


def blocks(rows, order="<", length=None):
    """A section with two interfaces: microseconds, and 2^-10 s with an offset."""
    wrap = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    one = wrap(1, struct.pack(order + "HHI", 1, 0, 0))
    two = wrap(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 138) + struct.pack(order + "HHq", 14, 8, 1000) + struct.pack(order + "HH", 0, 0))
    out = [one, two]
    for k, (t, data, _) in enumerate(rows):
        ticks = round((t - 1000) * 1024) if k % 3 == 0 else round(t * 1_000_000)
        body = struct.pack(order + "IIIII", int(k % 3 == 0), ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data + b"\0" * (-len(data) % 4)
        out += [wrap(6, body), wrap(5, b"\0" * 12)] if k % 40 == 39 else [wrap(6, body)]
    size = sum(map(len, out)) if length is None else length
    return [wrap(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, size)), *out]


def wanted(rows):
    return [(round(t, 4), *p, len(data)) for t, data, p in rows if p]


def got(df):
    rows = df.orderBy("stream_id", "seq").collect()
    return [(round(r["ts"], 4), *r[3:9], r["length"]) for r in rows]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", ["micro", "nano", "blocks"])
def test_parts_of_a_capture_equal_a_plain_parse(spark, tmp_path, monkeypatch, order, kind):
    monkeypatch.setattr(capture, "LONGEST", 4096)
    nested = b"".join(classic(frames(40, 9), order)[1:]) if kind != "blocks" else b"".join(blocks(frames(40, 9), order)[3:])
    rows = frames(4000, 1, nested)
    data = b"".join(blocks(rows, order) if kind == "blocks" else classic(rows, order, kind == "nano"))
    path = tmp_path / "x.pcap"
    path.write_bytes(data + b"\0" * 7 if kind != "blocks" else data)  # what follows the last whole record is left out
    for split in (len(data) // 4 + 1, 30_001, None):
        parts = capture.ranges(str(path), 0, path.stat().st_size, split)
        assert len(parts) == (1 if split is None else -(-path.stat().st_size // split)) or kind == "blocks"
        out = [tuple(x.values()) for p in parts for b in capture.read(p) for x in b.to_pylist()]
        assert [(round(x[2], 4), *x[3:9], x[9]) for x in out] == wanted(rows)


def test_capture_source_reads_by_ranges_and_folders(spark, tmp_path):
    a, b = frames(3000, 2), frames(500, 3)
    (tmp_path / "a.pcap").write_bytes(b"".join(classic(a)))
    (tmp_path / "b.pcapng").write_bytes(b"".join(blocks(b, ">")) + b"".join(blocks(a[:50], "<")))  # two sections that tell their length
    (tmp_path / "_c").write_bytes(b"junk" * 9)
    df = files.read_packets(spark, str(tmp_path), splitBytes="300000")
    assert df.rdd.getNumPartitions() >= 5
    assert got(df) == wanted(a) + wanted(b) + wanted(a[:50])
    assert got(files.read_packets(spark, str(tmp_path / "a.pcap"), split="false")) == wanted(a)
    (tmp_path / "d").mkdir()
    assert files.read_packets(spark, str(tmp_path / "d")).count() == 0
    (tmp_path / "d" / "head.pcap").write_bytes(classic([])[0])
    assert files.read_packets(spark, str(tmp_path / "d")).count() == 0
    with pytest.raises(Exception, match="not a packet capture"):
        files.read_packets(spark, str(tmp_path / "_c")).count()
    with pytest.raises(ValueError, match="another"):
        (tmp_path / "u.pcapng").write_bytes(b"".join(blocks(b, length=-1)) + b"".join(blocks(a[:50])))
        list(capture.read(capture.ranges(str(tmp_path / "u.pcapng"), 0, (tmp_path / "u.pcapng").stat().st_size, None)[0]))


def test_capture_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(capture.CaptureSource)
    rows, folder = frames(600, 4), tmp_path / "in"
    folder.mkdir()
    parts = classic(rows)

    def trigger():
        q = spark.readStream.format("capture").option("path", str(folder)).option("splitBytes", "50000").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return got(spark.read.parquet(str(tmp_path / "out"))) if list((tmp_path / "out").glob("*.parquet")) else []

    (folder / "a.pcap").write_bytes(b"".join(parts[:300]) + parts[300][:9])  # a record that isn't whole yet
    assert trigger() == wanted(rows[:299])
    (folder / "a.pcap").write_bytes(b"".join(parts))
    (folder / "b.pcap").write_bytes(b"".join(classic(rows[:20])))
    assert trigger() == wanted(rows) + wanted(rows[:20])
    assert trigger() == wanted(rows) + wanted(rows[:20])


def plain_windows(rows, dt, idle=60.0):
    """Packets of one stream in order -> (window, flow) rows, and windows' first packets."""
    table, start, out, k, starts = {}, None, set(), 0, []

    def record(n, r):
        f = r["packets"]
        return (n, r["seq"], *r["key"], r["start"], r["last"], r["bytes"], f, r["done"], max(1, f // 3), r["bad"])

    for seq, ts, src, dst, sp, dp, proto, flag, size in rows:
        r = table.setdefault((src, dst, sp, dp, proto), dict(key=(src, dst, sp, dp), seq=seq, start=ts, last=ts, bytes=0, packets=0, done=False, bad=False, syn=False, both=False))
        r["bytes"], r["packets"], r["last"] = r["bytes"] + size, r["packets"] + 1, max(r["last"], ts)
        r["syn"] |= bool(flag & 2 and not flag & 16)
        r["both"] |= bool(flag & 2 and flag & 16)
        r["done"] |= bool(flag & 16 and r["syn"] and r["both"])
        r["bad"] |= bool(flag & 2 and flag & 5)
        if start is None:
            start = ts
            starts.append(seq)
        if ts - start >= dt:
            out |= {record(k, r) for r in table.values() if r["start"] < ts and r["last"] >= start}
            table = {key: r for key, r in table.items() if r["last"] >= ts - idle}
            start, k = ts, k + 1
            starts.append(seq)
    return out | {record(k, r) for r in table.values()}, starts


@pytest.mark.parametrize("seed", range(4))
def test_windows_and_flows_equal_a_plain_loop(spark, seed):
    rng, data = random.Random(seed), []
    for stream in ("a", "b"):
        t, seq = 1000.0, 0
        for _ in range(700):
            t += rng.choice([0.0, 0.1, 0.7, 1.3, 5.0, -3.0, 40.0 if rng.random() < 0.1 else 0.2, 130.0 if rng.random() < 0.05 else 0.3])
            seq += rng.randrange(1, 50)
            data.append((stream, seq, round(t, 1), f"10.0.0.{rng.randrange(6)}", "10.0.0.9", rng.randrange(2), 80, rng.choice([6, 17]), rng.choice([2, 18, 16, 3, 6, 24]), rng.randrange(1500)))
    packets = spark.createDataFrame(data, SCHEMA).repartition(5)
    for rows in (1 << 20, 90, 7):
        got = windows.flows(packets, 5.0, 60.0, rows).collect()
        starts = windows.windows(windows.blocked(packets, rows), 5.0).orderBy("stream_id", "wid").collect()
        for stream in ("a", "b"):
            want, begun = plain_windows([r[1:] for r in data if r[0] == stream], 5.0)
            assert [r["start_seq"] for r in starts if r["stream_id"] == stream] == begun
            mine = [(r["wid"], r["flow_seq"], r["src_ip"], r["dst_ip"], r["sport"], r["dport"], r["start_time"], r["last_time"], r["bytes_sent"], r["packets"], r["handshake_complete"], r["request_count"], r["protocol_violation"]) for r in got if r["stream_id"] == stream]
            assert len(mine) == len(set(mine)) and set(mine) == want
    assert windows.flows(packets.limit(0)).count() == 0


def test_first_offender_of_a_capture_is_the_first_to_come(spark, tmp_path):
    from tidewatch.config import Settings
    from tidewatch.operators import features, rules

    late, early = "10.0.0.1", "10.0.0.2"
    rows = [(1000.0 + k * 0.001, frame(ip, "10.9.9.9", 1000 + k % 7, 80), None) for k, ip in enumerate([early] * 40 + [late] * 400 + [early] * 360)]
    (tmp_path / "x.pcap").write_bytes(b"".join(classic(rows)))
    flows = files.read_capture_flows(spark, str(tmp_path / "x.pcap"))
    s = Settings(rate_start=0.5)
    r = rules.request_spike(features.windows(flows, s).filter("wid = 0"), s).first()
    by = {x["src_ip"]: x["n"] for x in flows.groupBy("src_ip").agg(F.sum("request_count").alias("n")).collect()}
    assert r["fired"] and by[early] != by[late]
    first = features.windows(flows, s).first()["records"]
    assert first[0]["rate"] == by[early] / 5.0
