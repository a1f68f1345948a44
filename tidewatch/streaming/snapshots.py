"""Snapshots of all live flows from a packet stream, every few seconds of packet time.

State is kept by source host, so a capture is spread over its hosts: a map of the host's live flows, and the packets that came since the last
snapshot.  An event-time timer at multiples of `every` puts the packets before each in order, brings the flows up to date, and gives every
flow that isn't idle for over `drop` seconds, under the number of the snapshot; so a flow comes out once a snapshot.  Idle flows
are forgotten then, and the timer ends with the host's last flow.  Packets later than the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_FLOW = "start_time double, last_time double, bytes_sent long, packets long, handshake_complete boolean, protocol_violation boolean, syn boolean, both boolean"
_KEY = "sport int, dst_ip string, dport int, proto_num int"
_PACKET = f"ts double, seq long, {_KEY}, tcp_flags int, length long"
SNAPSHOT = f"snapshot long, src_ip string, {_KEY}, start_time double, last_time double, bytes_sent long, packets long, handshake_complete boolean, protocol_violation boolean, request_count long"


def updated(flow: tuple | None, ts: float, flags: int, length: int) -> tuple:
    """A flow's record after one more packet (as the live path judges it: a FIN before the handshake is a violation)."""
    start, last, size, n, done, bad, syn, both = flow or (ts, ts, 0, 0, False, False, False, False)
    fin, s, rst, ack = bool(flags & 1), bool(flags & 2), bool(flags & 4), bool(flags & 16)
    syn, both = syn or s and not ack, both or s and ack
    done = done or ack and not s and syn and both
    bad = bad or s and (fin or rst) or fin and not done
    return start, max(last, ts), size + length, n + 1, done, bad, syn, both


class Snapshots(StatefulProcessor):
    def __init__(self, every: float, drop: float):
        self.every, self.drop = every, drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getMapState("flows", _KEY, _FLOW)
        self.waiting = handle.getListState("waiting", _PACKET)
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, tick: int) -> None:
        """A timer at the end of tick number `tick`."""
        at = round(tick * self.every * 1000)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in _PACKET.split(", ")]
        came = pd.concat(list(rows))[names]
        self.waiting.appendList([tuple(v.item() if hasattr(v, "item") else v for v in row) for row in came.itertuples(index=False, name=None)])
        if not self.timer.exists():
            self._wake(int(came["ts"].min() // self.every) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        tick, (host,), out = round(expiredTimerInfo.getExpiryTimeInMs() / 1000 / self.every), key, []
        # Every snapshot that the watermark has passed: a timer set now would wait for the next batch.
        until = max(tick, int(timerValues.getCurrentWatermarkInMs() // round(self.every * 1000)))
        packets = sorted(self.waiting.get())
        flows = {tuple(name): tuple(flow) for name, flow in self.flows.iterator()}
        held, used = set(flows), 0
        while tick <= until and (flows or used < len(packets)):
            now = tick * self.every
            while used < len(packets) and packets[used][0] < now:
                ts, _, sport, dst, dport, proto, flags, length = packets[used]
                flows[sport, dst, dport, proto] = updated(flows.get((sport, dst, dport, proto)), ts, flags, length)
                used += 1
            flows = {name: flow for name, flow in flows.items() if now - flow[1] <= self.drop}
            out += [(tick, host, *name, *flow[:6], max(1, flow[3] // 3)) for name, flow in flows.items()]
            tick += 1
        for name in held - set(flows):
            self.flows.removeKey(name)
        for name, flow in flows.items():
            self.flows.updateValue(name, flow)
        self.waiting.clear()
        if used < len(packets):
            self.waiting.put(packets[used:])
        if flows or used < len(packets):
            self._wake(tick if flows else max(tick, int(packets[used][0] // self.every) + 1))
        else:
            self.timer.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SNAPSHOT.split(", ")])

    def close(self) -> None:
        pass


def snapshot_stream(packets: DataFrame, every: float = 5.0, drop: float = 60.0, late: str = "5 seconds") -> DataFrame:
    """(snapshot, flow record) of a packet stream (ts, seq, the five-tuple, tcp_flags, length): all live flows at each multiple of `every`."""
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = packets.withColumn("event_ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("event_ts", late)
    return timed.groupBy("src_ip").transformWithStateInPandas(Snapshots(every, drop), SNAPSHOT, "append", "eventTime")
