"""Windows that a capture's packets cut, and the flows of each.

A window begins with a packet; the first packet that comes at least dt after it closes the window and begins the next, so the windows
are a greedy chain of successors, and cut by arrival.  Every packet up to and with the closing one counts.  A closed window lists
the flows with a packet in it, and one whose latest is the packet that began it, with their counters so far; flows idle for over `idle` seconds are
forgotten at that moment.  The last window, which nothing closes, lists all flows not forgotten.

The chain is found without walking it whole.  A stream is cut into blocks of packets.  Each block says, for every packet with which a
chain may enter it (those within dt of the latest one before it, and the next), with which one the chain leaves it: all blocks
at once, from the right.  These short tables are then followed block by block, and each block walks its part.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import flags, protocol_name
from tidewatch.operators.packets import KEY
from tidewatch.storage import stored

#: Packets of a block, about.
BLOCK = 1 << 20
BY = ["stream_id", "block"]


def blocked(packets: DataFrame, rows: int = BLOCK) -> DataFrame:
    """packets with their block, a range of seq; streams are cut evenly by seq."""
    spans = packets.groupBy("stream_id").agg(F.min("seq").alias("low_"), (F.max("seq") - F.min("seq") + 1).alias("span_"), F.ceil(F.count(F.lit(1)) / rows).alias("blocks_"))
    return packets.join(spans, "stream_id").withColumn("block", F.expr("(seq - low_) * blocks_ div span_")).drop("low_", "span_", "blocks_")


def _records(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(time, seq) of the packets later than all before them: only these can close a window."""
    pdf = pdf.sort_values("seq")
    ts, seq = pdf["ts"].to_numpy(float), pdf["seq"].to_numpy(np.int64)
    before = pdf["before"].iloc[0]
    top = np.maximum.accumulate(np.concatenate([[-np.inf if pd.isna(before) else float(before)], ts]))
    new = ts > top[:-1]
    return ts[new], seq[new]


def _next(t: np.ndarray, dt: float) -> np.ndarray:
    """For each time the index of the first at least dt later; by the difference, as the sum may round."""
    at = np.searchsorted(t, t + dt, "left")
    back = (at > 0) & (t[np.maximum(at - 1, 0)] - t >= dt)
    at = at - back
    on = (at < len(t)) & (t[np.minimum(at, len(t) - 1)] - t < dt)
    return at + on


def _entries(dt: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, _ = _records(pdf)
        before = pdf["before"].iloc[0]
        n = 1 if pd.isna(before) else int(np.searchsorted(t, float(before) + dt, "right")) + 1
        after, last = _next(t, dt), t.copy()
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                last[i] = last[after[i]]
        n = min(n, len(t))
        return pd.DataFrame({"stream_id": pdf["stream_id"].iloc[0], "block": pdf["block"].iloc[0], "entry": t[:n], "last": last[:n]})

    return run


def _follow(dt: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "entry"])
        now, out = None, []
        for block, rows in pdf.groupby("block", sort=True):
            entry = rows["entry"].to_numpy(float)
            fits = np.flatnonzero(entry - now >= dt) if now is not None else np.arange(len(entry))
            if len(fits):
                out.append((rows["stream_id"].iloc[0], block, entry[fits[0]]))
                now = float(rows["last"].iloc[fits[0]])
        return pd.DataFrame(out, columns=["stream_id", "block", "entry"])

    return run


def _starts(dt: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, seq = _records(pdf)
        after, at, out = _next(t, dt), int(np.searchsorted(t, pdf["entry"].iloc[0], "left")), []
        while at < len(t):
            out.append(at)
            at = int(after[at])
        return pd.DataFrame({"stream_id": pdf["stream_id"].iloc[0], "block": pdf["block"].iloc[0], "start_seq": seq[out], "start_ts": t[out]})

    return run


def windows(packets: DataFrame, dt: float) -> DataFrame:
    """(stream_id, wid, block, start_seq, start_ts, end_seq, end_ts) from packets with block; the last window has no end."""
    slim = packets.select(*BY, "seq", "ts")
    tops = stored(slim.groupBy(*BY).agg(F.max("ts").alias("top")), "capture-blocks")
    order = Window.partitionBy("stream_id").orderBy("block")
    tops = tops.select(*BY, F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    rows = slim.join(tops, BY)
    entries = rows.groupBy(*BY).applyInPandas(_entries(dt), "stream_id string, block long, entry double, last double")
    chosen = stored(entries.groupBy("stream_id").applyInPandas(_follow(dt), "stream_id string, block long, entry double"), "capture-chain")
    begun = rows.join(chosen, BY).groupBy(*BY).applyInPandas(_starts(dt), "stream_id string, block long, start_seq long, start_ts double")
    order = Window.partitionBy("stream_id").orderBy("start_seq")
    return begun.select("stream_id", (F.row_number().over(order) - 1).cast("long").alias("wid"), "block", "start_seq", "start_ts", F.lead("start_seq").over(order).alias("end_seq"), F.lead("start_ts").over(order).alias("end_ts"))


def placed(packets: DataFrame, found: DataFrame) -> DataFrame:
    """packets (with block) and the window in which each counts: the number of windows closed by packets before it.

    What began in earlier blocks comes as one row to each block, so a block is placed by itself.
    """
    fresh = found.filter("wid > 0").select(*BY, F.col("start_seq").alias("seq"), F.col("wid").alias("mark_"))
    per = packets.select(*BY).distinct().join(fresh.groupBy(*BY).agg(F.max("mark_").alias("m")), BY, "left")
    carry = per.select(*BY, F.lit(-(1 << 62)).alias("seq"), F.max("m").over(Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("mark_"))
    marks = fresh.unionByName(carry)
    every = packets.withColumn("mark_", F.lit(None).cast("long")).withColumn("kind_", F.lit(0)).unionByName(marks.withColumn("kind_", F.lit(1)), allowMissingColumns=True)
    # The packet that begins a window still counts in the one it closes.
    order = Window.partitionBy(*BY).orderBy("seq", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("wid", F.coalesce(F.max("mark_").over(order), F.lit(0).cast("long"))).filter("kind_ = 0").drop("mark_", "kind_")


def flows(packets: DataFrame, dt: float = 5.0, idle: float = 60.0, rows: int = BLOCK) -> DataFrame:
    """(stream_id, wid, flow_seq, flow record) of each window from (stream_id, seq, packet columns).

    Packets are summed by key and window first, so a hot key is a row a window afterwards.
    """
    packets = blocked(packets, rows)
    found = stored(windows(packets, dt), "capture-windows")
    key = ["stream_id", *KEY]
    f = flags("tcp_flags")
    per = placed(packets, found).groupBy(*key, "wid").agg(
        F.min(F.struct("seq", "ts")).alias("first"),
        F.max("ts").alias("top"),
        F.sum("length").alias("bytes"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(f["syn"] & ~f["ack"], F.col("seq"))).alias("syn"),
        F.min(F.when(f["syn"] & f["ack"], F.col("seq"))).alias("both"),
        F.max(F.when(f["ack"], F.col("seq"))).alias("ack"),
        F.coalesce(F.bool_or(f["syn"] & (f["fin"] | f["rst"])), F.lit(False)).alias("bad"),
    )
    at = found.select("stream_id", "wid", "start_ts", "end_ts")
    per = per.join(at, ["stream_id", "wid"])
    order = Window.partitionBy(*key).orderBy("wid")
    before = F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("new_", F.coalesce((F.col("wid") > 0) & (before < F.col("start_ts") - idle), F.lit(False)).cast("int")).withColumn("part", F.sum("new_").over(order))
    own = Window.partitionBy(*key, "part").orderBy("wid")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    state = per.select(
        *key, "wid", "start_ts", "end_ts", F.min("first").over(so_far).alias("first"), F.max("top").over(so_far).alias("last_time"), F.sum("bytes").over(so_far).alias("bytes_sent"), F.sum("n").over(so_far).alias("packets"),
        F.min("syn").over(so_far).alias("syn"), F.min("both").over(so_far).alias("both"), F.max("ack").over(so_far).alias("ack"), F.bool_or("bad").over(so_far).alias("protocol_violation"),
        F.lead("wid").over(order).alias("later"),
    )
    ends = found.groupBy("stream_id").agg(F.max("wid").alias("final"), F.max("start_ts").alias("final_ts"))
    state = state.join(ends, "stream_id")
    last = F.col("wid") == F.col("final")
    here = last | ((F.col("first.ts") < F.col("end_ts")) & (F.col("last_time") >= F.col("start_ts")))
    beyond = (F.col("wid") + 1 < F.col("final")) & (F.col("last_time") >= F.col("end_ts")) & (F.col("later").isNull() | (F.col("later") > F.col("wid") + 1))
    at_end = ~last & F.col("later").isNull() & (F.col("last_time") >= F.col("final_ts") - idle)
    listed = F.array_compact(F.array(F.when(here, F.col("wid")), F.when(beyond, F.col("wid") + 1), F.when(at_end, F.col("final"))))
    done = F.col("syn").isNotNull() & F.col("both").isNotNull() & F.col("ack").isNotNull() & (F.col("ack") >= F.greatest("syn", "both"))
    return state.select(
        "stream_id",
        F.explode(listed).alias("wid"),
        F.col("first.seq").alias("flow_seq"),
        *KEY,
        protocol_name("proto_num").alias("proto"),
        F.col("first.ts").alias("start_time"),
        "last_time",
        "bytes_sent",
        F.lit(0).cast("long").alias("bytes_recv"),
        "packets",
        F.coalesce(done, F.lit(False)).alias("handshake_complete"),
        F.greatest(F.lit(1).cast("long"), F.expr("packets div 3")).alias("request_count"),
        "protocol_violation",
        F.lit("pcap").alias("user_agent"),
        F.lit("UNKNOWN").alias("country_code"),
        F.lit(0).alias("response_status"),
    )
