"""Packets to flows, and flows over windows they overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import flags, protocol_name

KEY = ["src_ip", "sport", "dst_ip", "dport", "proto_num"]


def to_flows(packets: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One flow a directional 5-tuple (and extra keys).  Packets carry seq, their order.

    The handshake is complete once an ACK-flagged packet comes when a SYN without ACK and a SYN-ACK have been seen on the same
    key; that needs three extreme places, so the aggregation is partial before the shuffle and a hot key is no problem.
    """
    f = flags("tcp_flags")
    syn = F.min(F.when(f["syn"] & ~f["ack"], F.col("seq")))
    both = F.min(F.when(f["syn"] & f["ack"], F.col("seq")))
    ack = F.max(F.when(f["ack"], F.col("seq")))
    done = syn.isNotNull() & both.isNotNull() & ack.isNotNull() & (ack >= F.greatest(syn, both))
    out = packets.groupBy(*KEY, *(extra or [])).agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("last_time"),
        F.sum("length").alias("bytes_sent"),
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(done, F.lit(False)).alias("handshake_complete"),
        F.coalesce(F.bool_or(f["syn"] & (f["fin"] | f["rst"])), F.lit(False)).alias("protocol_violation"),
    )
    return out.withColumns(
        {
            "proto": protocol_name("proto_num"),
            "bytes_recv": F.lit(0).cast("long"),
            "request_count": F.greatest(F.lit(1).cast("long"), F.floor(F.col("packets") / 3).cast("long")),
            "user_agent": F.lit("pcap"),
            "country_code": F.lit("UNKNOWN"),
            "response_status": F.lit(0),
        }
    )


def split_idle(packets: DataFrame, idle: float = 60.0) -> DataFrame:
    """packets with part: a new flow begins after more than `idle` seconds without a packet of its key."""
    order = Window.partitionBy(*KEY).orderBy("ts", "seq")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(order) > idle, F.lit(False))
    return packets.withColumn("gap_", gap.cast("int")).withColumn("part", F.sum("gap_").over(order)).drop("gap_")


def early_fin(packets: DataFrame) -> DataFrame:
    """(key, early): a FIN before the handshake was complete, the live path's further violation."""
    f = flags("tcp_flags")
    fin = F.min(F.when(f["fin"], F.col("seq")))
    syn = F.min(F.when(f["syn"] & ~f["ack"], F.col("seq")))
    both = F.min(F.when(f["syn"] & f["ack"], F.col("seq")))
    placed = packets.groupBy(*KEY).agg(fin.alias("fin_"), F.greatest(syn, both).alias("seen_"), syn.alias("syn_"), both.alias("both_"))
    after = packets.join(placed, KEY).filter(flags("tcp_flags")["ack"] & (F.col("seq") >= F.col("seen_")) & F.col("syn_").isNotNull() & F.col("both_").isNotNull()).groupBy(*KEY).agg(F.min("seq").alias("done_"))
    return placed.join(after, KEY, "left").select(*KEY, F.coalesce(F.col("fin_").isNotNull() & (F.col("done_").isNull() | (F.col("fin_") < F.col("done_"))), F.lit(False)).alias("early"))


def to_live_flows(packets: DataFrame) -> DataFrame:
    """to_flows with the live path's further violation."""
    flows = to_flows(packets).join(early_fin(packets), KEY)
    return flows.withColumn("protocol_violation", F.col("protocol_violation") | F.col("early")).drop("early")


def overlapping_windows(flows: DataFrame, dt: float) -> DataFrame:
    """flows with wid, once for each window that [start_time, last_time] touches: a generated range, not a range join."""
    first, last = F.floor(F.col("start_time") / dt).cast("long"), F.floor(F.col("last_time") / dt).cast("long")
    return flows.withColumn("wid", F.explode(F.sequence(first, F.greatest(first, last))))
