"""The flow record and its defaults."""

from __future__ import annotations

from pyspark.sql import types as T

#: (column, type, default) of a flow, in order.
FLOW_FIELDS = (
    ("src_ip", T.StringType(), "0.0.0.0"),
    ("dst_ip", T.StringType(), "0.0.0.0"),
    ("sport", T.IntegerType(), 0),
    ("dport", T.IntegerType(), 80),
    ("proto", T.StringType(), "TCP"),
    ("start_time", T.DoubleType(), 0.0),
    ("last_time", T.DoubleType(), 0.0),
    ("bytes_sent", T.LongType(), 0),
    ("bytes_recv", T.LongType(), 0),
    ("packets", T.LongType(), 1),
    ("handshake_complete", T.BooleanType(), True),
    ("request_count", T.LongType(), 1),
    ("protocol_violation", T.BooleanType(), False),
    ("user_agent", T.StringType(), "unknown"),
    ("country_code", T.StringType(), "UNKNOWN"),
    ("response_status", T.IntegerType(), 200),
)
FLOW = T.StructType([T.StructField(n, t) for n, t, _ in FLOW_FIELDS])
FLOW_COLUMNS = [n for n, _, _ in FLOW_FIELDS]
DEFAULTS = {n: d for n, _, d in FLOW_FIELDS}

PACKET = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("proto_num", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("length", T.LongType()),
    ]
)
