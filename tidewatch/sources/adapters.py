"""Flow records projected from event and order tables, so that the detector runs on any of them.

Each is a pure projection: columns and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Country codes that event keys are mapped to.
COUNTRIES = tuple(f"C{k:02d}" for k in range(20))
#: In hours HOURS of every CYCLE hours each event is COPIES flows: a deterministic burst.
CYCLE, HOURS, COPIES = 60, (20, 22), 12
STREAMS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def event_flows(spark: SparkSession, sf_dir: str, dt: int = 3600) -> DataFrame:
    """events as flows of STREAMS streams, tumbled into windows of dt seconds."""
    e = table(spark, sf_dir, "events").select("event_id", micros().alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumn("wid", F.expr(f"us div {dt * 1_000_000}"))
    e = e.withColumn("copies", F.when(F.pmod("wid", F.lit(CYCLE)).between(*HOURS), COPIES).otherwise(1))
    e = e.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    text = lambda c: c.cast("string")
    return e.select(
        F.concat(F.lit("s"), text(F.col("user_id") % STREAMS)).alias("stream_id"),
        "wid",
        (F.col("event_id") * 100 + F.col("c")).alias("flow_seq"),
        F.concat(F.lit("10."), text(F.col("user_id") % 4), F.lit("."), text(F.expr("user_id div 254")), F.lit("."), text((F.col("user_id") + F.col("c") % 3 * 17) % 254 + 1)).alias("src_ip"),
        F.concat(F.lit("10.0.0."), text(F.col("k") % 4)).alias("dst_ip"),
        (F.lit(1024) + F.col("k")).alias("sport"),
        F.lit(80).alias("dport"),
        F.when(F.col("k") % 10 == 0, "UDP").otherwise("TCP").alias("proto"),
        (F.col("us") / 1e6).alias("start_time"),
        (F.col("us") / 1e6 + F.col("value")).alias("last_time"),
        F.floor(F.col("value") * 10).cast("long").alias("bytes_sent"),
        F.floor(F.col("value") * 30).cast("long").alias("bytes_recv"),
        (F.col("event_id") % 7 + 1).alias("packets"),
        ((F.col("event_type") != "error") & (F.col("c") == 0)).alias("handshake_complete"),
        (F.col("event_id") % 5 + 1).alias("request_count"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("protocol_violation"),
        F.col("event_type").alias("user_agent"),
        F.element_at(F.array(*map(F.lit, COUNTRIES)), F.col("k") % 20 + 1).alias("country_code"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("response_status"),
    )


def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as flows: supplier as source, month as window, market segment as stream."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    j = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text = lambda c: c.cast("string")
    return j.select(
        F.col("c_mktsegment").alias("stream_id"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("wid"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("flow_seq"),
        F.concat(F.lit("10.1."), text(F.expr("l_suppkey div 254")), F.lit("."), text(F.col("l_suppkey") % 254)).alias("src_ip"),
        F.col("n_name").alias("country_code"),
        F.lit("TCP").alias("proto"),
        (micros("l_shipdate") / 1e6).alias("start_time"),
        (micros("l_shipdate") / 1e6 + F.col("l_quantity")).alias("last_time"),
        F.floor("l_extendedprice").cast("long").alias("bytes_sent"),
        (F.col("l_returnflag") != "R").alias("handshake_complete"),
        F.col("l_quantity").cast("long").alias("request_count"),
        (F.col("l_linestatus") == "F").alias("protocol_violation"),
        F.col("l_returnflag").alias("user_agent"),
        F.when(F.col("l_returnflag") == "R", 500).otherwise(200).alias("response_status"),
    )
