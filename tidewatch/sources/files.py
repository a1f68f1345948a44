"""File sources of flows: CSV flow exports, JSON, packet captures; YAML settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.functions import scalars
from tidewatch.operators import capture
from tidewatch.schema import FLOW, FLOW_COLUMNS
from tidewatch.sources.capture import CaptureSource
from tidewatch.storage import stored

# CSV header -> field.
CSV_COLUMNS = {
    "Source IP": "src_ip",
    "Destination IP": "dst_ip",
    "Source Port": "sport",
    "Destination Port": "dport",
    "Protocol": "protocol",
    "Timestamp": "timestamp",
    "Flow Duration": "duration",
    "Total Fwd Packets": "fwd",
    "Total Backward Packets": "bwd",
    "Total Length of Fwd Packets": "fwd_bytes",
    "Total Length of Bwd Packets": "bwd_bytes",
    "Flow Packets/s": "packet_rate",
    "Flow Bytes/s": "byte_rate",
    "Label": "label",
}


def _below(path: str):
    """A file's name below the folder read (so equal names in two folders stay apart); its last part for a single file."""
    base = path.split("*")[0].rstrip("/")
    file = F.url_decode(F.replace(F.col("file_"), F.lit("+"), F.lit("%2B")))  # names come encoded as in a URI
    at = F.instr(file, F.lit(base))
    rest = F.substring(file, at + F.lit(len(base) + 1), F.lit(1 << 30))
    return F.when((at > 0) & (rest != ""), rest).when(at > 0, F.element_at(F.split(file, "/"), -1)).otherwise(file)


def read_csv_flows(spark: SparkSession, path: str, dt: float = 5.0) -> DataFrame:
    """Flows of CSV exports: one stream a file, windows of dt seconds, label kept.

    Headers may have spaces around them; missing columns read as empty.  Rows that come late join their
    window (all rows of a window are one group whatever their order in the file).
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c.strip(): c for c in raw.columns}
    src = raw.select(F.input_file_name().alias("file_"), F.monotonically_increasing_id().alias("flow_seq"), *[(F.col(f"`{names[h]}`") if h in names else F.lit(None).cast("string")).alias(f) for h, f in CSV_COLUMNS.items()])
    n = lambda c: F.greatest(scalars.safe_long(c), F.lit(0).cast("long"))
    proto = scalars.protocol_name(scalars.safe_long("protocol"))
    label = F.upper(F.trim(F.coalesce("label", F.lit("BENIGN"))))
    src = src.withColumns({"start_": scalars.parse_time("timestamp"), "proto_": proto, "label_": label})
    ip = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("0.0.0.0"))
    out = src.select(
        _below(path).alias("stream_id"),
        "flow_seq",
        ip("src_ip").alias("src_ip"),
        ip("dst_ip").alias("dst_ip"),
        scalars.safe_long("sport").cast("int").alias("sport"),
        scalars.safe_long("dport").cast("int").alias("dport"),
        F.col("proto_").alias("proto"),
        F.col("start_").alias("start_time"),
        (F.col("start_") + F.greatest(F.nanvl(scalars.safe_double("duration"), F.lit(0.0)) / 1e6, F.lit(0.0))).alias("last_time"),
        n("fwd_bytes").alias("bytes_sent"),
        n("bwd_bytes").alias("bytes_recv"),
        F.greatest(n("fwd") + n("bwd"), F.lit(1).cast("long")).alias("packets"),
        ((F.col("proto_") == "TCP") & (F.nanvl(scalars.safe_double("packet_rate"), F.lit(0.0)) > 0) & (n("bwd_bytes") > 0)).alias("handshake_complete"),
        scalars.requests_of(n("fwd")).alias("request_count"),
        F.lit(False).alias("protocol_violation"),
        F.lit("unknown").alias("user_agent"),
        scalars.country_of(ip("src_ip")).alias("country_code"),
        F.when(F.col("label_") == "BENIGN", 200).otherwise(0).alias("response_status"),
        F.col("label_").alias("label"),
    )
    return out.withColumn("wid", scalars.window_id("start_time", dt))


def read_json_flows(spark: SparkSession, path: str, dt: float = 5.0, stream: str | None = None) -> DataFrame:
    """Flows of JSON files, a stream a file (or all one stream of a given name, by file and place): a list of flows or {"flows": [...]}; missing or null keys get defaults; other shapes raise ValueError."""
    text = spark.read.text(path, wholetext=True).withColumn("file_", F.input_file_name())
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.flows"))
    items = F.from_json(listed, _list_of_flows())
    parsed = text.select(_below(path).alias("name_"), F.ltrim("value").startswith("[").alias("list_"), F.get_json_object("value", "$.flows").isNotNull().alias("object_"), items.alias("items"))
    if parsed.filter("NOT (list_ OR object_)").head(1):
        raise ValueError("JSON must be a list of flows or an object with a list 'flows'")
    rows = parsed.select("name_", F.posexplode("items").alias("flow_seq", "f")).select("name_", "flow_seq", "f.*")
    return rows.select((F.col("name_") if stream is None else F.lit(stream)).alias("stream_id"), F.col("flow_seq").cast("long").alias("flow_seq"), *scalars.filled(FLOW_COLUMNS)).withColumn("wid", scalars.window_id("start_time", dt))


def _list_of_flows():
    from pyspark.sql import types as T

    return T.ArrayType(FLOW)


def read_packets(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(stream_id, seq, packet columns) of capture files: a stream a file, seq the packet's place in it; large files are parted (sources.capture)."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").options(**options).load(path)


def read_capture_flows(spark: SparkSession, path: str, dt: float = 5.0, idle: float = 60.0, **options: str) -> DataFrame:
    """Flows of capture files in the windows the packets themselves cut (operators.capture); flow_seq is the place of a flow's first packet."""
    flows = capture.flows(stored(read_packets(spark, path, **options), "packets"), dt, idle)
    return flows.select("stream_id", "wid", "flow_seq", *FLOW_COLUMNS)


def read_flows(spark: SparkSession, path: str, dt: float = 5.0) -> DataFrame:
    """By the file name's ending: .csv, .json, .pcap, .pcapng or .cap."""
    ending = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv_flows, "json": read_json_flows, "pcap": read_capture_flows, "pcapng": read_capture_flows, "cap": read_capture_flows}
    if ending not in readers:
        raise ValueError(f"no reader for .{ending}")
    return readers[ending](spark, path, dt)


def read_settings(path: str) -> dict:
    """A YAML mapping; empty if the file can't be read as one."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except Exception:
        return {}
    return found if isinstance(found, dict) else {}


def settings_of(folder: str) -> Settings:
    """Settings of a folder with detection_params.yaml and feature_weights.yaml; what is missing keeps its default."""
    return Settings.of(read_settings(f"{folder}/detection_params.yaml"), read_settings(f"{folder}/feature_weights.yaml"))
