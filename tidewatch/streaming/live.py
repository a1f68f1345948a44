"""The detector on streams.

windows_query gives the rows of closed windows exactly, through the batch's aggregates, and again where late flows reopen one; streaming.detector
takes them to scores and the response.  window_features gives those features that one watermarked tumbling-window aggregate can give, at once; it
drops flows later than the watermark.  The state scans here are keyed operators with state for series that come from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.config import FEATURES, Settings
from tidewatch.functions.scalars import duration, is_tcp, window_id
from tidewatch.operators import features
from tidewatch.operators.mitigate import Responder
from tidewatch.operators.scan import Baseline
from tidewatch.schema import FLOW
from tidewatch.storage import stored


def read_flow_stream(spark, folder: str, schema=None) -> DataFrame:
    """Flows of JSON-lines files that appear in a folder."""
    return spark.readStream.schema(schema or T.StructType([*FLOW.fields, T.StructField("stream_id", T.StringType())])).json(folder)


def window_features(flows: DataFrame, s: Settings, late: str = "10 seconds") -> DataFrame:
    """Streaming features of each closed window that need one aggregation (append mode): counts, rates, ratios, durations."""
    timed = flows.withColumn("event_ts", F.timestamp_micros((F.col("start_time") * 1e6).cast("long"))).withColumn("dur", duration())
    by = timed.withWatermark("event_ts", late).groupBy("stream_id", F.window("event_ts", f"{int(s.dt * 1e6)} microseconds").alias("w"))
    out = by.agg(
        F.count(F.lit(1)).alias("n_flows"),
        (F.sum("request_count") / s.dt).alias("request_rate"),
        F.avg(F.col("handshake_complete").cast("double")).alias("handshake_completion_ratio"),
        F.avg("dur").alias("mean_connection_duration"),
        (F.count_if(F.col("response_status") >= 400) / F.greatest(F.sum("request_count"), F.lit(1))).alias("backend_error_rate"),
        (F.count_if(is_tcp("proto")) / F.count(F.lit(1))).alias("protocol_frequency_ratio"),
        F.approx_count_distinct("src_ip").alias("unique_source_count"),
    )
    wid = F.floor(F.unix_micros("w.start") / F.lit(int(s.dt * 1e6))).cast("long")
    return out.select("stream_id", wid.alias("wid"), *[c for c in out.columns if c not in ("stream_id", "w")])


STATE = "mean double, variance double, n long, accumulator double"
SCANNED = "stream_id string, feature string, wid long, value double, z double, accumulator double, confirmed boolean"


def scan_stream(long: DataFrame, s: Settings) -> DataFrame:
    """The deviation scan on a stream of (stream_id, feature, wid, value): pre-update z, update, leaky accumulator.

    State is four numbers a series.  Rows of one trigger are ordered by window before they are taken.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, var, n, acc = state.get if state.exists else (0.0, 1.0, 0, 0.0)
        base = Baseline(s, {0: (mean, var, n)} if n else None, (mean, var, n) if n else None)
        rows = pd.concat(list(frames)).sort_values("wid")
        out = []
        for wid, x in zip(rows["wid"].tolist(), rows["value"].tolist(), strict=True):
            z = base.z(x, 0)
            base.update(x, 0)
            acc = acc + (abs(z) - s.tau_z) if abs(z) > s.tau_z else acc * s.decay
            out.append((*key, wid, x, z, acc, acc > s.theta))
        state.update((*base.contexts[0], acc))
        yield pd.DataFrame(out, columns=["stream_id", "feature", "wid", "value", "z", "accumulator", "confirmed"])

    return long.groupBy("stream_id", "feature").applyInPandasWithState(step, SCANNED, STATE, "append", GroupStateTimeout.NoTimeout)


def respond_stream(scored: DataFrame, s: Settings) -> DataFrame:
    """The mitigation state machine on a stream of (stream_id, wid, score)."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Responder(s)
        if state.exists:
            tier, *times = state.get
            machine.tier = tier
            machine.since1, machine.calm3, machine.calm = (None if t < 0 else t for t in times)
        rows = pd.concat(list(frames)).sort_values("wid")
        out = [(*key, wid, x, machine.step(wid * s.dt, x)) for wid, x in zip(rows["wid"].tolist(), rows["score"].tolist(), strict=True)]
        state.update((machine.tier, *(-1.0 if t is None else float(t) for t in (machine.since1, machine.calm3, machine.calm))))
        yield pd.DataFrame(out, columns=["stream_id", "wid", "score", "current_tier"])

    return scored.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, wid long, score double, current_tier int", "tier int, since1 double, calm3 double, calm double", "append", GroupStateTimeout.NoTimeout)


def live_flows(packets: DataFrame, idle: float = 1.0, late: str = "5 seconds") -> DataFrame:
    """Flows of a packet stream: a key's packets until it has been silent for `idle` seconds (session windows, append mode)."""
    timed = packets.withColumn("event_ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("event_ts", late)
    by = timed.groupBy("src_ip", "sport", "dst_ip", "dport", "proto_num", F.session_window("event_ts", f"{int(idle * 1e6)} microseconds").alias("w"))
    return by.agg(F.min("ts").alias("start_time"), F.max("ts").alias("last_time"), F.sum("length").alias("bytes_sent"), F.count(F.lit(1)).alias("packets")).drop("w")


_KEY = ["src_ip", "sport", "dst_ip", "dport", "proto_num"]
_RECORD = "start_time double, last_time double, bytes_sent long, packets long, handshake_complete boolean, protocol_violation boolean"
FLUSHED = f"src_ip string, sport int, dst_ip string, dport int, proto_num int, {_RECORD}, request_count long, flushed_at double"


def flush_stream(packets: DataFrame, late: str = "5 seconds", idle: float = 1.0, every: float = 5.0, drop: float = 60.0) -> DataFrame:
    """Records of live flows so far, from a packet stream (ts, the key, tcp_flags, length).

    A flow's record comes out `every` seconds while packets come, and once it has been idle for `idle` seconds; after
    `drop` idle seconds it is forgotten.  Handshake and violations (SYN with FIN or RST, FIN before the handshake) follow
    the packets in order of time.  State is one record a key; timers run on event time.
    """
    timed = packets.withColumn("event_ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("event_ts", late)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        start, last, size, n, done, bad, syn, both, sent = state.get if state.exists else (None, -1.0, 0, 0, False, False, False, False, None)

        def emit(at: float) -> None:
            out.append((*key, start, last, size, n, done, bad, max(1, n // 3), at))

        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() / 1000
            if now - last > drop:
                state.remove()
                return
            emit(now)
            sent = now
        else:
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for t, flags, length in zip(rows["ts"].tolist(), rows["tcp_flags"].tolist(), rows["length"].tolist(), strict=True):
                if start is None:
                    start = sent = t
                last, size, n = max(last, t), size + length, n + 1
                f, s, r, a = flags & 1, flags & 2, flags & 4, flags & 16
                syn, both = syn or bool(s and not a), both or bool(s and a)
                done = done or bool(a and not s and syn and both)
                bad = bad or bool(s and (f or r)) or bool(f and not done)
                if t - sent >= every:
                    emit(t)
                    sent = t
        state.update((start, last, size, n, done, bad, syn, both, sent))
        # Idle first, then forgotten; a timer must lie after the watermark.
        wait = last + (idle if sent <= last else drop)
        state.setTimeoutTimestamp(max(int(wait * 1000), state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in FLUSHED.split(", ")])

    held = f"{_RECORD}, syn boolean, both boolean, sent double"
    return timed.groupBy(*_KEY).applyInPandasWithState(step, FLUSHED, held, "append", GroupStateTimeout.EventTimeTimeout)


#: Windows of one folder of staged flows.
SLOT = 720


def window_schema(spark, s: Settings) -> T.StructType:
    """Of the rows that windows_query writes."""
    flows = spark.createDataFrame([], T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("wid", T.LongType()), T.StructField("flow_seq", T.LongType()), *FLOW.fields]))
    return T.StructType([*features.windows(flows, s).schema.fields, T.StructField("batch", T.LongType())])


def windows_query(flows: DataFrame, folder: str, s: Settings, checkpoint: str, late: float = 10.0, **trigger):
    """The started query that writes a row of each closed window (features.windows) to {folder}/windows, exactly as the batch gives it.

    Flows of a micro-batch are staged by slots of windows; a window is closed once a flow of any stream has come that starts `late` seconds after its
    end.  What has just closed is read back (its slots only) and goes through the batch's aggregates.  Flows that come later reopen their window: it is
    gathered again with all its flows and written again, under the number of the batch; the highest batch of a window is the whole
    one.  Every folder is written by batch, so a batch that runs again replaces what it wrote.  What a batch needs to know of earlier ones is
    in one small table of the batch before: the clock, and each stream's last window with its entropy.

    {folder}/features has the features of windows when they first closed.
    """
    spark = flows.sparkSession

    def told(name: str, number: int) -> DataFrame | None:
        """A folder's rows of one batch; None if there are none."""
        try:
            return spark.read.parquet(f"{folder}/{name}/batch={number}")
        except AnalysisException:
            return None

    def staged(slots: list[int]) -> DataFrame | None:
        paths = [f"{folder}/flows/slot={k}" for k in slots]
        there = spark._jvm.org.apache.hadoop.fs.Path
        there = [p for p in paths if there(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(there(p))]
        return spark.read.option("basePath", f"{folder}/flows").parquet(*there) if there else None

    def close(batch: DataFrame, number: int) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch = batch.withColumn("wid", window_id("start_time", s.dt)).withColumn("slot", F.floor(F.col("wid") / SLOT))
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(f"{folder}/flows")
        before = told("progress", number - 1)
        latest, upto = before.first() if before is not None else (None, None)
        now = max((x for x in (batch.agg(F.max("start_time")).first()[0], latest) if x is not None), default=None)
        if now is None:
            return
        closed = int((now - late) // s.dt) - 1
        closed = closed if upto is None else max(closed, upto)
        put(spark.createDataFrame([(float(now), closed)], "latest double, upto long"), "progress")
        again = stored(batch.filter(F.lit(upto is not None) & (F.col("wid") <= (upto if upto is not None else 0))).select("stream_id", "wid", "slot").distinct(), "reopened")
        late_slots = sorted(r[0] for r in again.select("slot").distinct().collect())  # slots of one micro-batch
        earliest, newest = again.agg(F.min("wid"), F.max("wid")).first()
        tails = told("tails", number - 1)
        rows = staged(list(range((upto if upto is not None else closed) // SLOT, closed // SLOT + 1)) if upto is not None else _slots(spark, folder, closed // SLOT))
        found = None
        if rows is not None:
            rows = rows.filter((F.col("batch") <= number) & (F.col("wid") <= closed))
            found = stored(features.windows((rows.filter(F.col("wid") > upto) if upto is not None else rows).drop("batch", "slot"), s), "closed-windows")
            # The shift of a stream's first new window is from its last one before.
            fresh = found
            if tails is not None:
                shift = F.abs(F.col("geographic_entropy") - F.coalesce(F.lag("geographic_entropy").over(Window.partitionBy("stream_id").orderBy("wid")), F.col("h_"), F.lit(0.0)))
                fresh = found.join(tails.select("stream_id", F.col("h").alias("h_")), "stream_id", "left").withColumn("geo_distribution_shift_rate", shift).drop("h_")
            put(fresh.select(*found.columns[:2], "n_flows", *FEATURES), "features")
            last = found.groupBy("stream_id").agg(F.max("wid").alias("wid"), F.max_by("geographic_entropy", "wid").alias("h"))
            merged = last if tails is None else last.unionByName(tails).groupBy("stream_id").agg(F.max("wid").alias("wid"), F.max_by("h", "wid").alias("h"))
            put(merged, "tails")
            found = fresh
        elif tails is not None:
            put(tails, "tails")
        reopened = staged(late_slots) if late_slots else None
        if reopened is not None:
            # Between the reopened windows' ends, so that files and row groups of others aren't read.
            whole = reopened.filter((F.col("batch") <= number) & F.col("wid").between(earliest, newest)).drop("batch", "slot").join(again.drop("slot"), ["stream_id", "wid"], "left_semi")
            whole = features.windows(whole, s)
            found = whole if found is None else found.unionByName(whole)
        if found is not None:
            put(found, "windows")

    return flows.writeStream.foreachBatch(close).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{s.dt} seconds"})).start()


def _slots(spark, folder: str, most: int) -> list[int]:
    """Slots of staged flows up to one, of the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/flows")
    names = [x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(k for n in names if n.startswith("slot=") and (k := int(n[5:])) <= most)


#: The query under its older name.
features_query = windows_query
