"""Telemetry tables and their queries: events, scores, mitigation_log, baseline_snapshots.

Tables are Parquet by batch and day, so a query on recent times reads recent days only.  Small batches are merged by ``compact``, old days dropped by
``retain``; a manifest, replaced by a rename, says what readers read, so they see each row once whatever runs meanwhile.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "events": ("ts", "feature_id", "confidence", "event_type"),
    "scores": ("ts", "score"),
    "mitigation_log": ("ts", "tier", "score", "description"),
    "baseline_snapshots": ("ts", "feature_id", "mean", "variance"),
}
#: Beginning of the names of merged folders: batches to readers' eyes only once a manifest says so.
_MERGED = "batch=compacted-"

SCHEMAS = {
    "events": "ts double, feature_id string, confidence double, event_type string",
    "scores": "ts double, score double",
    "mitigation_log": "ts double, tier int, score double, description string",
    "baseline_snapshots": "ts double, feature_id string, mean double, variance double",
}


def _write(df: DataFrame, table: str, path: str, mode: str) -> None:
    kinds = dict(x.split(" ") for x in SCHEMAS[table].split(", "))
    df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in TABLES[table]]).withColumn("day", F.to_date(F.timestamp_seconds("ts"))).write.mode(mode).partitionBy("day").parquet(path)


def append(df: DataFrame, folder: str, table: str) -> None:
    """Append rows (the table's columns; more are dropped)."""
    _write(df, table, f"{folder}/{table}/batch=files", "append")


def append_stream(stream: DataFrame, folder: str, table: str, checkpoint: str, **trigger):
    """The started query that appends a stream's rows to a table; a batch run again after a failure replaces its own files."""
    write = lambda batch, number: _write(batch, table, f"{folder}/{table}/batch=stream{zlib.crc32(checkpoint.encode())}-{number}", "overwrite")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _manifest(spark: SparkSession, folder: str, table: str) -> tuple[int, dict]:
    """(number, what it says) of the newest manifest: compacted folders, batches that they hold, first day kept."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{folder}/{table}/_manifest") if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {"compacted": [], "absorbed": [], "since": None}
    text = spark.read.text(f"{folder}/{table}/_manifest/{max(numbers):09d}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _publish(spark: SparkSession, folder: str, table: str, number: int, said: dict) -> None:
    """Write a manifest whole and rename it to its number: readers see the one before or this one.  Fails if another wrote that number."""
    at = f"{folder}/{table}/_manifest"
    staged, fs = _fs(spark, f"{at}/.{uuid.uuid4().hex}")
    fs.mkdirs(staged.getParent())
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    target, _ = _fs(spark, f"{at}/{number:09d}.json")
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise RuntimeError(f"another compaction of {table} was first")


def _live(spark: SparkSession, folder: str, table: str, said: dict) -> list[str]:
    held = set(said["absorbed"])
    return [*said["compacted"], *(n for n in _names(spark, f"{folder}/{table}") if n.startswith("batch=") and not n.startswith(_MERGED) and n not in held)]


def _rows(spark: SparkSession, folder: str, table: str, names: list[str], said: dict) -> DataFrame:
    kinds = f"{SCHEMAS[table]}, batch string, day date"
    rows = spark.read.schema(kinds).option("basePath", f"{folder}/{table}").parquet(*[f"{folder}/{table}/{n}" for n in names]) if names else spark.createDataFrame([], kinds)
    return (rows.filter(F.col("day") >= F.lit(said["since"]).cast("date")) if said["since"] else rows).drop("batch")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of a table: compacted folders and the batches that came since, each once, from the first day kept."""
    _, said = _manifest(spark, folder, table)
    return _rows(spark, folder, table, _live(spark, folder, table, said), said).select(*TABLES[table])


def compact(spark: SparkSession, folder: str, table: str, file_rows: int = 1_000_000, most: int = 8) -> int:
    """Merge the batches that came since the last time into one folder with a file a day (or file_rows rows each); the number of batches merged.

    Readers go over at once, with the new manifest; batches that are absorbed stay for those who began before, until `clean`.  `batch=files`,
    to which append() adds, is moved aside first.  Once there are `most` compacted folders they are merged too.
    """
    number, said = _manifest(spark, folder, table)
    base = f"{folder}/{table}"
    names = [n for n in _live(spark, folder, table, said) if n not in said["compacted"]]
    if "batch=files" in names:
        aside = f"batch=files{uuid.uuid4().hex}"
        (old, fs), (new, _) = _fs(spark, f"{base}/batch=files"), _fs(spark, f"{base}/{aside}")
        fs.rename(old, new)
        names[names.index("batch=files")] = aside
    if not names:
        return 0
    merged = said["compacted"] if len(said["compacted"]) >= most else []
    rows = _rows(spark, folder, table, [*merged, *names], said)
    out = f"{_MERGED}{uuid.uuid4().hex}"
    counts = rows.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / file_rows).alias("files_"))
    dealt = rows.join(F.broadcast(counts), "day").withColumn("file_", F.pmod(F.xxhash64(*TABLES[table]), F.col("files_")))
    dealt.repartition("day", "file_").drop("files_", "file_").sortWithinPartitions("day", "ts").write.partitionBy("day").parquet(f"{base}/{out}")
    _publish(spark, folder, table, number + 1, said | {"compacted": [*(n for n in said["compacted"] if n not in merged), out], "absorbed": [*said["absorbed"], *names]})
    return len(names)


def retain(spark: SparkSession, folder: str, table: str, since: str) -> None:
    """Keep days from `since` (yyyy-mm-dd) on: readers drop older partitions at once, `clean` removes their files."""
    number, said = _manifest(spark, folder, table)
    _publish(spark, folder, table, number + 1, said | {"since": max(since, said["since"] or since)})


def clean(spark: SparkSession, folder: str, table: str) -> None:
    """Remove what the newest manifest doesn't read: absorbed batches, merged folders, days before the first one kept.  Run it once no reader of earlier manifests is left.

    Names of a stream's last absorbed batches stay in the manifest, as the last one may run again after a failure."""
    number, said = _manifest(spark, folder, table)
    base = f"{folder}/{table}"
    for n in _names(spark, base):
        p, fs = _fs(spark, f"{base}/{n}")
        if n in said["absorbed"] or n.startswith(_MERGED) and n not in said["compacted"]:
            fs.delete(p, True)
        elif said["since"] and n != "_manifest":
            for day in _names(spark, f"{base}/{n}"):
                if day.startswith("day=") and day[4:] < said["since"]:
                    fs.delete(_fs(spark, f"{base}/{n}/{day}")[0], True)
    streams: dict[str, list[int]] = {}
    for n in said["absorbed"]:
        if n.startswith("batch=stream"):
            streams.setdefault(n.rpartition("-")[0], []).append(int(n.rpartition("-")[2]))
    kept = [f"{stream}-{k}" for stream, numbers in streams.items() for k in sorted(numbers)[-100:]]
    if number and len(kept) < len(said["absorbed"]):
        _publish(spark, folder, table, number + 1, said | {"absorbed": kept})


def recent_scores(scores: DataFrame, since: float) -> DataFrame:
    return scores.filter(F.col("ts") > since).select("ts", "score").orderBy("ts", "score")


def event_count(events: DataFrame, since: float) -> DataFrame:
    return events.filter(F.col("ts") > since).agg(F.count(F.lit(1)).alias("n"))


def result_lines(detected: DataFrame, scored: DataFrame, tiers: DataFrame, dt: float) -> DataFrame:
    """(stream_id, wid, line): a JSON line a window with its time (ISO, UTC), worst feature, score and tier, rounded to 3 places."""
    worst = F.max_by(F.struct("feature", "z", "accumulator"), F.struct(F.round("accumulator", 6), -F.col("ord")))
    by = detected.groupBy("stream_id", "wid").agg(worst.alias("w"))
    by = by.join(scored.select("stream_id", "wid", "score"), ["stream_id", "wid"]).join(tiers.select("stream_id", "wid", "tier"), ["stream_id", "wid"])
    at = F.date_format(F.timestamp_seconds(F.col("wid") * F.lit(dt)), "yyyy-MM-dd'T'HH:mm:ss")
    entry = F.struct(at.alias("timestamp"), F.col("w.feature").alias("feature"), F.round("w.z", 3).alias("z_score"), F.round("w.accumulator", 3).alias("accumulator"), F.round("score", 3).alias("correlation_score"), F.col("tier").alias("mitigation_tier"))
    return by.select("stream_id", "wid", F.to_json(entry).alias("line"))


def write_results(runs: DataFrame, path: str) -> None:
    """Run results as JSON without the score series, of which the length stays."""
    out = runs.withColumn("n_scores", F.size("score_series")).drop("score_series") if "score_series" in runs.columns else runs
    out.write.mode("overwrite").json(path)
